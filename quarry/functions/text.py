"""Column expressions for text that mirror Python string semantics.

Python's ``str.split()`` / ``str.strip()`` and ``re``'s ``\\s`` use the Unicode
whitespace set, Java regex ``\\s`` and RE2 ``\\s`` are ASCII only.  We spell the
set out so Spark (Java regex) and the DuckDB oracle (RE2) agree with Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace (str.isspace()).
PY_WS_CLASS = (
    "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
PY_WS_RUN = PY_WS_CLASS + "+"
# The same set as a string of characters, for btrim (scans only the two ends).
PY_WS_CODEPOINTS = [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PY_WS_CHARS = "".join(chr(c) for c in PY_WS_CODEPOINTS)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_text(c) -> Column:
    """Text as Python decodes it with ``errors="replace"``: each sequence of bytes that is no
    UTF-8, as far as it could have been the beginning of a character, is one U+FFFD."""
    return F.make_valid_utf8(col_(c))


def py_split(c) -> Column:
    """``s.split()``: split on whitespace runs, empty pieces dropped.

    Every whitespace character is first mapped to a space (``translate``, one
    pass) so the split runs on a single literal character, which Java splits
    without the regex engine."""
    spaced = F.translate(col_(c), PY_WS_CHARS, " " * len(PY_WS_CHARS))
    return F.filter(F.split(spaced, " "), lambda x: x != F.lit(""))


def py_strip(c) -> Column:
    """``s.strip()`` with the Unicode whitespace set (btrim: only the ends are read)."""
    return F.btrim(col_(c), F.lit(PY_WS_CHARS))


def is_blank(c) -> Column:
    """True for NULL, empty or all-whitespace text (Python ``not s.strip()``)."""
    c = col_(c)
    return c.isNull() | (py_strip(c) == F.lit(""))


def term_set(c) -> Column:
    """``set(s.lower().split())`` as a distinct array."""
    return F.array_distinct(py_split(F.lower(col_(c))))


def md5_unit(c) -> Column:
    """Deterministic uniform in [0, 1) from the first 8 hex digits of md5.

    The same expression exists in DuckDB, so seeded choices are oracle-checkable.
    """
    return F.conv(F.substring(F.md5(col_(c).cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def md5_int(c, modulo: int) -> Column:
    """Deterministic integer in [0, modulo) from md5 (first 8 hex digits)."""
    return (F.conv(F.substring(F.md5(col_(c).cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(modulo))


def map_with_scalar(arr, scalar, fn) -> Column:
    """``transform(arr, x -> fn(x, scalar))`` with ``scalar`` evaluated once per row.

    Catalyst does not hoist expressions out of lambda bodies: a per-row scalar
    written inside the lambda is recomputed for every element.  Repeating it
    into an array and zipping keeps the work linear.
    """
    arr = col_(arr)
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)
