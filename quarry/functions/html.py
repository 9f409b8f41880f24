"""HTML as Columns: tags with quoted attributes, character references, attributes.

Everything is regular expressions and higher-order functions.  Character references
are those of the HTML standard (from Python's own table of them): named ones, with
or without their semicolon where the standard allows that, and numeric ones.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import col_

#: Inside of a start tag: a quoted value hides a ``>``.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
COMMENT = r"(?s)<!--(?:>|->|.*?(?:--!?>|\z))"
TAG = rf"<[a-zA-Z]{ATTRIBUTES}(?:>|\z)|<[/!?][^>]*+(?:>|\z)"
#: What stands for something taken out: a tag that says nothing.
CUT = "<!>"
#: name, value (quoted or not; may be missing).
ATTRIBUTE = r"""([^\s=>/"'][^\s=>/]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*))?"""
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"

_WHOLE = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")}, ensure_ascii=False)
#: Names that need no semicolon, longest first.
_OPEN = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
_OPEN_TEXT = json.dumps({name: html5[name] for name in _OPEN}, ensure_ascii=False)


def _c1() -> dict[int, str]:
    """What numbers of control characters stand for: the code page that authors meant."""
    out = {0: "�", 0x0D: "\r"}
    for n in range(0x80, 0xA0):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[n] = chr(n)
    return out


def _table(text: str) -> Column:
    """A map from a JSON object; a constant of the plan."""
    return F.from_json(F.lit(text), "map<string,string>")


def _numeric(reference: Column) -> Column:
    """The character of ``#digits`` or ``#xdigits`` (without ``&`` and ``;``)."""
    hexadecimal = reference.rlike("^#[xX]")
    digits = F.regexp_replace(reference, "^#[xX]?0*", "")
    known = F.length(digits) <= F.when(hexadecimal, 6).otherwise(7)
    code = F.when(known & (digits != ""), F.conv(digits, 10, 10).cast("bigint")).when(digits == "", 0)
    from_hex = F.when(known & (digits != ""), F.conv(digits, 16, 10).cast("bigint")).when(digits == "", 0)
    n = F.coalesce(F.when(hexadecimal, from_hex).otherwise(code), F.lit(0x110000))
    meant = F.create_map(*(x for k, v in _c1().items() for x in (F.lit(k).cast("bigint"), F.lit(v))))
    never = n.between(1, 8) | n.isin(0xB) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000).isin(0xFFFE, 0xFFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (F.when(F.element_at(meant, n).isNotNull(), F.element_at(meant, n))
            .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(never, "").otherwise(text))


def unescape(c) -> Column:
    """Text with its character references read; what is none stays as it is."""
    text = col_(c)

    def read(part, reference):
        body = F.regexp_replace(reference, "^&|;$", "")
        whole = F.when(F.endswith(reference, F.lit(";")), F.element_at(_table(_WHOLE), body))
        name = F.regexp_extract(body, f"^({'|'.join(_OPEN)})", 1)
        begins = F.when(name != "", F.concat(F.element_at(_table(_OPEN_TEXT), name), F.substring(reference, F.length(name) + 2, F.length(reference))))
        said = F.when(F.startswith(body, F.lit("#")), _numeric(body)).otherwise(F.coalesce(whole, begins, reference))
        return F.concat(part, F.when(reference.isNull(), "").otherwise(said))

    parts, references = F.split(text, REFERENCE), F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), 1)
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.zip_with(parts, references, read), "")).otherwise(text)


def attribute(tag_inside: Column, name: str) -> Column:
    """The value of an attribute of a start tag (its last, if there are several); NULL if it is not there."""
    names, values = (F.regexp_extract_all(tag_inside, F.lit(ATTRIBUTE), F.lit(i)) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: F.lower(p["n"]) == name)
    value = F.try_element_at(pairs, F.lit(-1))["v"]
    quoted = F.startswith(value, F.lit('"')) | F.startswith(value, F.lit("'"))
    return unescape(F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value))
