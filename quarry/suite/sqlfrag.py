"""SQL fragments for the DuckDB oracle queries.

The oracle is written independently in SQL; these helpers only spell the same
Python-string rules (whitespace set, strip, split) in DuckDB syntax.
"""

from __future__ import annotations

from quarry.functions.text import PY_WS_CLASS, PY_WS_CODEPOINTS

WS = PY_WS_CLASS
WS_RUN = PY_WS_CLASS + "+"


WS_CHARS_SQL = "(" + " || ".join(f"chr({c})" for c in PY_WS_CODEPOINTS) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS_SQL})"


def split_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_RUN}'), lambda t: t <> '')"


def term_set(x: str) -> str:
    return f"list_distinct({split_ws(f'lower({x})')})"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def md5_unit(x: str) -> str:
    return f"(('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0)"


def md5_int(x: str, m: int) -> str:
    return f"((('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8))::BIGINT) % {m})"


def chunk_ctes(src: str, cols: str, size: int, overlap: int, name: str = "chunks") -> str:
    """CTEs ``{name}_f`` and ``{name}`` (cols, chunk_index, content) from table/CTE ``src``.

    The chunker rule as a list_reduce over the sentence list of each text.
    """
    tail = "acc.cur" if overlap == 0 else f"right(acc.cur, {overlap})"
    sentences = f"string_split(regexp_replace(text, '([.!?]){WS_RUN}', '\\1' || chr(1), 'g'), chr(1))"
    fold = (
        f"list_reduce({sentences}, lambda acc, s: CASE "
        f"WHEN length(acc.cur) + length(s) > {size} AND acc.cur <> '' THEN "
        f"{{'out': list_append(acc.out, {strip('acc.cur')}), 'cur': {tail} || ' ' || s}} "
        f"WHEN length(acc.cur) + length(s) > {size} THEN "
        f"{{'out': list_append(acc.out, left(s, {size})), 'cur': substr(s, {size - overlap + 1})}} "
        f"ELSE {{'out': acc.out, 'cur': CASE WHEN acc.cur <> '' THEN acc.cur || ' ' || s ELSE s END}} END, "
        f"{{'out': []::VARCHAR[], 'cur': ''}})"
    )
    return (
        f"{name}_f AS (SELECT {cols}, text, CASE WHEN length(text) <= {size} THEN NULL ELSE {fold} END AS st FROM {src}), "
        f"{name}_l AS (SELECT {cols}, CASE WHEN st IS NULL THEN [text] "
        f"WHEN {strip('st.cur')} <> '' THEN list_append(st.out, {strip('st.cur')}) ELSE st.out END AS cl FROM {name}_f), "
        f"{name} AS (SELECT {cols}, unnest(range(len(cl))) AS chunk_index, unnest(cl) AS content "
        f"FROM {name}_l)"
    )
