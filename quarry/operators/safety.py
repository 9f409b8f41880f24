"""Content safety: ordered pattern categories evaluated as Catalyst predicates.

A policy is an ordered list of (category, patterns) plus the enabled list.
Each category becomes an ``OR`` of case-insensitive ``rlike`` tests, one per
pattern; a ``CASE WHEN`` chain in enabled order returns the first matching
category.  Nothing leaves the JVM: no UDF, whole-stage codegen
keeps the chain inside the scan's stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import PY_WS_CLASS, col_, is_blank

# The reference's default blocklists, in its order.
JAILBREAK_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"(you\s+are|be)\s+(now\s+)?(DAN|GPT|unfiltered|uncensored)",
    r"act\s+as\s+(if\s+you\s+(are|were)\s+)?(DAN|a\s+different\s+AI)",
    r"pretend\s+(you\s+are|to\s+be)\s+(not|someone|a\s+different)",
    r"developer\s+mode|jailbreak|override\s+safety",
    r"system\s*prompt\s*[:=]|reveal\s+your\s+(system\s+)?(prompt|instructions)",
    r"you\s+(must|have\s+to|should)\s+(ignore|disregard|forget)",
    r"new\s+instructions?\s*[:=]|from\s+now\s+on\s+you\s+(are|will)",
    r"do\s+not\s+(follow|obey|respect)\s+(any\s+)?(rules?|guidelines?)",
]
HARM_CONTENT_PATTERNS = [
    r"how\s+to\s+(make|build|create|manufacture)\s+(a\s+)?(bomb|weapon|explosive)",
    r"instructions?\s+(for|on)\s+(making|building|manufacturing)\s+(weapons?|explosives?)",
    r"how\s+to\s+(kill|murder|assassinate)",
    r"ways\s+to\s+(hurt|harm|injure)\s+(yourself|myself|people)",
    r"suicide\s+method|best\s+way\s+to\s+(die|kill\s+myself)",
    r"child\s+(abuse|pornography|exploitation)",
    r"how\s+to\s+(hack|bypass\s+security|crack\s+password)",
    r"distribute\s+(malware|ransomware|virus)",
    r"cp\b|CSAM",
]
HATE_CONTENT_PATTERNS = [
    r"(hate|kill|exterminate)\s+all\s+\w+",
    r"racial\s+slur|ethnic\s+cleansing",
    r"white\s+supremac|neo[\s-]*nazi",
    r"genocide\s+(of|against)\s+\w+",
    r"terroris(ts?|m)\s+(are|is)\s+(good|right|hero)",
]
# The categories check_output looks at, in order, and the reasons.
OUTPUT_CATEGORIES = ["harm", "hate"]
INPUT_REASON = "Input matches blocked pattern in '{}' category"
OUTPUT_REASON = "Output contains blocked content in '{}' category"

_WORD_BODY = "\\p{L}\\p{N}_"
_WS_BODY = PY_WS_CLASS[1:-1]


def python_regex_to_portable(p: str) -> str:
    """Rewrite Python-``re`` classes so Java regex and RE2 give Python's answer.

    ``\\s`` -> Python's Unicode whitespace set, ``\\w`` -> letters, numbers,
    underscore; a ``\\b`` next to a word character at an end of an alternative ->
    a non-word character or the end of the text (equivalent for a search).
    """
    out, i, in_class = [], 0, False
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            if nxt == "s":
                out.append(_WS_BODY if in_class else PY_WS_CLASS)
            elif nxt == "d":
                out.append("\\p{Nd}" if in_class else "\\p{Nd}")
            elif nxt == "w":
                out.append(_WORD_BODY if in_class else f"[{_WORD_BODY}]")
            elif nxt == "b" and not in_class:
                if i + 2 == len(p) or p[i + 2] in "|)":
                    out.append(f"(?:[^{_WORD_BODY}]|$)")
                elif i == 0 or p[i - 1] in "|(":
                    out.append(f"(?:^|[^{_WORD_BODY}])")
                else:
                    raise ValueError(f"unsupported \\b position in {p!r}")
            else:
                out.append(p[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


_BODIES = {"s": _WS_BODY, "d": "\\p{Nd}", "w": _WORD_BODY}
_WORD, _ELSE = f"[{_WORD_BODY}]", f"[^{_WORD_BODY}]"
_BOUNDARIES = {"b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
               "B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"}


def python_regex_to_java(p: str) -> str:
    """Rewrite a Python pattern for Java's engine: ``\\s \\w \\d``, their opposites (in
    classes too) and ``\\b \\B`` anywhere keep Python's Unicode meaning."""
    out, i = [], 0
    while i < len(p):
        if p[i] == "\\" and i + 1 < len(p):
            c = p[i + 1]
            if c.lower() in _BODIES:
                out.append(f"[{'^' if c.isupper() else ''}{_BODIES[c.lower()]}]")
            else:
                out.append(_BOUNDARIES.get(c, p[i:i + 2]))
            i += 2
        elif p[i] == "[":
            text, i = _java_class(p, i)
            out.append(text)
        else:
            out.append(p[i])
            i += 1
    return "".join(out)


def _java_class(p: str, i: int) -> tuple[str, int]:
    """The class of ``p`` that begins at ``i``, for Java, and where it ends.  An opposite such
    as ``\\W`` becomes an alternative beside the class (or, if negated, a look ahead)."""
    negated = p[i + 1:i + 2] == "^"
    j = first = i + 1 + negated
    body, opposites = "", []
    while j < len(p) and (p[j] != "]" or j == first):
        step = 1
        if p[j] == "\\" and j + 1 < len(p):
            step, c = 2, p[j + 1]
            if c in "SDW":
                opposites.append(f"[^{_BODIES[c.lower()]}]")
            else:
                body += _BODIES.get(c, p[j:j + 2])
        else:
            body += "\\" + p[j] if p[j] in "[]&" else p[j]
        j += step
    either = "|".join(opposites)
    if not opposites:
        text = f"[{'^' if negated else ''}{body}]"
    elif negated:
        text = f"(?:(?!{either})" + (f"[^{body}])" if body else "[\\s\\S])")
    else:
        text = f"(?:{either}" + (f"|[{body}])" if body else ")")
    return text, j + 1


_META = set("\\()[].*+?{}|^$")


def _top_alternatives(p: str) -> list[str]:
    parts, cur, depth, in_class, i = [], "", 0, False, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            cur += p[i:i + 2]
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(cur)
            cur, i = "", i + 1
            continue
        cur += c
        i += 1
    return parts + [cur]


def _group_end(p: str) -> int:
    depth, in_class, i = 0, False, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def _leading_literals(alt: str) -> list[str] | None:
    """Literals one of which starts every match of ``alt`` (None if unknown)."""
    if alt.startswith("("):
        j = _group_end(alt)
        if j < 0 or alt[j + 1:j + 2] in ("?", "*", "{"):
            return None
        inner = alt[1:j]
        if inner.startswith("?:"):
            inner = inner[2:]
        elif inner.startswith("?"):
            return None
        lits = []
        for a in _top_alternatives(inner):
            got = _leading_literals(a)
            if got is None:
                return None
            lits += got
        return lits
    run, i = "", 0
    while i < len(alt) and alt[i] not in _META:
        run += alt[i]
        i += 1
    if i < len(alt) and alt[i] in "?*{":
        run = run[:-1]  # the last character is optional
    return [run.lower()] if len(run) >= 2 else None


def required_literals(pattern: str) -> list[str] | None:
    """Lower-cased literals at least one of which every match contains, derived
    from the pattern's top-level alternatives; None when a branch has none."""
    lits = []
    for a in _top_alternatives(pattern):
        got = _leading_literals(a)
        if got is None:
            return None
        lits += got
    return sorted(set(lits))


def pattern_hit(lowered: Column, pattern: str) -> Column:
    """``rlike`` of one pattern on lower-cased text, behind a literal prefilter:
    a substring test for the pattern's required literals (short-circuit AND),
    so the regex engine only runs on rows that can match."""
    rx = lowered.rlike("(?iu)" + python_regex_to_java(pattern))
    lits = required_literals(pattern)
    if not lits:
        return rx
    pre = None
    for lit in lits:
        c = lowered.contains(lit)
        pre = c if pre is None else (pre | c)
    return pre & rx


def category_hit(lowered: Column, patterns: list[str]) -> Column:
    """Any pattern of the category matches: short-circuit OR of one prefiltered
    ``rlike`` per pattern (separate patterns keep the regex engine's literal
    search, which one big alternation loses)."""
    hit = None
    for p in patterns:
        h = pattern_hit(lowered, p)
        hit = h if hit is None else (hit | h)
    return hit


@dataclass
class SafetyPolicy:
    """Ordered categories and the enabled list (defaults = the reference's)."""

    blocklists: dict[str, list[str]] = field(default_factory=lambda: {
        "jailbreak": list(JAILBREAK_PATTERNS),
        "harm": list(HARM_CONTENT_PATTERNS),
        "hate": list(HATE_CONTENT_PATTERNS),
    })
    enabled: list[str] | None = None

    def __post_init__(self):
        if not self.enabled:
            self.enabled = list(self.blocklists)
        for p in (p for ps in self.blocklists.values() for p in ps):
            re.compile(p)  # reject patterns Python itself would reject

    def add_patterns(self, category: str, patterns: list[str]) -> "SafetyPolicy":
        """Extend (or create) a category; it is checked only if enabled."""
        self.blocklists.setdefault(category, []).extend(patterns)
        return self

    def load_blocklist(self, spark, path: str) -> "SafetyPolicy":
        """Merge a JSON ``{category: [regex, ...]}`` file (a few rows: read with Spark, collected)."""
        raw = spark.read.option("multiLine", True).json(path)
        for cat in raw.columns:
            for row in raw.select(F.explode(F.col(cat)).alias("p")).collect():
                self.blocklists.setdefault(cat, []).append(row["p"])
        return self

    def stats(self) -> dict:
        return {"categories": list(self.blocklists), "enabled": list(self.enabled),
                "total_patterns": sum(len(v) for v in self.blocklists.values())}


def _first_category(text: Column, categories: list[str], policy: SafetyPolicy,
                    lowered: Column | None = None) -> Column:
    lowered = F.lower(text) if lowered is None else lowered
    expr = None
    for cat in categories:
        pats = policy.blocklists.get(cat)
        if not pats:
            continue
        hit = category_hit(lowered, pats)
        expr = F.when(hit, F.lit(cat)) if expr is None else expr.when(hit, F.lit(cat))
    if expr is None:
        return F.lit(None).cast("string")
    return expr.otherwise(F.lit(None).cast("string"))


def _verdict(text: Column, categories: list[str], policy: SafetyPolicy, reason_fmt: str,
             lowered: Column | None = None) -> Column:
    cat = F.when(is_blank(text), F.lit(None).cast("string")).otherwise(
        _first_category(text, categories, policy, lowered))
    blocked = cat.isNotNull()
    prefix, suffix = reason_fmt.split("{}")
    return F.struct(
        (~blocked).alias("safe"),
        blocked.alias("blocked"),
        cat.alias("category"),
        F.when(blocked, F.concat(F.lit(prefix), cat, F.lit(suffix))).alias("reason"),
        F.when(blocked, F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"),
    )


def check_input(text, policy: SafetyPolicy | None = None, lowered=None) -> Column:
    """Verdict struct for user input: enabled categories in enabled order.

    ``lowered``: an already lower-cased column of the text (see ``moderate``)."""
    policy = policy or SafetyPolicy()
    return _verdict(col_(text), list(policy.enabled), policy, INPUT_REASON,
                    None if lowered is None else col_(lowered))


def check_output(text, policy: SafetyPolicy | None = None, lowered=None) -> Column:
    """Verdict struct for model output: harm then hate, if enabled."""
    policy = policy or SafetyPolicy()
    cats = [c for c in OUTPUT_CATEGORIES if c in policy.enabled]
    return _verdict(col_(text), cats, policy, OUTPUT_REASON, None if lowered is None else col_(lowered))


def check(text, is_input, policy: SafetyPolicy | None = None, lowered=None) -> Column:
    """Dispatch on a boolean column: input rule or output rule per row."""
    return F.when(col_(is_input), check_input(text, policy, lowered)).otherwise(check_output(text, policy, lowered))


LOWER_COL = "_lowered"


def moderate(df: DataFrame, text_col: str, policy: SafetyPolicy | None = None,
             is_input_col: str | None = None) -> DataFrame:
    """Add the verdict fields (safe, blocked, category, reason, score).

    The text is lower-cased once in its own projection; the pattern probes
    read that column (Catalyst keeps a non-cheap expression that is used many
    times in its own projection instead of inlining it into every probe)."""
    low = df.withColumn(LOWER_COL, F.lower(F.col(text_col)))
    v = (check(text_col, is_input_col, policy, LOWER_COL) if is_input_col
         else check_input(text_col, policy, LOWER_COL))
    return low.withColumn("_v", v).select("*", "_v.*").drop("_v", LOWER_COL)


def all_matches(df: DataFrame, key_cols: list[str], text_col: str,
                policy: SafetyPolicy | None = None) -> DataFrame:
    """Every (row, category, pattern) hit, not just the first (corpus audit).

    One row per hit: key columns, category, pattern index within the category.
    """
    policy = policy or SafetyPolicy()
    df = df.withColumn(LOWER_COL, F.lower(F.col(text_col)))
    lowered = F.col(LOWER_COL)
    probes = []
    for cat in policy.enabled:
        for i, p in enumerate(policy.blocklists.get(cat, [])):
            probes.append(F.when(pattern_hit(lowered, p), F.struct(F.lit(cat).alias("category"),
                                                                   F.lit(i).alias("pattern_index"))))
    hits = F.filter(F.array(*probes), lambda x: x.isNotNull()) if probes else F.array()
    return (df.select(*key_cols, F.when(is_blank(text_col), F.array()).otherwise(hits).alias("_h"))
            .select(*key_cols, F.explode_outer("_h").alias("_m")).filter(F.col("_m").isNotNull())
            .select(*key_cols, "_m.*"))


def category_counts(hits: DataFrame, key_cols: list[str]) -> DataFrame:
    """Per category and pattern: hits and distinct rows hit (ROLLUP adds category totals)."""
    row_key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key_cols])
    return (hits.withColumn("_row", row_key)
            .rollup("category", "pattern_index")
            .agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("_row").alias("rows_hit")))
