"""Conversation repair against a search of all edits that knows nothing of blocks or automata."""

import hashlib
import heapq
import itertools
import re
from zlib import crc32

from quarry.llm import suite, turn_repair
from tests.conftest import SMALL

BLANK, GOOD = re.compile(r"[\x20\x09-\x0D]*"), re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spoken = [" " if x is None else x for x in (conv, turn, role, text)]
        role, text = spoken[2:]
        by = crc32(f"{spoken[0]}:{spoken[1]}".encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        out += [(conv, turn, "user" if by == 4 else role, text)] * {0: 0, 3: 2}.get(by, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Least (cost, letters), by cheapest-first search over prefixes of what is left of rows."""
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, letters, i, initials, kept = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, letters, "\n".join(f"{r}:{t}" for r, t in kept)
        short = "s" if initials == "s" else initials[-1:]
        if (i, short) in best:
            continue
        best[i, short] = True
        steps = [("I", 3, i, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            role, text = rows[i][2:]
            steps.append(("D", 4, i + 1, None, ""))
            if fault[i] not in ("blank", "duplicate"):
                extra = 3 * (fault[i] == "truncated")
                steps.append(("K", extra, i + 1, role, text))
                steps += [("R", 3 + extra, i + 1, r, text) for r in ("user", "assistant")]
        for letter, more, at, role, text in steps:
            now = initials if role is None else initials + (role[:1] or "?")
            if role is None or re.fullmatch(r"s?(ua)*u?", now):
                heapq.heappush(heap, (cost + more, letters + letter, at, now, kept if role is None else (*kept, (role, text))))


def wanted(rows):
    """Result rows of (conv, turn, role, text) rows."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(damage([r for r in rows if r[0] == conv]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        fault = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, text = cheapest(own, fault)
        out.append((conv, gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(df):
    cols = ["conv_id", *turn_repair.COUNTS, "audit", "repaired_sha256"]
    return sorted(map(tuple, turn_repair.digests(turn_repair.repaired(turn_repair.damaged(df))).select(*cols).collect()), key=str)


def test_query(spark):
    rows = [tuple(r) for r in suite.table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    cols = ["conv_id", *turn_repair.COUNTS, "audit", "repaired_sha256"]
    got = sorted(map(tuple, suite.QUERIES["op13_conversation_repair"](spark, SMALL).select(*cols).collect()), key=str)
    assert got == wanted(rows)


def test_every_short_conversation():
    """All sequences of symbols up to length 5, and some long ones: cost and least string."""
    roles = ("s", "u", "a", "t")
    for n in range(6):
        for codes in itertools.islice(itertools.product(range(turn_repair.NONE), repeat=n), 0, None, 1 if n < 4 else 37 if n == 4 else 501):
            rows = [(0, 0, "x" if c == 0 else roles[(c - 1) % 4], "t") for c in codes]
            fault = ["blank" if c == 0 else "truncated" if c >= turn_repair.CUT else "" for c in codes]
            assert turn_repair.cheapest(bytes(codes)) == cheapest(rows, fault)[:2]


def test_edge_rows(spark):
    texts = ["Fine.", "no end", "", " \n\t", "Ends! ", "x" * 3000 + "?", None, "zażółć…", "end.\x0b"]
    rows = []
    for conv in (None, *range(60)):
        n = conv or 7
        rows += [(conv, (k * n) % 5 if (k + n) % 6 else None, ["user", "assistant", "system", "tool", None, "", "sudo", "User"][(k * k + n) % 8], texts[(k * 3 + n) % 9]) for k in range(n % 23)]
    rows += rows[:40] + [(None, None, None, None)] * 3 + [(99, -(2**62), "user", "a."), (99, 2**62, "assistant", "b."), (99, 1, "user", "a.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, gaps int")
    assert repaired(df) == wanted(rows)
    assert turn_repair.digests(turn_repair.repaired(turn_repair.damaged(df.limit(0)))).count() == 0


def test_long_conversation(spark):
    """One conversation over many batches: its blocks are those of the whole."""
    rows = [(1, t, ("user", "assistant", "tool")[t * t % 3], f"{t % 401} words{'.' if t % 5 else ''}") for t in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = repaired(df)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    assert got == wanted(rows)
