"""Conversation structure repair: cheapest edits of turns, by block tables (Four Russians).

A row of a conversation is a symbol: must go, or the initial of its role (s, u, a,
other) and whether its text is truncated.  Edits turn the rows' initials into
``(s?(ua)+)?``, a small automaton: keep (0), rerole (3), delete (4), insert (3), and 3
for a truncated row that stays.  The costs of finishing from each state are a vector;
less its least entry, it is one of a few, as inserts and deletes bound the
differences.  So a table holds, for every such vector and every block of BLOCK symbols,
the vector before the block and what the block adds.

A conversation is read from its end, a lookup a block; the vector after each block is
kept.  Then it is read forward: a block is expanded backward, row by row, from the
vector after it, and of the edits that cost no more than the best the first in the
alphabet is taken (delete, insert, keep, rerole), so that of all cheapest edits those
with the least string are found, whatever the ties.

A conversation's rows are streamed in order: a task holds a byte for each row of the
conversation at hand, and no texts.  Its string of edits is one value of the result,
and the hash of what is left is sequential, so one task reads it.

Defined results: null role or text is one space; rows without a conversation are one
conversation; rows without a turn come first; equal turns are ordered by role, then
text; repeated rows are duplicates; other columns are not looked at; an empty table
gives an empty table; gaps beyond 64 bits are the largest number there is.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textbytes import column_of
from quarry.plans.layout import key_starts

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Symbols of a block.
BLOCK = 4
#: Symbols: must go, then initial (s, u, a, other), then the same truncated, and none (fills the last block).
GONE, WHOLE, CUT, NONE = 0, 1, 5, 9
SYMBOLS = NONE + 1
#: States: nothing yet, after s, after u, after a.  What an inserted or reroled row leads to
#: (there is one role that fits), and what a kept initial leads to (-1: it doesn't fit).
NEXT = (2, 2, 3, 2)
KEPT = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
ROLE_AFTER = {2: "user", 3: "assistant"}
#: Costs of finishing after the last row, and the edits.
END, END_EDITS = (0, 6, 3, 0), ("", "II", "I", "")
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
MOST = (1 << 63) - 1


def edits_of(symbol: int, state: int, after) -> list[tuple[str, int, int]]:
    """(letter, cost with what follows, state) of the edits of a row, in order of letters,
    but for inserts.  after: costs of finishing after the row, by state."""
    if symbol == NONE:
        return [("", after[state], state)]
    out = [("D", DELETE + after[state], state)]
    if symbol != GONE:
        cut, initial = divmod(symbol - WHOLE, CUT - WHOLE)
        to = KEPT[initial][state]
        if to >= 0:
            out.append(("K", KEEP + TRUNCATED * cut + after[to], to))
        out.append(("R", REROLE + TRUNCATED * cut + after[NEXT[state]], NEXT[state]))
    return out


def before(symbol: int, after) -> list[int]:
    """Costs of finishing before a row, by state."""
    out = [min(x[1] for x in edits_of(symbol, q, after)) for q in range(4)]
    for _ in range(3):  # an insert may be followed by another
        out = [min(x, INSERT + out[NEXT[q]]) for q, x in enumerate(out)]
    return out


def edits(symbol: int, state: int, after) -> tuple[str, int]:
    """The least string among the cheapest edits of a row, inserts before it included, and the state then."""
    costs, letters = before(symbol, after), ""
    while True:
        options = edits_of(symbol, state, after)
        best = costs[state]
        if options[0][1] == best and options[0][0] != "K":
            return letters + options[0][0], options[0][2]
        if INSERT + costs[NEXT[state]] == best:
            letters, state = letters + "I", NEXT[state]
            continue
        letter, _, to = next(x for x in options if x[1] == best)
        return letters + letter, to


class Tables:
    """vectors: the normalised costs there are, the first that of the end.  By vector and
    symbol: step (vector before, cost added); row (by state: edits, state).  By vector and
    block: block_to, block_cost."""

    def __init__(self):
        number = {END: 0}
        self.vectors, self.step = [END], []
        for v in self.vectors:  # grows
            steps = []
            for symbol in range(SYMBOLS):
                costs = before(symbol, v)
                least = min(costs)
                new = tuple(x - least for x in costs)
                if new not in number:
                    number[new] = len(self.vectors)
                    self.vectors.append(new)
                steps.append((number[new], least))
            self.step.append(steps)
        self.row = [[[edits(symbol, q, v) for q in range(4)] for symbol in range(SYMBOLS)] for v in self.vectors]
        to, cost = (np.array([[s[i] for s in steps] for steps in self.step]) for i in (0, 1))
        at, added = np.arange(len(self.vectors))[:, None], np.zeros((len(self.vectors), 1), np.int64)
        for _ in range(BLOCK):  # the symbol before those so far
            at, added = (x.transpose(0, 2, 1).reshape(len(self.vectors), -1) for x in (to[at], added[:, :, None] + cost[at]))
        self.block_to, self.block_cost = array("H", at.astype(np.uint16).tobytes()), array("H", added.astype(np.uint16).tobytes())


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def cheapest(symbols: bytes) -> tuple[int, str]:
    """Cost and string of the cheapest edits (of those, the least string)."""
    t = tables()
    rows = np.frombuffer(symbols + bytes([NONE]) * (-len(symbols) % BLOCK), np.uint8).reshape(-1, BLOCK)
    codes = (rows @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))).tolist()
    size, v, cost = SYMBOLS**BLOCK, 0, 0
    after = array("H", bytes(2 * len(codes)))
    for i in range(len(codes) - 1, -1, -1):
        after[i] = v
        at = v * size + codes[i]
        cost += t.block_cost[at]
        v = t.block_to[at]
    out, state = [], 0
    cost += t.vectors[v][state]
    for i, block in enumerate(rows.tolist()):
        v, inside = after[i], []
        for symbol in reversed(block):
            inside.append(v)
            v = t.step[v][symbol][0]
        for symbol, v in zip(block, reversed(inside), strict=True):
            letters, state = t.row[v][symbol][state]
            out.append(letters)
    return cost, "".join(out) + END_EDITS[state]


@lru_cache(maxsize=1 << 15)
def cheapest_short(symbols: bytes) -> tuple[int, str]:
    return cheapest(symbols)


def damaged(df: DataFrame) -> DataFrame:
    """The conversations' rows after damage by crc32: conv_id, turn, role, text and _gone (a
    row that was dropped; it stays so that its conversation does)."""
    spoken = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    by = F.crc32(F.concat(spoken["conv_id"], F.lit(":"), spoken["turn"]).cast("binary")) % 20
    gone = by == 0
    text = F.when(gone, None).when(by == 1, "").when(by == 2, F.translate(spoken["text"], ".!?", "")).otherwise(spoken["text"])
    role = F.when(gone, None).when(by == 4, "user").otherwise(spoken["role"])
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), gone.alias("_gone"), F.when(by == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0))).alias("_copies"))
    return rows.withColumn("_copy", F.explode("_copies")).drop("_copies", "_copy")


def in_order(*first: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*first, "turn", "role", "text")]


def symbols(rows: DataFrame) -> DataFrame:
    """The rows of each conversation in order: conv_id, turn, _gone, _fault (0 none, 1 blank,
    2 duplicate, 3 truncated) and _initial (0 s, 1 u, 2 a, 3 other)."""
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*in_order()))
    fault = F.when(stripped == "", 1).when(nth > 1, 2).when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    found = rows.repartition("conv_id").withColumn("_fault", fault.cast("int")).withColumn("_initial", kind.cast("int"))
    return found.sortWithinPartitions(*in_order("conv_id")).select("conv_id", "turn", "_gone", "_fault", "_initial")


class _Conversation:
    """What is known of the conversation at hand."""

    def __init__(self):
        self.symbols, self.last, self.faults, self.illegal = bytearray(), None, np.zeros(4, np.int64), 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: pa.Array, fault: np.ndarray, initial: np.ndarray) -> None:
        if not len(fault):
            return
        self.symbols += np.where((fault == 1) | (fault == 2), GONE, np.where(fault == 3, CUT, WHOLE) + initial).astype(np.uint8).tobytes()
        self.faults += np.bincount(fault, minlength=4)
        pairs = np.concatenate([initial[:0] if self.last is None else [self.last], initial])
        a, b = pairs[:-1], pairs[1:]
        self.illegal += int((~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))).sum())
        self.last = initial[-1]
        known = turn.drop_null().to_numpy()
        if len(known):
            new = known[0] != self.high if self.high is not None else True
            self.turns += int(new) + int((known[1:] != known[:-1]).sum())
            self.low = int(known[0]) if self.low is None else self.low
            self.high = int(known[-1])

    def found(self) -> tuple:
        cost, audit = (cheapest_short if len(self.symbols) <= 64 else cheapest)(bytes(self.symbols))
        gaps = min(MOST, self.high - self.low + 1 - self.turns) if self.turns else 0
        return gaps, *self.faults[1:].tolist(), self.illegal, cost, audit


def plans(rows: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    rows: as from ``damaged``."""
    key = rows.schema["conv_id"]

    def run(batches):
        conv, name, done = None, None, []

        def out():
            cols = list(zip(*(x[1] for x in done), strict=True))
            ids = pa.concat_arrays([x[0] for x in done])
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], names=["conv_id", *COUNTS, "audit"])

        for b, starts in key_starts(batches, ["conv_id"]):
            ids, turn = column_of(b, "conv_id"), column_of(b, "turn").cast(pa.int64())
            fault, initial = (column_of(b, c).to_numpy().astype(np.int64) for c in ("_fault", "_initial"))
            here = ~column_of(b, "_gone").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(starts)
            edges = [0, *at[at > 0].tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if starts[lo]:
                    if conv is not None:
                        done.append((name, conv.found()))
                    conv, name = _Conversation(), ids.slice(lo, 1)
                stays = here[lo:hi]
                conv.add(turn.slice(lo, hi - lo).filter(pa.array(stays)), fault[lo:hi][stays], initial[lo:hi][stays])
            if done:
                yield out()
                done = []
        if conv is not None:
            done.append((name, conv.found()))
            yield out()

    schema = T.StructType([key, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])
    return symbols(rows).mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations, in order within a task: of each a row with place 0, the counts
    and the audit, then its rows from place 1 on (role, text)."""
    heads = plans(rows)
    kept = rows.filter(~F.col("_gone")).select("conv_id", "turn", "role", "text")
    nothing = {c: F.lit(None).cast(heads.schema[c].dataType) for c in (*COUNTS, "audit")}
    both = kept.withColumn("_head", F.lit(1)).withColumns(nothing).unionByName(heads.withColumn("_head", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions(*in_order("conv_id", "_head"))
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])

    def run(batches):
        audit, at, state, place = "", 0, 0, 0
        for b, starts in key_starts(batches, ["conv_id"]):
            role, text, strings = (column_of(b, c).to_pylist() for c in ("role", "text", "audit"))
            head = (column_of(b, "_head").to_numpy() == 0).tolist()
            rows, places, roles, texts, heads = [], [], [], [], []

            def put(row, said, what):
                rows.append(row)
                places.append(place)
                roles.append(said)
                texts.append(what)

            for i in range(b.num_rows):
                if head[i]:
                    audit, at, state, place = strings[i], 0, 0, 0
                    heads.append(len(rows))
                    put(i, None, None)
                else:
                    letter = audit[at]
                    at += 1
                    if letter != "D":
                        state = KEPT["sua".find(role[i][:1])][state] if letter == "K" else NEXT[state]
                        place += 1
                        put(i, role[i] if letter == "K" else ROLE_AFTER[state], text[i])
                while at < len(audit) and audit[at] == "I":  # those before the next row, or the end
                    at, state, place = at + 1, NEXT[state], place + 1
                    put(i, ROLE_AFTER[state], "")
            took = pa.array(rows, pa.int64())
            only = np.zeros(len(rows), bool)
            only[heads] = True
            counts = [pc.if_else(pa.array(only), column_of(b, c).take(took), pa.scalar(None, column_of(b, c).type)) for c in (*COUNTS, "audit")]
            yield pa.RecordBatch.from_arrays([column_of(b, "conv_id").take(took), pa.array(places, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), *counts], names=schema.names)

    return dealt.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """A row for each conversation of ``repaired``, whose order it relies on: conv_id, the
    counts, audit, repaired_sha256 (rows ``role:text`` joined by newlines)."""
    schema = T.StructType([*(found.schema[c] for c in ("conv_id", *COUNTS, "audit")), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        head, sha = None, None  # of the conversation at hand, whose rows go on in the next batch

        def out(heads, hashes):
            whole = pa.Table.from_batches(heads).select(schema.names[:-1])
            return whole.append_column("repaired_sha256", pa.array(hashes)).combine_chunks().to_batches()[0]

        for b in batches:
            place, hashes = column_of(b, "place").to_numpy(), []
            role, text = column_of(b, "role").to_pylist(), column_of(b, "text").to_pylist()
            for i, n in enumerate(place.tolist()):
                if n:
                    sha.update((("\n" if n > 1 else "") + f"{role[i]}:{text[i]}").encode())
                else:
                    if sha is not None:
                        hashes.append(sha.hexdigest())
                    sha = hashlib.sha256()
            heads = np.flatnonzero(place == 0)
            if len(heads):
                ended = [*([head] if head is not None else []), b.take(pa.array(heads[:-1]))]
                head = b.slice(heads[-1], 1)
                if hashes:
                    yield out(ended, hashes)
        if head is not None:
            yield out([head], [sha.hexdigest()])

    return found.mapInArrow(run, schema)
