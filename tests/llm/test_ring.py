"""Fingerprints and their components against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm import pigeonring, suite
from tests.conftest import SMALL
from tests.llm.test_texts import mutated

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    parts = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] if w else []
    h = [xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def least_of(prints):
    """Component of each of the (id, fingerprint) rows: its least id."""
    n, root = len(prints), list(range(len(prints)))
    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    ids = {}
    for (doc, _), r in zip(prints, root, strict=True):
        ids.setdefault(r, []).append(doc)
    return [min((d for d in ids[r] if d is not None), default=None) for r in root]


def wanted(rows):
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    return sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, least_of(prints), strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_components(spark, edge, empty):
    for df in (edge, mutated(spark)):
        assert found(pigeonring.near_duplicates(df)) == wanted(df.collect())
    assert pigeonring.near_duplicates(empty).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [x[2] for x in found(pigeonring.near_duplicates(unnamed))] == [None, None]


def test_query(spark):
    df = suite.table(spark, SMALL, "documents")
    assert found(suite.QUERIES["op11_simhash_pigeonring"](spark, SMALL)) == wanted(df.collect())


def near(n, seed):
    """Fingerprints in clusters: a few centres, each with values some bits away."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    out = set(centres)
    while len(out) < n:
        x = rng.choice(centres)
        for j in rng.sample(range(64), rng.choice([1, 2, 3, 4, 8, 30])):
            x ^= 1 << j
        out.add(x)
    return sorted(out)


def roots(values, links):
    root = {v: v for v in values}
    for a, b in links:
        x, y = root[a], root[b]
        root = {v: min(x, y) if r in (x, y) else r for v, r in root.items()}
    return root


def test_links_of_large_and_cut_buckets(spark):
    """The same components whether buckets are compared, or given up as too large."""
    values = near(260, 7)
    pairs = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    prints = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "_f long")
    for most in (1, 3, 4096):
        links = pigeonring.near_links(prints, most).collect()
        assert roots(values, [(r.a % 2**64, r.b % 2**64) for r in links]) == roots(values, pairs)


def test_every_chain_has_a_start_within_budget():
    """The pigeonring principle, for all pairs of differing bits: some first segment keeps the pair."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    for i in range(64):
        for j in range(64):
            x = np.array([base, base ^ np.uint64(1 << i) ^ (np.uint64(1 << j) if i != j else np.uint64(0))])
            kept = False
            for s in range(pigeonring.RING):
                n = np.uint64(pigeonring._EDGE[s])
                r = (x << n) | (x >> ((np.uint64(64) - n) & np.uint64(63))) if n else x
                if int(r[0] ^ r[1]) >> (64 - int(pigeonring._CHAIN[s, pigeonring.KEY - 1])) == 0:
                    kept |= bool(pigeonring.in_budget(np.array([s]), r[:1] ^ r[1:])[0])
            assert kept


def test_hash_is_the_engines_own(spark):
    df = spark.createDataFrame([("grün is the new",), ("x" * 70 + " y z",)], "t string")
    for r in df.withColumn("h", F.xxhash64("t")).collect():
        assert r.h % 2**64 == xxh64_intdigest(r.t.encode(), 42)
