"""op12 against a plain trie in Python."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from foldlake.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, size int, d string"


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    nodes = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    below = lambda k: [x for x in nodes if x[: len(k)] == k]
    out = []
    for k, members in nodes.items():
        children = [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in members if full[c] == k))
        saved = sum((len(nodes[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below(k))
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in nodes) for x in below(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def spark_rows(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((tuple(r) for r in got), key=str)


def case(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        for k in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([None, k, k, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long " * 20]), 5, "x"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_trie(spark, seed):
    rows = case(seed) + [(None, 1, "user", "lost", 1, "x")]
    assert spark_rows(spark, rows) == plain(rows)


def test_chunks_and_ranges_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    monkeypatch.setattr(prefix_trie, "numbered", lambda t, k, o: common.numbered(t, k, o, most=3))
    rows = case(3, 40) + [(7, k, "user", "same", 0, None) for k in range(50)] + [(8, k, "user", "same", 0, None) for k in range(50)] + [(500, 1, "user", "alone", 0, None)] * 5
    assert spark_rows(spark, rows) == plain(rows)


def test_copies_and_empty_tables(spark):
    assert spark_rows(spark, []) == []
    rows = [(c, k, "user", "hello", 0, None) for c in range(30, 60) for k in range(6)]
    assert spark_rows(spark, rows) == plain(rows)
    one = [(5, 0, None, None, 0, None)]
    assert spark_rows(spark, one) == plain(one)
    negative = [(c, k, "user", str(c % 3), 0, None) for c in (-250, -200, -3, -1, 0, 2) for k in range(4)]
    assert spark_rows(spark, negative) == plain(negative)


def test_numbers_of_rows(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("x"))
    for most in (10, 1000):
        got = common.numbered(df, "k", [F.col("x")], most).collect()
        for k in range(3):
            rows = sorted((r["nr"], r["x"]) for r in got if r["k"] == k)
            assert [r[0] for r in rows] == list(range(len(rows))) and [r[1] for r in rows] == sorted(r[1] for r in rows)
