"""op11 against stretches compared word by word."""

import hashlib
import random
import re
import zlib

import numpy as np

from foldlake.llm import periodic_runs


def plain(words):
    """All (start, length, period) by comparing every word with those behind it."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, l, q) for (s, l), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    out = {i for s, l, q in found for i in range(s + q, s + l)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in out)))


def test_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 5)):
            n, kinds = rng.choice([0, 1, 5, 13, 30, 80, 200]), rng.choice([1, 2, 3, 10, 1000])
            w = [rng.randrange(kinds) for _ in range(n)]
            for _ in range(rng.randint(0, 2) if n > 5 else 0):
                s = rng.randrange(n)
                p, e = rng.randint(1, max(1, (n - s) // 2)), rng.randint(s, n)
                for i in range(s, e):
                    w[i] = w[s + (i - s) % p]
            docs.append(w)
        starts = np.cumsum([0, *map(len, docs)])
        got = periodic_runs.runs(np.array([x for d in docs for x in d], np.int64), starts)
        for t, d in enumerate(docs):
            assert [tuple(r[1:]) for r in got.tolist() if r[0] == t] == plain(d)


def test_rows_of_odd_documents(spark):
    rng = random.Random(1)
    rows = [(None, "a b " * 20), (0, None), (1, ""), (2, " \n\t "), (3, "é ñ ü " * 9), (3, "é ñ ü " * 9), (4, "x" * 50_000), (5, "one\x0btwo " * 3000)]
    rows += [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 120))) + rng.choice(["", " ", "\n"])) for k in range(10, 140)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_runs int, start string")
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(df, alter=True).collect()), key=str)
    assert got == sorted((plain_row(*r) for r in rows), key=str)
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []


def test_slices_hold_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE", 40)
    rows = [(k, "a b c d " * k) for k in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [b.to_pydict() for b in periodic_runs._found(df.toArrow().to_batches(), True)]
    assert len(got) > 10
    flat = sorted((r for b in got for r in zip(*b.values())), key=str)
    assert flat == sorted((plain_row(*r) for r in rows), key=str)
