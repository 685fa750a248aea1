"""Work and memory of the queries on long tables."""

import time

import numpy as np
import pandas as pd
from test_library import brute_matching

from foldlake.operators import bands, blocks, folding, matching, structure, windowed


def test_matching_of_many_pieces_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGUN"), n)) for n in [*range(24), 40, 7, 0]]
    assert matching.most_pairs(seqs).tolist() == [brute_matching(s) for s in seqs]
    monkeypatch.setattr(matching, "HELD", 50)
    assert matching.most_pairs(seqs).tolist() == [brute_matching(s) for s in seqs]
    assert matching.most_pairs(["G" * 300 + "C" * 300]).tolist() == [298]
    many = ["".join(x) for x in rng.choice(list("ACGU"), (272, 60))]
    t = time.process_time()
    for _ in range(40):
        matching.most_pairs(many)
    assert time.process_time() - t < 4  # 10,880 pieces; 6.4 s in the form before, 0.3 s in this one


def test_pair_rows_are_packed(spark):
    texts = {1: "((..))" * 400, 2: "...", 3: "", 4: "(" * 900 + ")" * 900, 5: ".(.)"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, structure string")
    n = d.selectExpr("doc_id", "length(structure) AS n")
    for pairs in (structure.pairs(d), structure.pairs(d).repartition(7)):
        assert dict(map(tuple, structure.from_pairs(pairs, n).collect())) == texts
    sent = structure.pairs(d).coalesce(1).mapInArrow(structure._runs, "k long, run binary").collect()
    assert sorted((r["k"], len(r["run"]) // 8) for r in sent) == [(1, 800), (4, 900), (5, 1)]


def test_blocks_against_bands():
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list(letters), n)) for letters in ("ACGU", "GGCCAUN") for n in [*range(1, 60, 4), 60, 60, 75, 120]]
    seqs += ["G" * 25 + "CAACGG" + "C" * 25, "GGGGGAAAACCCCC" * 4, "A" * 60]
    for dangles in (0, 2):
        for rows in blocks.together(seqs, 1 << 15):
            group = [seqs[r] for r in rows]
            low, old = blocks.Block(group, dangles=dangles), folding._filled(group, bands.Minimum, dangles=dangles)
            f = low.suffixes()
            assert list(zip(f[1].tolist(), low.best(f))) == [folding._best(old, k) for k in range(len(group))]
            z, old = blocks.Block(group, sums=True, dangles=dangles), folding._filled(group, bands.Sum, bands.GROW, dangles=dangles)
            got = np.log(z.suffixes()[1]) - bands.GROW * (z.n - 2)
            want = [np.log(old.exterior(k)[0]) - bands.GROW * len(s) for k, s in enumerate(group)]
            np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)


def test_fold_of_many_pieces_at_once():
    rng = np.random.default_rng(6)
    many = pd.DataFrame({"key": range(1000), "seq": ["".join(x) for x in rng.choice(list("ACGU"), (1000, 60))]})
    t = time.process_time()
    new = next(folding._folded([many]))
    new_s, folding_short = time.process_time() - t, folding.SHORT
    try:
        folding.SHORT = 0
        t = time.process_time()
        old = next(folding._folded([many]))
    finally:
        folding.SHORT = folding_short
    assert new_s < (time.process_time() - t) / 1.5
    assert list(new["structure"]) == list(old["structure"]) and list(new["mfe"]) == list(old["mfe"])


def test_local_folds_of_many_texts_at_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ACGUN"), n)) for n in (0, 1, 6, 40, 300, 90, 0, 171, 500)] + [None, "ACGU " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, seq string").coalesce(1)
    want = sorted((k, *h) for k, s in enumerate(texts) for h in windowed.local_hits((s or "").replace(" ", "N"), 50)[1])
    assert sorted(map(tuple, windowed.local_folds(df, 50).collect())) == want
    seqs, batch = [s or "" for s in texts], pd.DataFrame({"key": range(len(texts)), "seq": texts})
    for tile, strip in ((64, 1000), (333, 100)):
        monkeypatch.setattr(windowed, "TILE", tile)
        monkeypatch.setattr(windowed, "STRIP", strip)
        assert sorted(row for out in windowed._local([batch], 50, lambda x: x[1], 2) for row in out) == want
    monkeypatch.undo()
    long = pd.DataFrame({"key": range(40), "seq": ["".join(x) for x in rng.choice(list("ACGU"), (40, 1000))]})
    t = time.process_time()
    assert sum(map(len, windowed._local([long], 70, lambda x: x[1], 2))) > 1000
    assert time.process_time() - t < 2.5


def test_probabilities_of_blocks_against_windows():
    rng = np.random.default_rng(9)
    seqs = ["".join(rng.choice(list("ACGUN"), n)) for n in (1, 4, 5, 6, 13, 14, 30, 59, 60, 60)] + ["GGGGGAAAACCCCC" * 4, "A" * 60, "G" * 25 + "CAACGG" + "C" * 25]
    for rows in blocks.together(seqs, 1 << 20):
        group = [seqs[r] for r in rows]
        (texts, centroids, distances, mea, accuracy, diversity), (row, i, j, p) = folding._short_ensembles(rows, group, 1e-5, (blocks.Room(), blocks.Room()))
        w = bands.Windows(group, len(group[-1]), len(group[-1]))
        for k, (r, s) in enumerate(zip(rows, group)):
            old, pairs = folding._long_ensemble(w, k, s, w.most_accurate()[k], 1e-5)
            assert (texts[k], centroids[k], mea[k]) == (old[0], old[1], old[3])
            np.testing.assert_allclose([distances[k], accuracy[k], diversity[k]], [old[2], old[4], old[5]], rtol=1e-9, atol=1e-9)
            own = sorted(zip(i[row == r].tolist(), j[row == r].tolist(), p[row == r].tolist()))
            assert [x[:2] for x in own] == sorted(zip(*(x.tolist() for x in pairs[:2])))
            np.testing.assert_allclose([x[2] for x in own], pairs[2], rtol=1e-9)


def test_sampled_pairs_follow_the_probabilities(spark):
    rng = np.random.default_rng(10)
    seqs = ["".join(rng.choice(list("GGCCAU"), n)) for n in (0, 4, 9, 20, 33, 60, 60)] + ["GGGGGAAAACCCCC" * 4]
    n = 4000
    row, i, j, count = folding._pair_counts(seqs, n, 1, blocks.Room())
    got = {(r, x, y): c / n for r, x, y, c in zip(row.tolist(), i.tolist(), j.tolist(), count.tolist())}
    want = {}
    for r, s in enumerate(seqs):
        if s:
            w = bands.Windows([s], len(s), len(s))
            want |= {(r, int(x), int(y)): p for x, y, p in w.pairs(0, 1e-9).T}
    assert set(got) <= set(want)
    for x, p in want.items():
        assert abs(got.get(x, 0) - p) < 5 * (p * (1 - p) / n) ** 0.5 + 2e-3
    again = folding._pair_counts(seqs[::-1], n, 1, blocks.Room())  # other neighbours, the same draws
    assert sorted(zip((len(seqs) - 1 - again[0]).tolist(), *again[1:].tolist())) == sorted(zip(row.tolist(), i.tolist(), j.tolist(), count.tolist()))
    rows = [(k % 5, s) for k, s in enumerate(seqs)] + [(None, seqs[5]), (None, seqs[6]), (9, None)]
    one = {}
    for k, s in rows:
        for _, x, y, c in zip(*(v.tolist() for v in folding._pair_counts([s or ""], 10, 1, blocks.Room()))):
            one[k, x, y] = one.get((k, x, y), 0) + c
    df = spark.createDataFrame(rows, "doc_id long, seq string").repartition(4)
    for size in ("10000", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        out = folding.sampled_pairs(df, 10).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(out) == len({r["doc_id"] for r in out}) == 7
        assert {(r["doc_id"], p["i"], p["j"]): round(p["frequency"] * 10) for r in out for p in r["pairs"]} == one
