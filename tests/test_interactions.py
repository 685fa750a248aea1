"""Interaction search against the plain duplex of two strands."""

import random

import pytest

from foldlake.operators import interactions
from foldlake.operators.bands import KT
from foldlake.operators.landscape import duplex


def random_strand(rng, n):
    return "".join(rng.choice("ACGU") for _ in range(n))


def test_scan_against_duplex():
    rng = random.Random(5)
    for k in range(30):
        a, b = random_strand(rng, rng.choice([1, 3, 9, 14, 20])), random_strand(rng, rng.randint(1, 50))
        low, last = interactions.scan(a, b)
        want = duplex(a, b)
        assert low[1:].min() == (want[0] if want else interactions.FAR)
        for j in range(1, len(b) + 1, 7):  # ends at every seventh place
            ends = [duplex(a, b, (i, j)) for i in range(1, len(a) + 1)]
            ends = [x[0] for x in ends if x]
            assert low[j] == (min(ends) if ends else interactions.FAR)


def test_hits_do_not_overlap_and_are_true():
    rng = random.Random(8)
    s, t = random_strand(rng, 12), random_strand(rng, 150)
    low, last = interactions.scan(s, t)
    found = interactions.hits(s, t, -100)
    assert found and min(h[0] for h in found) == low[1:].min()
    for h in found:
        assert h[0] == low[h[3]] and last[h[3]] == h[2] and len(h[5]) == h[2] - h[1] + 1 + 1 + h[4] - h[3] + 1
        assert h[5].count("(") == h[5].count(")")
    assert all(x[4] < y[3] for x, y in zip(found, found[1:]))


def test_rows_of_interactions(spark, monkeypatch):
    rng = random.Random(9)
    site = "GGCAUCGA"
    target = "A" * 30 + "UCGAUGCC" + "A" * 30
    rows = [(1, site, target), (None, site, target), (2, None, target), (2, site, ""), (3, site, "A" * 20)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, strand string, target string, start int")
    got = {r["doc_id"]: r for r in interactions.interactions(df, "strand", "target", -500).collect()}
    assert set(got) == {1, None} and got[1]["target_start"] == 31 and got[1]["target_end"] == 38 and got[1]["structure"] == "((((((((&))))))))"
    assert got[1]["total"] == pytest.approx(got[1]["energy"] + got[1]["opening"]) and got[1]["opening"] >= 0
    assert interactions.interactions(df.limit(0), "strand", "target").collect() == []
    t = random_strand(rng, 140)
    sites = [(1, 4), (60, 70), (137, 140), (5, 5)]
    whole = interactions.opening(t, sites, 40, 40)
    monkeypatch.setitem(interactions._pieces.__globals__, "TILE", 50)
    assert interactions.opening(t, sites, 40, 40) == pytest.approx(whole, abs=1e-6)
    assert interactions.opening(t, [(1, 60)], 40, 40) == [None] and KT > 0
