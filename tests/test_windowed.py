"""Diagonal tables, local folds, window probabilities and accessibilities against enumeration and plain recursions."""

import math
import random
from functools import lru_cache

import numpy as np
import pytest

from foldlake.operators import bands, folding, windowed
from foldlake.operators.energy import Loops

PAIRS = {"AU", "UA", "GC", "CG", "GU", "UG"}


def letters_of(rng, n):
    return "".join(rng.choice("ACGU") for _ in range(n))


def structures(s, a, b, span):
    """All sets of pairs of places a to b, at most span apart."""

    @lru_cache(None)
    def sets(i, j):
        if j - i < 4:
            return [()]
        out = list(sets(i + 1, j))
        for k in range(i + 4, min(j, i + span) + 1):
            if s[i] + s[k] in PAIRS:
                out += [((i, k), *x, *y) for x in sets(i + 1, k - 1) for y in sets(k + 1, j)]
        return out

    return sets(a, b)


def brackets(n, pairs):
    t = ["."] * n
    for i, j in pairs:
        t[i], t[j] = "(", ")"
    return "".join(t)


def energy(s, pairs):
    return int(Loops(brackets(len(s), pairs), s).energies()[1].sum()) if pairs else 0


SEQS = ["GGGAAACCCAGGGAAACC", "GGGGAAAACCUCC", "GCGAAAGC", "AC", "GGCGAAAGCAGGAAACCACC", "GGAAGGAAACCAAGGAAACCAACC", "GGGAGAAAAUAACCC"]


@pytest.mark.parametrize("window,span", [(12, 10), (16, 16), (40, 40)])
def test_windows_against_enumeration(window, span):
    lengths = [1, 2, 3, 5, 8]
    w = bands.Windows(SEQS, window, span)
    sums = w.unpaired(lengths)
    for k, s in enumerate(SEQS):
        size, p, held, free, two = min(window, len(s)), {}, {}, {}, {}
        for a in range(len(s) - size + 1):
            all_of = [(math.exp(-energy(s, x) / bands.KT), x) for x in structures(s, a, a + size - 1, span)]
            z = sum(x for x, _ in all_of)
            for x, pairs in all_of:
                for ij in pairs:
                    p[ij] = p.get(ij, 0) + x / z
                    if (ij[0] + 1, ij[1] - 1) in pairs:
                        two[ij] = two.get(ij, 0) + x / z
                t = brackets(len(s), pairs)
                for u in lengths:
                    for i in range(a, a + size - u + 1):
                        free[i, u] = free.get((i, u), 0) + x / z * (t[i : i + u] == "." * u)
            for i in range(a, a + size):
                for j in range(i, a + size):
                    held[i, j] = held.get((i, j), 0) + 1
        got = {(int(i) - 1, int(j) - 1): x for i, j, x in w.pairs(k, 1e-12).T}
        for ij in set(p) | set(got):
            assert got.get(ij, 0) == pytest.approx(p.get(ij, 0) / held[ij], abs=1e-9)
        got = {(int(i) - 1, int(j) - 1): x for i, j, x in w.stacks(k, 1e-12).T}
        assert got == pytest.approx({ij: x / held[ij] for ij, x in two.items()}, abs=1e-9)
        got = {(int(i) - 1, int(u)): x for i, u, x in w.stretches(k, lengths, sums).T}
        assert set(got) == set(free)
        for (i, u), x in free.items():
            assert got[i, u] == pytest.approx(x / held[i, i + u - 1], abs=1e-9)


def test_local_energy_against_enumeration():
    rng = random.Random(7)
    for s in [*SEQS, *(letters_of(rng, 17) for _ in range(6))]:
        for span in (5, 9, 30):
            assert windowed.local_hits(s, span)[0] == min(energy(s, x) for x in structures(s, 0, len(s) - 1, span))


def test_hits_and_borders_of_tiles(monkeypatch):
    rng = random.Random(3)
    for n, span in ((60, 30), (80, 79), (25, 40), (6, 5), (120, 20)):
        s = letters_of(rng, n)
        best, hits = windowed.local_hits(s, span)
        for i, j, e, text in hits:
            assert Loops("." * (i - 1) + text + "." * (n - j), s).energies()[1].sum() == e and j - i <= span and len(text) == j - i + 1
            assert text[0] == "(" and text[-1] == ")" and text.count("(") == text.count(")")
        for tile in (7, 16, 33):
            monkeypatch.setattr(windowed, "TILE", tile)
            assert windowed.local_hits(s, span) == (best, hits)
        monkeypatch.undo()


def test_tables_equal_those_by_cells():
    rng = random.Random(1)
    seqs = [letters_of(rng, n) for n in (30, 29, 27, 12)]
    low, total = folding.Tables(seqs, folding.Minimum), folding.Tables(seqs, folding.Sum)
    a, b = bands.Bands(seqs, 30, bands.Minimum), bands.Bands(seqs, 30, bands.Sum, -0.3)
    for k, s in enumerate(seqs):
        for d in range(4, len(s)):
            i = np.arange(1, len(s) - d + 1)
            got = a.c[d, a.starts[k] :][: len(i)].astype(float)
            assert (np.where(got >= bands.Minimum.zero, np.inf, got) == low.c[i, i + d, k]).all()
            assert b.c[d, b.starts[k] :][: len(i)] * math.exp(0.3 * (d + 1)) == pytest.approx(total.c[i, i + d, k], rel=1e-9)


def test_sums_of_long_sequences_are_finite(spark):
    s = "G" * 500 + "AAAA" + "C" * 500
    row = folding.fold(spark.createDataFrame([(1, s)], "doc_id long, seq string")).first()
    assert row["structure"] == "(" * 500 + "AAAA".replace("A", ".") + ")" * 500 and math.isfinite(row["free_energy"]) and row["free_energy"] <= row["mfe"]


def test_most_accurate_equals_that_by_cells():
    rng = random.Random(4)
    seqs = [letters_of(rng, rng.randint(1, 40)) for _ in range(12)]
    w = bands.Windows(seqs, 40, 40)
    for k, (text, accuracy) in enumerate(w.most_accurate()):
        p = np.zeros((len(seqs[k]) + 2,) * 2)
        i, j, x = w.pairs(k, 0.0)
        p[i.astype(int), j.astype(int)] = x
        assert folding.most_accurate(p) == (text, pytest.approx(accuracy, abs=1e-9))


def test_rows_of_windows(spark, monkeypatch):
    rng = random.Random(9)
    long = letters_of(rng, 150)
    rows = [(1, None), (2, ""), (3, "ACGU"), (None, SEQS[0]), (4, long), (4, long)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, seq string, i int, p string")
    table = lambda x: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()), key=str)
    folds = table(windowed.local_folds(df, 20))
    pairs, free = table(windowed.window_pairs(df, 25, 20)), table(windowed.accessibilities(df, [1, 4], 25, 20))
    assert len([r for r in free if r[0] == 4]) == 2 * (150 + 147) and {r[0] for r in pairs} == {None, 4}
    totals = {r["doc_id"]: r["energy"] for r in windowed.local_energy(df, 20).collect()}
    assert totals[4] == windowed.local_hits(long, 20)[0] and totals[1] == totals[2] == totals[3] == 0
    lines = windowed.accessibility_lines(windowed.accessibilities(df.filter("doc_id = 3"), [1, 4], 25, 20), [1, 4]).orderBy("i").collect()
    assert [r["line"].split("\t")[0] for r in lines] == ["1", "2", "3", "4"] and lines[0]["line"].endswith("NA") and lines[3]["line"] == "4\t1.000000\t1.000000"
    assert windowed.local_folds(df.limit(0)).collect() == []
    w = [r[1:] for r in pairs if r[0] == 4][::2]
    monkeypatch.setattr(windowed, "TILE", 40)
    got = [(int(y[0, x]), int(y[1, x] + f), round(float(y[2, x]), 9)) for _, y, f in windowed._windows([df.filter("doc_id = 4").limit(1).select(df.doc_id.alias("key"), "seq").toPandas()], 25, 20, lambda v: lambda x: v.pairs(x, 0.01)) for x in range(y.shape[1])]
    assert sorted(got) == sorted(w)
    assert folds


def test_without_dangling_ends(spark):
    rows = [(k, s) for k, s in enumerate(SEQS)]
    df = spark.createDataFrame(rows, "doc_id long, seq string")
    got = {r["doc_id"]: r for r in folding.fold(df, dangles=0).collect()}
    local = {r["doc_id"]: r["energy"] for r in windowed.local_energy(df, 30, dangles=0).collect()}
    for k, s in rows:
        all_of = [int(Loops(brackets(len(s), x), s, 0).energies()[1].sum()) if x else 0 for x in structures(s, 0, len(s) - 1, len(s))]
        assert got[k]["mfe"] == local[k] == min(all_of)
        assert got[k]["free_energy"] == pytest.approx(-bands.KT * math.log(sum(math.exp(-e / bands.KT) for e in all_of)))
    # By hand: a multiloop of three stems without and with the ends of its stems.
    assert Loops(".(((....))((....))).", "ACCCAAAAGGCCAAAAGGGC", 2).energies()[1].sum() == 400
    bare = 930 - 3 * 90
    loops = dict(zip(*(x.tolist() for x in Loops(".(((....))((....))).", "ACCCAAAAGGCCAAAAGGGC", 0).energies())))
    assert loops[3] == bare and loops[0] == 0
