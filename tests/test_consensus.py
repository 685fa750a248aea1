"""Folds of alignments against every structure of small ones, energies added row by row and loop by loop."""

import math
import random

import numpy as np
import pytest

from foldlake.operators import consensus, parameters as par
from foldlake.operators.bands import KT, Minimum
from foldlake.operators.energy import Loops, interior


def every(may, i, j):
    """All sets of pairs (from 1) of columns i to j that may form."""
    if j - i < 4:
        yield ()
        return
    yield from every(may, i + 1, j)
    for k in range(i + 4, j + 1):
        if may(i, k):
            for x in every(may, i + 1, k - 1):
                for y in every(may, k + 1, j):
                    yield ((i, k), *x, *y)


def row_energy(row, pairs):
    """Energy of one row: loops of the columns' pairs, its gaps left out."""
    n = len(row)
    gap = lambda c: row[c - 1] in "-."
    code = lambda c: par.CODE_OF[ord(row[c - 1])]
    before = lambda c: next((code(x) for x in range(c - 1, 0, -1) if not gap(x)), 5)
    after = lambda c: next((code(x) for x in range(c + 1, n + 1) if not gap(x)), 5)
    kind = lambda i, j: par.TYPE_OF[code(i), code(j)]
    inside = lambda i, j: sum(not gap(x) for x in range(i + 1, j))
    total = 0
    for i, j in [(0, n + 1), *pairs]:
        own = [(p, q) for p, q in pairs if i < p and q < j and not any(i < a < p and q < b < j for a, b in pairs)]
        if not i:
            total += sum(par.EXTERIOR_STEM[kind(p, q), before(p), after(q)] for p, q in own)
        elif not own:
            size = inside(i, j)
            e = par.by_size(par.HAIRPIN, max(size, 3)) + (par.NO_AU[kind(i, j)] if size == 3 else par.HAIRPINS[kind(i, j), after(i) % 5, before(j) % 5])
            word = "".join(row[x - 1] for x in range(i, j + 1) if not gap(x))
            if not gap(i) and not gap(j):
                e = par.SPECIAL_HAIRPINS.get(word, e)
            total += 600 if size < 3 else e
        elif len(own) == 1:
            p, q = own[0]
            total += int(interior(*[np.array([v]) for v in (inside(i, p), inside(q, j), kind(i, j), par.TURNED[kind(p, q)], after(i) % 5, before(j) % 5, before(p) % 5, after(q) % 5)])[0])
        else:
            total += par.MULTI_CLOSING + par.MULTI_STEMS[par.TURNED[kind(i, j)], before(j), after(i)] + sum(par.MULTI_STEMS[kind(p, q), before(p), after(q)] for p, q in own)
    return int(total)


CASES = [
    ["GGGAAACCC", "GCGAAACGC", "AGGA-ACCU"],
    ["GGCGAAAGCAGGAAACCACC", "GGCGAAAGCAGGAAACCACC", "GACG-AAGCAGCAAAGCAUC"],
    ["GGGGAAAACC-CC", "GG-GAAAACCUCC", "GGGGAAAACC", "CCGGAAAACCUGG"],
    ["GGGAAACCC"],
]


@pytest.mark.parametrize("rows", CASES)
def test_against_every_structure(rows):
    n = max(map(len, rows))
    full = [r.ljust(n, "-") for r in rows]
    table = consensus.scores(np.array([par.CODE_OF[np.frombuffer(r.encode(), np.uint8)] for r in full]))
    score = lambda i, j: int(table[j - i, i - 1])
    all_of = {x: sum(row_energy(r, x) for r in full) - sum(score(*p) for p in x) for x in every(lambda i, j: score(i, j) >= consensus.LOWEST, 1, n)}
    text, energy, part, free, mean, index = consensus.fold_alignment(rows)
    assert energy * len(rows) == pytest.approx(min(all_of.values()))
    stack, pairs = [], []
    for k, c in enumerate(text, 1):
        if c == "(":
            stack.append(k)
        elif c == ")":
            pairs.append((stack.pop(), k))
    assert all_of[next(x for x in all_of if set(x) == set(pairs))] == pytest.approx(energy * len(rows))
    assert part * len(rows) == pytest.approx(-sum(score(*p) for p in pairs))
    assert free == pytest.approx(-KT * math.log(sum(math.exp(-e / (KT * len(rows))) for e in all_of.values())))


def test_one_row_is_a_plain_fold():
    rng = random.Random(2)
    for _ in range(5):
        s = "".join(rng.choice("ACGU") for _ in range(24))
        low = consensus.Consensus([s], Minimum, cv=0.0)
        assert Loops(low.structure(), s).energies()[1].sum() == low.f[1]


def test_rows_of_alignments(spark):
    rows = [(1, r, 0) for r in CASES[0]] + [(None, CASES[3][0], 0), (2, None, 0), (2, "", 0), (3, "acg", 0), (3, None, 0)]
    df = spark.createDataFrame(rows, "aln long, seq string, rows int")
    got = {r["aln"]: r for r in consensus.fold_alignments(df).collect()}
    assert got[1]["structure"] == "(((...)))" and got[1]["n_seq"] == 3 and got[1]["conservation"] > 0
    assert got[None]["structure"] == "(((...)))" and got[None]["energy"] == got[None]["mean_energy"]
    assert got[2]["structure"] == "" and got[3]["structure"] == "..." and got[3]["conservation"] is None
    assert consensus.fold_alignments(df.limit(0)).collect() == []
