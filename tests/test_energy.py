"""Loop energies, folding and sampling against every structure of short sequences."""

import math
from collections import Counter

import numpy as np

from foldlake.functions.sequence import PAIR_TYPES
from foldlake.operators import energy as en
from foldlake.operators import folding
from foldlake.operators import parameters as par


def every_structure(s, i=0, j=None):
    """All dot-brackets of s[i:j] with hairpins of three or more."""
    j = len(s) if j is None else j
    if i >= j:
        return [""]
    out = ["." + x for x in every_structure(s, i + 1, j)]
    for k in range(i + 4, j):
        if s[i] + s[k] in PAIR_TYPES:
            out += [f"({x}){y}" for x in every_structure(s, i + 1, k) for y in every_structure(s, k + 1, j)]
    return out


def by_hand(s, structure):
    """Energy of one structure by a walk over its loops; None where an interior loop is too long."""
    partner, opened = {}, []
    for x, c in enumerate(structure):
        if c == "(":
            opened.append(x)
        elif c == ")":
            partner[opened.pop()] = x
    t = lambda a, b: PAIR_TYPES.get(s[a] + s[b], 7)
    code = lambda k: " ACGU".index(s[k]) if 0 <= k < len(s) else 5
    au = lambda a, b: 50 if t(a, b) > 2 else 0
    stem = lambda a, b: par.EXTERIOR_STEM[t(a, b), code(a - 1), code(b + 1)]

    def inside(a, b):
        found, x = [], a
        while x < b:
            if x in partner:
                found.append((x, partner[x]))
                x = partner[x]
            x += 1
        return found

    def facing(table, a, b):
        return table[t(a, b), code(a + 1), code(b - 1)]

    total = sum(stem(*p) for p in inside(0, len(s)))
    for i, j in partner.items():
        stems, n = inside(i + 1, j), j - i - 1
        if not stems:
            total += par.SPECIAL_HAIRPINS.get(s[i : j + 1], par.HAIRPIN[n] + (au(i, j) if n == 3 else facing(par.HAIRPINS, i, j)))
        elif len(stems) == 1:
            (p, q), = stems
            a, b = p - i - 1, j - q - 1
            inner = PAIR_TYPES.get(s[q] + s[p], 7)
            back = lambda table: table[inner, code(q + 1), code(p - 1)]  # noqa: B023, E731
            if a + b > 30:
                return None
            if a + b <= 1:
                total += par.STACK[t(i, j) - 1][inner - 1] + (380 if a + b else 0)
            elif a == 0 or b == 0:
                total += par.BULGE[a + b] + au(i, j) + au(p, q)
            elif (a, b) == (1, 1):
                total += par.ONE_ONE[t(i, j), inner, code(i + 1), code(j - 1)]
            elif (a, b) == (1, 2):
                total += par.ONE_TWO[t(i, j), inner, code(i + 1), code(q + 1), code(j - 1)]
            elif (a, b) == (2, 1):
                total += par.ONE_TWO[inner, t(i, j), code(q + 1), code(i + 1), code(p - 1)]
            elif min(a, b) == 1:
                total += par.INTERIOR[a + b] + min(300, 60 * abs(a - b)) + 70 * ((t(i, j) > 2) + (inner > 2))
            else:
                table = par.TWO_THREE if a + b == 5 else par.LONG
                total += par.INTERIOR[a + b] + min(300, 60 * abs(a - b)) + facing(table, i, j) + back(table)
        else:
            closing = par.EXTERIOR_STEM[PAIR_TYPES.get(s[j] + s[i], 7), code(j - 1), code(i + 1)]
            total += 930 - 90 * (len(stems) + 1) + closing + sum(stem(*p) for p in stems)
    return total


SEQS = ["GGGAAAUCCC", "GGAAACGAAAGC", "GCGAAAGCAGCAAAGC", "GGCAAAGCGCAAAGCC", "GACGAAACAGCAAAGUC", "AAAA", "GGGGAAAACCCC", "GCUAAAGAAACCGUUGC", "GGCCUUCGGGUC", "GACAGUGAUGUC", "CGUUACGAGCAAAC"]


def test_energies_of_every_structure(spark):
    rows = [(k, s, x) for k, (s, x) in enumerate((s, x) for s in SEQS for x in every_structure(s))]
    got = {r["doc_id"]: r["energy"] for r in en.structure_energy(spark.createDataFrame(rows, "doc_id long, seq string, structure string")).collect()}
    assert got == {k: by_hand(s, x) for k, s, x in rows}
    assert any(len(s) > 14 and "(" in x for _, s, x in rows)


#: Structures with energies worked out by hand from the parameters, with dangling ends on both sides.
KNOWN = [
    ("ACCCAAAAGGCCAAAAGGGC", ".(((....))((....))).", 400),
    ("ACACAAAAAUGUUACAAAAGUCCGA", ".(.((....))..((....))..).", 800),
    ("AAACAAAAAUGUUACAAAAGUCCUA", ".(.((....))..((....))..).", 960),
    ("ACACAAAAAUGUUACAAAAGUCCAAAAGGCGA", ".(.((....))..((....))((....)).).", 740),
    ("CAAAAAAG", "(......)", -150 + 540),
    ("CCAAAAAAGG", "((......))", -330 - 150 + 540),
    ("GAAAAAACCC", "(........)", 550 - 150),
    ("CACAAAAAAGAG", "(.(......).)", 90 - 150 + 540),
    ("CAGCAAAAAAGAUG", "((.(......).))", -210 + 120 - 150 + 540),
    ("CUAAAAAAAUCAG", "(.(......)..)", 300 - 80 + 50 + 540),
    ("UGCAAAAAAAUGA", "(..(......).)", 50 + 260 - 80 + 50 + 540),
]


def test_known_energies(spark):
    d = spark.createDataFrame([(k, s, x) for k, (s, x, _) in enumerate(KNOWN)], "doc_id long, seq string, structure string")
    got = {r["doc_id"]: r["energy"] for r in en.structure_energy(d).collect()}
    assert got == {k: e for k, (_, _, e) in enumerate(KNOWN)} == {k: by_hand(s, x) for k, (s, x, _) in enumerate(KNOWN)}
    best = folding.fold(spark.createDataFrame([(1, "CGCAGGGAUACCCGCG")], "doc_id long, seq string")).first()
    assert best["structure"] == "(((.(((...))))))"


def test_move_energies(spark):
    s, x = "GGGAAAUCCCA", "((......))."
    moves = [(1, 10), (-1, -10), (-2, -9), (3, 8), (2, 9), (11, 12)]
    d = spark.createDataFrame([(1, s, x, moves), (2, s, x, []), (3, None, None, None)], "doc_id long, seq string, structure string, moves array<struct<i int, j int>>")
    got = {(r["i"], r["j"]): r["change"] for r in en.move_energies(d).collect()}
    e = by_hand(s, x)
    assert got == {(1, 10): None, (2, 9): None, (11, 12): None, (-1, -10): by_hand(s, ".(......)..") - e, (-2, -9): by_hand(s, "(........).") - e, (3, 8): by_hand(s, "(((....))).") - e}


def test_long_loops(spark):
    s = "G" + "A" * 35 + "C"
    d = spark.createDataFrame([(1, s, "(" + "." * 35 + ")"), (2, "GCAAC", "((.))"), (3, "", ""), (4, None, None)], "doc_id long, seq string, structure string")
    got = {r["doc_id"]: r["energy"] for r in en.structure_energy(d).collect()}
    assert got[1] == 770 + int(107.856 * math.log(35 / 30)) - 110 and got[2] == par.FORBIDDEN + par.STACK[1][6] and got[3] == got[4] == 0


def test_fold_against_every_structure(spark):
    d = spark.createDataFrame([(k, s) for k, s in enumerate(SEQS)] + [(98, ""), (99, None), (97, "NNNNNNNN")], "doc_id long, seq string")
    got = {r["doc_id"]: r for r in folding.fold(d).collect()}
    for k, s in enumerate(SEQS):
        energies = [by_hand(s, x) for x in every_structure(s)]
        z = sum(math.exp(-e / folding.KT) for e in energies)
        assert got[k]["mfe"] == min(energies) == by_hand(s, got[k]["structure"])
        np.testing.assert_allclose(got[k]["free_energy"], -folding.KT * math.log(z), atol=1e-9)
        np.testing.assert_allclose(got[k]["frequency"], math.exp(-min(energies) / folding.KT) / z)
    assert [got[k]["structure"] for k in (97, 98, 99)] == ["." * 8, "", ""] and got[99]["mfe"] == 0


def test_best_structure_of_longer_sequences(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "".join(rng.choice(list("ACGU"), n))) for k, n in enumerate([30, 45, 45, 60, 60, 80])]
    for r in folding.fold(spark.createDataFrame(rows, "doc_id long, seq string")).collect():
        assert by_hand(rows[r["doc_id"]][1], r["structure"]) == r["mfe"] and 0 < r["frequency"] <= 1


def test_samples_follow_the_weights(spark):
    s, n = "GGGAAAUCCC", 3000
    d = spark.createDataFrame([(1, s), (2, "")], "doc_id long, seq string")
    rows = folding.sampled_structures(d, n).collect()
    seen = Counter(r["structure"] for r in rows if r["doc_id"] == 1)
    weights = {x: math.exp(-by_hand(s, x) / folding.KT) for x in every_structure(s)}
    z = sum(weights.values())
    assert set(seen) <= set(weights) and len(rows) == 2 * n
    for x, w in weights.items():
        assert abs(seen[x] / n - w / z) < 0.04
    assert sorted(map(tuple, folding.sampled_structures(d.repartition(3), n).collect())) == sorted(map(tuple, rows))


def test_pair_probabilities_against_every_structure(spark):
    from test_library import by_stack

    d = spark.createDataFrame([(k, s) for k, s in enumerate(SEQS)] + [(98, ""), (99, None)], "doc_id long, seq string")
    for r in folding.ensembles(d, cutoff=1e-12).collect():
        s = SEQS[r["doc_id"]] if r["doc_id"] < 90 else ""
        every = [x for x in every_structure(s) if by_hand(s, x) is not None]
        w = np.array([math.exp(-by_hand(s, x) / folding.KT) for x in every])
        w /= w.sum()
        p = Counter()
        for x, v in zip(every, w):
            for q in by_stack(x):
                p[q] += v
        got = {(x["i"], x["j"]): x["p"] for x in r["pairs"]}
        for q in set(p) | set(got):
            assert math.isclose(p[q], got.get(q, 0), rel_tol=1e-9, abs_tol=1e-11)
        assert by_stack(r["centroid"]) == sorted(q for q in p if p[q] > 0.5)
        free = {k: 1 - sum(v for q, v in p.items() if k in q) for k in range(1, len(s) + 1)}
        gain = lambda x: sum(2 * p[q] for q in by_stack(x)) + sum(free[k] for k, c in enumerate(x, 1) if c == ".")
        assert math.isclose(r["accuracy"], max(map(gain, every)), abs_tol=1e-9) and math.isclose(gain(r["mea"]), r["accuracy"], abs_tol=1e-9)
        assert len(r["symbols"]) == len(s) and math.isclose(r["diversity"], 2 * sum(v * (1 - v) for v in p.values()), abs_tol=1e-9)


def test_long_sequence_in_bounded_memory(monkeypatch):
    rng = np.random.default_rng(6)
    seqs = ["".join(rng.choice(list("ACGU"), 90)) for _ in range(5)]
    whole = [list(g) for g in folding._groups(seqs)]
    monkeypatch.setattr(folding, "CELLS", 2 * 92**2)
    assert [len(g) for g in whole] == [5] and [len(g) for g in folding._groups(seqs)] == [2, 2, 1]
    assert [len(g) for g in folding._groups(["A" * 3000] * 3)] == [1, 1, 1]


def test_lengths_together_change_nothing():
    rng = np.random.default_rng(8)
    seqs = ["".join(rng.choice(list("ACGU"), n)) for n in (0, 1, 3, 20, 21, 24, 24, 27, 29)]
    alone = [folding.Tables([s], folding.Sum).f[-1, 0] if s else 1 for s in seqs]
    together = folding.Tables(seqs, folding.Sum)
    np.testing.assert_allclose(together.f[-1], alone)
    assert sorted(k for g in folding._groups(seqs) for k in g) == list(range(9)) and [len(g) for g in folding._groups(seqs)] == [3, 6]
