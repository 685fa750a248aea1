"""Bands of structures, constraints, local minima, tree distances and duplexes against brute force."""

from functools import lru_cache

import numpy as np
from test_energy import SEQS, by_hand, every_structure

from foldlake.functions.sequence import PAIR_TYPES
from foldlake.operators import energy as en
from foldlake.operators import folding, landscape
from foldlake.operators import parameters as par
from test_library import by_stack


def test_bands_hold_every_structure_once(spark):
    d = spark.createDataFrame([(k, s) for k, s in enumerate(SEQS)] + [(98, ""), (99, None)], "doc_id long, seq string")
    rows = landscape.suboptimals(d, 600)
    got = sorted((r["doc_id"], r["structure"], r["energy"]) for r in rows.collect())
    wanted = [(98, "", 0), (99, "", 0)]
    for k, s in enumerate(SEQS):
        e = {x: by_hand(s, x) for x in every_structure(s)}
        wanted += [(k, x, v) for x, v in e.items() if v <= min(e.values()) + 600]
    assert got == sorted(wanted)
    n = {(r["doc_id"], r["bin"]): r["n_structures"] for r in landscape.density_of_states(rows).collect()}
    low = {k: min(e for q, _, e in got if q == k) for k, _, _ in got}
    assert sum(n.values()) == len(got) and all(n[k, (e - low[k]) // 10] > 0 for k, _, e in got)


def test_constraints(spark):
    def fits(c, x):
        pairs, held = by_stack(x), by_stack("".join(k if k in "()" else "." for k in c))
        for i, j in pairs:
            a, b = c[i - 1], c[j - 1]
            if "x" in (a, b) or a == ">" or b == "<":
                return False
            for p, q in held:
                if (i, j) != (p, q) and ({i, j} & {p, q} or (p < i < q) != (p < j < q)):
                    return False
        return True

    cases = [(s, c.ljust(len(s), ".")[: len(s)]) for s in SEQS if len(s) > 9 for c in ("", "xx", "..<<>>", ".(......)", "(.......)")]
    rows = [(k, s, c) for k, (s, c) in enumerate(cases)] + [(90, SEQS[0], None), (91, None, "((")]
    got = {r["doc_id"]: r for r in folding.fold(spark.createDataFrame(rows, "doc_id long, seq string, limit string"), constraint="limit").collect()}
    for k, (s, c) in enumerate(cases):
        assert got[k]["mfe"] == min(by_hand(s, x) for x in every_structure(s) if fits(c, x)) == by_hand(s, got[k]["structure"]) and fits(c, got[k]["structure"])
    assert got[90]["structure"] == got[0]["structure"] and got[91]["structure"] == ""


def test_local_minima(spark):
    rows = [(k, s, x) for k, s in enumerate(SEQS[:4]) for x in ("." * len(s), every_structure(s)[-1])] + [(90, None, None), (91, "ACGU", None)]
    d = spark.createDataFrame(rows, "doc_id long, seq string, structure string")
    for r in landscape.local_minima(d).collect():
        s = SEQS[r["doc_id"]] if r["doc_id"] < 90 else ""
        if s:
            near = [x for x in every_structure(s) if len(set(by_stack(x)) ^ set(by_stack(r["minimum"]))) == 1]
            assert r["energy"] == by_hand(s, r["minimum"]) <= min((by_hand(s, x) for x in near), default=0)


def forest(text):
    """Nested tuples of a structure: '' for an unpaired position, a tuple of children for a pair."""
    out = [[]]
    for c in text:
        if c == "(":
            out.append([])
        elif c == ")":
            inner = tuple(out.pop())
            out[-1].append(inner)
        else:
            out[-1].append("")
    return tuple(out[0])


@lru_cache(None)
def apart(f, g):
    """Edit distance of two forests by its recursion on the last trees."""
    if not f and not g:
        return 0
    cost = lambda t: 1 if t == "" else 2
    out = []
    if f:
        out.append(apart(f[:-1] + tuple(f[-1]), g) + cost(f[-1]))
    if g:
        out.append(apart(f, g[:-1] + tuple(g[-1])) + cost(g[-1]))
    if f and g:
        out.append(apart(f[:-1], g[:-1]) + apart(tuple(f[-1]), tuple(g[-1])) + (cost(f[-1]) != cost(g[-1])))
    return min(out)


def test_tree_distances(spark):
    texts = ["", "...", "(...)", "((...))", "(.(...).)", "((..)(..))", "(..)..(..)", ".((((...).)..))"]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in texts for b in texts)] + [(99, None, "(...)")]
    got = {r["doc_id"]: r["distance"] for r in landscape.tree_distances(spark.createDataFrame(rows, "doc_id long, a string, b string"), "a", "b").collect()}
    assert got == {k: apart(forest(a or ""), forest(b or "")) for k, a, b in rows}


def plain_alignment(x, y, drop, change):
    d = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) + 1):
        for j in range(len(y) + 1):
            if i or j:
                d[i][j] = min(([d[i - 1][j] + drop(x[i - 1])] if i else []) + ([d[i][j - 1] + drop(y[j - 1])] if j else []) + ([d[i - 1][j - 1] + change(x[i - 1], y[j - 1])] if i and j else []))
    return d[-1][-1]


def test_string_and_profile_distances(spark):
    def tokens(text):
        return [c for x in text for c in {"(": ["<P"], ")": [">P"], ".": ["<U", ">U"]}[x]]

    texts = ["", "...", "(...)", "((...))", "((..)(..))", ".((((...).)..))"]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in texts for b in texts)] + [(99, None, "(...)")]
    got = {r["doc_id"]: r["distance"] for r in landscape.string_distances(spark.createDataFrame(rows, "doc_id long, a string, b string"), "a", "b").collect()}
    drop = lambda t: 1.0 if "P" in t else 0.5
    change = lambda t, u: 1e9 if t[0] != u[0] else 0.5 * (t != u)
    assert got == {k: plain_alignment(tokens(a or ""), tokens(b or ""), drop, change) for k, a, b in rows}
    pairs = [(k, a, b) for k, (a, b) in enumerate(zip(SEQS, SEQS[1:]))] + [(98, SEQS[0], SEQS[0]), (99, None, "ACG")]
    d = spark.createDataFrame(pairs, "doc_id long, a string, b string")
    got = {r["doc_id"]: r["distance"] for r in landscape.profile_distances(d, "a", "b").collect()}

    def profile(s):
        every = {x: np.exp(-by_hand(s, x) / folding.KT) for x in every_structure(s)}
        z = sum(every.values())
        return [tuple(sum(w for x, w in every.items() if x[i] == c) / z for c in ".()") for i in range(len(s))]

    for k, a, b in pairs:
        wanted = plain_alignment(profile(a or ""), profile(b), sum, lambda p, q: 2 - 2 * sum(np.sqrt(x * y) for x, y in zip(p, q)))
        assert abs(got[k] - wanted) < 1e-6
    assert abs(got[98]) < 1e-6 and got[99] == 3


def test_stack_energies(spark):
    def bonus(x, e):
        pairs = set(by_stack(x))
        return sum(e[i - 1] + e[j - 1] + e[i] + e[j - 2] for i, j in pairs if (i + 1, j - 1) in pairs)

    rng = np.random.default_rng(9)
    rows = [(k, s, [int(v) for v in rng.integers(-150, 150, len(s))]) for k, s in enumerate(SEQS)]
    d = spark.createDataFrame(rows + [(98, "GGGAAAUCCC", None), (99, None, [1])], "doc_id long, seq string, e array<int>")
    got = {r["doc_id"]: r for r in folding.fold(d, stacked="e").collect()}
    for k, s, e in rows:
        energies = {x: by_hand(s, x) + bonus(x, e) for x in every_structure(s)}
        assert got[k]["mfe"] == min(energies.values()) == energies[got[k]["structure"]]
        z = sum(np.exp(-v / folding.KT) for v in energies.values())
        assert abs(got[k]["free_energy"] + folding.KT * np.log(z)) < 1e-6
    assert got[98]["mfe"] == min(by_hand("GGGAAAUCCC", x) for x in every_structure("GGGAAAUCCC")) and got[99]["structure"] == ""


def every_duplex(a, b, i=0, j=None):
    """All chains of pairs (0-based) that rise in a and fall in b."""
    j = len(b) if j is None else j
    yield ()
    for p in range(i, len(a)):
        for q in range(j):
            if a[p] + b[q] in PAIR_TYPES:
                for rest in every_duplex(a, b, p + 1, q):
                    yield ((p, q), *rest)


def test_duplexes(spark):
    rng = np.random.default_rng(4)
    cases = [tuple("".join(rng.choice(list("ACGU"), n)) for n in sizes) for sizes in ((4, 4), (5, 6), (7, 6), (6, 7))] + [("GGAC", "GUCC"), ("AAA", "GGG")]
    rows = [(k, *c) for k, c in enumerate(cases)] + [(98, None, "A"), (99, "", "")]
    got = {r["doc_id"]: r for r in landscape.duplexes(spark.createDataFrame(rows, "doc_id long, a string, b string"), "a", "b").collect()}
    for k, (a, b) in enumerate(cases):
        code = lambda s, x: "ACGU".index(s[x]) + 1 if 0 <= x < len(s) else 5
        low = None
        for pairs in every_duplex(a, b):
            if not pairs:
                continue
            t = [PAIR_TYPES[a[p] + b[q]] for p, q in pairs]
            (p, q), (r, s) = pairs[0], pairs[-1]
            e = 410 + par.EXTERIOR_STEM[t[0], code(a, p - 1), code(b, q + 1)] + par.EXTERIOR_STEM[par.TURNED[t[-1]], code(b, s - 1), code(a, r + 1)]
            for (p, q), (r, s), x, y in zip(pairs, pairs[1:], t, t[1:]):
                e += int(en.interior(r - p - 1, q - s - 1, x, par.TURNED[y], code(a, p + 1), code(b, q - 1), code(a, r - 1), code(b, s + 1)))
            low = e if low is None else min(low, e)
        assert got[k]["energy"] == low
    assert got[4]["structure"] == "((((&))))" and got[5]["energy"] is got[98]["energy"] is got[99]["structure"] is None


def test_text_records(spark, tmp_path):
    from foldlake.sources import fasta, records

    (tmp_path / "a.maf").write_text("##maf version=1\n\na score=1\ns x.1 0 4 + 100 AC-GU\ns y.1 7 5 - 50 ACGGU\n\na score=2\ns x.1 9 1 + 100 A\ni x.1 N 0\n")
    r = sorted((x["aln"], x["row"], x["name"], x["start"], x["strand"], x["seq"]) for x in records.read_maf(spark, str(tmp_path / "a.maf")).collect())
    assert [x[2:] for x in r] == [("x.1", 0, "+", "AC-GU"), ("y.1", 7, "-", "ACGGU"), ("x.1", 9, "+", "A")] and len({x[0] for x in r}) == 2
    (tmp_path / "p.txt").write_text("ACGU\n# no\n\nGG&CC\n>head\n((..))\n")
    assert sorted(x["seq"] for x in records.read_plain(spark, str(tmp_path / "p.txt")).collect()) == ["ACGU", "GG&CC"]
    (tmp_path / "f.fa").write_text(">s1 one\nACG\n* note\nUU\n.(.).\n>s2\n/ x\nGG\n")
    assert sorted((x["id"], x["seq"]) for x in fasta.read_fasta(spark, str(tmp_path / "f.fa")).collect()) == [("s1", "ACGUU"), ("s2", "GG")]
    d = spark.createDataFrame([("a", "AC-G"), ("a", "ACG"), ("b", "AC"), ("b", "GG"), ("c", None), ("c", "")], "aln string, seq string")
    assert sorted(map(tuple, records.alignment_faults(d).collect())) == [("a", 2, None, 0), ("c", 2, 0, 2)]
    x = spark.createDataFrame([("((...))", -120)], "structure string, mfe long")
    assert x.select(records.energy_text(x.structure, x.mfe)).first()[0] == "((...)) ( -1.20)"
    assert records.fold_json(x).first()[0] == '{"structure":"((...))","mfe":-120}'
