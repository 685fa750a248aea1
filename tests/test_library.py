"""Library queries against their SQL, and small golden cases."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldlake.functions import sequence as fs
from foldlake.operators import matching, structure
from foldlake.plans import registry
from foldlake.sources import fasta

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def tidy(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    a, b = tidy(registry.queries()[name](spark, SF).toPandas()), tidy(duck.execute(registry.oracle_sql()[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]):
            np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9)
        else:
            assert list(a[c]) == list(b[c])


def brute_matching(s, min_loop=3):
    best = [[0] * (len(s) + 2) for _ in range(len(s) + 2)]
    for j in range(1, len(s) + 1):
        for i in range(j - min_loop - 1, 0, -1):
            best[i][j] = max([best[i][j - 1]] + [best[i][k - 1] + 1 + best[k + 1][j - 1] for k in range(i, j - min_loop) if s[k - 1] + s[j - 1] in fs.PAIR_TYPES])
    return best[1][len(s)] if s else 0


def test_maximum_matching(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("ACGU"), n))) for i, n in enumerate([0, 1, 4, 5, 9, 9, 20, 33])] + [(99, None)]
    got = {r[0]: r[1] for r in matching.maximum_matching(spark.createDataFrame(rows, "doc_id long, seq string")).collect()}
    assert got == {i: brute_matching(s or "") for i, s in rows}


def test_pair_table_of_known_structure(spark):
    d = spark.createDataFrame([(1, "((..))."), (2, "..."), (3, "")], "doc_id long, structure string")
    assert sorted(map(tuple, structure.pairs(d).collect())) == [(1, 1, 6), (1, 2, 5)]
    assert [tuple(r) for r in structure.helices(d).collect()] == [(1, 1, 6, 2)]


def test_fasta_and_commands(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACG\nUU\n>s2\n;note\nGGG CC\n")
    got = sorted((r["id"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect())
    assert got == [("s1", "ACGUU"), ("s2", "GGGCC")]
    c = fasta.parse_commands(spark.createDataFrame([("P 1-2 8",), ("F 3 9 2",), ("junk",)], "value string"))
    assert sorted(map(tuple, c.select("command", "i", "j").collect())) == [("F", 3, 9), ("P", 1, 8), ("P", 2, 8)]
    assert sorted(map(tuple, fasta.stacked_pairs(c.filter("command = 'F'")).collect())) == [("F", 3, 9), ("F", 4, 8)]


def test_folding_queries_cover_whole_texts(spark, tmp_path):
    texts = {1: "gggg aaaa bbbb" * 12, 2: "Acg!", 3: "", 4: None, None: "ab" * 35}
    spark.createDataFrame([(i, t, "en", "a") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    code = dict(zip(fs.LETTERS, "ACGU" * 7))
    whole = {i: "".join(code[c] for c in (t or "").lower() if c in code) for i, t in texts.items()}
    cut = {(i, k): s[60 * k : 60 * k + 60] for i, s in whole.items() for k in range(max(1, -(-len(s) // 60)))}
    got = {(r["doc_id"], r["piece"]): r["n_pairs"] for r in registry.maximum_matching(spark, str(tmp_path)).collect()}
    assert got == {k: brute_matching(s) for k, s in cut.items()}
    rows = registry.fold(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["piece"], len(r["structure"])) for r in rows) == sorted((str(i), k, len(s)) for (i, k), s in cut.items())
    pairs = registry.sampled_pairs(spark, str(tmp_path)).collect()
    assert max(r["j"] for r in pairs) > 60 and all((r["i"] - 1) // 60 == (r["j"] - 1) // 60 and whole[r["doc_id"]][r["i"] - 1] + whole[r["doc_id"]][r["j"] - 1] in fs.PAIR_TYPES for r in pairs)
    n = {r["doc_id"]: sum(r[f"n_{b}"] for b in "acgu") for r in registry.queries()["sequence_composition"](spark, str(tmp_path)).collect()}
    assert n == {i: len(s) for i, s in whole.items()}


def by_stack(text, brackets="()"):
    """(i, j) of a dot-bracket string; brackets without a partner are left out."""
    out, opened = [], []
    for k, c in enumerate(text or "", 1):
        if c == brackets[0]:
            opened.append(k)
        elif c == brackets[1] and opened:
            out.append((opened.pop(), k))
    return sorted(out)


def test_structure_arrays_against_a_stack():
    rng = np.random.default_rng(4)
    for n in [0, 1, 2, 5, 30, 200] * 20:
        t = "".join(rng.choice(list("().["), n))
        s, p = structure.Structure(t), by_stack(t)
        assert list(zip(*(x.tolist() for x in s.pairs()))) == p
        inside = [max((k for k in p if k[0] < i and j < k[1]), default=(0, 0))[0] for i, j in p]
        assert s.around().tolist() == inside
        loop = [max((i for i, j in p if i <= k <= j), default=0) for k in range(1, n + 1)]
        assert s.loop().tolist() == [sum(i <= x for i, _ in p) for x in loop]
        helix = [q for q in p if (q[0] - 1, q[1] + 1) not in p]
        assert list(zip(*(x.tolist() for x in s.helices()[:2]))) == helix and s.helices()[2].sum() == len(p)


def test_structure_texts():
    t = "..((..((...)).(((...)))..)).((.(....)))"
    assert structure.element_text(t) == "eeIMmmIHhhhHImIIHhhhHIImmMIeIIiHhhhhHII"
    assert structure.tree_text("(.).") == "((" + "(U)P)" + "(U)" + "R)"
    assert structure.homeomorphic_text(".((..)).") == "((U1)((U2)P2)(U1)R1)"
    assert structure.coarse_text(t) == "(((H)(H)M)((H)B)R)"
    assert structure.element_text(None) == "" and structure.coarse_text("") == "(R)"


def test_structure_rows(spark):
    t = "((.((...))..))"
    d = spark.createDataFrame([(1, t, "([.)]"), (None, None, None), (2, "", ""), (1, t, ")(")], "doc_id long, structure string, i string")
    m = structure.merged_helices(d, 2).collect()
    assert [tuple(r) for r in m] == [(1, 1, 14, 4, 1, 2)] * 2
    assert [tuple(r)[3] for r in structure.merged_helices(d, 1).collect()] == [2, 2] * 2
    assert sorted(map(tuple, structure.knotted_pairs(d, "doc_id", "i").collect())) == [(1, 1, 4, 0), (1, 2, 5, 1)]
    p = d.select(structure.pack(structure.F.col("structure")).alias("p"), structure.F.length("structure").alias("n"), "structure")
    assert all(r[0] == r[1] for r in p.select(structure.unpack(structure.F.col("p"), structure.F.col("n")), "structure").collect())
    assert structure.pair_table(d.limit(0)).count() == 0


def test_record_files(spark, tmp_path):
    from foldlake.sources import records

    (tmp_path / "a.sto").write_text("# STOCKHOLM 1.0\n#=GF ID one\ns1 ACG-\ns2 AC-U\n#=GC SS_cons ....\n\ns1 GG\ns2 CC\n//\n# STOCKHOLM 1.0\nx AAA\n//\n")
    got = sorted((r["name"], r["seq"]) for r in records.read_stockholm(spark, str(tmp_path / "a.sto")).collect())
    assert got == [("s1", "ACG-GG"), ("s2", "AC-UCC"), ("x", "AAA")]
    assert {r["aln"] for r in records.read_stockholm(spark, str(tmp_path / "a.sto")).filter("name <> 'x'").collect()} == {"one"}
    (tmp_path / "a.aln").write_text("CLUSTAL W\n\ns1 ACG- 3\ns2 AC-U 3\n   **\n\ns1 GG 5\ns2 CC 5\n   *\n")
    rows = records.read_clustal(spark, str(tmp_path / "a.aln")).orderBy("row").collect()
    assert [(r["name"], r["seq"]) for r in rows] == [("s1", "ACG-GG"), ("s2", "AC-UCC")]
    (tmp_path / "b.aln").write_text("CLUSTAL W\n\nz UUU\na GGG\n\nz AAA\na CCC\n\nz AUA\na ACC\n")
    rows = records.read_clustal(spark, str(tmp_path / "b.aln")).orderBy("row").collect()
    assert [(r["name"], r["seq"]) for r in rows] == [("z", "UUUAAAAUA"), ("a", "GGGCCCACC")]
    (tmp_path / "r.txt").write_text("1 A 0.5\n2 -999\n3\n4 1.25\njunk\n")
    assert sorted(map(tuple, records.read_reactivities(spark, str(tmp_path / "r.txt")).collect())) == [(1, "A", 0.5), (2, "N", None), (3, "N", None), (4, "N", 1.25)]
    t = structure.connect_table(spark.createDataFrame([(1, "GCAAAGC", "((...))")], "doc_id long, seq string, structure string"))
    assert records.bpseq_lines(t).filter("i = 2").first()["line"] == "2 C 6"
    records.connect_lines(t).select("line").write.text(str(tmp_path / "ct"))
    back = {r["i"]: (r["base"], r["partner"]) for r in records.read_connect(spark, str(tmp_path / "ct")).collect()}
    assert back == {1: ("G", 7), 2: ("C", 6), 3: ("A", 0), 4: ("A", 0), 5: ("A", 0), 6: ("G", 2), 7: ("C", 1)}


def test_alignment_scores(spark):
    """Counts, covariance and forbidden pairs of columns against the plain sums over rows."""
    from foldlake.functions.sequence import PAIR_TYPES
    from foldlake.operators import alignment

    rows = ["GGGAAACCC", "GCGAAACGC", "AGGA-ACCU", "GGGAA", "G-GAAACCC", "AUGAAACAU"]
    df = spark.createDataFrame([("x", r, 1) for r in rows] + [("y", "G", 1), ("y", None, 1), (None, "GAAAAC", 1)], "aln string, seq string, i int")
    got = {(r["aln"], r["i"], r["j"]): r["score"] for r in alignment.covariance(df, (4, 8)).collect()}
    full = [r.ljust(9, "-") for r in rows]
    for i in range(9):
        for j in range(i + 4, 9):
            kinds = [PAIR_TYPES.get(r[i] + r[j], 7 if r[i] == r[j] == "-" else 0) for r in full]
            n = {k: kinds.count(k) for k in range(8)}
            if not sum(n[k] for k in range(1, 7)):
                assert ("x", i + 1, j + 1) not in got
                continue
            names = {v: k for k, v in PAIR_TYPES.items()}
            apart = sum(n[k] * n[l] * sum(a != b for a, b in zip(names[k], names[l])) for k in range(1, 7) for l in range(k + 1, 7))
            want = alignment.FORBIDDEN if 2 * n[0] + n[7] > len(rows) else int(100 * apart / len(rows) - 100 * (n[0] + n[7] * 0.25))
            assert got["x", i + 1, j + 1] == want
    assert got[None, 1, 6] == 0
    alignment.HELD, held = 50, alignment.HELD
    assert {(r["aln"], r["i"], r["j"]): r["score"] for r in alignment.covariance(df, (4, 8)).collect()} == got
    alignment.HELD = held
    counts = {(r["aln"], r["i"]): (r["A"], r["C"], r["G"], r["U"], r["gap"]) for r in alignment.column_counts(df).collect()}
    assert counts["x", 2] == (0, 1, 3, 1, 1) and counts["y", 1] == (0, 0, 1, 0, 1)


def test_alignments_of_any_format(spark, tmp_path):
    from foldlake.sources import records

    files = {
        "a.sto": "# STOCKHOLM 1.0\n#=GF ID one\nz AC\na GG\n#=GC SS_cons <.\n\nz UU\na CC\n#=GC SS_cons .>\n//\n# STOCKHOLM 1.0\nx AAA\n//\n",
        "b.aln": "CLUSTAL W\n\nz UUU\na GGG\n\nz AAA 6\na CCC 6\n",
        "c.fa": ">z first\nAC-\nGU\n>a\nACCGU\n>a\nAC--U\n",
        "d.maf": "##maf version=1\na score=1\ns z 0 3 + 9 ACG\ns a 0 2 - 9 A-G\n\na score=2\ns z 3 1 + 9 U\n",
        "e.txt": "nothing of the kind\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    kinds = {r["file"][-5:].strip("/"): r["format"] for r in records.alignment_formats(spark, str(tmp_path)).collect()}
    assert kinds == {"a.sto": "stockholm", "b.aln": "clustal", "c.fa": "fasta", "d.maf": "maf", "e.txt": None}
    got = sorted((r["format"], r["record"], r["row"], r["name"], r["seq"]) for r in records.read_alignments(spark, str(tmp_path)).collect())
    assert got == [
        ("clustal", 0, 0, "z", "UUUAAA"), ("clustal", 0, 1, "a", "GGGCCC"),
        ("fasta", 0, 0, "z", "AC-GU"), ("fasta", 0, 1, "a", "ACCGU"), ("fasta", 0, 2, "a", "AC--U"),
        ("maf", 0, 0, "z", "ACG"), ("maf", 0, 1, "a", "A-G"), ("maf", 1, 0, "z", "U"),
        ("stockholm", 0, 0, "z", "ACUU"), ("stockholm", 0, 1, "a", "GGCC"), ("stockholm", 1, 0, "x", "AAA"),
    ]
    assert [tuple(r) for r in records.read_stockholm_structures(spark, str(tmp_path / "a.sto")).collect()] == [("one", "(..)")]


def test_small_functions(spark):
    from foldlake.functions import sequence as fs

    assert structure.letter_text("((..((...)).(((...)))..)).((.(....)))") == "AA..BB...BB.CCC...CCC..AA.DD.E....EDD" and structure.letter_text(None) == ""
    d = spark.createDataFrame([(1, "ACGU", 3, "AGGA"), (2, "ACGU", 1, "A"), (3, "ACGU", 5, ""), (4, "ACGU", 0, "CCGA"), (5, None, None, None)], "id long, a string, n int, b string")
    got = {r["id"]: (r["x"], r["y"]) for r in d.select("id", fs.with_cut(F.col("a"), F.col("n")).alias("x"), fs.hamming_within(F.col("a"), F.col("b"), F.col("n")).alias("y")).collect()}
    assert got[1] == ("AC&GU", 1) and got[2] == ("&ACGU", 0) and got[3] == ("ACGU", 0) and got[4] == ("ACGU", 0) and got[5][0] is None
    s = spark.createDataFrame([(1, "(...)", 0), (None, "((...))", 0), (2, None, 0)], "doc_id long, structure string, p int")
    one = structure.pair_list(s, 0.9)
    assert sorted(map(tuple, one.collect()), key=str) == [(1, 1, 5, 0.9), (None, 1, 7, 0.9), (None, 2, 6, 0.9)]
    assert structure.joined_lists(one, structure.pair_list(s.filter("doc_id = 1")).withColumn("kind", F.lit("x"))).count() == 4
