"""The training-data operators against SQL, brute force, round trips and held-out labels, with edge cases."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.llm.common import LOWER_BYTES, scratch_path
from foldlake.llm import chat, decontaminate, hmm, html_cut, jaccard, mixing, quality, queries, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, n string, row string"


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (4, long, "en", None), (5, long + " end", "de", "b"), (None, "one two", "en", "b"), (7, " \n\t ", "en", "b"), (8, "One TWO", "fr", "c")]
    return spark.createDataFrame([(*r, 0, "x", "y", "z") for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = queries.queries()[name](spark, SF).toPandas(), c.execute(queries.oracle_sql()[name]).df()
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values.tolist()))
    assert key(a) == key(b)


def test_hmm_is_a_distribution_and_beats_its_base(spark):
    got = hmm.op1_hmm_likelihood(spark, SF).toPandas()
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    tokens = {i: (t or "").encode().translate(LOWER_BYTES).split() + [b""] for i, t in docs.items()}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_hmm_forward_sums_to_one():
    rng = np.random.default_rng(0)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T
    x = np.array(list(itertools.product(range(4), repeat=3))).T
    *_, ll = hmm.forward(x, np.full(64, 3), np.broadcast_to(start, (64, 3)), move, emit)
    assert math.isclose(np.exp(ll).sum(), 1, rel_tol=1e-12)
    brute = [sum(start[a] * emit[p[0], a] * move[a, b] * emit[p[1], b] * move[b, c] * emit[p[2], c] for a in range(3) for b in range(3) for c in range(3)) for p in x.T]
    np.testing.assert_allclose(np.exp(ll), brute)


@pytest.mark.parametrize("long", [3, 100])
def test_baum_welch_counts_against_enumeration(monkeypatch, long):
    monkeypatch.setattr(hmm, "LONG", long)
    rng = np.random.default_rng(1)
    k, v = 2, 4
    start, move, emit = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(v), k).T
    for lengths in ([7], [5, 3, 1]) if long > 10 else ([7], [8]):
        texts = [rng.integers(0, v, n) for n in lengths]
        x = np.zeros((max(lengths), len(lengths)), int)
        for c, t in enumerate(texts):
            x[: len(t), c] = t
        first, moves, ids, emissions = hmm.expected(x, np.array(lengths), start, move, emit)
        want = [np.zeros(k), np.zeros((k, k)), np.zeros((v, k))]
        ll = []
        for t in texts:
            paths = list(itertools.product(range(k), repeat=len(t)))
            p = np.array([start[s[0]] * emit[t[0], s[0]] * np.prod([move[a, b] * emit[c, b] for a, b, c in zip(s, s[1:], t[1:])]) for s in paths])
            ll.append(np.log(p.sum()))
            for s, q in zip(paths, p / p.sum()):
                want[0][s[0]] += q
                for a, b in zip(s, s[1:]):
                    want[1][a, b] += q
                for a, c in zip(s, t):
                    want[2][c, a] += q
        np.testing.assert_allclose(first, want[0])
        np.testing.assert_allclose(moves, want[1])
        np.testing.assert_allclose(emissions, want[2][ids])
        np.testing.assert_allclose(hmm.likelihood(x, np.array(lengths), start, move, emit), ll)


def test_hmm_edges(spark):
    d = odd_documents(spark)
    rows = hmm.score(d, hmm.split(7) != 2, head=5, tails=4).collect()
    assert len(rows) == 9 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 7)} == {1} and {r["n_tokens"] for r in rows if r["doc_id"] == 4} == {30_001}
    assert hmm.score(d.limit(0), hmm.split(7) != 2).count() == 0
    same = [r for r in rows if r["doc_id"] == 3]
    assert same[0]["score"] == same[1]["score"]


def test_toxicity_edges_and_training_condition(spark):
    rng = random.Random(3)
    clean = ["".join(rng.choice("aeiou") + rng.choice("bcdfgm") for _ in range(3)) for _ in range(100)]
    doc = lambda bad: " ".join([rng.choice(clean) for _ in range(30)] + (["zorkle"] if bad else []))
    texts = [(k, doc(k % 3 == 0)) for k in range(240)]
    d = spark.createDataFrame([(*t, "x") for t in texts] + [(None, "zorkle", "x"), (500, None, "x"), (501, "", "x"), (502, "zorkle " * 9000, "x"), (0, "other", "x"), (3, texts[3][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), 1) for k in range(240)] + [(None, 1, 1), (7, None, 1), (999, 1, 1)], "doc_id long, toxic long, text int")
    got = toxicity.score(d, labels, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == 246 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is None or r["doc_id"] % 2 == 1) for r in got)
    by = {r["doc_id"]: r["score"] for r in got if r["doc_id"] not in (0, None)}
    held = [k for k in range(240) if k % 2]
    assert np.mean([by[a] > by[b] for a in held if a % 3 == 0 for b in held if b % 3]) > 0.8
    assert toxicity.score(d.limit(0), labels, F.col("doc_id") % 2 == 0).count() == 0
    none = toxicity.score(d, labels.limit(0), F.col("doc_id") % 2 == 0).collect()
    assert {r["score"] for r in none} == {0.0}


def test_toxicity_finds_unseen_spellings():
    rng = random.Random(1)
    clean = ["".join(rng.choice("aeiou") + rng.choice("bcdfgm") for _ in range(3)) for _ in range(300)]
    def doc(bad):
        ws = [rng.choice(clean) for _ in range(60)]
        if bad:
            ws[rng.randrange(60)] = "zorkle" + rng.choice(clean)[:2]
        return " ".join(ws)
    rows = [(doc(k % 3 == 0), int(k % 3 == 0)) for k in range(600)]
    m = toxicity.train(rows)
    s, b = m.scalars()
    p = lambda t: 1 / (1 + math.exp(-(m.curve[0] * toxicity.worst(toxicity.grams(t), s, b) + m.curve[1])))
    assert np.mean([p(doc(True)) > p(doc(False)) for _ in range(100)]) > 0.95


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x" * 200_000), (2, "http://b\r\nX: 1", "é\r\n\r\nWARC/1.1" * 9000), (3, None, None), (4, "u", ""), (5, "u", "x" * 200_000), (None, "u", "solo"), (6, "u", "solo2"), (6, "u", "solo2")]
    warc.write_archives(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, sha string"), str(tmp_path / "w"), segment_bytes=1000, records_per_file=50)
    got = sorted(map(tuple, warc.read_records(spark, str(tmp_path / "w")).collect()), key=str)
    want = []
    for i, _, h in rows:
        h = (h or "").encode()
        best = max((j for j, _, g in rows if (g or "").encode() == h and j is not None), default=None)
        want.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if i == best else "revisit", None if i == best else best))
    assert got == sorted(want, key=str)
    written = "".join(r[0] for r in spark.read.text(str(tmp_path / "w"), wholetext=True).collect())
    ids = collections.Counter(re.findall("WARC-Record-ID: (.*)\r", written))
    refers = re.findall("WARC-Refers-To: (.*)\r", written)
    assert max(ids.values()) == 1 and len(refers) == written.count("WARC-Type: revisit") == 2 and set(refers) <= set(ids)


def test_warc_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op3_warc_chunks(spark, str(tmp_path)).collect() == []


def test_shards_have_exact_sizes(spark):
    rows = sharding.op4_hypergeometric_shuffle(spark, SF).collect()
    for s, own in itertools.groupby(sorted((r["shard"], r["slot"]) for r in rows), key=lambda x: x[0]):
        own = [x[1] for x in own]
        assert own == list(range(len(own))) and len(own) in (len(rows) // 16, len(rows) // 16 + 1)
    assert sharding.shard_plan(odd_documents(spark)).count() == 9
    assert sharding.shard_plan(odd_documents(spark).limit(0)).count() == 0
    assert sharding.shard(odd_documents(spark)).select("row.row").count() == 9


def test_hypergeometric_law():
    rng = random.Random(3)
    n = collections.Counter(sharding.hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    for k in range(6):
        assert abs(n[k] / 20_000 - math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)) < 0.015
    m = sharding.communication_matrix([5, 0, 7], [4, 4, 4], rng)
    assert [sum(r) for r in m] == [5, 0, 7] and [sum(c) for c in zip(*m)] == [4, 4, 4]


def test_decontamination_edges(spark):
    d = odd_documents(spark)
    b = spark.createDataFrame([(1, "ONE, two!"), (2, None), (3, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (sorted(r["items"]), len(r["spans"])) for r in decontaminate.scan(d, b).collect()}
    assert got[(3, 2)] == (["1"], 1) and got[(None, 2)] == (["1"], 1) and got[(1, 0)] == ([], 0) and got[(4, 30000)][0] == ["3"]
    wide = {(r["doc_id"], r["n_words"]): (sorted(r["items"]), len(r["spans"])) for r in decontaminate.scan(d, b, broadcast_bytes=0).collect()}
    assert wide == got
    assert sorted(str(r["doc_id"]) for r in decontaminate.remove_documents(d, b).collect()) == ["1", "2", "7"]
    assert decontaminate.scan(d, b.limit(0)).filter(F.size("spans") > 0).count() == 0
    assert {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(d.filter("doc_id = 8"), b).collect()} == {8: ""}


def test_ledger_edges_and_ablations(spark):
    d = odd_documents(spark)
    led = quality.ledger(d)
    assert led.count() == 9 and quality.ledger(d.limit(0)).count() == 0
    stored = quality.store(d, scratch_path(spark, "ledger"))
    assert {r["doc_id"] for r in quality.keep(stored).collect()} == {r["doc_id"] for r in led.filter(quality.verdict()).collect()}
    assert quality.ablations(stored).collect() == quality.ablations(led).collect() and quality.keep(stored).columns == d.columns
    a = {r["rule"]: (r["failed"], r["only_by_it"]) for r in quality.ablations(led).collect()}
    bits = [r["fail_bits"] for r in led.collect()]
    for b, (name, _) in quality.RULES.items():
        assert a[name] == (sum(x >> b & 1 for x in bits), sum(x == 1 << b for x in bits))


def brute_repair(roles):
    """Least cost over every sequence of actions, by search over states."""
    best = {0: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for mid in range(4):
                if chat.INSERTS[s][mid] is None:
                    continue
                for a, b, x, _ in chat.MOVES.get(r, chat.MOVES[None]):
                    if a == mid:
                        new[b] = min(new.get(b, 10**9), c + chat.INSERT * len(chat.INSERTS[s][mid]) + x)
        best = new
    return min(c + chat.INSERT * len(chat.INSERTS[s][chat.FINAL]) for s, c in best.items() if chat.INSERTS[s][chat.FINAL] is not None)


def test_role_repair_in_chunks(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "", "hi", "a\nb"])) for c in range(40) for t in range(rng.randrange(1, 12))]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chunk long")
    for size in (2, 256):
        got = collections.defaultdict(list)
        for r in sorted(chat.repair(d, size).collect(), key=lambda r: (r["conv_id"], r["chunk"], r["piece"])):
            got[r["conv_id"]].append(r)
        for c, own in got.items():
            assert own[0]["cost"] == brute_repair([r[2] for r in rows if r[0] == c])
            said = [x for r in own for x in ([r["role"]] if r["action"] != "merge" else [])]
            state = 0
            for x in said:
                assert chat.ROLES.index(x) + 1 in chat.LEGAL[state]
                state = chat.ROLES.index(x) + 1
            assert state == chat.FINAL and "".join(r["rendered"] for r in own).endswith("<|end|>\n")
    assert chat.repair(d.limit(0)).count() == 0


def test_role_repair_bounds_rows_of_a_chunk(spark):
    rng = random.Random(6)
    rows = [(None, k % 8, rng.choice(["user", "assistant", "tool", None]), rng.choice(["hi", "a", None])) for k in range(500)] + [(1, None, "user", "x")] * 120
    rows += [(2, 10**6 * k, rng.choice(["user", "assistant"]), f"t{k}") for k in range(90)] + [(3, 0, "user", "short"), (3, 5000, "assistant", "end")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got, whole = (sorted(chat.repair(d, n).collect(), key=lambda r: (str(r["conv_id"]), r["chunk"], r["piece"])) for n in (16, 10**6))
    held = collections.Counter((r["conv_id"], r["chunk"]) for r in got if r["action"] != "insert")
    assert max(held.values()) == 16 and sum(held.values()) == len(rows)
    assert {c: sorted(k for i, k in held if i == c) for c in (None, 1, 2, 3)} == {None: list(range(32)), 1: list(range(8)), 2: list(range(6)), 3: [0]}
    key = lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or "")
    for c in (None, 1, 2, 3):
        own = sorted((r for r in rows if r[0] == c), key=key)
        cost = brute_repair([r[2] for r in own])
        assert {r["cost"] for r in got if r["conv_id"] == c} == {r["cost"] for r in whole if r["conv_id"] == c} == {cost}
        assert [r["turn"] for r in got if r["conv_id"] == c and r["action"] != "insert"] == [r[1] for r in own]
        assert "".join(r["rendered"] for r in got if r["conv_id"] == c).endswith("<|end|>\n")


def test_extraction():
    page = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class=cookie-notice><p>We use cookies on this site, please accept them all.</p></div><article><h1>Head</h1><p>First  paragraph &amp; more words, long enough for a reader.<p>Second<br>line</p><form><label>Name</label></form></article><div id=comments><p>I really like this article, thanks for writing it down.</p></div><footer>&copy; x</footer>"
    assert html_cut.extract(page) == "Head\n\nFirst paragraph & more words, long enough for a reader.\n\nSecond line"
    assert html_cut.extract(None) == html_cut.extract("") == html_cut.extract("<nav>x") == ""


def test_minimum_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 7)
        cap = [(rng.randrange(9), rng.randrange(9)) for _ in range(n)]
        ties = [(a, b, rng.randrange(6)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(s if not k else t for k, (s, t) in zip(x, cap)) + sum(c for a, b, c in ties if x[a] != x[b])
        assert cost(html_cut.minimum_cut(cap, ties)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_the_cut_decides_borderline_blocks():
    long = "This is a paragraph of the story that goes on for quite a while, as stories do, and then it ends."
    page = f"<div class=x><p>{long}</p><div>Yes.</div><p>{long}</p></div><div class=sidebar><ul><li>Yes.</li></ul><p>{long}</p></div>"
    cut, own = html_cut.labels(html_cut.blocks(page), html_cut.Classifier(html_cut.PRIOR))
    assert own == [True, False, True, False, False] and cut == [True, True, True, False, False]
    assert html_cut.extract(page) == f"{long}\n\nYes.\n\n{long}"


def test_fit_learns_names_from_tags(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(50)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = [f"<nav><div class=zork>{line(30)}</div></nav><article class=yarn><p>{line(25)}</p><p>{line(30)}</p></article>" for _ in range(60)]
    plain = f"<div class=zork>{line(30)}</div>"
    assert html_cut.extract(plain) and not html_cut.extract(plain, html_cut.fit(pages))
    rows = [(k, None, p, "x") for k, p in enumerate(pages)] + [(900, "u", plain, "x"), (901, "u", None, "x"), (None, "u", "", "x"), (902, "u", "<article><p>a &amp;amp; b", "x"), (902, "u", "<article><p>a &amp;amp; b", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in html_cut.main_text(d).collect() if r["page_id"] is None or r["page_id"] >= 900)
    assert got == {(900, "", 0): 1, (901, "", 0): 1, (None, "", 0): 1, (902, "a &amp; b", 9): 2}
    assert html_cut.main_text(d.limit(0)).count() == 0 and html_cut.fit([]).weights == html_cut.PRIOR


def test_broken_and_long_pages_take_linear_time():
    import time

    t = time.time()
    for piece in ("a<b ", "<svg ", "<svg >", '<b "', "<div>", "</p>", "<!-- ", "<p>x<nav>y</nav>", '<a "'):
        html_cut.extract(piece * ((1 << 20) // len(piece)) + '">"')
    html_cut.extract("<article>" + "<p>word word word in a long block of text that goes on and on for a while</p><div class=ad>x y</div>" * 3000)
    assert time.time() - t < 40
    assert html_cut.extract("<article><p>one two three four five six seven eight nine <svg>x</svg> ten<script>var a = '</p>'</script> end<p>cut <b") == "one two three four five six seven eight nine ten end\n\ncut"


def test_mix_edges(spark):
    d = odd_documents(spark)
    p = mixing.mix_plan(d).collect()
    assert len(p) == 9 and all(0 <= r["copies"] <= 3 for r in p)
    assert mixing.mix(d).columns == d.columns and mixing.mix(d).count() == sum(r["copies"] for r in p)
    assert mixing.mix_plan(d.limit(0)).count() == 0


def brute_components(rows, n, num, den):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().translate(LOWER_BYTES).split()
        if i is not None:
            sets[i].append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = {i: i for i in sets}
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("crowd,hot", [(8, 64), (2, 1)])
def test_jaccard_join(spark, crowd, hot):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000, None), (1001, ""), (1002, "a"), (1003, "A"), (1004, "a b"), (None, "a")]
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 150]))]
        for k in range(12):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((g * 20 + k, " ".join(own)))
    passage = [rng.choice(words) for _ in range(60)]
    for k in range(30):  # a passage in many texts, some of them near copies, and repeated rows
        own = [f"{x}{k // 2}" for x in (rng.sample(words, 200) if k % 2 == 0 else own[60:])]
        own = passage + [x.removesuffix(f"{k // 2}{k // 2}") if k % 2 else x for x in own]
        rows.append((500 + k, " ".join(own)))
    rows += rows[-3:] + rows[20:26]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    sizes, edges = jaccard.links(d, 4, 85, 100, hot_copies=hot, crowd=crowd)
    comp = {r["node"]: r["component"] for r in jaccard.components(edges).collect()}
    assert {i: comp.get(i, i) for i, _ in rows if i is not None} == brute_components(rows, 4, 85, 100)
    assert sizes.count() == len(rows)


def test_jaccard_template_gives_no_candidates(spark):
    """Texts that share 90 % of their words, too little for a link, are not tried with each other."""
    rng = random.Random(9)
    passage = [f"t{i}" for i in range(180)]
    rows = [(k, " ".join(passage + [f"o{k}x{i}" for i in range(20)])) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = d.mapInArrow(jaccard._sets(4), "doc_id long, sketch array<long>, s array<long>").withColumn("n", F.size("s"))
    p = jaccard._prefixes(sets, 85, 100).withColumn("g", F.col("doc_id"))
    assert p.count() > 300 and jaccard._across(p, 85, 100).count() == 0
    assert jaccard.links(d, 4, 85, 100)[1].count() == 0


def test_jaccard_rows_of_frequent_tokens_are_not_multiplied(spark):
    """Rows that no early row fits are not dealt out at all, the others to a few parts; the pairs are those of all rows."""
    rows = [(1, k, 100, 14, 601, k) for k in range(600)] + [(1, 5000, 100, 8, 601, 5000)]
    rows += [(2, 1000 + k, 100, 0, 520, 1 + k % 2) for k in range(519)] + [(2, 1999, 100, 9, 520, 3)]
    rows += [(3, 2000 + k, 80 + k, k % 13, 40, 2000 + k // 2) for k in range(40)]
    width, early = -math.log(0.85 - 1e-3), lambda r: r[3] * 185 <= r[2] * 15
    band = lambda r: int(math.log(r[2]) / width)
    fits = lambda r, q: max(r[3] + q[3], r[2] + q[2] - 2 * min(r[2] - r[3], q[2] - q[3])) * 185 <= (r[2] + q[2]) * 15
    want = {(r[1], q[1]) for r, q in itertools.combinations(rows, 2) if r[0] == q[0] and r[5] != q[5] and (early(r) or early(q)) and abs(band(r) - band(q)) <= 1 and fits(r, q)}
    p = spark.createDataFrame(rows, "token long, doc_id long, n int, i int, df long, g long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pairs = jaccard._across(p, 85, 100)
        assert {tuple(r) for r in pairs.collect()} == want
        todo, made = [pairs._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            todo += [node.children().apply(k) for k in range(node.children().size())]
            made += node.metrics().apply("numOutputRows").value() if node.nodeName() == "Generate" else 0
        assert 0 < made < 8 * len(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_jaccard_edges(spark):
    d = odd_documents(spark)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(d).collect())
    assert got == {(1, 0, 1): 1, (2, 0, 2): 1, (3, 1, 3): 2, (4, 977, 4): 1, (5, 978, 4): 1, (None, 1, None): 1, (7, 0, 7): 1, (8, 1, 3): 1}
    assert jaccard.near_duplicates(d.limit(0)).count() == 0
    many = spark.createDataFrame([(1, "a b c d e")] * 500 + [(2, "a b c d e")] * 500, "doc_id long, text string")
    assert {tuple(r) for r in jaccard.near_duplicates(many).collect()} == {(1, 2, 1), (2, 2, 1)} and jaccard.near_duplicates(many).count() == 1000


def test_word_hashes_of_slices():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é\n\t\x0bxyzQ中") for _ in range(rng.randrange(40))) for _ in range(500)] + ["", None, "x", " ", "A b C"]
    seen, back = {}, {}
    for column in (pa.array(texts), pa.array(texts)[7:]):
        for first, h, lengths in jaccard.Words().runs(column):
            at = iter(h.tolist())
            for r, n in enumerate(lengths):
                own = (column[first + r].as_py() or "").encode().translate(LOWER_BYTES).split()
                assert len(own) == n
                for w in own:
                    v = next(at)
                    assert seen.setdefault(w, v) == v and back.setdefault(v, w) == w


def test_sampling_stages_on_repeated_and_null_rows(spark):
    import corpus_pipeline

    d = odd_documents(spark)
    copies = collections.Counter()
    for r in mixing.mix_plan(d).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = hmm.materialize(corpus_pipeline.source_mix(spark, d, SF), "mix")
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +copies
    out = corpus_pipeline.shards(spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in out) == +copies and len({(r["shard"], r["slot"]) for r in out}) == len(out)


def test_near_duplicates_stage_against_all_pairs(spark):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, "a b c"), (None, "a b c"), (900, None), (901, ""), (902, "a b c"), (902, "a b c"), (903, None), (903, "x y z"), (904, None), (904, None)]
    for g in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([30, 90]))]
        for k in range(6):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows += [(g * 10 + k, " ".join(own))] * rng.choice([1, 1, 3])
    d = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, d, SF)
    group = brute_components(rows, 5, 4, 5)
    want = {i for i in group if group[i] == i}
    got = [tuple(r) for r in out.select("doc_id", "text").collect()]
    assert out.columns == d.columns and len(want) < len(group)
    assert collections.Counter(i for i, _ in got) == collections.Counter([*want, None, None]) and set(got) <= set(rows) and (903, "x y z") in got
