"""Every stage of the corpus pipeline against a plain version of it, on rows that are null, repeated, empty or copies."""

import collections
import random
import time

import corpus_pipeline
import pytest
from foldlake.llm import mixing, quality
from foldlake.llm.common import LOWER_BYTES, materialize
from test_llm import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, pos int"
ITEM = " ".join(f"bench{i}" for i in range(14))


def rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    out = [(None, "a b c"), (None, "a b c"), (900, None), (901, ""), (902, "a b c"), (902, "a b c"), (903, None), (903, "x y z"), (904, "# " * 80), (905, "one two three four " * 40)]
    for g in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([60, 90]))]
        for k in range(6):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            if k == 3:
                own[20:20] = ITEM.split()
            out += [(g * 10 + k, " ".join(own))] * rng.choice([1, 1, 3])
    out.append((990, " ".join(rng.choice(words) for _ in range(30_000))))
    return [(i, t, "en", random.Random(str(i)).choice(["a", "b", None]), 0, "r", 1) for i, t in out]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


def test_quality_rules(spark, docs, folder):
    out = corpus_pipeline.quality_rules(spark, docs, folder)
    m = lambda t: dict(zip(quality.MEASURES, quality.measure(t or "")))
    bad = lambda t: any(eval(c.replace("AND", "and"), {}, m(t)) for _, c in quality.RULES.values())
    want = collections.Counter(r for r in rows() if not bad(r[1]))
    assert out.columns == docs.columns and bag(out) == want and 0 < len(want) < len(set(rows()))
    assert corpus_pipeline.quality_rules(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates(spark, docs, folder):
    out = corpus_pipeline.near_duplicates(spark, docs, folder)
    group = brute_components([r[:2] for r in rows()], 5, 4, 5)
    want = {i for i in group if group[i] == i}
    assert out.columns == docs.columns and len(want) < len(group)
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter([*want, None, None])
    assert set(bag(out)) <= set(rows()) and (903, "x y z") in {r[:2] for r in bag(out)}


def test_benchmark_leaks(spark, docs, folder):
    out = corpus_pipeline.benchmark_leaks(spark, docs, folder)
    item = ITEM.split()
    grams = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    words = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").encode().translate(LOWER_BYTES).decode()).split()
    hit = lambda w: any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))
    want = collections.Counter(r for r in rows() if not hit(words(r[1])))
    assert out.columns == docs.columns and bag(out) == want and sum(want.values()) < len(rows())
    assert corpus_pipeline.benchmark_leaks(spark, docs.limit(0), folder).count() == 0


def test_source_mix_and_shards(spark, docs, folder):
    copies = collections.Counter()
    for r in mixing.mix_plan(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    mixed = materialize(corpus_pipeline.source_mix(spark, docs, folder), "mix")
    assert mixed.columns == docs.columns and collections.Counter(r["doc_id"] for r in mixed.collect()) == +copies
    size = lambda s: sum(len((t or "").split()) for _, t, _, o, *_ in rows() if o == s)
    targets = {r["source"]: r["target"] for r in mixing.mix_plan(docs).select("source", "target").distinct().collect()}
    left, weights = sum(map(size, ("a", "b", None))), {"a": 5, "b": 2, None: 1}
    want, live = {}, set(weights)
    while live:  # the excess of full sources goes to the others
        share = {s: left * weights[s] / sum(weights[x] for x in live) for s in live}
        full = {s for s in live if share[s] > 3 * size(s)}
        want |= {s: 3 * size(s) for s in full} if full else share
        left, live = left - sum(3 * size(s) for s in full), live - full if full else set()
    assert targets == pytest.approx(want)
    out = corpus_pipeline.shards(spark, mixed, folder)
    got = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"] and bag(out.select(*docs.columns)) == bag(mixed)
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) - len(got) // 16 in (0, 1)


def test_run_on_given_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.filter("text IS NULL").count() == 0


def test_shuffle_files_of_a_written_table_go(spark):
    """They would else stay on the executors' disks through the jobs that follow."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = shuffles()
    t = materialize(spark.range(10_000).repartition(4, "id"), "shuffled")
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before and t.count() == 10_000
