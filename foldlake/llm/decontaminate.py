"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, in DataFrame functions only.

Both sides are lower-cased in A-Z and cut into words of a-z, 0-9 and non-ASCII characters. Benchmark items give their
distinct windows of ``n`` words (an item of fewer words is one window of its own length). Documents are scanned once:
every word is hashed once, a window's 64-bit hash comes from those of its words and probes the set in the scan's own
task; only hits and one marker row per document are shuffled. Documents with hits are read again and every hit is
verified word for word there; the items of verified windows are joined last, so no window carries a list of items. The
window set is broadcast while it has few bytes (it depends on the benchmark alone, not on the corpus); a larger one is
joined by a shuffle on the hash.

Defined results: a null text has no words; an item without words is ignored; a null item_id marks words but is not
listed; hits of repeated rows are found for each of them; an empty benchmark contaminates nothing; columns other than
those named are ignored by ``scan`` and kept by ``remove_documents`` and ``remove_spans``; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, lower_az, materialize, small, split_words, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10


def norm_words(text: Column) -> Column:
    return split_words(lower_az(text), GAP)


def _window_hash(hashes: Column, i: Column, n: int) -> Column:
    """Hash of the n words from i (0-based), out of the words' hashes."""
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """gram_hash, gram, len, item (as a string) for each window of each item, distinct."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), norm_words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.select("item", "w", _hashes(F.col("w")).alias("h"), F.least(F.size("w"), F.lit(n)).alias("len"))
    spots = F.sequence(F.lit(0), F.size("w") - F.col("len"))
    hashed = reduce(lambda out, k: F.when(F.col("len") == k, F.transform(spots, lambda i: _window_hash(F.col("h"), i, k))).otherwise(out), range(1, n), F.transform(spots, lambda i: _window_hash(F.col("h"), i, n)))
    grams = F.transform(spots, lambda i: F.array_join(F.slice("w", i + 1, F.col("len")), " "))
    return w.select("item", "len", F.explode(F.arrays_zip(hashed.alias("gram_hash"), grams.alias("gram"))).alias("x")).select("x.gram_hash", "x.gram", "len", "item").distinct()


def _hits(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """docs: __id, text. One marker row (pos null, n: number of words) per document, and one row per hash hit."""
    w = docs.select("__id", F.coalesce(F.col("text"), F.lit("")).alias("t")).select("__id", F.xxhash64("t").alias("__text"), _hashes(norm_words(F.col("t"))).alias("h"))

    def probes(n: int) -> Column:
        last = F.size("h") - n
        spots = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), _window_hash(F.col("h"), i, n).alias("h")))

    marker = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.size("h").alias("n"), F.lit(None).cast("long").alias("h")))
    rows = w.select("__id", "__text", F.explode(F.concat(marker, *[probes(n) for n in lengths])).alias("x")).select("__id", "__text", "x.*")
    j = rows.join(windows, (F.col("h") == F.col("gram_hash")) & (F.col("n") == F.col("len")), "left")
    return j.filter(F.col("pos").isNull() | F.col("gram_hash").isNotNull()).select("__id", "__text", "pos", "n", "gram")


def _covered(spans: Column) -> Column:
    """Number of positions in the union of [pos, pos + n) over sorted (pos, n) structs."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    step = lambda a, s: F.struct(
        F.greatest(a["end"], s["pos"] + s["n"]).alias("end"),
        (a["sum"] + F.greatest(F.lit(0), s["pos"] + s["n"] - F.greatest(a["end"], s["pos"]))).alias("sum"),
    )
    return F.aggregate(spans, zero, step, lambda a: a["sum"])


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, spans (sorted (pos, n) of verified windows), items (sorted ids)."""
    items = materialize(benchmark_windows(benchmark, n), "windows")
    grams = materialize(items.select("gram_hash", "gram", "len").distinct(), "grams")
    lengths = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most n rows
    d = docs.select(F.col("doc_id").alias("__id"), "text")
    g = _hits(d, small(grams, broadcast_bytes), lengths).groupBy("__id", "__text").agg(
        F.count(F.when(F.col("pos").isNull(), 1)).alias("copies"),
        F.max(F.when(F.col("pos").isNull(), F.col("n"))).alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "n", "gram")))).alias("hits"),
    )
    g = materialize(g, "hits")
    hit = g.filter(F.size("hits") > 0).select(F.col("__id").alias("h_id"), F.col("__text").alias("h_text"), "hits")
    t = d.select("__id", F.coalesce("text", F.lit("")).alias("t"))
    t = t.join(small(hit), F.col("__id").eqNullSafe(F.col("h_id")) & (F.xxhash64("t") == F.col("h_text")))
    said = lambda x: F.array_join(F.slice("w", x["pos"] + 1, x["n"]), " ") == x["gram"]
    t = t.select("h_id", "h_text", norm_words(F.col("t")).alias("w"), "hits").select("h_id", "h_text", F.filter("hits", said).alias("hits"))
    t = materialize(t.filter(F.size("hits") > 0).groupBy("h_id", "h_text").agg(F.first("hits").alias("hits")), "verified")
    own = t.select("h_id", "h_text", F.explode(F.array_distinct(F.transform("hits", lambda x: F.struct(x["gram"].alias("gram"), x["n"].alias("n"))))).alias("x"))
    own = own.join(items, (F.col("x.gram") == F.col("gram")) & (F.col("x.n") == F.col("len"))).groupBy(F.col("h_id").alias("i_id"), F.col("h_text").alias("i_text")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    t = t.join(own, F.col("h_id").eqNullSafe(F.col("i_id")) & (F.col("h_text") == F.col("i_text")))
    t = materialize(t.select("h_id", "h_text", F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"))).alias("spans"), "items"), "found")
    g = g.drop("hits").join(small(t), F.col("__id").eqNullSafe(F.col("h_id")) & (F.col("__text") == F.col("h_text")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<pos:int,n:int>>"))
    g = g.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text_hash"), "n_words", spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return g.drop("col")


def _marked(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """__id, __text and spans of the documents with hits."""
    bad = scan(docs, benchmark, n).filter(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), "spans").distinct()
    return small(materialize(bad, "bad"))


def _same(docs: DataFrame, bad: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__text"])


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The documents without any benchmark window, all columns kept."""
    bad = _marked(docs, benchmark, n)
    return docs.join(bad, _same(docs, bad), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id and the normalised words outside every hit, joined by spaces."""
    bad = _marked(docs, benchmark, n)
    j = docs.join(bad, _same(docs, bad), "left")
    j = j.select(docs["doc_id"], norm_words(docs["text"]).alias("w"), "spans")
    keep = F.filter("w", lambda w, i: ~F.exists("spans", lambda s: (s["pos"] <= i) & (i < s["pos"] + s["n"])))
    return j.select("doc_id", F.array_join(F.when(F.col("spans").isNull(), F.col("w")).otherwise(keep), " ").alias("text"))


def op5_benchmark_ngrams(spark, sf_dir):
    s = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return s.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        _covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, pos, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
