"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each source gets a target of words: the weights 5, 2, 1 (repeating over the sources in code-point order, null
last) share all words; a target stops at ``cap`` times its source's words and the excess is shared again by weight
until none is above. Every document of a source has the same expected number of copies, target / source words.
Documents are ordered within their source by size class and then pseudo-randomly; the prefix sums of the expected
copies plus one offset per source decide how often each is emitted: once per integer boundary crossed.

The prefix sum is never taken over a whole source in one task. Documents fall into (source, size class, hash prefix)
cells; the cell counts are summed first, their running totals come back by a broadcast (while they have few bytes) and
only the rank inside a cell needs a shuffle and a sort. The hash covers the id and the text, so null or repeated ids
spread over the cells like others; rows with the same id and text are equal, and which of them is taken is no difference.

Defined results: a null text has size 0; a null source is a source of its own, last; a source without words has target
0 and none of its documents is taken; repeated rows are separate documents with consecutive ranks; an empty table gives
an empty result; columns other than those named are ignored by ``mix_plan`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, small, table

WEIGHTS = (5, 2, 1)
CAP = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> plus target. One row per source; capped shares found by one pass over prefix sums."""
    by_name, by_fill = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("fill", "i")
    all_rows = W.partitionBy(F.lit(1))
    t = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    t = t.withColumn("fill", F.col("source_size").cast("double") / F.col("weight")).withColumn("total", F.sum("source_size").over(all_rows))
    before = F.coalesce(F.sum(F.col("source_size") * cap).over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("left", F.col("total") - before).withColumn("w_left", F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("open", F.col("left") * F.col("weight") <= F.col("source_size") * cap * F.col("w_left"))
    first = F.min(F.when(F.col("open"), F.struct("fill", "i", "left", "w_left"))).over(all_rows)
    t = t.withColumn("level", first)
    share = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.w_left")
    return t.select("source", "source_size", F.when(F.col("open"), share).otherwise((F.col("source_size") * cap).cast("double")).alias("target"))


def _keyed(docs: DataFrame, seed: str, hash_digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with size, class and hash, and the cell table."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    bits = F.bin(F.col("__size"))
    d = docs.withColumn("__size", size)
    d = d.withColumn("__class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(F.rpad(bits, 3, "0"), 1, 3)))
    d = d.withColumn("__hash", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5("text"), F.lit("")))))
    d = d.withColumn("__cell", F.substring("__hash", 1, hash_digits))
    cells = d.groupBy(F.col("source").alias("c_source"), F.col("__class").alias("c_class"), F.col("__cell").alias("c_cell")).agg(F.count(F.lit(1)).alias("rows"), F.sum("__size").alias("words"))
    return d, materialize(cells, "cells")


def _with_copies(docs: DataFrame, weights, cap, seed, hash_digits) -> DataFrame:
    d, cells = _keyed(docs, seed, hash_digits)
    targets = source_targets(cells.groupBy(F.col("c_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, cap)
    targets = targets.withColumnRenamed("source", "t_source")
    running = W.partitionBy("c_source").orderBy("c_class", "c_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("rows").over(running), F.lit(0))).drop("rows", "words")
    cells = small(materialize(cells.join(targets, F.col("c_source").eqNullSafe(F.col("t_source"))), "starts"))
    j = d.join(cells, d["source"].eqNullSafe(F.col("c_source")) & (d["__class"] == F.col("c_class")) & (d["__cell"] == F.col("c_cell")))
    inner = W.partitionBy("c_source", "c_class", "c_cell").orderBy("__hash")
    j = j.withColumn("__rank", F.col("before") + F.row_number().over(inner))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("c_source"), F.lit("")))), 1, 4), 16, 10).cast("double") / 65536
    crossed = F.floor(offset + F.col("__rank") * each) - F.floor(offset + (F.col("__rank") - 1) * each)
    return j.withColumn("__copies", F.least(crossed, F.lit(cap)).cast("long"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix-1", hash_digits: int = 2) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies."""
    j = _with_copies(docs.select("doc_id", "text", "source"), weights, cap, seed, hash_digits)
    return j.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", F.col("__copies").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix-1", hash_digits: int = 2) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the input's columns."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    j = _with_copies(packed, weights, cap, seed, hash_digits).filter(F.col("__copies") > 0)
    return j.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select("__row.*")


def op9_systematic_mix(spark, sf_dir):
    p = mix_plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, text FROM documents),
k AS (SELECT *, bin(size) AS bits, md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS h FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lpad(CAST(length(bits) AS VARCHAR), 2, '0') || substr(rpad(bits, 3, '0'), 1, 3), h) AS rnk FROM k),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM n),
f AS (SELECT *, CAST(source_size AS DOUBLE) / weight AS fill, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
g AS (SELECT *, CAST(total - coalesce(sum(3 * source_size) OVER (ORDER BY fill, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lft,
  CAST(sum(weight) OVER (ORDER BY fill, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS w_left FROM f),
o AS (SELECT *, lft * weight <= 3 * source_size * w_left AS open FROM g),
l AS (SELECT lft AS l_left, w_left AS l_w FROM o WHERE open ORDER BY fill, i LIMIT 1),
t AS (SELECT o.source, source_size, CASE WHEN open THEN CAST(l_left * weight AS DOUBLE) / l_w ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM o LEFT JOIN l ON true),
e AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.rnk, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each_,
  CAST(('0x' || substr(md5('mix-1' || coalesce(r.source, '')), 1, 4)) AS INTEGER) / 65536.0 AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(CAST(u AS DOUBLE) + rnk * each_) - floor(CAST(u AS DOUBLE) + (rnk - 1) * each_), 3) AS BIGINT) * size AS taken FROM e
"""
