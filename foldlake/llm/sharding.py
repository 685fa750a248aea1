"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame functions only.

1. Rows fall into P pseudo-random parts by a hash of the whole key; one aggregate counts the parts (P numbers).
2. From the counts alone the exact numbers of rows that go from each part to each bin are drawn: a multivariate
   hypergeometric draw a part, so that a uniform permutation has the same law. A bin is one block of one shard; its
   size, and so its first slot, is known before any row moves. The matrix has at most ``max_parts`` x ``max_parts``
   numbers, however large the table.
3. Each part is permuted locally (a sort by a seeded hash); ranks pick the bin.
4. Rows are exchanged by bin and permuted again there; slot = first slot of the bin + rank.

No shard is ever sorted as a whole, and no counting pass over exchanged rows is needed.

Equal rows that fill more than a part are dealt out by a random number a row first, so no key holds a part of its own.

Defined results: a null text has size 1 and checksum 0; null ids are rows like others; repeated rows get slots of their
own; an empty table gives an empty result; other columns are ignored by ``shard_plan`` and kept by ``shard``.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 16
ROWS_PER_PART = 200_000
MIN_PARTS, MAX_PARTS = 64, 2048


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Exact draw (to float precision) of the good ones among ``draws`` of good + bad: inversion outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    lg = math.lgamma
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    if u < 0:
        return mode
    up = down = mode
    p_up = p_down = p
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode


def even_parts(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def communication_matrix(rows: list[int], columns: list[int], rng: random.Random) -> list[list[int]]:
    """Counts with the given row and column sums, as a uniform permutation would have them."""
    left, out = list(columns), []
    for n in rows:
        total, line = sum(left), []
        for j, good in enumerate(left):
            x = hypergeometric(rng, good, total - good, n)
            total, n = total - good, n - x
            line.append(x)
            left[j] -= x
        out.append(line)
    return out


def _salted(keyed: DataFrame, most: int = ROWS_PER_PART) -> DataFrame:
    """Rows whose key more than ``most`` rows share (equal rows, so none is told from another) get keys of their own parts."""
    hot = keyed.groupBy(F.col("__key").alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    hot = materialize(hot, "hot_keys")  # fewer than rows / most
    if hot.isEmpty():
        return keyed
    part = F.floor(F.rand(1) * (1 + 4 * F.col("__n") / most))
    k = keyed.join(F.broadcast(hot), F.col("__key") == F.col("__hot"), "left")
    return k.withColumn("__key", F.when(F.col("__n").isNull(), F.col("__key")).otherwise(F.xxhash64("__key", part))).drop("__hot", "__n")


def _placed(keyed: DataFrame, shards: int, seed: int) -> DataFrame:
    """keyed: has __key (a hash of the whole row). Adds shard (int) and slot (long)."""
    spark = keyed.sparkSession
    keyed = _salted(keyed)
    per_part = keyed.groupBy(F.pmod("__key", F.lit(MAX_PARTS)).alias("fine")).count().collect()  # at most MAX_PARTS rows
    total = sum(r["count"] for r in per_part)
    parts = MIN_PARTS  # powers of two, so that the fine counts fold
    while parts < MAX_PARTS and total > parts * ROWS_PER_PART:
        parts *= 2
    counts = [0] * parts
    for r in per_part:
        counts[r["fine"] % parts] += r["count"]
    blocks = max(1, parts // shards)
    sizes = [even_parts(n, blocks) for n in even_parts(total, shards)]
    matrix = communication_matrix(counts, [n for s in sizes for n in s], random.Random(seed))
    lines = []
    for p, line in enumerate(matrix):
        seen, ends, inner = 0, [], []
        for s in range(shards):
            own = []
            for n in line[s * blocks : (s + 1) * blocks]:
                seen += n
                own.append(seen)
            ends.append(seen)
            inner.append(own)
        lines.append((p, ends, inner))
    firsts = []
    for s in sizes:
        at, own = 0, []
        for n in s:
            own.append(at)
            at += n
        firsts.append(own)
    ends = spark.createDataFrame(lines, "m_part long, shard_ends array<long>, block_ends array<array<long>>")
    first = F.array(*[F.array(*[F.lit(x).cast("long") for x in own]) for own in firsts])
    k = keyed.withColumn("__part", F.pmod("__key", F.lit(parts)))
    k = k.withColumn("__rank", F.row_number().over(W.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed), "__key"), "__key")))
    k = k.join(F.broadcast(ends), F.col("__part") == F.col("m_part"))  # at most MAX_PARTS rows of MAX_PARTS numbers
    k = k.withColumn("shard", F.size(F.filter("shard_ends", lambda e: e < F.col("__rank"))))
    k = k.withColumn("__block", F.size(F.filter(F.element_at("block_ends", F.col("shard") + 1), lambda e: e < F.col("__rank"))))
    k = k.drop("shard_ends", "block_ends", "m_part", "__rank")
    again = W.partitionBy("shard", "__block").orderBy(F.xxhash64(F.lit(seed + 1), "__key"), "__key")
    start = F.element_at(F.element_at(first, F.col("shard") + 1), F.col("__block") + 1)
    return k.withColumn("slot", start + F.row_number().over(again) - 1)


def shard_plan(docs: DataFrame, shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    d = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    d = d.withColumn("__key", F.xxhash64("doc_id", "size", "text_crc32"))
    return _placed(d, shards, seed).select("doc_id", "size", "text_crc32", "shard", "slot")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 20) -> DataFrame:
    """The input's rows and columns (packed in ``row``), with shard and slot."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("__key"))
    return _placed(packed, shards, seed).select("row", "shard", "slot")


def op4_hypergeometric_shuffle(spark, sf_dir):
    p = shard_plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
