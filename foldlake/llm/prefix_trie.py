"""Prefix trie of conversations by truncation peeling.

Every distinct conversation starts at its own depth. From the deepest level down, the conversations that end at a level
are merged with the nodes that survive from below, and all are stripped of their last turn and grouped again by what is
left; counts, leaves and saved tokens are aggregated as the nodes appear. The turns that one distinct conversation has
to itself are stripped in one step, so the rounds are as many as the deepest prefix that two different conversations
share. A prefix is known by 128 bits (two XORs of hashes of its turns and their places), so no sequence travels.

Defined results: turns are ordered by turn (null first), then role and text, so ties and repeated rows have one order;
a null role or text is empty; rows of a null conv_id belong to no conversation; other columns are ignored; an empty
table gives no nodes. A conversation of any number of turns is numbered by ranges of one sort and hashed in chunks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, crc32_sql, materialize, numbered, scratch_path, small, table

#: Turns of a conversation that are hashed in one group, and width of a range of conv_ids whose list is one row.
CHUNK, IDS = 1024, 4096
#: Conversations of a hundred share the first turns of the first of them: as many as the remainder by SHARED.
SHARED = 6


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, d (place from 1), t1 and t2 (hashes of role and text), n_chars, size; conversations: conv_id, size)
    after the first turns of every conversation are replaced by those of the first conversation of its hundred."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).filter("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    t = numbered(t, "conv_id", order)
    t = t.select("conv_id", "nr", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit("/"), "role").alias("t2"), F.length("text").cast("long").alias("n_chars"))
    t = materialize(t, "turns")
    ids = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    ids = ids.withColumn("first", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % SHARED)
    heads = t.filter((F.col("conv_id") % 100 == 0) & (F.col("nr") < SHARED - 1)).groupBy(F.col("conv_id").alias("of")).agg(F.collect_list(F.struct("nr", "t1", "t2", "n_chars")).alias("head"))
    ids = ids.join(heads, F.col("first") == F.col("of"), "left")  # at most 199 conversations and one row of heads a key
    ids = ids.withColumn("head", F.filter("head", lambda x: x["nr"] < F.col("h")))
    ids = ids.select("conv_id", "h", F.coalesce("head", F.array().cast("array<struct<nr:long,t1:long,t2:long,n_chars:long>>")).alias("head"), "own")
    ids = materialize(ids.withColumn("size", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "ids")
    taken = ids.select("conv_id", "size", F.explode("head").alias("x")).select("conv_id", (F.col("x.nr") + 1).alias("d"), "x.t1", "x.t2", "x.n_chars", "size")
    plan = ids.select(F.col("conv_id").alias("c"), "h", F.size("head").alias("n_head"), "size")
    kept = t.join(small(plan), F.col("conv_id") == F.col("c")).filter(F.col("nr") >= F.col("h"))
    kept = kept.select("conv_id", (F.col("nr") - F.col("h") + F.col("n_head") + 1).alias("d"), "t1", "t2", "n_chars", "size")
    return taken.unionByName(kept), ids.select("conv_id", "size")


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, d (0 to size), f1 and f2 (the prefix of d turns), p1 and p2 (that of d - 1), n_chars (of turn d), upto
    (code points of the prefix), size: one row per conversation and prefix."""
    t = turns.withColumn("h1", F.xxhash64("d", "t1", "t2")).withColumn("h2", F.xxhash64("t2", "d", "t1")).withColumn("chunk", F.floor((F.col("d") - 1) / CHUNK))
    run = W.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    x = t.select("conv_id", "chunk", "d", "h1", "h2", "n_chars", "size", F.bit_xor("h1").over(run).alias("f1"), F.bit_xor("h2").over(run).alias("f2"), F.sum("n_chars").over(run).alias("upto"))
    if not ids.filter(F.col("size") > CHUNK).isEmpty():
        c = t.filter(F.col("size") > CHUNK).groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"), F.sum("n_chars").alias("cn"))
        before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
        c = c.select(F.col("conv_id").alias("c_conv"), F.col("chunk").alias("c_chunk"), *[F.coalesce(f(n).over(before), F.lit(0)).alias(n) for f, n in ((F.bit_xor, "c1"), (F.bit_xor, "c2"), (F.sum, "cn"))])
        x = x.join(c, (F.col("conv_id") == F.col("c_conv")) & (F.col("chunk") == F.col("c_chunk")), "left")
        x = x.withColumns({"f1": F.col("f1").bitwiseXOR(F.coalesce("c1", F.lit(0))), "f2": F.col("f2").bitwiseXOR(F.coalesce("c2", F.lit(0))), "upto": F.col("upto") + F.coalesce("cn", F.lit(0))})
    x = x.select("conv_id", "d", "f1", "f2", F.col("f1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("f2").bitwiseXOR(F.col("h2")).alias("p2"), "n_chars", "upto", "size")
    nothing = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    roots = ids.select("conv_id", zero.alias("d"), zero.alias("f1"), zero.alias("f2"), nothing.alias("p1"), nothing.alias("p2"), zero.alias("n_chars"), zero.alias("upto"), "size")
    return roots.unionByName(x.withColumn("d", F.col("d").cast("long")))


def _digests(batches):
    """SHA-256 of the lists of one node, row after row; rows of a node may cross batches."""
    schema = pa.schema([("e_d", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()), ("ends_sha256", pa.string())])

    def rows():
        at, state = None, None
        for b in batches:
            for d, f1, f2, ids in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (d, f1, f2) == at:
                    state.update(b",")
                else:
                    if at:
                        yield (*at, state.hexdigest()), 100
                    at, state = (d, f1, f2), hashlib.sha256()
                state.update(ids.encode())
        if at:
            yield (*at, state.hexdigest()), 100

    yield from arrow_rows(rows(), schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """e_d, e1, e2, ends_sha256 of every prefix that is a whole conversation."""
    s = ends.groupBy("d", "f1", "f2", F.floor(F.col("conv_id") / IDS).alias("range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))  # at most IDS a row
    s = s.select("d", "f1", "f2", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "range")
    return s.repartition("d", "f1", "f2").sortWithinPartitions("d", "f1", "f2", "range").mapInArrow(_digests, "e_d long, e1 long, e2 long, ends_sha256 string")


SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    p = materialize(prefixes(*rebuilt(conversations)), "prefixes")
    ends = p.filter(F.col("d") == F.col("size"))
    whole = ends.groupBy("d", "f1", "f2").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("upto").alias("total"))
    whole = materialize(whole, "whole")
    r = p.join(small(whole.select("rep", "n", "total")), F.col("conv_id") == F.col("rep"))
    one = ("conv_id", "n_chars", "upto", "size", "n", "total")  # of prefixes of one distinct conversation all rows agree
    found = r.groupBy("d", "f1", "f2").agg(F.count(F.lit(1)).alias("k"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in one[1:]])
    found = materialize(found, "found")
    shared = found.filter("k > 1").select("d", "f1", "f2", "p1", "p2", "n_chars")
    alone = found.filter("k = 1").select(
        "d", "f1", "f2", "p1", "p2", "conv_id", F.col("n").alias("n_convs"), (F.col("d") < F.col("size")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("total") - F.col("upto") + F.col("n_chars"))).alias("saved_tokens"),
    )
    deepest = shared.agg(F.max("d")).first()[0]
    if deepest is None:
        nodes, parents = alone, None
    else:
        # What enters the shared levels: the stripped tails, and conversations that end at a shared prefix.
        top = alone.groupBy("conv_id").agg(F.min(F.struct("d", "p1", "p2", "n_convs", "saved_tokens")).alias("x")).filter("x.d > 0")
        zero = F.lit(0).cast("long")
        tails = top.select((F.col("x.d") - 1).alias("at"), F.col("x.p1").alias("f1"), F.col("x.p2").alias("f2"), "conv_id", F.col("x.n_convs").alias("n_convs"), (zero + 1).alias("n_children"), (zero + 1).alias("n_leaves"), F.col("x.saved_tokens").alias("saved_tokens"))
        ended = whole.join(shared.select("d", "f1", "f2"), ["d", "f1", "f2"], "left_semi").select(F.col("d").alias("at"), "f1", "f2", F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"))
        entering, levels, peeled = (scratch_path(spark, x) for x in ("entering", "levels", "peeled"))
        tails.unionByName(ended).write.partitionBy("at").parquet(entering)
        shared.withColumn("at", F.col("d")).write.partitionBy("at").parquet(levels)
        entering, levels = (spark.read.parquet(x) for x in (entering, levels))
        above = None
        for d in range(deepest, -1, -1):
            a = entering.filter(F.col("at") == d).drop("at")
            if above is not None:
                stripped = above.select(F.col("p1").alias("f1"), F.col("p2").alias("f2"), "conv_id", "n_convs", (zero + 1).alias("n_children"), "n_leaves", "saved_tokens")
                a = a.unionByName(stripped)
            g = a.groupBy("f1", "f2").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in SUMS])
            g = g.join(levels.filter(F.col("at") == d).drop("at"), ["f1", "f2"])
            g = g.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_chars"))
            g.select("d", "f1", "f2", "p1", "p2", "conv_id", *SUMS).write.parquet(f"{peeled}/at={d}")
            above = spark.read.schema(alone.schema).parquet(f"{peeled}/at={d}")
        merged = spark.read.schema(alone.schema).parquet(*[f"{peeled}/at={d}" for d in range(deepest + 1)])
        parents = merged.select((F.col("d") + 1).alias("child_d"), F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.col("conv_id").alias("shared_parent"))
        nodes = alone.unionByName(merged)
    own = F.when(F.col("d") > 0, F.col("conv_id"))
    if parents is None:
        nodes = nodes.withColumn("parent_conv_id", own)
    else:
        nodes = nodes.join(small(parents), (F.col("d") == F.col("child_d")) & (F.col("p1") == F.col("q1")) & (F.col("p2") == F.col("q2")), "left").withColumn("parent_conv_id", F.coalesce("shared_parent", own))
    e = end_digests(ends.select("d", "f1", "f2", "conv_id"))
    nodes = nodes.join(e, (F.col("d") == F.col("e_d")) & (F.col("f1") == F.col("e1")) & (F.col("f2") == F.col("e2")), "left")
    return nodes.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", *SUMS, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS first, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM o)),
t AS (SELECT c.conv_id, 0 AS part, r, role, text FROM c JOIN o ON o.conv_id = c.first AND o.r <= c.h UNION ALL SELECT c.conv_id, 1, r, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND o.r > c.h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, r) AS d, text, md5(length(role) || ':' || role || text) AS x FROM t),
p AS (SELECT conv_id, d, length(text) AS n_chars, md5(string_agg(x, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM n UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
e AS (SELECT conv_id, max(d) AS size FROM p GROUP BY conv_id),
l AS (SELECT p.*, lag(k) OVER (PARTITION BY p.conv_id ORDER BY d) AS up, size FROM p JOIN e ON p.conv_id = e.conv_id),
g AS (SELECT d, k, any_value(up) AS up, any_value(n_chars) AS n_chars, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = size), '')) AS ends_sha256 FROM l GROUP BY d, k),
f AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY up, d),
m AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN f ON g.k = f.up AND g.d = f.d),
s AS (SELECT p.d, p.k, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.n_chars) AS saved FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.d, p.k)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON m.k = s.k AND m.d = s.d LEFT JOIN m u ON m.up = u.k AND m.d = u.d + 1
"""
