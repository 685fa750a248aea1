"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space that separates words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, so that every engine agrees; null becomes the empty text."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))


def split_words(text: Column, separator: str = SPACE) -> Column:
    """Array of words; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


#: bytes.translate table that lower-cases A-Z; bytes.split() then cuts at exactly SPACE.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_words(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(LOWER_BYTES).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a new local one serves a
    local master (tests); on a cluster that is an error, as executors would not see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="foldlake-"))
    return where.rstrip("/")


_LOCAL: dict[str, str] = {}


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is there when the application ends goes."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    at, files = file_system(spark, path)
    files.mkdirs(at.getParent())
    files.deleteOnExit(at)
    return path


#: Whether the shuffle files of a query go as soon as it ends, and not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors. The shuffle files of
    the write, which nothing reads again, go with it."""
    spark = df.sparkSession
    path, before = scratch_path(spark, tag), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() once all that was made of them is written."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if not re.search(r"/\w+-[0-9a-f]{32}$", path):
                raise ValueError(f"not a table of materialize(): {path}")
            at, files = file_system(df.sparkSession, path)
            files.delete(at, True)


BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes of the values of a row: 8 each, and those of strings, binaries and arrays."""
    parts = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif kind == "array":
            parts.append(F.coalesce(F.size(c), F.lit(0)) * 8 + 16)
        else:
            parts.append(F.lit(8))
    return reduce(add, parts, F.lit(16)).cast("long")


def small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast where its measured bytes are few; df is read for that, so materialize it first."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= most_bytes else df


def numbered(t: DataFrame, key: str, order: list[Column], most: int = 4096) -> DataFrame:
    """t with nr: the number of the row among those of its key, from 0, in the order given; equal rows in any order.

    Keys of more rows than most are sorted all together by ranges, which cut long keys and equal rows too; the number is
    the count in the ranges before and the place in the range. The others are numbered by a window. Keys are not null.
    """
    long = t.groupBy(F.col(key).alias("l_key")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most)
    long = materialize(long.select("l_key", F.lit(True).alias("long")), "long")
    by_window = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long") - 1
    if long.isEmpty():
        return t.withColumn("nr", by_window)
    j = t.withColumn("salt", F.rand(1)).join(small(long), F.col(key) == F.col("l_key"), "left").drop("l_key")
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = [F.col(key), *order, F.col("salt")]
    r = j.filter("long").repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    r = materialize(r.select(*t.columns, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranges")
    s = r.groupBy(F.col(key).alias("s_key"), F.col("range").alias("s_range")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("s_key").orderBy("s_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = materialize(s.select("s_key", "s_range", (before - F.col("low")).alias("shift")), "starts")
    r = r.join(small(s), (F.col(key) == F.col("s_key")) & (F.col("range") == F.col("s_range"))).select(*t.columns, (F.col("at") + F.col("shift")).alias("nr"))
    return j.filter("long IS NULL").select(*t.columns).withColumn("nr", by_window).unionByName(r)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda z: CAST(ord(z) AS BIGINT))), lambda c, b: {bits}))"


def stream_groups(batches, keys: list[str]):
    """(key, rows) for each run of equal keys over sorted Arrow batches; rows are dicts. Runs may cross batches."""
    last, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != last:
                yield last, rows
                rows = []
            last = key
            rows.append(row)
    if rows:
        yield last, rows


def arrow_rows(rows, schema, most: int = 2000, most_bytes: int = 4 << 20):
    """Record batches of bounded size from an iterator of (tuple, bytes) pairs."""
    import pyarrow as pa

    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
