"""FASTA records, read and written by Spark's own text source, and a parser of the rows of command files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Lines that hold a structure or a constraint instead of letters.
STRUCTURE_LINE = r"^[.()<>{}\[\]|,x]+(\s.*)?$"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq of each record; sequence lines are joined, comment lines (; # % * /), lines of a
    structure and text before the first header left out (``records.read_plain`` reads files without headers)."""
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"), F.col("value").startswith(">").alias("first"))
    lines = F.split("v", r"\r?\n")
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: ~x.rlike("^[;#%*/]") & ~x.rlike(STRUCTURE_LINE))
    head = F.trim(F.element_at(lines, 1))
    r = r.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("id"), head.alias("description"), F.regexp_replace(F.array_join(body, ""), r"\s+", "").alias("seq"))
    return r.filter("seq <> ''")


def write_fasta(df: DataFrame, path: str, key: str = "id", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def parse_commands(lines: DataFrame) -> DataFrame:
    """Rows (value) of a command file -> command, i, j, k; ranges a-b are expanded to one row per position pair."""
    f = F.split(F.trim("value"), r"\s+")
    part = lambda n: F.when(F.size(f) > n, F.element_at(f, n + 1))
    low = lambda c: F.regexp_extract(c, r"^(\d+)", 1).cast("int")
    high = lambda c: F.coalesce(F.regexp_extract(c, r"-(\d+)$", 1).try_cast("int"), low(c))
    d = lines.select(part(0).alias("command"), part(1).alias("a"), part(2).alias("b"), part(3).try_cast("int").alias("k")).filter(F.col("command").isin("P", "F", "A", "C", "E") & F.col("a").isNotNull() & F.col("b").isNotNull())
    d = d.withColumn("i", F.explode(F.sequence(low(F.col("a")), high(F.col("a")))))
    return d.withColumn("j", F.explode(F.sequence(low(F.col("b")), high(F.col("b"))))).select("command", "i", "j", "k")


def stacked_pairs(commands: DataFrame) -> DataFrame:
    """command, i, j of the k pairs stacked inside each (i, j)."""
    d = commands.withColumn("s", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)) - 1)))
    return d.select("command", (F.col("i") + F.col("s")).alias("i"), (F.col("j") - F.col("s")).alias("j"))
