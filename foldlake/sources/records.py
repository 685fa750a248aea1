"""Text files of alignments, reactivities and connect tables, read by Spark's own text source.

Defined results: lines that are no record lines are left out; an empty file has no rows; names keep their order of first
appearance in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _rows(records: DataFrame, line_is_row: Column, name: Column, seq: Column) -> DataFrame:
    """aln, row, name, seq: the pieces of each name in records (aln, rec, value), joined in the order of their lines."""
    numbered = F.transform(F.split("value", r"\r?\n"), lambda x, k: F.struct(k.alias("k"), x.alias("line")))
    lines = records.select("aln", "rec", F.explode(numbered).alias("x")).select("aln", "rec", "x.k", "x.line").filter(line_is_row)
    parts = lines.select("aln", "rec", "k", name.alias("name"), seq.alias("part"))
    g = parts.groupBy("aln", "rec", "name").agg(F.min("k").alias("row"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p"))
    return g.select("aln", "row", "name", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("seq"))


def _field(n: int) -> Column:
    return F.regexp_extract("line", r"^\s*(\S+)\s+(\S+)", n)


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """aln (its ID line, or its place), row, name, seq of every alignment; blocks of one name are joined."""
    r = spark.read.option("lineSep", "\n//").text(path).select("value", F.monotonically_increasing_id().alias("rec"))
    own = F.regexp_extract("value", r"#=GF\s+ID\s+(\S+)", 1)
    r = r.select(F.when(own != "", own).otherwise(F.col("rec").cast("string")).alias("aln"), "rec", "value")
    return _rows(r, F.col("line").rlike(r"^\s*[^#\s/]\S*\s+\S+\s*$"), _field(1), _field(2))


def read_stockholm_structures(spark: SparkSession, path: str) -> DataFrame:
    """aln and structure: the '#=GC SS_cons' lines of every alignment that has some, joined; '<' and '>' read as brackets."""
    r = spark.read.option("lineSep", "\n//").text(path).select("value", F.monotonically_increasing_id().alias("rec"))
    own = F.regexp_extract("value", r"#=GF\s+ID\s+(\S+)", 1)
    parts = F.regexp_extract_all("value", F.lit(r"(?m)^#=GC\s+SS_cons\s+(\S+)"), F.lit(1))
    r = r.select(F.when(own != "", own).otherwise(F.col("rec").cast("string")).alias("aln"), F.translate(F.array_join(parts, ""), "<>", "()").alias("structure"))
    return r.filter("structure <> ''")


#: How a file begins, in the order in which formats are tried.
FORMATS = {"stockholm": r"^\s*# STOCKHOLM", "clustal": r"^\s*CLUSTAL", "fasta": r"^\s*>", "maf": r"^\s*##maf"}


def _formatted(spark: SparkSession, path: str) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("value").rlike(v), k) for k, v in FORMATS.items()])
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), kind.alias("format"), "value")


def alignment_formats(spark: SparkSession, path: str) -> DataFrame:
    """file, format (stockholm, clustal, fasta, maf; null for others) of every file."""
    return _formatted(spark, path).select("file", "format")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """file, format, record (its number in the file), row (of appearance in the record), name, seq of the alignments of all
    files, whatever their formats; files of none have no rows."""
    f = _formatted(spark, path).filter("format IS NOT NULL")
    cut = F.when(F.col("format") == "stockholm", F.split("value", r"\n//")).when(F.col("format") == "maf", F.split("value", r"\r?\n[ \t]*\r?\n")).otherwise(F.array("value"))
    records = f.select("file", "format", F.explode(F.transform(cut, lambda x, k: F.struct(k.alias("record"), x.alias("text")))).alias("x")).select("file", "format", "x.*")
    lines = F.transform(F.split("text", r"\r?\n"), lambda x, k: F.struct(k.alias("k"), x.alias("line")))
    r = records.select("file", "format", "record", F.explode(lines).alias("x")).select("file", "format", "record", "x.*")
    words = F.split(F.trim("line"), r"\s+")
    plain = r.filter(
        (F.col("format") == "stockholm") & F.col("line").rlike(r"^\s*[^#\s/]\S*\s+\S+\s*$")
        | (F.col("format") == "clustal") & F.col("line").rlike(r"^[^#\s]\S*\s+[A-Za-z.~_-]+(\s+\d+)?\s*$") & ~F.col("line").startswith("CLUSTAL")
    ).select("file", "format", "record", "k", words[0].alias("name"), words[1].alias("part"))
    maf = r.filter((F.col("format") == "maf") & F.col("line").rlike(r"^s\s") & (F.size(words) == 7)).select("file", "format", "record", "k", words[1].alias("name"), words[6].alias("part"))
    blocks = F.filter(F.split("text", r"(?:^|\n)\s*>"), lambda x: x != "")
    fasta = records.filter(F.col("format") == "fasta").select("file", "format", "record", F.explode(F.transform(blocks, lambda x, k: F.struct(k.alias("k"), x.alias("line")))).alias("x"))
    body = F.regexp_replace(F.regexp_replace("x.line", r"^[^\n]*", ""), r"\s+", "")
    fasta = fasta.select("file", "format", "record", "x.k", F.regexp_extract("x.line", r"^\s*(\S+)", 1).alias("name"), body.alias("part")).filter("part <> ''")
    # Pieces of one name are one row, but for formats whose names may repeat.
    piece = F.when(F.col("format").isin("maf", "fasta"), F.col("k")).otherwise(-1)
    g = plain.unionByName(maf).unionByName(fasta).groupBy("file", "format", "record", "name", piece.alias("piece"))
    g = g.agg(F.min("k").alias("k"), F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p"))
    row = F.row_number().over(Window.partitionBy("file", "record").orderBy("k")) - 1
    return g.select("file", "format", "record", row.alias("row"), "name", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("seq"))


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """aln (the file), row, name, seq of one alignment a file; conservation lines and counts are left out."""
    r = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("aln"), F.lit(0).cast("long").alias("rec"), "value")
    return _rows(r, F.col("line").rlike(r"^[^#\s]\S*\s+[A-Za-z.~_-]+(\s+\d+)?\s*$") & ~F.col("line").startswith("CLUSTAL"), _field(1), _field(2))


def read_reactivities(spark: SparkSession, path: str) -> DataFrame:
    """pos, nt, reactivity of lines 'pos', 'pos value' or 'pos nt value'; a missing base is N, a missing value (or one
    below 0) null."""
    f = F.split(F.trim("value"), r"\s+")
    r = spark.read.text(path).select(f.alias("f")).filter(F.col("f")[0].rlike(r"^\d+$"))
    value = F.when(F.size("f") > 1, F.element_at("f", -1).try_cast("double"))
    nt = F.when(F.size("f") > 2, F.get("f", F.lit(1))).otherwise("N")
    return r.select(F.col("f")[0].cast("int").alias("pos"), nt.alias("nt"), F.when(value >= 0, value).alias("reactivity"))


def read_connect(spark: SparkSession, path: str) -> DataFrame:
    """file, i, base, partner of connect tables, one structure a file; the header line is left out."""
    f = F.split(F.trim("value"), r"\s+")
    r = spark.read.text(path).select(F.input_file_name().alias("file"), f.alias("f")).filter((F.size("f") == 6) & F.col("f")[1].rlike("^[A-Za-z]$"))
    return r.select("file", F.col("f")[0].cast("int").alias("i"), F.upper(F.col("f")[1]).alias("base"), F.col("f")[4].cast("int").alias("partner"))


def connect_lines(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, i and the text line of rows of ``structure.connect_table``."""
    return table.select(key, "i", F.concat_ws(" ", "i", "base", "before", "after", "partner", "i").alias("line"))


def bpseq_lines(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, i and the bpseq line (position, base, partner) of rows of ``structure.connect_table``."""
    return table.select(key, "i", F.concat_ws(" ", "i", "base", "partner").alias("line"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """aln, row, name, start, size, strand, source_size, seq of the sequence lines of every alignment block; blocks are
    parted by blank lines, and other lines are left out."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("aln", F.monotonically_increasing_id())
    blocks = blocks.select("aln", F.posexplode(F.split("value", r"\r?\n")).alias("row", "line"))
    f = F.split(F.trim("line"), r"\s+")
    r = blocks.select("aln", "row", f.alias("f")).filter((F.col("f")[0] == "s") & (F.size("f") == 7))
    number = lambda n: F.col("f")[n].try_cast("long")
    return r.select("aln", "row", F.col("f")[1].alias("name"), number(2).alias("start"), number(3).alias("size"), F.col("f")[4].alias("strand"), number(5).alias("source_size"), F.col("f")[6].alias("seq"))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """seq of the lines of files without headers, one sequence a line; comments and lines of other than letters, '-', '_',
    '.' and '&' are left out."""
    return spark.read.text(path).select(F.trim("value").alias("seq")).filter(F.col("seq").rlike("^[A-Za-z][A-Za-z._&-]*$"))


def alignment_faults(rows: DataFrame, aln: str = "aln", seq: str = "seq") -> DataFrame:
    """aln, n_rows, n_columns (null if rows differ), n_empty of alignments that cannot be used: rows of unequal lengths, or none with
    letters."""
    g = rows.groupBy(aln).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.length(F.coalesce(seq, F.lit("")))).alias("low"), F.max(F.length(F.coalesce(seq, F.lit("")))).alias("high"), F.count_if(~F.coalesce(F.col(seq).rlike("[A-Za-z]"), F.lit(False))).alias("n_empty"))
    bad = (F.col("low") < F.col("high")) | (F.col("n_empty") == F.col("n_rows"))
    return g.filter(bad).select(aln, "n_rows", F.when(F.col("low") == F.col("high"), F.col("low")).alias("n_columns"), "n_empty")


def energy_text(structure: Column, energy: Column) -> Column:
    """The structure and its energy (0.01 kcal/mol) in kcal/mol, as in fold reports: '((...)) ( -1.20)'."""
    return F.format_string("%s (%6.2f)", structure, energy.cast("double") / 100)


def fold_json(folds: DataFrame) -> DataFrame:
    """One JSON text per row, of all its columns."""
    return folds.select(F.to_json(F.struct("*")).alias("value"))
