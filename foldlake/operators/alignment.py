"""Aggregates over multiple alignments: rows (aln, seq); a row ends in gaps up to the longest one.

Everything is computed from counts per column and base (or column pair and base pair), which aggregate before they
shuffle; no pair of sequences is ever formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import PAIR_TYPES
from .structure import letters


def _sizes(aln: DataFrame) -> DataFrame:
    """of, n_seq, width: rows and longest row of each alignment."""
    return aln.groupBy(F.col("aln").alias("of")).agg(F.count(F.lit(1)).alias("n_seq"), F.max(F.length("seq")).alias("width"))


def _counts(aln: DataFrame, names: list[str], add, spans: list[int]) -> DataFrame:
    """aln, d, i and sums of the counts ``names`` over the rows. A task keeps one array of counts an alignment and span, to
    which add(counts, letters of a row, d) adds a row, and gives its sums when it ends or when they fill HELD numbers."""

    def run(batches):
        held: dict = {}

        def given():
            for (key, d), x in held.items():
                i = np.flatnonzero(x.any(0))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(i), kind), pa.array(np.full(len(i), d, np.int32)), pa.array((i + 1).astype(np.int32)), *[pa.array(v[i]) for v in x]], ["aln", "d", "i", *names])
            held.clear()

        kind, size = None, 0
        for b in batches:
            kind = b.column(0).type
            for key, seq in zip(b.column(0).to_pylist(), b.column(1)):
                row = letters(seq.as_py())
                for d in spans:
                    x = held.get((key, d))
                    if x is None or x.shape[1] < len(row):
                        new = np.zeros((len(names), max(len(row), 64) * 5 // 4), np.int64)
                        if x is not None:
                            new[:, : x.shape[1]] = x
                        size += new.size - (0 if x is None else x.size)
                        x = held[key, d] = new
                    add(x, row, d)
                if size > HELD:
                    yield from given()
                    size = 0
        yield from given()

    kind = aln.schema["aln"].dataType.simpleString()
    c = aln.select("aln", "seq").mapInArrow(run, f"aln {kind}, d int, i int, " + ", ".join(f"`{n}` long" for n in names))
    return c.groupBy("aln", "d", "i").agg(*[F.sum(n).alias(n) for n in names])


#: Numbers that a task counts with at once.
HELD = 1 << 24


def _sized(c: DataFrame, aln: DataFrame) -> DataFrame:
    """c with n_seq and width of its alignments."""
    return c.join(_sizes(aln), F.col("aln").eqNullSafe(F.col("of"))).drop("of")


def column_counts(aln: DataFrame) -> DataFrame:
    """aln, i, A, C, G, U, gap, n_seq, width: one row per column up to the longest row with a base; a row ends in gaps."""

    def add(x, row, d):
        for k, b in enumerate(b"ACGU"):
            x[k, : len(row)] += row == b

    c = _sized(_counts(aln, list("ACGU"), add, [0]).drop("d"), aln)
    return c.withColumn("gap", F.col("n_seq") - F.col("A") - F.col("C") - F.col("G") - F.col("U"))


def _text(c: DataFrame, letter: Column, name: str) -> DataFrame:
    """aln and the letters of its columns in order."""
    x = c.select("aln", F.struct("i", letter.alias("x")).alias("s")).groupBy("aln").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return x.select("aln", F.array_join(F.transform("s", lambda r: r["x"]), "").alias(name))


def consensus(aln: DataFrame) -> DataFrame:
    """aln, consensus: the most frequent base of each column, the first in code order (gap first) among equals."""
    most = F.greatest("gap", *"ACGU")
    letter = F.when(F.col("gap") == most, "-")
    for b in "ACGU":
        letter = letter.when(F.col(b) == most, b)
    return _text(column_counts(aln), letter, "consensus")


def mean_pairwise_identity(aln: DataFrame) -> DataFrame:
    """aln, n_seq, identity: equal columns over all pairs of sequences, in whole percent."""
    same = sum(F.col(b) * (F.col(b) - 1) for b in (*"ACGU", "gap"))
    j = column_counts(aln).groupBy("aln").agg(F.max("n_seq").alias("n_seq"), F.max("width").alias("width"), F.sum(same).alias("same"))
    ordered = F.col("n_seq") * (F.col("n_seq") - 1) * F.col("width")
    return j.select("aln", "n_seq", F.when(ordered > 0, F.floor(100 * F.col("same") / ordered)).otherwise(100).alias("identity"))


def _pair_counts(aln: DataFrame, span: tuple[int, int]) -> DataFrame:
    """aln, i, j, t1 to t6 (rows by kind of pair), one and other (rows with a base in i, in j), both, n_seq, for the pairs of
    columns within the span."""
    kinds = np.zeros((128, 128), np.int8)
    for pair, t in PAIR_TYPES.items():
        kinds[ord(pair[0]), ord(pair[1])] = t
    gaps = np.isin(np.arange(128), [ord(c) for c in "-_.~"])

    def add(x, row, d):
        b = row & 127
        full = ~gaps[b]
        n = max(len(b) - d, 0)
        t = kinds[b[:n], b[d:]]
        for k in range(1, 7):
            x[k - 1, :n] += t == k
        x[6, : len(b)] += full
        x[7, :n] += full[d:]
        x[8, :n] += full[:n] & full[d:]

    c = _counts(aln, [*[f"t{k}" for k in range(1, 7)], "one", "other", "both"], add, list(range(span[0], span[1] + 1)))
    return _sized(c.withColumn("j", F.col("i") + F.col("d")).drop("d"), aln)


def _compatible():
    return sum((F.col(f"t{k}") for k in PAIR_TYPES.values()), F.lit(0))


def pair_support(aln: DataFrame, span: tuple[int, int] = (4, 8)) -> DataFrame:
    """aln, i, j, n_seq, compatible, types, entropy for the pairs of columns within the span that some row can pair: rows
    whose bases can pair, how many kinds of pair, and the entropy (bits) of the kinds among all rows."""
    c = _pair_counts(aln, span).withColumn("compatible", _compatible()).filter("compatible > 0")
    share = [F.col(f"t{k}") / F.col("n_seq") for k in PAIR_TYPES.values()] + [1 - F.col("compatible") / F.col("n_seq")]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0))
    return c.select("aln", "i", "j", "n_seq", "compatible", sum(((F.col(f"t{k}") > 0).cast("long") for k in PAIR_TYPES.values()), F.lit(0)).alias("types"), entropy.alias("entropy"))


#: Fixed value: score of a pair of columns that may not pair.
FORBIDDEN = -10_000


def covariance(aln: DataFrame, span: tuple[int, int] = (4, 8), cv: float = 1.0, nc: float = 1.0) -> DataFrame:
    """aln, i, j, score (0.01 kcal/mol) of the pairs of columns within the span that some row can pair.

    The distances of all pairs of kinds of pair, by the rows of either, over the rows, less ``nc`` times 100 for a row that
    can't pair and 25 for one with gaps in both columns; all times ``cv``. FORBIDDEN where twice the rows that can't and those
    with two gaps are more than the rows.
    """
    c = _pair_counts(aln, span).withColumn("compatible", _compatible()).filter("compatible > 0")
    names = list(PAIR_TYPES.items())
    apart = sum(F.col(f"t{v}") * F.col(f"t{w}") * sum(x != y for x, y in zip(a, b)) for k, (a, v) in enumerate(names) for b, w in names[k + 1 :])
    empty = F.col("n_seq") - (F.col("one") + F.col("other") - F.col("both"))
    wrong = F.col("n_seq") - F.col("compatible") - empty
    score = cv * (100.0 * apart / F.col("n_seq") - nc * 100.0 * (wrong + empty * 0.25))
    return c.select("aln", "i", "j", F.when(2 * wrong + empty > F.col("n_seq"), F.lit(FORBIDDEN)).otherwise(score.cast("long")).alias("score"))


def most_informative(aln: DataFrame) -> DataFrame:
    """aln, mis: per column the IUPAC letter of all bases at least as frequent there as in the whole alignment, lower
    case where gaps are more frequent than in the whole alignment; '-' where no base is."""
    c = column_counts(aln)
    every = c.groupBy(F.col("aln").alias("e")).agg(*[F.sum(b).alias(f"all_{b}") for b in (*"ACGU", "gap")])
    c = c.join(every, F.col("aln").eqNullSafe(F.col("e")))
    bit = lambda b, v: F.when(F.col(b) * F.col("width") >= F.col(f"all_{b}"), v).otherwise(0)
    code = bit("A", 1) + bit("C", 2) + bit("G", 4) + bit("U", 8)
    # IUPAC letters by the set of A (1), C (2), G (4), U (8).
    letter = F.substring(F.lit("-ACMGRSVUWYHKDBN"), code + 1, F.lit(1))
    return _text(c, F.when(F.col("gap") * F.col("width") > F.col("all_gap"), F.lower(letter)).otherwise(letter), "mis")
