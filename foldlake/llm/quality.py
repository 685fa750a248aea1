"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. Policies are
versioned masks over those bits, so a new policy or an ablation never reads a text again: rejections, rejections by one
rule alone and kept counts come from one aggregation by distinct bit pattern and bitwise tests.

Defined results: a null text measures as the empty text; a null doc_id is a row like others; repeated rows each get an
entry; other columns are ignored by ``ledger`` and kept by ``store`` and ``keep``; an empty table gives an empty ledger.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, file_system, table

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_CAPITAL = re.compile(r"[A-Z]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")

#: bit -> (name, SQL condition over the measures that fails the rule). Append only: bits keep their meaning.
RULES = {
    0: ("few_words", "n_words < 50"),
    1: ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbols", "10 * n_symbols > n_words"),
    3: ("duplicate_lines", "n_lines >= 10 AND 100 * n_dup_lines > 50 * n_lines"),
    4: ("capitals", "100 * n_capitals > 50 * word_chars"),
    5: ("short_words", "word_chars < 2 * n_words"),
    6: ("long_words", "word_chars > 20 * n_words"),
}
BASE_BITS = 0b11
#: version -> mask of the rules that reject. v1 is the base alone; v2 is in production.
POLICIES = {"v1": 0b0000011, "v2": 0b1111111}
CURRENT = "v2"


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of one whole text."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        if len(seen) < len(windows):
            end = 0
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return (
        len(words),
        sum(map(len, words)),
        len(_SYMBOL.findall(text)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        sum(map(len, _CAPITAL.findall(text))),
    )


def _measured(batches):
    schema = pa.schema([("doc_id", pa.int64())] + [(m, pa.int64()) for m in MEASURES])
    rows = (((i, *measure(t.as_py() or "")), 80) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1)))
    yield from arrow_rows(rows, schema)


def fail_bits() -> Column:
    out = F.lit(0).cast("long")
    for bit, (_, condition) in RULES.items():
        out = out.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and fail_bits of every row."""
    out = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    m = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, out)
    return m.withColumn("fail_bits", fail_bits())


def verdict(policy: str = CURRENT) -> Column:
    """True where the ledger's row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that would be kept without it."""
    mask = POLICIES[policy]
    patterns = led.groupBy("fail_bits").count().withColumn("bits", F.col("fail_bits").bitwiseAND(F.lit(mask)))  # 2^rules rows at most
    rules = F.explode(F.array(*[F.struct(F.lit(1 << b).cast("long").alias("bit"), F.lit(n).alias("rule")) for b, (n, _) in RULES.items() if mask >> b & 1]))
    p = patterns.select("bits", "count", rules.alias("r"))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return p.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(F.when(failed, F.col("count")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("only_by_it"))


def marked(docs: DataFrame) -> DataFrame:
    """The rows (packed in ``row``) with their ledger entry: measures and fail_bits, each rule evaluated once."""
    @F.pandas_udf(", ".join(f"{m} long" for m in MEASURES))
    def measures(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t or "") for t in text], columns=list(MEASURES))

    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measures("text").alias("m"))
    return d.select("row", *[F.col(f"m.{m}").alias(m) for m in MEASURES]).withColumn("fail_bits", fail_bits())


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write the rows with their ledger entries once; policies and ablations read the entries back without the texts."""
    marked(docs).write.parquet(path)
    _STORED.append(path)
    return docs.sparkSession.read.parquet(path)


_STORED: list[str] = []


def drop_stored(docs: DataFrame) -> None:
    """Delete the stored ledgers, which hold whole rows, that docs does not read. For a stage whose input was written and
    read again: what was taken from the ledgers before is written by then."""
    read = docs.inputFiles()
    for path in [p for p in _STORED if not any(p.rsplit("/", 1)[1] in f for f in read)]:
        at, files = file_system(docs.sparkSession, path)
        files.delete(at, True)
        _STORED.remove(path)


def keep(stored: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The stored rows that pass the policy, with the input's columns."""
    return stored.filter(verdict(policy)).select("row.*")


def op6_rule_ledger(spark, sf_dir):
    led = ledger(table(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE_BITS)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict()).alias("kept"), "fail_bits")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (n_lines >= 10 AND 100 * n_dup_lines > 50 * n_lines)::INT
  + 16 * (100 * n_capitals > 50 * word_chars)::INT + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 20 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
