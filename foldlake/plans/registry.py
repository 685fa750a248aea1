"""The library's queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as fs
from ..operators import alignment, consensus, dimers, energy, folding, interactions, landscape, matching, paths, structure, windowed
from ..operators import parameters as par
from ..sources import records

#: Letters in a piece of a sequence that is folded on its own.
WIDTH = 60
#: Documents (by id) that a task takes at once to find the one before.
STEP = 1000


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark, sf_dir):
    """doc_id, lang, source and seq: the letters of the whole text as a sequence."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.coalesce(fs.from_text(F.col("text")), F.lit("")).alias("seq"))


def pieces(spark, sf_dir):
    """key (doc_id:piece) and seq: all letters of every text in consecutive pieces of WIDTH, from 0; one empty piece of a text without letters."""
    s = sequences(spark, sf_dir)
    cut = F.when(F.col("seq") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("seq", F.lit(f"(.{{1,{WIDTH}}})"), F.lit(1)))
    p = s.select("doc_id", F.posexplode(cut).alias("piece", "seq"))
    return p.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("piece").cast("string")).alias("key"), "seq")


def _of_piece(key="key"):
    """doc_id and piece out of the key of a piece."""
    part = lambda n: F.split_part(key, F.lit(":"), F.lit(n))
    return part(1).try_cast("long").alias("doc_id"), part(2).cast("int").alias("piece")


def structures(spark, sf_dir):
    """doc_id, seq, structure and other: the whole sequence, and the structures that pair its G with C, and its A with U,
    as brackets; those without a partner are unpaired."""
    return sequences(spark, sf_dir).select("doc_id", "seq", structure.bracketed("G", "C")("seq").alias("structure"), structure.bracketed("A", "U")("seq").alias("other"))


def alignment_rows(spark, sf_dir):
    """aln and seq: the sequences of a source are the rows of an alignment, which end in gaps."""
    return sequences(spark, sf_dir).filter(F.length("seq") > 0).select(F.col("source").alias("aln"), "seq")


SEQ = r"seqs AS (SELECT doc_id, lang, source, coalesce(translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGUACGUACGUACGUACGUACGUAC'), '') AS seq FROM documents)"
STR = SEQ + """, strs AS (SELECT doc_id, seq FROM seqs),
chars AS (SELECT doc_id, c, CAST(i AS INT) AS i FROM (SELECT doc_id, unnest(string_split(seq, '')) AS c, unnest(range(1, length(seq) + 1)) AS i FROM seqs) WHERE i IS NOT NULL)"""


def _pairs_sql(name: str, column: str) -> str:
    opening, closing = {"structure": "GC", "other": "AU"}[column]
    return f"""{name}_d AS (SELECT doc_id, i, CASE c WHEN '{opening}' THEN 1 WHEN '{closing}' THEN -1 ELSE 0 END AS d FROM chars),
{name}_s AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM {name}_d),
{name}_m AS (SELECT *, coalesce(least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS low, min(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM {name}_s),
{name}_p AS (SELECT doc_id, i, CASE WHEN d = 1 AND after < s THEN '(' WHEN d = -1 AND low <= s THEN ')' ELSE '.' END AS c FROM {name}_m),
{name}_h AS (SELECT *, CAST(sum(CASE c WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS height FROM {name}_p),
{name}_l AS (SELECT *, height + CASE c WHEN ')' THEN 1 ELSE 0 END AS level FROM {name}_h),
{name}_t AS (SELECT doc_id, i, c, height, level, CASE c WHEN '(' THEN lead(i) OVER w WHEN ')' THEN lag(i) OVER w ELSE 0 END AS partner FROM {name}_l WINDOW w AS (PARTITION BY doc_id, level, c <> '.' ORDER BY i)),
{name} AS (SELECT doc_id, i, partner AS j FROM {name}_t WHERE partner > i)"""


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {SEQ} SELECT lang, count(*) AS n_seq, CAST(sum(length(seq)) AS BIGINT) AS n_bases, CAST(sum(length(replace(replace(seq, 'A', ''), 'U', ''))) AS BIGINT) AS n_gc,
round(CAST(sum(length(replace(replace(seq, 'A', ''), 'U', ''))) AS DOUBLE) / CAST(sum(length(seq)) AS DOUBLE), 6) AS gc FROM seqs GROUP BY lang""")
def sequence_statistics(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("n_gc", fs.count_of(F.col("seq"), "G") + fs.count_of(F.col("seq"), "C"))
    return s.groupBy("lang").agg(F.count(F.lit(1)).alias("n_seq"), F.sum(F.length("seq")).alias("n_bases"), F.sum("n_gc").alias("n_gc"), F.round(F.sum("n_gc").cast("double") / F.sum(F.length("seq")).cast("double"), 6).alias("gc"))


@query(f"WITH {SEQ} SELECT doc_id, " + ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS INT) AS n_{b.lower()}" for b in "ACGU") + " FROM seqs")
def sequence_composition(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", *[fs.count_of(F.col("seq"), b).alias(f"n_{b.lower()}") for b in "ACGU"])


@query(f"WITH {SEQ} SELECT doc_id, translate(seq, 'ACGU', '1234') AS codes, seq AS decoded FROM seqs")
def sequence_codes(spark, sf_dir):
    c = fs.encoded(F.col("seq"))
    return sequences(spark, sf_dir).select("doc_id", F.array_join(c.cast("array<string>"), "").alias("codes"), fs.decoded(c).alias("decoded"))


@query(f"""WITH {SEQ}, x AS (SELECT doc_id, replace(seq, 'U', 'T') || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '&' END || CASE WHEN doc_id % 3 = 1 THEN reverse(seq) ELSE '' END AS s FROM seqs)
SELECT doc_id, translate(s, 'Tt', 'Uu') AS rna, CAST(CASE WHEN strpos(s, '&') = 0 OR strpos(s, '&') = length(s) THEN -1 ELSE strpos(s, '&') END AS INT) AS cut, translate(replace(s, 'A', '-'), '-_~.', '') AS ungapped FROM x""")
def sequence_strands(spark, sf_dir):
    third = F.col("doc_id") % 3
    s = F.concat(F.replace("seq", F.lit("U"), F.lit("T")), F.when(third == 0, "").otherwise("&"), F.when(third == 1, F.reverse("seq")).otherwise(""))
    x = sequences(spark, sf_dir).select("doc_id", s.alias("s"))
    return x.select("doc_id", fs.to_rna(F.col("s")).alias("rna"), fs.cut_point(F.col("s")).alias("cut"), fs.ungapped(F.replace("s", F.lit("A"), F.lit("-"))).alias("ungapped"))


@query(f"""WITH {SEQ}, x AS (SELECT doc_id, seq, lag(seq) OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, seq) AS before FROM seqs)
SELECT doc_id, CAST(coalesce(len(list_filter(list_zip(string_split(seq, ''), string_split(before, ''), true), lambda p: p[1] <> p[2] AND p[1] <> '' AND p[2] <> '')), 0) AS INT) AS distance FROM x WHERE before IS NOT NULL""")
def hamming_consecutive(spark, sf_dir):
    """Distance to the document before within the source (null ids and sources first; equal ids by sequence). Documents are
    taken STEP ids at a time; the first of each such run takes the last of the run before it, so no source is sorted in one
    task."""
    s = sequences(spark, sf_dir).select("doc_id", "source", "seq", F.floor(F.col("doc_id") / STEP).alias("run"))
    near = s.withColumn("before", F.lag("seq").over(W.partitionBy("source", "run").orderBy("doc_id", "seq")))
    runs = s.groupBy(F.col("source").alias("r_source"), F.col("run").alias("r_run")).agg(F.max_by("seq", F.struct("doc_id", "seq")).alias("last"))
    runs = runs.select("r_source", "r_run", F.lag("last").over(W.partitionBy("r_source").orderBy("r_run")).alias("last"))
    first = near.filter("before IS NULL").join(runs, F.col("source").eqNullSafe(F.col("r_source")) & F.col("run").eqNullSafe(F.col("r_run")))  # a row a run
    both = near.filter("before IS NOT NULL").select("doc_id", "seq", "before").unionByName(first.select("doc_id", "seq", F.col("last").alias("before")))
    return both.filter("before IS NOT NULL").select("doc_id", fs.hamming(F.col("seq"), F.col("before")).alias("distance"))


@query(f"""WITH {SEQ}, cells AS (SELECT doc_id, c, CAST(i AS INT) AS i FROM (SELECT doc_id, unnest(string_split(seq, '')) AS c, unnest(range(1, length(seq) + 1)) AS i FROM seqs) WHERE i IS NOT NULL),
x AS (SELECT doc_id, i, c || lead(c) OVER o || lead(c, 2) OVER o || lead(c, 3) OVER o AS g FROM cells WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id AS id, count(*) AS n, min(i) AS first FROM x WHERE regexp_matches(g, '^[AG][CU][ACGU][GU]$') GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS n_sites, first AS first_site FROM seqs LEFT JOIN n ON doc_id = id""")
def iupac_motif_sites(spark, sf_dir):
    x = sequences(spark, sf_dir).select("doc_id", fs.motif_starts(F.col("seq"), "RYNK").alias("at"))
    return x.select("doc_id", F.size("at").alias("n_sites"), F.get("at", F.lit(0)).alias("first_site"))


@query(f"WITH {STR}, {_pairs_sql('a', 'structure')} SELECT doc_id, i, partner FROM a_t")
def pair_table(spark, sf_dir):
    return structure.pair_table(structures(spark, sf_dir))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')}, o AS (SELECT *, sum((c = '(')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS opened FROM a_t)
SELECT doc_id, i, CAST(CASE WHEN level = 0 THEN 0 ELSE max(CASE WHEN c = '(' THEN opened END) OVER (PARTITION BY doc_id, level ORDER BY i) END AS BIGINT) AS loop FROM o""")
def loop_index(spark, sf_dir):
    return structure.loop_index(structures(spark, sf_dir))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')}, s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, i + j ORDER BY i) AS island FROM a)
SELECT doc_id, min(i) AS start, max(j) AS "end", count(*) AS length FROM s GROUP BY doc_id, i + j, island""")
def helix_list(spark, sf_dir):
    return structure.helices(structures(spark, sf_dir))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')}, {_pairs_sql('b', 'other')}, d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.i = b.i AND a.j = b.j WHERE a.doc_id IS NULL OR b.doc_id IS NULL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id) SELECT strs.doc_id, coalesce(n, 0) AS distance FROM strs LEFT JOIN n ON strs.doc_id = n.doc_id""")
def base_pair_distance(spark, sf_dir):
    return structure.pair_distance(structures(spark, sf_dir), "structure", "other")


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')} SELECT t.doc_id, t.i, x.c AS base, t.i - 1 AS before, CASE WHEN lead(t.i) OVER (PARTITION BY t.doc_id ORDER BY t.i) IS NULL THEN 0 ELSE t.i + 1 END AS after, t.partner FROM a_t t JOIN chars x ON t.doc_id = x.doc_id AND t.i = x.i""")
def connect_table(spark, sf_dir):
    return structure.connect_table(structures(spark, sf_dir))


@query(f"WITH {STR}, {_pairs_sql('a', 'structure')} SELECT doc_id, i, height FROM a_t")
def mountain_heights(spark, sf_dir):
    return structure.mountain_heights(structures(spark, sf_dir))


@query(f"WITH {STR}, {_pairs_sql('a', 'structure')}, g AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS structure FROM a_p GROUP BY doc_id) SELECT strs.doc_id, coalesce(structure, '') AS structure FROM strs LEFT JOIN g ON strs.doc_id = g.doc_id")
def structure_round_trip(spark, sf_dir):
    """Dot-bracket -> pair rows -> dot-bracket."""
    s = structures(spark, sf_dir)
    return structure.from_pairs(structure.pairs(s), s.select("doc_id", F.length("seq").alias("n")))


ALN = SEQ + """, rows_ AS (SELECT source AS aln, doc_id, seq FROM seqs WHERE length(seq) > 0),
cells AS (SELECT aln, doc_id, c, CAST(i AS INT) AS i FROM (SELECT aln, doc_id, unnest(string_split(seq, '')) AS c, unnest(range(1, length(seq) + 1)) AS i FROM rows_) WHERE i IS NOT NULL),
w AS (SELECT aln AS wa, count(*) AS n_seq, max(length(seq)) AS width FROM rows_ GROUP BY aln),
cols AS (SELECT aln, i, any_value(n_seq) AS n_seq, any_value(width) AS width, count(*) FILTER (c = 'A') AS a, count(*) FILTER (c = 'C') AS c, count(*) FILTER (c = 'G') AS g, count(*) FILTER (c = 'U') AS u, any_value(n_seq) - count(*) AS gap FROM cells JOIN w ON aln = wa GROUP BY aln, i)"""


@query(f"""WITH {ALN} SELECT aln, string_agg(CASE greatest(a, c, g, u, gap) WHEN gap THEN '-' WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'U' END, '' ORDER BY i) AS consensus FROM cols GROUP BY aln""")
def alignment_consensus(spark, sf_dir):
    return alignment.consensus(alignment_rows(spark, sf_dir))


@query(f"""WITH {ALN} SELECT aln, any_value(n_seq) AS n_seq, CAST(CASE WHEN any_value(n_seq) > 1 THEN floor(CAST(100 * sum(a * (a - 1) + c * (c - 1) + g * (g - 1) + u * (u - 1) + gap * (gap - 1)) AS DOUBLE) / CAST(any_value(n_seq * (n_seq - 1) * width) AS DOUBLE)) ELSE 100 END AS BIGINT) AS identity FROM cols GROUP BY aln""")
def alignment_identity(spark, sf_dir):
    return alignment.mean_pairwise_identity(alignment_rows(spark, sf_dir))


_KINDS = """kinds AS (SELECT aln, i, CAST(i + d AS INT) AS j, CASE c || x WHEN 'CG' THEN 1 WHEN 'GC' THEN 2 WHEN 'GU' THEN 3 WHEN 'UG' THEN 4 WHEN 'AU' THEN 5 WHEN 'UA' THEN 6 ELSE 0 END AS t FROM (
SELECT aln, i, c, unnest([4, 5, 6, 7, 8]) AS d, unnest([lead(c, 4) OVER o, lead(c, 5) OVER o, lead(c, 6) OVER o, lead(c, 7) OVER o, lead(c, 8) OVER o]) AS x FROM cells WINDOW o AS (PARTITION BY aln, doc_id ORDER BY i)) WHERE x IS NOT NULL)"""


@query(f"""WITH {ALN}, {_KINDS}, n AS (SELECT aln, i, j, t, count(*) AS n FROM kinds WHERE t > 0 GROUP BY aln, i, j, t)
SELECT aln, i, j, any_value(n_seq) AS n_seq, CAST(sum(n) AS BIGINT) AS compatible, count(*) AS types FROM n JOIN w ON aln = wa GROUP BY aln, i, j""")
def alignment_pair_support(spark, sf_dir):
    return alignment.pair_support(alignment_rows(spark, sf_dir)).drop("entropy")


@query(f"""WITH {ALN}, {_KINDS}, n AS (SELECT aln, i, j, t, count(*) AS n FROM kinds WHERE t > 0 GROUP BY aln, i, j, t), p AS (SELECT aln, i, j, n / CAST(n_seq AS DOUBLE) AS p FROM n JOIN w ON aln = wa),
s AS (SELECT aln, i, j, 1 - sum(p) AS rest, -sum(p * log2(p)) AS s FROM p GROUP BY aln, i, j) SELECT aln, i, j, round(s - CASE WHEN rest > 1e-12 THEN rest * log2(rest) ELSE 0 END, 6) + 0.0 AS entropy FROM s""")
def alignment_pair_entropy(spark, sf_dir):
    """Entropy of the kinds of pair of two columns over all rows."""
    return alignment.pair_support(alignment_rows(spark, sf_dir)).select("aln", "i", "j", (F.round("entropy", 6) + 0.0).alias("entropy"))


_DISTANCES = " + ".join(f"t{v} * t{w} * {sum(x != y for x, y in zip(a, b))}" for k, (a, v) in enumerate(fs.PAIR_TYPES.items()) for b, w in list(fs.PAIR_TYPES.items())[k + 1 :])


@query(f"""WITH {ALN}, {_KINDS}, n AS (SELECT aln, i, j, {", ".join(f"count(*) FILTER (t = {k}) AS t{k}" for k in range(1, 7))} FROM kinds WHERE t > 0 GROUP BY aln, i, j),
p AS (SELECT n.aln, n.i, n.j, n_seq, gap AS p7, n_seq - t1 - t2 - t3 - t4 - t5 - t6 - gap AS p0, {_DISTANCES} AS apart FROM n JOIN cols ON n.aln = cols.aln AND n.i = cols.i)
SELECT aln, i, j, CASE WHEN 2 * p0 + p7 > n_seq THEN {alignment.FORBIDDEN} ELSE CAST(trunc(100.0::DOUBLE * apart / n_seq - 100.0::DOUBLE * (p0 + p7 * 0.25::DOUBLE)) AS BIGINT) END AS score FROM p""")
def alignment_covariance(spark, sf_dir):
    return alignment.covariance(alignment_rows(spark, sf_dir))


_FREQUENT = " + ".join(f"CASE WHEN {b} * width >= all_{b} THEN {1 << k} ELSE 0 END" for k, b in enumerate("acgu"))


@query(f"""WITH {ALN}, t AS (SELECT aln AS ta, sum(a) AS all_a, sum(c) AS all_c, sum(g) AS all_g, sum(u) AS all_u, sum(gap) AS all_gap FROM cols GROUP BY aln),
l AS (SELECT aln, i, substr('-ACMGRSVUWYHKDBN', CAST({_FREQUENT} AS INT) + 1, 1) AS letter, gap * width > all_gap AS gaps FROM cols JOIN t ON aln = ta)
SELECT aln, string_agg(CASE WHEN gaps THEN lower(letter) ELSE letter END, '' ORDER BY i) AS mis FROM l GROUP BY aln""")
def alignment_most_informative(spark, sf_dir):
    return alignment.most_informative(alignment_rows(spark, sf_dir))


_R = "CASE WHEN event_id % 11 = 0 THEN -1.0 ELSE value / 100 END"


@query(f"""WITH e AS (SELECT event_id, {_R} AS r FROM events) SELECT event_id,
round(CASE WHEN r < 0 THEN 0.5 ELSE greatest(0.0, least(1.0, r)) END, 6) AS p_s,
round(CASE WHEN r < 0 THEN 0.5 ELSE greatest(0.0, least(1.0, CASE WHEN r < 0.25 THEN r * (0.35 / 0.25) WHEN r < 0.3 THEN 0.35 + (r - 0.25) * (0.2 / 0.05) WHEN r < 0.7 THEN 0.55 + (r - 0.3) * (0.3 / 0.4) ELSE 0.85 + (r - 0.7) * (0.15 / 0.3) END)) END, 6) AS p_m,
CASE WHEN r < 0 THEN 0.5::DOUBLE WHEN r < 0.25 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS p_c,
round(CASE WHEN r < 0 THEN 0.5 ELSE greatest(0.0, least(1.0, (r - 0.2) / 0.68)) END, 6) AS p_l,
round(CASE WHEN r < 0 THEN 0.5 ELSE greatest(0.0, least(1.0, (ln(greatest(r, 1e-300)) + 2.29) / 1.6)) END, 6) AS p_o,
round(CASE WHEN r < 0 THEN 0.0 ELSE 1.8 * ln(greatest(r, 0.0) + 1) - 0.6 END, 6) AS energy FROM e""")
def shape_conversion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, -1.0).otherwise(F.col("value") / 100).alias("r"))
    r = F.col("r")
    return e.select("event_id", *[(F.round(fs.shape_probability(r, m), 6) if m != "C" else fs.shape_probability(r, m)).alias(f"p_{m.lower()}") for m in "SMCLO"], F.round(fs.shape_energy(r), 6).alias("energy"))


@query("""SELECT event_id, round(value * (4184.0 / 1000.0), 6) AS kj, round(value * (4184.0 / 41.84), 4) AS dcal, round(value + 273.15, 6) AS kelvin, round(value * 9 / 5 + 32, 6) AS fahrenheit, round((100.0 - value) * 3 / 2, 6) AS delisle, round(value * 21 / 40 + 7.5, 6) AS romer FROM events""")
def unit_conversion(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(fs.convert_energy(v, "kcal", "kJ"), 6).alias("kj"), F.round(fs.convert_energy(v, "kcal", "dcal"), 4).alias("dcal"),
        *[F.round(fs.convert_temperature(v, u), 6).alias(n) for u, n in (("K", "kelvin"), ("F", "fahrenheit"), ("De", "delisle"), ("Ro", "romer"))],
    )


def probability_rows(spark, sf_dir):
    """Pair rows (id, i, j, p) from lineitem: each order is an ensemble, each line a pair."""
    l = table(spark, sf_dir, "lineitem")
    i = F.col("l_linenumber").cast("int")
    return l.select(F.col("l_orderkey").alias("id"), i.alias("i"), (F.lit(40) - i).alias("j"), (F.col("l_quantity") / 50).alias("p"))


_PAIR_ROWS = "SELECT l_orderkey AS id, l_linenumber AS i, 40 - l_linenumber AS j, l_quantity / 50 AS p FROM lineitem"


@query(f"WITH r AS ({_PAIR_ROWS}) SELECT id, round(2 * sum(p * (1 - p)), 6) AS diversity, CAST(sum((p > 0.5)::INT) AS BIGINT) AS centroid_pairs, round(sum(CASE WHEN p > 0.5 THEN 1 - p ELSE p END), 6) AS centroid_distance FROM r GROUP BY id")
def ensemble_diversity(spark, sf_dir):
    e = structure.ensemble(probability_rows(spark, sf_dir))
    return e.select("id", F.round("diversity", 6).alias("diversity"), "centroid_pairs", F.round("centroid_distance", 6).alias("centroid_distance"))


@query(f"""WITH r AS ({_PAIR_ROWS}), e AS (SELECT id, i AS pos, p AS up, 0.0 AS down FROM r UNION ALL SELECT id, j, 0.0, p FROM r),
s AS (SELECT id, pos, least(1.0, round(sum(up), 9)) AS up, least(1.0, round(sum(down), 9)) AS down FROM e GROUP BY id, pos), x AS (SELECT *, greatest(0.0, round(1 - up - down, 9)) AS free, up + down AS paired FROM s)
SELECT id, pos, CASE WHEN free > 0.667 THEN '.' WHEN up > 0.667 THEN '(' WHEN down > 0.667 THEN ')' WHEN paired > free AND up > 0.667 * paired THEN '{{' WHEN paired > free AND down > 0.667 * paired THEN '}}' WHEN paired > free THEN '|' WHEN free > paired THEN ',' ELSE ':' END AS symbol FROM x""")
def probability_symbols(spark, sf_dir):
    r = probability_rows(spark, sf_dir)
    e = r.select("id", F.col("i").alias("pos"), F.col("p").alias("up"), F.lit(0.0).alias("down")).unionByName(r.select("id", F.col("j").alias("pos"), F.lit(0.0).alias("up"), F.col("p").alias("down")))
    s = e.groupBy("id", "pos").agg(*[F.least(F.lit(1.0), F.round(F.sum(c), 9)).alias(c) for c in ("up", "down")])
    free = F.greatest(F.lit(0.0), F.round(1 - F.col("up") - F.col("down"), 9))
    return s.select("id", "pos", fs.pair_symbol(free, F.col("up"), F.col("down")).alias("symbol"))


@query(f"""WITH r AS ({_PAIR_ROWS}), e AS (SELECT id, i AS pos, p FROM r UNION ALL SELECT id, j, p FROM r)
SELECT id, pos, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(2), 6) AS entropy FROM e GROUP BY id, pos""")
def positional_entropy(spark, sf_dir):
    r = probability_rows(spark, sf_dir)
    e = r.select("id", F.col("i").alias("pos"), "p").unionByName(r.select("id", F.col("j").alias("pos"), "p"))
    return e.groupBy("id", "pos").agg(F.round(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)) / F.log(F.lit(2.0)), 6).alias("entropy"))


@query("""WITH m AS (SELECT user_id, min(value) AS lowest FROM events GROUP BY user_id) SELECT e.user_id, CAST(floor((value - lowest) * 10) AS BIGINT) AS bin, count(*) AS n FROM events e JOIN m ON e.user_id = m.user_id GROUP BY ALL""")
def density_of_states(spark, sf_dir):
    """Energies (event values) of each ensemble (user) above its lowest, in bins of 0.1."""
    e = table(spark, sf_dir, "events").select("user_id", "value")
    low = e.groupBy("user_id").agg(F.min("value").alias("lowest")).withColumnRenamed("user_id", "u")
    return e.join(low, F.col("user_id") == F.col("u")).groupBy("user_id", F.floor((F.col("value") - F.col("lowest")) * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT user_id, event_id, 10 + row_number() OVER w AS t, 2 * lag(value, 2) OVER w - lag(value) OVER w - 2 * value - lead(value) OVER w + 2 * lead(value, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CAST(t AS BIGINT) AS t, round(-(t + 273.15) * s / 7, 6) AS heat_capacity FROM x WHERE s IS NOT NULL""")
def melting_curve(spark, sf_dir):
    """-T d2F/dT2 by a quadratic fit over five points; each user's events stand for free energies at rising temperatures."""
    w = W.partitionBy("user_id").orderBy("event_id")
    v = F.col("value")
    s = 2 * F.lag(v, 2).over(w) - F.lag(v).over(w) - 2 * v - F.lead(v).over(w) + 2 * F.lead(v, 2).over(w)
    x = table(spark, sf_dir, "events").select("user_id", "event_id", (10 + F.row_number().over(w)).cast("long").alias("t"), s.alias("s")).filter("s IS NOT NULL")
    return x.select("user_id", "event_id", "t", F.round(-(F.col("t") + 273.15) * F.col("s") / 7, 6).alias("heat_capacity"))


@query(f"""WITH {SEQ} SELECT length(seq) AS len, source, count(*) AS n, count(DISTINCT seq) AS n_distinct FROM seqs GROUP BY length(seq), source""")
def length_batches(spark, sf_dir):
    """Sequences and distinct sequences of each length and source: the batches that length-grouped kernels get."""
    return sequences(spark, sf_dir).groupBy(F.length("seq").cast("long").alias("len"), "source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("n_distinct"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, CAST(1 + o_orderkey % 20 AS INT) AS i, CAST(31 + o_orderkey % 20 AS INT) AS j, CAST(1 + o_custkey % 5 AS INT) AS k FROM orders) SELECT id, CAST(i + s AS INT) AS i, CAST(j - s AS INT) AS j FROM (SELECT *, unnest(range(0, k)) AS s FROM o)""")
def helix_constraints(spark, sf_dir):
    """Constraint rows (i, j, k) expanded to their k stacked pairs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1 + F.col("o_orderkey") % 20).cast("int").alias("i"), (31 + F.col("o_orderkey") % 20).cast("int").alias("j"), (1 + F.col("o_custkey") % 5).cast("int").alias("k"))
    d = o.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return d.select("id", (F.col("i") + F.col("s")).alias("i"), (F.col("j") - F.col("s")).alias("j"))


@query()
def maximum_matching(spark, sf_dir):
    """Most pairs of each piece of every text; no pair joins two pieces."""
    return matching.maximum_matching(pieces(spark, sf_dir), "key").select(*_of_piece(), "n_pairs")


def _list_sql(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def _at_sql(values, *codes: str) -> str:
    """Element of an array over bases, by their codes."""
    at = " + ".join(f"{c} * {math.prod(values.shape[k + 1:])}" for k, c in enumerate(codes))
    return f"{_list_sql(values.ravel().tolist())}[CAST({at} + 1 AS BIGINT)]"


def _size_sql(values, n: str) -> str:
    return f"CASE WHEN {n} > 30 THEN {values[30]} + trunc({par.LONGER} * ln(({n}) / 30.0)) ELSE {_list_sql(values)}[{n} + 1] END"


#: All pairs of these structures are G with C, so they are type 2, or 1 from inside. si, sj: bases after i and before j of
#: a loop's pair; sp, sq: before and after the first pair inside.
LOOPS = f"""{STR}, {_pairs_sql('a', 'structure')},
near AS (SELECT doc_id, i, coalesce(lag(b) OVER w, 5) AS prev, coalesce(lead(b) OVER w, 5) AS next FROM (SELECT doc_id, i, strpos('ACGU', c) AS b FROM chars) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pr AS (SELECT a_t.doc_id, a_t.i, partner AS j, level, x.prev AS s5, x.next AS si, y.prev AS sj, y.next AS s3 FROM a_t JOIN near x ON a_t.doc_id = x.doc_id AND a_t.i = x.i JOIN near y ON a_t.doc_id = y.doc_id AND a_t.partner = y.i WHERE c = '('),
slots AS (SELECT *, level AS slot, true AS own FROM pr UNION ALL SELECT *, level - 1, false FROM pr),
up AS (SELECT *, coalesce(max(CASE WHEN own THEN i END) OVER (PARTITION BY doc_id, slot ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS around FROM slots),
lp AS (SELECT doc_id, around AS i, coalesce(max(CASE WHEN own THEN j END), 0) AS j, count(*) FILTER (NOT own) AS stems, min(CASE WHEN NOT own THEN i END) - around - 1 AS u1, coalesce(max(CASE WHEN own THEN j END), 0) - arg_min(j, i) FILTER (NOT own) - 1 AS u2,
max(CASE WHEN own THEN si END) AS si, max(CASE WHEN own THEN sj END) AS sj, arg_min(s5, i) FILTER (NOT own) AS sp, arg_min(s3, i) FILTER (NOT own) AS sq,
sum({_at_sql(par.EXTERIOR_STEM[2], 's5', 's3')}) FILTER (NOT own) AS outer_stems, sum({_at_sql(par.MULTI_STEMS[2], 's5', 's3')}) FILTER (NOT own) AS multi_stems FROM up GROUP BY doc_id, slot, around),
le AS (SELECT lp.doc_id, i, j, CASE WHEN i = 0 THEN 'exterior' WHEN stems = 0 THEN 'hairpin' WHEN stems = 1 THEN 'interior' ELSE 'multi' END AS kind, CAST(CASE WHEN i = 0 THEN outer_stems
WHEN stems > 1 THEN {par.MULTI_CLOSING} + {_at_sql(par.MULTI_STEMS[1], 'sj', 'si')} + multi_stems
WHEN stems = 0 AND j - i - 1 = 3 AND substr(seq, i, 5) = 'GUUAC' THEN {par.SPECIAL_HAIRPINS['GUUAC']} WHEN stems = 0 AND j - i - 1 < 4 THEN {_list_sql(par.HAIRPIN)}[j - i]
WHEN stems = 0 THEN {_size_sql(par.HAIRPIN, 'j - i - 1')} + {_at_sql(par.HAIRPINS[2], 'si', 'sj')}
WHEN u1 + u2 <= 1 THEN {par.STACK[1][0]} + {par.BULGE[1]} * (u1 + u2) WHEN u1 = 0 OR u2 = 0 THEN {_size_sql(par.BULGE, 'u1 + u2')}
WHEN u1 = 1 AND u2 = 1 THEN {_at_sql(par.ONE_ONE[2, 1], 'si', 'sj')} WHEN u1 = 1 AND u2 = 2 THEN {_at_sql(par.ONE_TWO[2, 1], 'si', 'sq', 'sj')} WHEN u1 = 2 AND u2 = 1 THEN {_at_sql(par.ONE_TWO[1, 2], 'sq', 'si', 'sp')}
WHEN u1 = 1 OR u2 = 1 THEN {_size_sql(par.INTERIOR, 'u1 + u2')} + least({par.MOST_ASYMMETRY}, {par.ASYMMETRY} * abs(u1 - u2))
WHEN u1 + u2 = 5 THEN {par.INTERIOR[5] + par.ASYMMETRY} + {_at_sql(par.TWO_THREE[2], 'si', 'sj')} + {_at_sql(par.TWO_THREE[1], 'sq', 'sp')}
ELSE {_size_sql(par.INTERIOR, 'u1 + u2')} + least({par.MOST_ASYMMETRY}, {par.ASYMMETRY} * abs(u1 - u2)) + {_at_sql(par.LONG[2], 'si', 'sj')} + {_at_sql(par.LONG[1], 'sq', 'sp')} END AS BIGINT) AS energy FROM lp JOIN strs ON lp.doc_id = strs.doc_id)"""


@query(f"WITH {LOOPS} SELECT * FROM le")
def loop_energies(spark, sf_dir):
    return energy.loop_energies(structures(spark, sf_dir))


@query(f"WITH {LOOPS} SELECT s.doc_id, coalesce(CAST(sum(energy) AS BIGINT), 0) AS energy FROM strs s LEFT JOIN le ON s.doc_id = le.doc_id GROUP BY s.doc_id")
def structure_energy(spark, sf_dir):
    return energy.structure_energy(structures(spark, sf_dir))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')}, {_pairs_sql('b', 'other')}, d AS (SELECT a_t.doc_id, sum(abs(a_t.height - b_t.height)) AS d FROM a_t JOIN b_t ON a_t.doc_id = b_t.doc_id AND a_t.i = b_t.i GROUP BY a_t.doc_id)
SELECT strs.doc_id, CAST(coalesce(d, 0) AS BIGINT) AS distance FROM strs LEFT JOIN d ON strs.doc_id = d.doc_id""")
def mountain_distance(spark, sf_dir):
    return structure.mountain_distance(structures(spark, sf_dir), "structure", "other")


@query()
def fold(spark, sf_dir):
    """Best structure of each piece of every text; no pair joins two pieces."""
    f = folding.fold(pieces(spark, sf_dir), "key")
    return f.select(*_of_piece(), "structure", "mfe", F.round("free_energy", 4).alias("free_energy"), F.round("frequency", 6).alias("frequency"))


@query()
def sampled_pairs(spark, sf_dir):
    """Pair frequencies over ten sampled structures of each piece of every text, at positions of the text; no pair joins two pieces."""
    p = folding.sampled_pairs(pieces(spark, sf_dir), 10, key="key").select(*_of_piece(), F.explode("pairs").alias("p"))
    return p.select("doc_id", *[(F.col(f"p.{x}") + F.col("piece") * WIDTH).alias(x) for x in "ij"], "p.frequency")


@query()
def ensemble_structures(spark, sf_dir):
    """Symbols, centroid and most accurate structure of the ensemble of each piece of every text."""
    e = folding.ensembles(pieces(spark, sf_dir), key="key")
    return e.select(*_of_piece(), "symbols", "centroid", F.round("centroid_distance", 6).alias("centroid_distance"), "mea", F.round("accuracy", 6).alias("accuracy"), F.round("diversity", 6).alias("diversity"), F.size("pairs").alias("n_pairs"))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')}, pr AS (SELECT doc_id, i, level FROM a_t WHERE c = '('), o AS (SELECT doc_id, i, c, level, height, max(CASE WHEN c = '(' THEN i END) OVER (PARTITION BY doc_id, level ORDER BY i) AS own FROM a_t),
slots AS (SELECT doc_id, i, level AS slot, true AS own FROM pr UNION ALL SELECT doc_id, i, level - 1, false FROM pr),
up AS (SELECT doc_id, own, coalesce(max(CASE WHEN own THEN i END) OVER (PARTITION BY doc_id, slot ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS around FROM slots),
n AS (SELECT doc_id, around, count(*) FILTER (NOT own) AS stems FROM up GROUP BY doc_id, around),
e AS (SELECT o.doc_id, o.i, CASE WHEN o.c <> '.' THEN upper(k) ELSE k END AS x FROM (SELECT o.doc_id, o.i, o.c, CASE WHEN o.level = 0 THEN 'e' WHEN coalesce(stems, 0) = 0 THEN 'h' WHEN stems = 1 THEN 'i' ELSE 'm' END AS k FROM o LEFT JOIN n ON o.doc_id = n.doc_id AND o.own = n.around AND o.level > 0) o),
g AS (SELECT doc_id, string_agg(x, '' ORDER BY i) AS elements FROM e GROUP BY doc_id) SELECT strs.doc_id, coalesce(elements, '') AS elements FROM strs LEFT JOIN g ON strs.doc_id = g.doc_id""")
def element_strings(spark, sf_dir):
    """Which kind of loop each position lies in, upper case for the pair that closes it."""
    return structures(spark, sf_dir).select("doc_id", structure.per_text(structure.element_text)("structure").alias("elements"))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')}, g AS (SELECT doc_id, string_agg(CASE c WHEN '(' THEN '(' WHEN ')' THEN 'P)' ELSE '(U)' END, '' ORDER BY i) AS t FROM a_p GROUP BY doc_id) SELECT strs.doc_id, '(' || coalesce(t, '') || 'R)' AS tree FROM strs LEFT JOIN g ON strs.doc_id = g.doc_id""")
def structure_trees(spark, sf_dir):
    """Full trees: a node for every pair and every unpaired position."""
    return structures(spark, sf_dir).select("doc_id", structure.per_text(structure.tree_text)("structure").alias("tree"))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')}, b AS (SELECT doc_id, (i - 1) // 5 AS k, i, CASE c WHEN '(' THEN 0 WHEN '.' THEN 1 ELSE 2 END * [81, 27, 9, 3, 1][(i - 1) % 5 + 1] AS v FROM a_p),
x AS (SELECT doc_id, k, lpad(upper(to_hex(CAST(1 + sum(v) AS INT))), 2, '0') AS h FROM b GROUP BY doc_id, k), g AS (SELECT doc_id, string_agg(h, '' ORDER BY k) AS packed FROM x GROUP BY doc_id), o AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS structure FROM a_p GROUP BY doc_id)
SELECT strs.doc_id, coalesce(packed, '') AS packed, coalesce(structure, '') AS unpacked FROM strs LEFT JOIN g ON strs.doc_id = g.doc_id LEFT JOIN o ON strs.doc_id = o.doc_id""")
def packed_structures(spark, sf_dir):
    """Five positions a byte, and back."""
    s = structures(spark, sf_dir).select("doc_id", structure.pack(F.col("structure")).alias("packed"), F.length("structure").alias("n"))
    return s.select("doc_id", "packed", structure.unpack(F.col("packed"), F.col("n")).alias("unpacked"))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')}, {_pairs_sql('b', 'other')} SELECT doc_id, i, j, 0 AS layer FROM a UNION ALL SELECT doc_id, i, j, 1 FROM b""")
def knotted_pairs(spark, sf_dir):
    """Pairs of structures with two kinds of brackets, which may cross."""
    s = structures(spark, sf_dir)
    both = F.zip_with(F.split("structure", ""), F.split("other", ""), lambda x, y: F.when(x != ".", x).otherwise(F.translate(y, "()", "[]")))
    return structure.knotted_pairs(s.select("doc_id", F.array_join(both, "").alias("structure")))


@query(f"""WITH {STR}, {_pairs_sql('a', 'structure')} SELECT t.doc_id, t.i, concat_ws(' ', t.i, x.c, t.partner) AS line FROM a_t t JOIN chars x ON t.doc_id = x.doc_id AND t.i = x.i""")
def bpseq_lines(spark, sf_dir):
    return records.bpseq_lines(structure.connect_table(structures(spark, sf_dir)))


#: Longest distance of paired bases, and length of a window, where whole texts are folded.
SPAN = 70


@query()
def local_folds(spark, sf_dir):
    """Locally best structures of every whole text, with pairs up to SPAN apart."""
    return windowed.local_folds(sequences(spark, sf_dir), SPAN)


def items(spark, sf_dir):
    """item_id and seq: the letters of every whole benchmark text as a sequence."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(fs.from_text(F.col("text")), F.lit("")).alias("seq"))


@query()
def window_pairs(spark, sf_dir):
    """Mean pair probabilities over the windows of every whole benchmark text."""
    p = windowed.window_pairs(items(spark, sf_dir), SPAN, SPAN, 0.01, "item_id")
    return p.select("item_id", "i", "j", F.round("p", 6).alias("p"))


@query()
def accessibilities(spark, sf_dir):
    """Mean probabilities over the windows of every whole benchmark text that 1, 4 or 8 bases from i on are unpaired."""
    a = windowed.accessibilities(items(spark, sf_dir), [1, 4, 8], SPAN, SPAN, "item_id")
    return a.select("item_id", "i", "u", F.round("p", 6).alias("p"), F.round("energy", 4).alias("energy"))


def item_pieces(spark, sf_dir):
    """key (item_id:piece), item_id, piece and seq: all letters of every benchmark text in consecutive pieces of WIDTH."""
    d = table(spark, sf_dir, "benchmark")
    seq = F.coalesce(fs.from_text(F.col("text")), F.lit(""))
    cut = F.when(seq == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(seq, F.lit(f"(.{{1,{WIDTH}}})"), F.lit(1)))
    p = d.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.posexplode(cut).alias("piece", "seq"))
    return p.select(F.concat_ws(":", "item_id", F.col("piece").cast("string")).alias("key"), "item_id", "piece", "seq")


def _of_item():
    part = lambda n: F.regexp_extract("key", "(?s)^(.*):([0-9]+)$", n)
    return part(1).alias("item_id"), part(2).cast("int").alias("piece")


@query()
def suboptimal_states(spark, sf_dir):
    """Numbers of structures within 1 kcal/mol of the best of each piece of every benchmark text, in bins of 0.1."""
    s = landscape.density_of_states(landscape.suboptimals(item_pieces(spark, sf_dir), 100, "key"), 10, "key")
    return s.select(*_of_item(), "bin", "n_structures")


@query()
def constrained_fold(spark, sf_dir):
    """Best structures of the pieces of benchmark texts whose runs of three A stay unpaired."""
    held = F.translate(F.regexp_replace("seq", "AAA", "xxx"), "ACGU", "....")
    f = folding.fold(item_pieces(spark, sf_dir).withColumn("held", held), "key", constraint="held")
    return f.select(*_of_item(), "structure", "mfe", F.round("free_energy", 4).alias("free_energy"))


@query()
def local_minima(spark, sf_dir):
    """Where the walk from no pairs at all ends, for each piece of every benchmark text."""
    m = landscape.local_minima(item_pieces(spark, sf_dir).withColumn("structure", F.lit("")), "key")
    return m.select(*_of_item(), "minimum", "energy", "steps")


@query()
def tree_distances(spark, sf_dir):
    """Distance of the trees of the G-C and A-U brackets of each piece of every benchmark text."""
    s = item_pieces(spark, sf_dir).select("key", structure.bracketed("G", "C")("seq").alias("structure"), structure.bracketed("A", "U")("seq").alias("other"))
    return landscape.tree_distances(s, "structure", "other", "key").select(*_of_item(), "distance")


@query()
def duplexes(spark, sf_dir):
    """Best duplex of each piece of every benchmark text with the piece after it."""
    p = item_pieces(spark, sf_dir).withColumn("after", F.lead("seq").over(W.partitionBy("item_id").orderBy("piece")))
    return landscape.duplexes(p.filter("after IS NOT NULL"), "seq", "after", "key").select(*_of_item(), "energy", "start", "end", "other_start", "other_end", "structure")


def _item_pairs(spark, sf_dir):
    """Pieces of every benchmark text with the piece after them."""
    p = item_pieces(spark, sf_dir).withColumn("after", F.lead("seq").over(W.partitionBy("item_id").orderBy("piece")))
    return p.filter("after IS NOT NULL")


@query()
def strand_dimers(spark, sf_dir):
    """Structure and energies of each piece of every benchmark text as a strand that may join the piece after it."""
    d = dimers.dimers(_item_pairs(spark, sf_dir), "seq", "after", "key")
    return d.select(*_of_item(), "structure", "energy", *[F.round(c, 4).alias(c) for c in ("free_a", "free_b", "free_dimer", "free_all")], F.round("joined", 6).alias("joined"), F.size("pairs").alias("n_pairs"))


@query()
def strand_concentrations(spark, sf_dir):
    """Parts of each piece of every benchmark text, and of the piece after it, that are alone and in dimers, of a micromole
    a litre each."""
    p = _item_pairs(spark, sf_dir).withColumns({"a0": F.lit(1e-6), "b0": F.lit(1e-6)})
    c = dimers.dimer_concentrations(p, "seq", "after", "a0", "b0", "key")
    return c.select(*_of_item(), *[F.round(F.col(x) * 1e6, 6).alias(x) for x in ("a", "b", "aa", "bb", "ab")])


@query()
def alignment_folds(spark, sf_dir):
    """One structure of the pieces of every benchmark text as the rows of an alignment, with its conservation index."""
    f = consensus.fold_alignments(item_pieces(spark, sf_dir), "item_id")
    return f.select("item_id", "n_seq", "structure", *[F.round(c, 4).alias(c) for c in ("energy", "covariance", "free_energy", "mean_energy")], F.round("conservation", 6).alias("conservation"))


@query()
def refolding_paths(spark, sf_dir):
    """Barrier between the best and a sampled structure of each piece of every benchmark text."""
    p = item_pieces(spark, sf_dir)
    drawn = folding.sampled_structures(p, 1, key="key").select(F.col("key").alias("k"), F.col("structure").alias("drawn"))
    best = folding.fold(p, "key").select(F.col("key").alias("b"), "structure")
    x = p.join(best, F.col("key") == F.col("b")).join(drawn, F.col("key") == F.col("k"))
    return paths.refolding_paths(x, "structure", "drawn", 16, "key").select(*_of_item(), "barrier", "at", "n_steps")


@query()
def interaction_sites(spark, sf_dir):
    """Where each piece of every benchmark text binds the whole text, with the energy that opens the place."""
    x = item_pieces(spark, sf_dir).join(items(spark, sf_dir).select(F.coalesce("item_id", F.lit("")).alias("of"), F.col("seq").alias("whole")), F.col("item_id") == F.col("of"))
    h = interactions.interactions(x, "seq", "whole", -1000, key="key")
    return h.select(*_of_item(), "energy", F.round("opening", 4).alias("opening"), F.round("total", 4).alias("total"), "start", "end", "target_start", "target_end", "structure")


@query()
def covering_structures(spark, sf_dir):
    """Structures of each piece of every benchmark text within 2 kcal/mol of the best, each the best with a new pair."""
    return landscape.covering_structures(item_pieces(spark, sf_dir), 200, "key").select(*_of_item(), "rank", "structure", "energy")


@query()
def string_distances(spark, sf_dir):
    """Distance of the bracket strings of the G-C and A-U brackets of each piece of every benchmark text."""
    s = item_pieces(spark, sf_dir).select("key", structure.bracketed("G", "C")("seq").alias("structure"), structure.bracketed("A", "U")("seq").alias("other"))
    return landscape.string_distances(s, "structure", "other", "key").select(*_of_item(), "distance")


@query()
def profile_distances(spark, sf_dir):
    """Distance of the ensemble profiles of each piece of every benchmark text and the piece after it."""
    p = item_pieces(spark, sf_dir).withColumn("after", F.lead("seq").over(W.partitionBy("item_id").orderBy("piece")))
    return landscape.profile_distances(p.filter("after IS NOT NULL"), "seq", "after", "key").select(*_of_item(), F.round("distance", 6).alias("distance"))


def flagship(spark, sf_dir):
    return sequence_statistics(spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
