"""Personal data by weak supervision: labelers vote on spans, EM weighs the labelers, a span classifier decides.

One pass over the texts, in built-in functions alone, finds the spans of fixed patterns (which always stay) and further
candidates: numbers in card or phone groups, spelled-out addresses, colon-separated network addresses. On each, five
labelers vote yes, no or nothing: the pattern's own rule, gazetteers, words of the context, neighbouring characters, and
shape. Expectation-maximisation over the counts of the vote patterns of all documents estimates how reliable each
labeler is for each kind; its posteriors are the soft labels from which a classifier over features of the span and its
surroundings is counted. Candidates to which both the votes and the classifier give KEEP or more become spans.

Defined results: a null text is empty; a null doc_id is a row like others; repeated rows each have their row; other
columns are ignored; an empty table gives no rows and trains nothing. Equal votes leave the prior to decide. What reaches
the driver are counts of at most 4 x 243 vote patterns and 4 x SLOTS x WIDTH features. Spans of one kind don't overlap.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, written so that no text makes them slow: a run of letters is entered at its start (or where the
#: match before ended) and left as a whole. The card's has just the longest runs of 16 to 19 digits.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Further candidates: (patterns by kind) of which one pass finds whatever comes first.
MORE = {
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.,/-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20.-][0-9]{2,8}){1,4}(?![0-9A-Za-z.,/-]?[0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
SPELLED = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++"
# Gazetteers and words of contexts.
ENDINGS = "com org net edu gov mil int info biz name io co eu de fr es it nl be ch at uk us ca au jp cn in br mx pl se no dk fi ru pt ie"
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420"
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "\\bip\\b|host|server|address|login|adresse|servidor",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobil|cell|ruf|appel",
}
DECOYS = "token|key|hash|secret|isbn|issn|doi|version|order|invoice|ticket|\\bid\\b|=|#"
SPACE_BEFORE, LABELERS, SLOTS, WIDTH = 24, 5, 9, 256
ROUNDS, KEEP = 25, 0.9


def _spans(text: Column, pattern: str, kind: Column) -> Column:
    """array of (kind, s, e, m, left, right) of the matches: code points from 0, the text before and the character after."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = "struct<kind:int,s:int,e:int,m:string,left:string,right:string>"

    def step(acc, at):
        gap, m, after = F.get(acc["gaps"], at), F.get(acc["found"], at), F.get(acc["gaps"], at + 1)
        s = acc["end"] + F.length(gap)
        new = F.struct(kind.alias("kind"), s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), F.right(gap, F.lit(SPACE_BEFORE)).alias("left"), F.left(after, F.lit(1)).alias("right"))
        return F.struct((s + F.length(m)).alias("end"), acc["gaps"].alias("gaps"), acc["found"].alias("found"), F.array_append(acc["out"], new).alias("out"))

    start = F.struct(F.lit(0).alias("end"), gaps.alias("gaps"), found.alias("found"), F.array().cast(f"array<{one}>").alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(f"array<{one}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """True where the digits of m pass the Luhn check."""
    d = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    total = F.aggregate(d, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), lambda a, x: F.struct((a["sum"] + F.when(a["i"] % 2 == 0, x).when(x < 5, 2 * x).otherwise(2 * x - 9)).alias("sum"), (a["i"] + 1).alias("i")), lambda a: a["sum"])
    return total % 10 == 0


BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _holds(kind: str, m: Column) -> Column:
    """True where a match of the fixed pattern passes its rule."""
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(\.{BYTE}){{3}}$")
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda x: _holds(kind, x["m"])


def spans_of(text: Column) -> tuple[Column, Column]:
    """(spans of the fixed patterns that pass, further candidates), of a text that is not null."""
    kinds = {k: F.lit(i) for i, k in enumerate(KINDS)}
    empty = F.array().cast("array<struct<kind:int,s:int,e:int,m:string,left:string,right:string>>")
    base = [F.when(F.contains(text, F.lit(NEEDS[k])), F.filter(_spans(text, BASE[k], kinds[k]), _passing(k))).otherwise(empty) for k in KINDS]
    every = "|".join(MORE.values())
    kind_of = lambda m: F.when(F.contains(m, F.lit(":")), 1).when(m.rlike(rf"^(?:{MORE['card']})$"), 2).otherwise(3)
    numbers = F.when(text.rlike("[0-9]{2}|:"), F.transform(_spans(text, every, F.lit(3)), lambda x: x.withField("kind", kind_of(x["m"])))).otherwise(empty)
    spelled = F.when(text.rlike(r"[\[(]at[\])]"), _spans(text, SPELLED, kinds["email"])).otherwise(empty)
    return F.concat(*base), F.concat(spelled, numbers)


def _words(text: str) -> Column:
    return F.array(*[F.lit(w) for w in text.split()])


def _votes(x: Column, base: bool) -> Column:
    """The votes as a number in base 3, one digit a labeler: 0 none, 1 yes, 2 no."""
    kind, m, d = x["kind"], x["m"], _digits(x["m"])
    n = F.length(d)
    yes, no, none = F.lit(1), F.lit(2), F.lit(0)
    say = lambda c: F.when(c, yes).otherwise(no)
    rule = yes if base else F.when(kind == 2, say(luhn(m))).when(kind == 3, F.when(n < 7, no).when(n.between(8, 15) & m.rlike(r"^[+(0]"), yes).otherwise(none)).when(kind == 1, F.when(F.size(F.split(m, ":")) == 8, yes).otherwise(none)).otherwise(yes)
    ending = F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1))
    code = F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)
    gazetteer = (
        F.when(kind == 0, say(F.array_contains(_words(ENDINGS), ending)))
        .when(kind == 1, F.when(F.contains(m, F.lit(":")), F.when(m.rlike("^(2[0-9a-fA-F]{3}|f[cdeCDE])"), yes).otherwise(none)).otherwise(say(F.regexp_extract(m, "^0*([0-9]*)", 1).try_cast("int").between(1, 223))))
        .when(kind == 2, say(d.rlike("^[3-6]")))
        .otherwise(F.when(m.rlike(r"^(19|20)[0-9]{2}[.-]|^[0-9]{1,2}[.-][0-9]{1,2}[.-](19|20)?[0-9]{2}$"), no).when(F.exists(_words(COUNTRY_CODES), lambda c: F.startswith(code, c)), yes).otherwise(none))
    )
    left = F.lower(x["left"])
    cue = reduce(lambda c, k: c | ((kind == k) & left.rlike(CONTEXT[KINDS[k]])), range(1, 4), (kind == 0) & left.rlike(CONTEXT["email"]))
    context = F.when(left.rlike(DECOYS), no).when(cue, yes).otherwise(none)
    around = say(~F.right(left, F.lit(1)).rlike("[a-z0-9_]") & ~x["right"].rlike("[A-Za-z0-9_]"))
    shape = (
        F.when(kind == 0, F.when(m.rlike("^[^@]*[0-9.]"), yes).otherwise(none))
        .when(kind == 1, F.when(m.rlike(r"(^|\.)0[0-9]"), no).otherwise(yes))
        .when(kind == 2, F.when((n == 16) | ((n == 15) & d.startswith("3")), yes).otherwise(none))
        .otherwise(F.when(n < 7, no).when(n > 8, yes).otherwise(none))
    )
    return sum((v * 3**k for k, v in enumerate((rule, gazetteer, context, around, shape))), F.lit(0)).cast("int")


def _features(x: Column, votes: Column) -> Column:
    """One place in the table of weights for each slot: SLOTS numbers."""
    d, m = _digits(x["m"]), x["m"]
    sort = lambda c: F.when(c == "", 0).when(c.rlike("[0-9]"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike(r"\s"), 3).when(c.rlike("[.,;:!?]"), 4).otherwise(5)
    last = F.lower(F.regexp_extract(x["left"], r"([^\s]+)\s*$", 1))
    slots = [
        F.length(d), F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")), F.ascii(m), F.crc32(last), F.length(m), sort(x["right"]),
        F.size(F.array_distinct(F.split(d, ""))), sort(F.right(x["left"], F.lit(1))), votes,
    ]
    return F.array(*[((x["kind"] * SLOTS + k) * WIDTH + F.pmod(v.cast("long"), F.lit(WIDTH))).cast("int") for k, v in enumerate(slots)])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, s, e, base, votes, features) of every row, written once."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base, more = spans_of(F.col("text"))
    d = d.select("doc_id", base.alias("base"), more.alias("more"))
    clear = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    def entry(x, is_base):
        votes = _votes(x, is_base)
        return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(is_base).alias("base"), votes.alias("votes"), _features(x, votes).alias("features"))

    return materialize(d.select("doc_id", F.concat(F.transform("base", lambda x: entry(x, True)), F.transform(F.filter("more", clear), lambda x: entry(x, False))).alias("spans")), "spans")


def reliabilities(counts: list[tuple[int, int, int]], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """(posterior of (kind, votes), chances (kind, class) -> a list of three chances a labeler) by EM over (kind, votes,
    count), from the share of yes among the votes given."""
    ballots = {v: [v // 3**k % 3 for k in range(LABELERS)] for _, v, _ in counts}
    post = {}
    for kind, v, _ in counts:
        yes, no = ballots[v].count(1), ballots[v].count(2)
        post[kind, v] = (yes + 0.5) / (yes + no + 1)
    chances = {}
    for _ in range(rounds):
        for kind in {c[0] for c in counts}:
            own = [c for c in counts if c[0] == kind]
            mass = {}
            for y in (1, 0):
                table_ = [[1.0] * 3 for _ in range(LABELERS)]
                total = 1.0
                for _, v, n in own:
                    w = n * (post[kind, v] if y else 1 - post[kind, v])
                    total += w
                    for k, b in enumerate(ballots[v]):
                        table_[k][b] += w
                chances[kind, y] = [[x / sum(row) for x in row] for row in table_]
                mass[y] = total
            for _, v, _ in own:
                odds = math.log(mass[1] / mass[0]) + sum(math.log(chances[kind, 1][k][b] / chances[kind, 0][k][b]) for k, b in enumerate(ballots[v]))
                post[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, chances


def _lookup(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def trained(spans: DataFrame) -> tuple[list[float], list[float]]:
    """(posterior of each kind and votes; log odds of every feature and, behind them, of every kind, from the posteriors
    as soft labels)."""
    s = spans.select(F.explode("spans").alias("x")).select("x.kind", "x.votes", "x.features")
    counts = [tuple(r) for r in s.groupBy("kind", "votes").agg(F.count(F.lit(1))).collect()]  # 4 x 243 rows at most
    post, _ = reliabilities(counts)
    kinds, slots = len(KINDS), SLOTS * WIDTH
    table_ = [[0.0, 0.0] for _ in range(kinds * slots + kinds)]
    seen = s.select("kind", "votes", F.explode("features").alias("f")).groupBy("kind", "votes", "f").agg(F.count(F.lit(1)).alias("n"))
    every = [post.get((k, v), 0.5) for k in range(kinds) for v in range(3**LABELERS)]
    soft = F.get(_lookup(every), F.col("kind") * 3**LABELERS + F.col("votes"))
    seen = seen.groupBy("f").agg(F.sum(F.col("n") * soft).alias("yes"), F.sum(F.col("n") * (1 - soft)).alias("no"))
    for f, yes, no in seen.collect():  # kinds x SLOTS x WIDTH rows at most
        table_[f] = [yes, no]
    for kind, v, n in counts:
        table_[kinds * slots + kind][0] += n * post[kind, v]
        table_[kinds * slots + kind][1] += n * (1 - post[kind, v])
    out = []
    for at, (yes, no) in enumerate(table_):
        prior = at >= kinds * slots
        all_yes, all_no = (1, 1) if prior else table_[kinds * slots + at // slots]
        out.append(round(math.log((yes + 0.5) / (all_yes + 1)) - math.log((no + 0.5) / (all_no + 1)), 9))
    return every, out


def personal_data(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id and spans (kind, s, e, base) of every row, by kind and start."""
    found = candidates(docs)
    posterior, w = map(_lookup, trained(found))
    kinds = len(KINDS) * SLOTS * WIDTH
    odds = lambda x: F.aggregate(x["features"], F.get(w, F.lit(kinds) + x["kind"]), lambda a, f: a + F.get(w, f))
    voted = lambda x: F.get(posterior, x["kind"] * 3**LABELERS + x["votes"])
    kept = F.filter("spans", lambda x: x["base"] | ((voted(x) >= keep) & (odds(x) >= math.log(keep / (1 - keep)))))
    return found.select("doc_id", F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base")))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as 'kind:start:end' joined by commas."""
    name = lambda x: F.get(F.array(*map(F.lit, KINDS)), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _counting(kind: int):
    return lambda n, x: n + (x["kind"] == kind).cast("long")


def op13_personal_data(spark, sf_dir):
    p = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    n = [F.aggregate(base, F.lit(0).cast("long"), _counting(k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return p.select("doc_id", *n, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
