"""Structures near the best one, walks down to local minima, and distances between structures, one row at a time.

Rows are dealt over the shuffle partitions; nothing is shared between them. A null sequence or structure counts as empty;
null and repeated keys are rows like others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bands, folding
from . import energy as en
from . import parameters as par
from .folding import Minimum, Sum, Tables, _groups
from .matching import spread
from .structure import Structure, by_row, letters, tree_text

_ROWS_HELD = 10_000


def _band(low: Tables, delta: float):
    """(structure, energy) of every structure within delta of the best, each once."""
    best = {"f": lambda i, j: low.f[j, 0], "c": lambda i, j: low.c[i, j, 0], "m1": lambda i, j: low.m1[i, j, 0], "m": lambda i, j: low.m[i, j, 0]}
    seen = {}

    def near(part):
        """(excess over the best, what follows) of the choices of a cell within delta."""
        if part not in seen:
            weights, then = low.choices(*part, 0)
            over = weights - best[part[0]](*part[1:])
            seen[part] = [(over[k], then[k]) for k in np.flatnonzero(over <= delta + 1e-9)]
        return seen[part]

    held = [(0.0, (), (("f", 0, low.n),))]
    while held:
        over, pairs, todo = held.pop()
        if not todo:
            text = ["."] * low.n
            for i, j in pairs:
                text[i - 1], text[j - 1] = "(", ")"
            yield "".join(text), int(round(low.f[low.n, 0] + over))
            continue
        part, rest = todo[-1], todo[:-1]
        if part[0] == "f" and part[2] == 0:
            held.append((over, pairs, rest))
            continue
        own = (*pairs, part[1:]) if part[0] == "c" else pairs
        held += [(over + more, own, (*rest, *then)) for more, then in near(part) if over + more <= delta + 1e-9]


def suboptimals(df: DataFrame, delta: int, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """key, structure, energy of all structures at most delta (0.01 kcal/mol) above the best; the empty structure of an
    empty sequence. Their number grows exponentially with delta and length; rows are sent on as they are found."""

    def run(batches):
        for b in batches:
            held = []
            for k, s in zip(b["key"], b["seq"].fillna("")):
                for structure, energy in _band(Tables([s], Minimum), delta) if s else [("", 0)]:
                    held.append((k, structure, energy))
                    if len(held) == _ROWS_HELD:
                        yield pd.DataFrame(held, columns=["key", "structure", "energy"])
                        held = []
            yield pd.DataFrame(held, columns=["key", "structure", "energy"])

    return spread(df, key, seq).mapInPandas(run, f"key {dict(df.dtypes)[key]}, structure string, energy long").withColumnRenamed("key", key)


def best_through_pairs(low: bands.Bands, k: int) -> dict[tuple[int, int], int]:
    """The least energy of the structures with a pair (from 1), for every pair of sequence k; low has its derivatives."""
    a, n, out = int(low.starts[k]), len(low.seqs[k]), {}
    for d in range(bands.LEAST, min(low.span, n - 1) + 1):
        e = low.c[d, a : a + n - d].astype(np.int64) + low.dc[d, a : a + n - d]
        out.update({(int(x) + 1, int(x) + d + 1): int(e[x]) for x in np.flatnonzero(e < bands.Minimum.zero // 2)})
    return out


def _through(seq: str, pairs: list[tuple[int, int]]) -> list[str]:
    """The best structure with each pair, all of them folded together."""
    forced: dict[int, list[int]] = {}
    starts = bands.strip([seq] * len(pairs))[1]
    for a, (i, j) in zip(starts.tolist(), pairs):
        forced.setdefault(j - i, []).append(a + i - 1)
    b = bands.Bands([seq] * len(pairs), len(seq), bands.Minimum, forced=forced)
    return [folding._best(b, k)[1] for k in range(len(pairs))]


def covering(seq: str, delta: int, together: int = 16) -> list[tuple[str, int]]:
    """The best structure and its energy, and so on for the pair that no structure before has and that is in the best
    structure, as long as that is within delta of the best."""
    low = bands.Bands([seq], len(seq), bands.Minimum)
    q = low.segments(len(seq))
    seeds = np.full_like(q, bands.Minimum.zero)
    seeds[len(seq), low.starts[0]] = 0
    low.derivatives(q, seeds)
    best = int(q[len(seq), low.starts[0]])
    todo = sorted((e, p) for p, e in best_through_pairs(low, 0).items() if e <= best + delta)
    out, covered = [], set()
    if best == 0:
        out.append(("." * len(seq), 0))
    while todo:
        todo = [x for x in todo if x[1] not in covered]
        for (e, p), text in zip(todo[:together], _through(seq, [p for _, p in todo[:together]]) if todo else ()):
            if p not in covered:
                out.append((text, e))
                covered.update(zip(*(v.tolist() for v in Structure(text).pairs())))
    return out


def covering_structures(df: DataFrame, delta: int, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """key, rank (from 1), structure, energy (0.01 kcal/mol): structures within ``delta`` of the best, each the best one with
    a pair that none before it has. A null or empty sequence has the empty structure."""

    def run(batches):
        for b in batches:
            rows = [(k, r + 1, *x) for k, s in zip(b["key"], b["seq"].fillna("")) for r, x in enumerate(covering(s, delta) if s else [("", 0)])]
            x = pd.DataFrame(rows, columns=["key", "rank", "structure", "energy"])
            x["key"] = x["key"].astype(b["key"].dtype)
            yield x

    return spread(df, key, seq).mapInPandas(run, f"key {dict(df.dtypes)[key]}, rank int, structure string, energy long").withColumnRenamed("key", key)


def density_of_states(structures: DataFrame, width: int = 10, key: str = "doc_id") -> DataFrame:
    """key, bin (energies from bin * width above the best), n_structures out of rows of ``suboptimals``."""
    s = structures.groupBy(key, "energy").agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("low", F.min("energy").over(W.partitionBy(key)))  # a row per energy, not per structure
    return s.groupBy(key, F.floor((F.col("energy") - F.col("low")) / width).cast("int").alias("bin")).agg(F.sum("n").alias("n_structures"))


def _neighbours(text: str, seq: str):
    """Structures one pair away: every deletion, and every insertion of a pair that can form."""
    s, code = Structure(text), par.CODE_OF[letters(seq)]
    t = letters(text).copy()
    for i, j in zip(*(x.tolist() for x in s.pairs())):
        x = t.copy()
        x[[i - 1, j - 1]] = 46
        yield x.tobytes().decode()
    loop = s.loop()
    free = np.flatnonzero((s.partner == 0))
    for a in free.tolist():
        others = free[(free > a + 3) & (loop[free] == loop[a])]
        for b in others[par.TYPE_OF[code[a], code[others]] < 7].tolist():
            x = t.copy()
            x[a], x[b] = 40, 41
            yield x.tobytes().decode()


def local_minima(df: DataFrame, key: str = "doc_id", seq: str = "seq", structure: str = "structure") -> DataFrame:
    """key, minimum, energy, steps: the walk from a structure to the neighbour of lowest energy (of equals, the first as
    text) until none is lower."""

    def walk(seq, text):
        seq = (seq or "").upper()
        text = (text or "").ljust(len(seq), ".")[: len(seq)]
        total = lambda x: int(en.Loops(x, seq).energies()[1].sum())
        now, steps = total(text), 0
        while True:
            low = min(((total(x), x) for x in _neighbours(text, seq)), default=(now, text))
            if low[0] >= now:
                return text, now, steps
            (now, text), steps = low, steps + 1

    def run(batches):
        for b in batches:
            rows = [walk(s, t) for s, t in zip(b["seq"].fillna(""), b["structure"].fillna(""))]
            out = pd.DataFrame(rows, columns=["minimum", "energy", "steps"])
            out.insert(0, "key", b["key"].values)
            yield out

    d = df.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(structure).alias("structure")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return d.mapInPandas(run, f"key {dict(df.dtypes)[key]}, minimum string, energy long, steps int").withColumnRenamed("key", key)


#: Cost of inserting or deleting an unpaired position, a pair; of turning one into the other.
TREE_UNPAIRED, TREE_PAIR, TREE_REPLACE = 1, 2, 1


def _postorder(text: str | None) -> tuple[str, list[int]]:
    """Names of the nodes of a full tree in postorder, and of each the leftmost leaf below it."""
    names, left, opened = [], [], []
    for c in tree_text(text):
        if c == "(":
            opened.append(len(names))
        elif c != ")":
            names.append(c)
            left.append(opened.pop())
    return "".join(names), left


def tree_distance(a: str | None, b: str | None) -> int:
    """Cheapest series of insertions, deletions and replacements of nodes from one full tree to the other."""
    (x, lx), (y, ly) = _postorder(a), _postorder(b)
    cost = {"U": TREE_UNPAIRED, "P": TREE_PAIR, "R": 0}
    swap = lambda p, q: 0 if p == q else 1 << 20 if "R" in (p, q) else TREE_REPLACE
    roots = lambda left: sorted({v: k for k, v in enumerate(left)}.values())
    tree = np.zeros((len(x), len(y)), np.int64)
    for r in roots(lx):
        for s in roots(ly):
            m, n = r - lx[r] + 2, s - ly[s] + 2
            f = [[0] * n for _ in range(m)]
            for k in range(1, n):
                f[0][k] = f[0][k - 1] + cost[y[ly[s] + k - 1]]
            for h in range(1, m):
                p, row, before = lx[r] + h - 1, f[h], f[h - 1]
                row[0] = before[0] + cost[x[p]]
                for k in range(1, n):
                    q = ly[s] + k - 1
                    least = min(before[k] + cost[x[p]], row[k - 1] + cost[y[q]])
                    if lx[p] == lx[r] and ly[q] == ly[s]:
                        row[k] = min(least, before[k - 1] + swap(x[p], y[q]))
                        tree[p, q] = row[k]
                    else:
                        row[k] = min(least, f[lx[p] - lx[r]][ly[q] - ly[s]] + int(tree[p, q]))
    return int(tree[-1, -1])


def tree_distances(df: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """key, distance of the full trees of two structures of every row."""
    d = df.select(key, a, b).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return by_row(d, key, [a, b], "distance long", lambda x, y: (np.array([tree_distance(x, y)], np.int64),))


def _aligned(drop: np.ndarray, add: np.ndarray, change) -> float:
    """Cheapest alignment of two rows of items: costs of leaving items of each out, and change(i), the costs of turning item i
    of the first into each of the second. One row of the table is held."""
    ahead = np.r_[0, np.cumsum(add)]
    row = ahead.astype(float)
    for i, d in enumerate(drop):
        step = row + d
        step[1:] = np.minimum(step[1:], row[:-1] + change(i))
        row = ahead + np.minimum.accumulate(step - ahead)
    return float(row[-1])


def string_distance(a: str | None, b: str | None) -> float:
    """Distance of two structures as strings of tree brackets, each with half the costs of its node; opening brackets turn
    only into opening ones."""
    def tokens(text):
        s = Structure(text)
        return [t for o, c in zip(s.opens.tolist(), s.closes.tolist()) for t in ([(1, 1)] if o else [(-1, 1)] if c else [(1, 0), (-1, 0)])]

    x, y = (np.array(tokens(t), int).reshape(-1, 2) for t in (a, b))
    cost = np.array([TREE_UNPAIRED, TREE_PAIR]) / 2
    change = lambda i: np.where(y[:, 0] != x[i, 0], np.inf, (y[:, 1] != x[i, 1]) * TREE_REPLACE / 2)
    return _aligned(cost[x[:, 1]], cost[y[:, 1]], change)


def string_distances(df: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """key, distance of the bracket strings of two structures of every row."""
    d = df.select(key, a, b).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return by_row(d, key, [a, b], "distance double", lambda x, y: (np.array([string_distance(x, y)]),))


def profile_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two profiles (position x probabilities of being unpaired, opening, closing): two positions cost 2 less
    twice the sum of the geometric means, a position left out its sum."""
    p, q = np.sqrt(np.maximum(p, 0)), np.sqrt(np.maximum(q, 0))
    return _aligned((p * p).sum(1), (q * q).sum(1), lambda i: 2 - 2 * q @ p[i])


def profile_distances(df: DataFrame, one: str, other: str, key: str = "doc_id") -> DataFrame:
    """key, distance of the profiles of the ensembles of two sequences of every row."""
    def run(batches):
        for b in batches:
            seqs = [*b["one"].fillna("").str.upper(), *b["other"].fillna("").str.upper()]
            profiles = [np.zeros((0, 3))] * len(seqs)
            for rows in _groups(seqs):
                if seqs[rows[-1]]:
                    every = Tables([seqs[r] for r in rows], Sum).pair_probabilities()
                    for k, r in enumerate(rows):
                        x = every[1 : len(seqs[r]) + 1, 1 : len(seqs[r]) + 1, k]
                        up, down = x.sum(1), x.sum(0)
                        profiles[r] = np.stack([1 - up - down, up, down], 1)
            n = len(b)
            yield pd.DataFrame({"key": b["key"], "distance": [profile_distance(profiles[k], profiles[n + k]) for k in range(n)]})

    d = df.select(F.col(key).alias("key"), F.col(one).alias("one"), F.col(other).alias("other")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return d.mapInPandas(run, f"key {dict(df.dtypes)[key]}, distance double").withColumnRenamed("key", key)


def duplex(one: str, other: str, end: tuple[int, int] | None = None) -> tuple[int, list[tuple[int, int]]] | None:
    """Lowest energy of two strands that pair only with each other, and its pairs (position in one, position in the other)
    from the start of ``one``; of those whose last pair is ``end``, if given; None where no pair can form."""
    n1, n2 = len(one), len(other)
    x, y = (np.r_[5, par.CODE_OF[letters(s)], 5] for s in (one, other))
    kind = par.TYPE_OF[x[:, None], y[None, :]]
    c = np.full((n1 + 2, n2 + 2), np.inf)
    back = {}
    u = np.array([(p, q) for p in range(31) for q in range(31 - p)]).T
    best = (np.inf, None)
    for i in range(1, (end[0] if end else n1) + 1):
        for j in range(n2, (end[1] if end else 1) - 1, -1):
            t = kind[i, j]
            if t == 7:
                continue
            low, before = DUPLEX_START + par.EXTERIOR_STEM[t, x[i - 1], y[j + 1]], None
            k, m = i - 1 - u[0], j + 1 + u[1]
            fits = (k > 0) & (m <= n2)
            k, m, a, b = k[fits], m[fits], u[0, fits], u[1, fits]
            ok = np.isfinite(c[k, m])
            if ok.any():
                k, m, a, b = k[ok], m[ok], a[ok], b[ok]
                e = c[k, m] + en.interior(a, b, kind[k, m], par.TURNED[t], x[k + 1], y[m - 1], x[i - 1], y[j + 1])
                at = int(e.argmin())
                if e[at] < low:
                    low, before = e[at], (int(k[at]), int(m[at]))
            c[i, j], back[i, j] = low, before
            total = low + par.EXTERIOR_STEM[par.TURNED[t], y[j - 1], x[i + 1]]
            if (total < best[0]) if end is None else (i, j) == end:
                best = (total, (i, j))
    if best[1] is None:
        return None
    pairs, at = [], best[1]
    while at:
        pairs.append(at)
        at = back[at]
    return int(best[0]), pairs[::-1]


#: Fixed value: energy of bringing two strands together.
DUPLEX_START = 410


def duplexes(df: DataFrame, one: str, other: str, key: str = "doc_id") -> DataFrame:
    """key, energy, start, end (in one), other_start, other_end, structure ('((.(&).))' of both parts) of the best duplex of
    two strands of every row; nulls where no pair can form."""

    def row(s, t):
        found = duplex(s.upper(), t.upper())
        if found is None:
            return (None,) * 6
        energy, pairs = found
        (a, d), (b, c) = pairs[0], pairs[-1]
        left, right = ["."] * (b - a + 1), ["."] * (d - c + 1)
        for i, j in pairs:
            left[i - a], right[j - c] = "(", ")"
        return energy, a, b, c, d, "".join(left) + "&" + "".join(right)

    names = ["energy", "start", "end", "other_start", "other_end", "structure"]

    def run(batches):
        for b in batches:
            out = pd.DataFrame([row(s, t) for s, t in zip(b["one"].fillna(""), b["other"].fillna(""))], columns=names, dtype=object)
            out.insert(0, "key", b["key"].values)
            yield out.astype({n: "Int64" for n in names[:5]})

    d = df.select(F.col(key).alias("key"), F.col(one).alias("one"), F.col(other).alias("other")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return d.mapInPandas(run, f"key {dict(df.dtypes)[key]}, energy long, start long, end long, other_start long, other_end long, structure string").withColumnRenamed("key", key)
