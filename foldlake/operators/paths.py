"""Refolding paths: from one structure to another by pairs that only one of them has, over the lowest barrier found.

A search keeps the ``width`` best intermediates a step: those of the lowest barrier so far, then of the lowest energy. It runs
from both ends in turn with widths 1, 2, 4 and so on, and no path over the best barrier known is followed. With a width of
all intermediates it is exact. Spark deals the rows out; nothing is shared between them.

Defined results: a null sequence or structure counts as empty; equal structures give a path of one step; pairs of the
structures beyond the sequence or within brackets without partner count as in ``structure``; null and repeated keys are rows
like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .energy import Loops
from .structure import Structure


class Folded:
    """Energies of structures of one sequence, each worked out once."""

    def __init__(self, seq: str, n: int):
        self.seq, self.n, self.known = seq, n, {}

    def text(self, pairs: frozenset) -> str:
        t = ["."] * self.n
        for i, j in pairs:
            t[i - 1], t[j - 1] = "(", ")"
        return "".join(t)

    def energy(self, pairs: frozenset) -> int:
        e = self.known.get(pairs)
        if e is None:
            e = self.known[pairs] = int(Loops(self.text(pairs), self.seq).energies()[1].sum()) if pairs else 0
        return e


def _pairs(text: str) -> frozenset:
    return frozenset(zip(*(x.tolist() for x in Structure(text).pairs())))


def _moves(now: frozenset, goal: frozenset):
    """Structures one pair nearer to the goal: a pair less that it lacks, or one of its pairs that fits in."""
    for p in now - goal:
        yield now - {p}
    for i, j in goal - now:
        if all(not (i <= a <= j <= b or a <= i <= b <= j) and a not in (i, j) and b not in (i, j) for a, b in now):
            yield now | {(i, j)}


def search(f: Folded, start: frozenset, goal: frozenset, width: int, most: float) -> tuple[float, list[frozenset]] | None:
    """(barrier, path) from start to goal with every energy below most, or None."""
    kept = {start: (f.energy(start), None)}
    steps = [kept]
    for _ in range(len(start ^ goal)):
        found: dict = {}
        for now, (barrier, _) in kept.items():
            for then in _moves(now, goal):
                high = max(barrier, f.energy(then))
                if high < most and (then not in found or high < found[then][0]):
                    found[then] = (high, now)
        best = sorted(found, key=lambda x: (found[x][0], f.energy(x), sorted(x)))[:width]
        kept = {x: found[x] for x in best}
        if not kept:
            return None
        steps.append(kept)
    path = [goal]
    for kept in steps[:0:-1]:
        path.append(kept[path[-1]][1])
    return steps[-1][goal][0], path[::-1]


def refold(seq: str, one: str, other: str, width: int) -> tuple[int, list[tuple[str, int]]]:
    """(barrier, [(structure, energy)] from one to other)."""
    f = Folded(seq, max(len(seq), len(one), len(other)))
    a, b = _pairs(one), _pairs(other)
    best, w, ahead = None, 1, True
    while True:
        got = search(f, *((a, b) if ahead else (b, a)), w, best[0] if best else float("inf"))
        if got:
            best = got[0], got[1] if ahead else got[1][::-1]
        if w == width:
            break
        w, ahead = min(2 * w, width), not ahead
    return int(best[0]), [(f.text(x), f.energy(x)) for x in best[1]]


def refolding_paths(df: DataFrame, one: str, other: str, width: int = 16, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """key, barrier (highest energy on the way, 0.01 kcal/mol), at (its first step, from 0), n_steps, path (structure and
    energy of every step) from the structure ``one`` to ``other``."""

    def run(batches):
        for b in batches:
            out = []
            for k, s, x, y in zip(b["key"], b["seq"].fillna(""), b["one"].fillna(""), b["other"].fillna("")):
                barrier, path = refold(s, x, y, width)
                energies = [e for _, e in path]
                out.append((k, barrier, int(np.argmax(energies)), len(path) - 1, [{"structure": t, "energy": e} for t, e in path]))
            yield pd.DataFrame(out, columns=["key", "barrier", "at", "n_steps", "path"])

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(F.col(key).alias("key"), F.upper(seq).alias("seq"), F.col(one).alias("one"), F.col(other).alias("other")).repartition(n)
    return d.mapInPandas(run, f"key {dict(df.dtypes)[key]}, barrier long, at int, n_steps int, path array<struct<structure:string,energy:long>>").withColumnRenamed("key", key)
