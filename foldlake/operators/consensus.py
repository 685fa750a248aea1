"""Folds of alignments: one structure over the columns that adds up the loop energies of all rows.

A pair of columns may form where its covariance score is at least LOWEST; it has the energies of the pairs of the rows (type
"other" where a row has none), counted without gaps, less its score. Tables go by diagonals of columns; loops with one pair
inside are worked out for those pairs of columns only that may form, all rows of all of them at once.

Rows of an alignment are gathered before a fold (a fold needs all of them), so an alignment has to fit one task; alignments
are dealt out to tasks. Defined results: rows end in gaps up to the longest; a null row is all gaps; letters other than A, C,
G, U never pair; an alignment without columns has an empty structure; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import PAIR_TYPES
from . import parameters as par
from .alignment import FORBIDDEN
from .bands import KT, LEAST, MOST_UNPAIRED, SIZE, SPLITS, WITHIN, Bands, Minimum
from .energy import _by_size, interior
from .structure import letters

#: Least covariance score of a pair that may form, energy of a hairpin of fewer than three bases in a row.
LOWEST, TIGHT = -200, 600


def scores(codes: np.ndarray, cv: float = 1.0, nc: float = 1.0) -> np.ndarray:
    """Covariance scores of all pairs of columns, by distance and first column; codes: rows by columns, 0 for a gap."""
    n_seq, n = codes.shape
    out = np.full((n, n), FORBIDDEN, np.int64)
    names = list(PAIR_TYPES)
    apart = np.array([[sum(a != b for a, b in zip(x, y)) for y in names] for x in names])
    for d in range(LEAST, n):
        a, b = codes[:, : n - d], codes[:, d:]
        t = par.TYPE_OF[a, b] % 7
        t[(a == 0) & (b == 0)] = 7
        f = np.stack([(t == k).sum(0) for k in range(8)])
        score = cv * (100 * np.einsum("ki,kl,li->i", f[1:7], np.triu(apart), f[1:7]) / n_seq - nc * 100 * (f[0] + f[7] * 0.25))
        out[d, : n - d] = np.where(2 * f[0] + f[7] > n_seq, FORBIDDEN, score.astype(np.int64))
    return out


class Consensus:
    """Tables as those of ``bands`` over the columns 1 to n of one alignment; energies are sums over rows."""

    def __init__(self, rows: list[str], ring, cv: float = 1.0, nc: float = 1.0, kt: float = KT):
        self.ring, self.n, self.rows = ring, max(map(len, rows), default=0), rows
        n, n_seq = self.n, len(rows)
        self.kt = kt * n_seq
        self.code = np.zeros((n_seq, n + 2), np.int64)
        for s, r in enumerate(rows):
            self.code[s, 1 : len(r) + 1] = par.CODE_OF[letters(r)]
        full = self.code > 0
        for s, r in enumerate(rows):
            full[s, 1 : len(r) + 1] = ~np.isin(letters(r), list(b"-_.~"))
        self.upto = np.cumsum(full, 1)  # letters up to a column
        at = np.arange(n + 2)
        last = np.maximum.accumulate(np.where(full, at, 0), 1)
        after = np.minimum.accumulate(np.where(full, at, n + 1)[:, ::-1], 1)[:, ::-1]
        rows_of = np.arange(n_seq)[:, None]
        none = lambda x, column: np.where((column > 0) & (column <= n), x, 5)
        #: the letter before and after a column in its row, gaps left out; 5 beyond the ends
        self.before = np.full((n_seq, n + 2), 5)
        self.before[:, 1:] = none(self.code[rows_of, last[:, :-1]], last[:, :-1])
        self.after = np.full((n_seq, n + 2), 5)
        self.after[:, :-1] = none(self.code[rows_of, after[:, 1:]], after[:, 1:])
        self.text = ["".join(c for c in r if c not in "-_.~") for r in rows]
        self.score = scores(self.code[:, 1 : n + 1], cv, nc) if n else np.empty((0, 0), np.int64)
        self.may = np.zeros((n + 2, n + 2), bool)  # by distance and first column
        for d in range(LEAST, n):
            self.may[d, 1 : n - d + 1] = self.score[d, : n - d] >= LOWEST
        kind = ring.kind if ring is not Minimum else np.int64
        new = lambda: np.full((n + 2, n + 3), ring.zero, kind)
        self.c, self.m1, self.u, self.t, self.m = new(), new(), new(), new(), new()
        for d in range(LEAST, n):
            self._fill(d)
        self.f = np.full(n + 2, ring.one, kind)  # suffixes from a column on
        for i in range(n - LEAST, 0, -1):
            d = np.arange(LEAST, n - i + 1)
            stems = ring.times(ring.times(self.c[d, i], self.outer(np.full(len(d), i), i + d)), self.f[i + d + 1])
            self.f[i] = ring.plus(self.f[i + 1], ring.plus.reduce(stems))

    def w(self, e):
        return np.exp(-np.asarray(e, float) / self.kt) if self.ring is not Minimum else np.asarray(e, np.int64)

    def types(self, i, j) -> np.ndarray:
        return par.TYPE_OF[self.code[:, i], self.code[:, j]]

    def _stem(self, table, i, j) -> np.ndarray:
        return self.w(table[self.types(i, j), self.before[:, i], self.after[:, j]].sum(0))

    def outer(self, i, j):
        return self._stem(par.EXTERIOR_STEM, i, j)

    def stem(self, i, j):
        return self._stem(par.MULTI_STEMS, i, j)

    def close(self, i, j):
        x = par.MULTI_STEMS[par.TURNED[self.types(i, j)], self.before[:, j], self.after[:, i]] + par.MULTI_CLOSING
        return self.w(x.sum(0))

    def hairpin(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size, t = self.upto[:, j - 1] - self.upto[:, i], self.types(i, j)
        e = _by_size(par.HAIRPIN, np.maximum(size, 3)) + np.where(size == 3, par.NO_AU[t], par.HAIRPINS[t, self.after[:, i] % 5, self.before[:, j] % 5])
        for s, x in zip(*np.nonzero(np.isin(size, [3, 4, 6]) & (self.code[:, i] > 0) & (self.code[:, j] > 0))):
            a = self.upto[s, i[x]] - 1
            e[s, x] = par.SPECIAL_HAIRPINS.get(self.text[s][a : a + size[s, x] + 2], e[s, x])
        return self.w(np.where(size < 3, TIGHT, e).sum(0))

    def inner(self, i: np.ndarray, d: int):
        """(number in i, distance, first column, weight of the loop) of the pairs inside pairs (i, i + d)."""
        k = WITHIN[min(d - 2 - LEAST, MOST_UNPAIRED)] if d - 2 >= LEAST else 0
        p, e = i[:, None] + 1 + SPLITS[0, :k], np.broadcast_to(d - 2 - SIZE[:k], (len(i), k))
        x, z = np.nonzero(self.may[e, p])
        i, p, q = i[x], p[x, z], p[x, z] + e[x, z]
        j, up = i + d, self.upto
        energy = interior(up[:, p - 1] - up[:, i], up[:, j - 1] - up[:, q], self.types(i, j), par.TURNED[self.types(p, q)], self.after[:, i] % 5, self.before[:, j] % 5, self.before[:, p] % 5, self.after[:, q] % 5)
        return x, e[x, z], p, self.w(energy.sum(0))

    def _fill(self, d: int) -> None:
        ring, n = self.ring, self.n
        times, plus = ring.times, ring.plus
        k = n - d
        i = np.flatnonzero(self.may[d, : k + 1])
        if len(i):
            total = self.hairpin(i, i + d)
            x, e, p, w = self.inner(i, d)
            plus.at(total, x, times(w, self.c[e, p]))
            total = plus(total, times(self.t[d - 2, i + 1], self.close(i, i + d)))
            self.c[d, i] = times(total, self.w(-self.score[d, i - 1]))
        every = np.arange(1, k + 1)
        self.m1[d, 1 : k + 1] = plus(self.m1[d - 1, 1 : k + 1], times(self.c[d, 1 : k + 1], self.stem(every, every + d)))
        self.u[d, 1 : k + 1] = plus(self.m1[d, 1 : k + 1], self.u[d - 1, 2 : k + 2])
        for a in range(LEAST, d - LEAST):
            self.t[d, 1 : k + 1] = plus(self.t[d, 1 : k + 1], times(self.m[a, 1 : k + 1], self.m1[d - 1 - a, a + 2 : a + 2 + k]))
        self.m[d, 1 : k + 1] = plus(self.u[d, 1 : k + 1], self.t[d, 1 : k + 1])

    def best(self, cell: tuple) -> list:
        """What follows a cell at least energy."""
        what, d, i = cell
        if what == "f":
            return [] if i > self.n else [("f", 0, i + 1)] if self.f[i] == self.f[i + 1] else self._first(i)
        if what == "c":
            one = np.array([i])
            bare = self.c[d, i] + self.score[d, i - 1]
            if self.hairpin(one, one + d)[0] == bare:
                return []
            if d - 2 >= LEAST and self.t[d - 2, i + 1] + self.close(one, one + d)[0] == bare:
                return [("t", d - 2, i + 1)]
            _, e, p, w = self.inner(one, d)
            k = int((w + self.c[e, p]).argmin())
            return [("c", int(e[k]), int(p[k]))]
        if what == "m":
            return [("u", d, i)] if self.u[d, i] == self.m[d, i] else [("t", d, i)]
        if what == "u":
            return [("m1", d, i)] if self.m1[d, i] == self.u[d, i] else [("u", d - 1, i + 1)]
        if what == "m1":
            return [("m1", d - 1, i)] if self.m1[d - 1, i] == self.m1[d, i] else [("c", d, i)]
        a = np.arange(LEAST, d - LEAST)
        k = int(a[(self.m[a, i] + self.m1[d - 1 - a, i + a + 1]).argmin()])
        return [("m", k, i), ("m1", d - 1 - k, i + k + 1)]

    def _first(self, i: int) -> list:
        d = np.arange(LEAST, self.n - i + 1)
        k = int(d[(self.c[d, i] + self.outer(np.full(len(d), i), i + d) + self.f[i + d + 1]).argmin()])
        return [("c", k, i), ("f", 0, i + k + 1)]

    def structure(self) -> str:
        out, todo = ["."] * self.n, [("f", 0, 1)]
        while todo:
            cell = todo.pop()
            if cell[0] == "c":
                out[cell[2] - 1], out[cell[2] + cell[1] - 1] = "(", ")"
            todo.extend(self.best(cell))
        return "".join(out)


def fold_alignment(rows: list[str], cv: float = 1.0, nc: float = 1.0) -> tuple:
    """(structure, energy and covariance part, free energy, mean energy of the rows alone, conservation index), energies in
    0.01 kcal/mol and means over rows."""
    n_seq = len(rows)
    low = Consensus(rows, Minimum, cv, nc)
    if not low.n:
        return "", 0.0, 0.0, 0.0, 0.0, None
    text = low.structure()
    todo, part = [], 0
    for k, c in enumerate(text):
        if c == "(":
            todo.append(k)
        elif c == ")":
            i = todo.pop()
            part -= int(low.score[k - i, i])
    energy = float(low.f[1]) / n_seq
    z = Consensus(rows, Weights, cv, nc)
    alone = [Bands([s], len(s), Minimum) for s in low.text if s]
    mean = sum(float(b.exterior(0)[0]) for b in alone) / n_seq
    return text, energy, part / n_seq, -KT * math.log(z.f[1]), mean, energy / mean if mean else None


class Weights:
    """Sums of Boltzmann weights of means over rows."""

    kind, zero, one = np.float64, 0.0, 1.0
    times, plus = np.multiply, np.add


def fold_alignments(rows: DataFrame, aln: str = "aln", seq: str = "seq", cv: float = 1.0, nc: float = 1.0) -> DataFrame:
    """aln, n_seq, structure, energy (covariance and all), covariance, free_energy, mean_energy of the rows folded alone
    (0.01 kcal/mol, means over rows), conservation (energy over mean_energy; null if that is 0) of every alignment."""

    def run(batches):
        for b in batches:
            out = [(k, len(s), *fold_alignment([x or "" for x in s], cv, nc)) for k, s in zip(b["aln"], b["rows"])]
            yield pd.DataFrame(out, columns=["aln", "n_seq", "structure", "energy", "covariance", "free_energy", "mean_energy", "conservation"])

    kind = dict(rows.dtypes)[aln]
    g = rows.groupBy(F.col(aln).alias("aln")).agg(F.array_sort(F.collect_list(F.coalesce(F.upper(seq), F.lit("")))).alias("rows"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = g.repartition(n, "aln").mapInPandas(run, f"aln {kind}, n_seq long, structure string, energy double, covariance double, free_energy double, mean_energy double, conservation double")
    return out.withColumnRenamed("aln", aln)
