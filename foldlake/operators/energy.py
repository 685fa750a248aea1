"""Loop energies of given structures: one pass over Arrow batches, without a shuffle.

Energies are in units of 0.01 kcal/mol at 37 C, of the parameters of ``parameters``: stacks, loop initiation by size,
asymmetry, mismatches, special hairpins, terminal AU and GU pairs, linear multiloops, and dangling ends on both sides of
every stem of exterior and multiloops.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parameters as par
from .structure import Structure, by_row, letters

#: Fixed names of loops, by code.
KINDS = ["exterior", "hairpin", "interior", "multi"]


class Loops:
    """Arrays over the loops of one structure: the exterior one first, then one per pair."""

    def __init__(self, text: str | None, bases: str | None, dangles: int = 2):
        s = Structure(text)
        i, j = s.pairs()
        around = s.around()
        code = np.full(s.n + 2, 5)  # 1-based, 5 beyond the ends
        code[1 : s.n + 1] = 0
        own = par.CODE_OF[letters(bases)[: s.n]]
        code[1 : len(own) + 1] = own
        self.code, self.bases = code, bases or ""
        kind = par.TYPE_OF[code[i], code[j]]
        self.at = np.r_[0, i] if len(i) else i
        self.j, self.type = (np.r_[0, x][: len(self.at)] for x in (j, kind))
        at = self.at
        self.stems = np.bincount(around, minlength=s.n + 1)[at]
        self.au = np.bincount(around, weights=kind > 2, minlength=s.n + 1).astype(np.int64)[at]
        first = np.zeros(s.n + 1, np.int64)
        first[around[::-1]] = np.arange(len(i), 0, -1)  # the first pair inside each opening position, from 1
        f = first[at] - 1
        pick = lambda x: np.where(f >= 0, x[np.maximum(f, 0)] if len(x) else 0, 0)
        self.p, self.q, self.inner = pick(i), pick(j), pick(par.TURNED[kind])
        self.outside = [np.bincount(around, weights=t[kind, code[i - 1], code[j + 1]], minlength=s.n + 1).astype(np.int64)[at] for t in par.stems(dangles)]
        self.multi = par.stems(dangles)[1]

    def energies(self) -> tuple[np.ndarray, np.ndarray]:
        """Kinds and energies of the loops."""
        i, j, p, q, t, s, code = self.at, self.j, self.p, self.q, self.type, self.inner, self.code
        kind = np.where(i == 0, 0, 1 + np.minimum(self.stems, 2))
        out = np.where(kind == 0, self.outside[0], 0)
        k = np.flatnonzero(kind == 1)
        size = j[k] - i[k] - 1
        out[k] = _by_size(par.HAIRPIN, size) + np.where(size == 3, par.NO_AU[t[k]], np.where(size > 3, par.HAIRPINS[t[k], code[i[k] + 1], code[j[k] - 1]], 0))
        for x in k[np.isin(size, [3, 4, 6])]:
            out[x] = par.SPECIAL_HAIRPINS.get(self.bases[i[x] - 1 : j[x]], out[x])
        k = np.flatnonzero(kind == 2)
        if len(k):
            out[k] = interior(p[k] - i[k] - 1, j[k] - q[k] - 1, t[k], s[k], *(code[x] for x in (i[k] + 1, j[k] - 1, p[k] - 1, q[k] + 1)))
        k = np.flatnonzero(kind == 3)
        out[k] = par.MULTI_CLOSING + self.multi[par.TURNED[t[k]], code[j[k] - 1], code[i[k] + 1]] + self.outside[1][k]
        return kind, out


def _by_size(values: list[int], n: np.ndarray) -> np.ndarray:
    longer = values[30] + (par.LONGER * np.log(np.maximum(n, 30) / 30)).astype(np.int64)
    return np.where(n <= 30, np.array(values)[np.minimum(n, 30)], longer)


def interior(left, right, t, s, si, sj, sp, sq) -> np.ndarray:
    """Energies of loops with one pair inside: unpaired bases left and right, type of the outer pair, of the inner pair from
    inside, bases after i, before j, before p, after q."""
    n, short, long = left + right, np.minimum(left, right), np.maximum(left, right)
    skew = np.minimum(par.MOST_ASYMMETRY, par.ASYMMETRY * (long - short))
    stack = par.STACKS[t, s]
    return np.select(
        [n == 0, n == 1, short == 0, n == 2, (left == 1) & (right == 2), (left == 2) & (right == 1), short == 1, n == 5],
        [
            stack,
            par.BULGE[1] + stack,
            _by_size(par.BULGE, n) + par.NO_AU[t] + par.NO_AU[s],
            par.ONE_ONE[t, s, si, sj],
            par.ONE_TWO[t, s, si, sq, sj],
            par.ONE_TWO[s, t, sq, si, sp],
            _by_size(par.INTERIOR, n) + skew + par.ONE_LONG[t, si, sj] + par.ONE_LONG[s, sq, sp],
            par.INTERIOR[5] + par.ASYMMETRY + par.TWO_THREE[t, si, sj] + par.TWO_THREE[s, sq, sp],
        ],
        _by_size(par.INTERIOR, n) + skew + par.LONG[t, si, sj] + par.LONG[s, sq, sp],
    )


def loops(df: DataFrame, key: str = "doc_id", seq: str = "seq", structure: str = "structure") -> DataFrame:
    """One row per loop: key, i, j (closing pair; 0 for the exterior loop), n_stems inside, p, q (first pair inside, or 0),
    type of the closing pair (0: none), inner (type of the first pair, from its inside), n_au (AU-like pairs inside).

    Structures without pairs have no rows.
    """

    def run(text, bases):
        x = Loops(text, bases)
        return tuple(v.astype(np.int32) for v in (x.at, x.j, x.stems, x.p, x.q, x.type, x.inner, x.au))

    return by_row(df, key, [structure, seq], "i int, j int, n_stems int, p int, q int, type int, inner int, n_au int", run)


def loop_energies(df: DataFrame, key: str = "doc_id", seq: str = "seq", structure: str = "structure", dangles: int = 2) -> DataFrame:
    """key, i, j, kind (exterior, hairpin, interior, multi), energy of every loop, with dangling ends on both sides of stems
    (2) or none (0). Structures without pairs have no rows."""

    def run(text, bases):
        x = Loops(text, bases, dangles)
        kind, energy = x.energies()
        return x.at.astype(np.int32), x.j.astype(np.int32), kind.astype(np.int32), energy.astype(np.int64)

    e = by_row(df, key, [structure, seq], "i int, j int, kind int, energy long", run)
    return e.withColumn("kind", F.get(F.array(*[F.lit(k) for k in KINDS]), "kind"))


def structure_energy(df: DataFrame, key: str = "doc_id", seq: str = "seq", structure: str = "structure", dangles: int = 2) -> DataFrame:
    """key, energy of every row's structure, dangles as in ``loop_energies``; 0 without pairs. Null and repeated keys are rows
    like others."""

    def run(text, bases):
        return (np.array([Loops(text, bases, dangles).energies()[1].sum()], np.int64),)

    return by_row(df, key, [structure, seq], "energy long", run)


def move_energies(df: DataFrame, moves: str = "moves", key: str = "doc_id", seq: str = "seq", structure: str = "structure") -> DataFrame:
    """key, i, j, change of energy by each move of the array column ``moves`` of (i, j): a pair to insert, or, negative, one
    to delete. A move that the structure has no place for has a null change; rows without moves have none."""

    def run(text, bases, own):
        old = Structure(text)
        before, out = Loops(text, bases).energies()[1].sum(), []
        for i, j in ((m["i"], m["j"]) for m in own or ()):
            a, b = abs(i), abs(j)
            inside = 0 < a < b <= old.n
            t = np.where(old.opens, 40, np.where(old.closes, 41, 46)).astype(np.uint8)
            if inside and i < 0 and old.partner[a - 1] == b and old.opens[a - 1]:
                t[[a - 1, b - 1]] = 46
            elif inside and i > 0 and not old.partner[a - 1] and not old.partner[b - 1] and old.height[a - 1] == old.height[b - 1] == old.height[a - 1 : b].min():
                t[a - 1], t[b - 1] = 40, 41
            else:
                out.append((i, j, 0, False))
                continue
            out.append((i, j, int(Loops(t.tobytes().decode(), bases).energies()[1].sum() - before), True))
        return tuple(np.array(x, kind) for x, kind in zip(zip(*out) if out else ((),) * 4, (np.int32, np.int32, np.int64, bool)))

    e = by_row(df, key, [structure, seq, moves], "i int, j int, change long, fits boolean", run)
    return e.select(key, "i", "j", F.when(F.col("fits"), F.col("change")).alias("change"))
