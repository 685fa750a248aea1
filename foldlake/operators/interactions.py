"""Where short strands bind long targets: lowest energies of duplexes at every place of a target, in memory linear in it.

Rows of the table are the bases of the short strand; a row holds all places of the target at once, and only as many rows as a
loop can span are kept. Loops cost a few operations for each number of unpaired bases, as in ``bands``. Places that are lowest
in their surroundings are traced in a window of the target, and what overlaps a better hit is left out. A hit may be charged
with the energy that opens its place in the target, from the windows of ``windowed``.

Defined results: a null strand or target counts as empty and has no hits; letters other than A, C, G, U never pair; null and
repeated keys are rows like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parameters as par
from .bands import KT, MOST_UNPAIRED, SPLITS, Windows
from .energy import interior
from .landscape import DUPLEX_START
from .structure import letters
from .windowed import _pieces

FAR = 10_000_000


def scan(strand: str, target: str, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lowest energy of duplexes whose first base of the target is j, last base of the strand in that duplex), for every
    place j of the target from 1; FAR where there is none. Entry 0 is not used. ``keep`` gets every row of the table."""
    n1, n = len(strand), len(target)
    wide = n + MOST_UNPAIRED + 6
    x = np.r_[5, par.CODE_OF[letters(strand)], 5]
    y = np.full(wide + 2, 5)
    y[1 : n + 1] = par.CODE_OF[letters(target)]
    low, last = np.full(n + 1, FAR, np.int64), np.zeros(n + 1, np.int64)
    z = y % 5
    j = slice(1, n + 1)
    empty = np.full(wide, FAR, np.int64)
    rows = {name: {} for name in ("c", "au", "one", "long", "23", "kind")}
    far: dict[int, np.ndarray] = {}
    row = lambda name, i: rows[name].get(i, empty)
    at = lambda v, k: v[1 + k : 1 + k + n]
    for i in range(1, n1 + 1):
        kind = par.TYPE_OF[x[i], y[: wide]]
        t, turned = kind[j], par.TURNED[kind[j]]
        before = x[i - 1] % 5
        c = DUPLEX_START + par.EXTERIOR_STEM[t, x[i - 1], at(y, 1)]
        seen = lambda k, s: rows["kind"].get(i - 1 - k, np.full(wide, 7))[1 + s : 1 + s + n]  # noqa: B023, E731
        best = [
            at(row("c", i - 1), 1) + par.STACKS[seen(0, 1), turned],
            at(row("c", i - 1), 2) + par.BULGE[1] + par.STACKS[seen(0, 2), turned],
            at(row("c", i - 2), 1) + par.BULGE[1] + par.STACKS[seen(1, 1), turned],
            at(row("c", i - 2), 2) + par.ONE_ONE[seen(1, 2), turned, before, at(z, 1)],
            at(row("c", i - 2), 3) + par.ONE_TWO[seen(1, 3), turned, before, at(z, 1), at(z, 2)],
            at(row("c", i - 3), 2) + par.ONE_TWO[turned, seen(2, 2), at(z, 1), x[max(i - 2, 0)] % 5, before],
            np.minimum(at(row("23", i - 3), 4), at(row("23", i - 4), 3)) + par.INTERIOR[5] + par.ASYMMETRY + par.TWO_THREE[turned, at(z, 1), before],
        ]
        bulge, one, long, now = (np.full(n, FAR, np.int64) for _ in range(3)), None, None, {}
        bulge, one, long = bulge
        for s in range(2, MOST_UNPAIRED + 1):
            np.minimum(bulge, np.minimum(at(row("au", i - 1), 1 + s), at(row("au", i - 1 - s), 1)) + par.BULGE[s], out=bulge)
            if s < 4:
                continue
            skew = lambda u: min(par.MOST_ASYMMETRY, par.ASYMMETRY * u)
            np.minimum(one, np.minimum(at(row("one", i - 2), s), at(row("one", i - s), 2)) + par.INTERIOR[s] + skew(s - 2), out=one)
            g = np.minimum(row("long", i - 3)[s - 1 :][: wide - s], row("long", i + 1 - s)[3:][: wide - s]) + skew(s - 4)
            if s > 5 and s - 2 in far:
                old = far[s - 2][1:]
                k = min(len(g), len(old))
                g = np.minimum(g[:k], old[:k])
            now[s] = g
            if s != 5:
                np.minimum(long, g[1 : n + 1] + par.INTERIOR[s], out=long)
        best += [bulge + par.NO_AU[turned], one + par.ONE_LONG[turned, at(z, 1), before], long + par.LONG[turned, at(z, 1), before]]
        for v in best:
            c = np.minimum(c, v)
        far = now
        full = empty.copy()
        full[j] = np.where(t == 7, FAR, np.minimum(c, FAR))
        after, behind = x[i + 1] % 5, np.r_[0, z[: wide - 1]]
        rows["c"][i], rows["kind"][i] = full, kind
        if keep is not None:
            keep[i] = full
        rows["au"][i] = full + par.NO_AU[kind]
        for name, values in (("one", par.ONE_LONG), ("long", par.LONG), ("23", par.TWO_THREE)):
            rows[name][i] = full + values[kind, after, behind]
        for name in rows:
            rows[name].pop(i - MOST_UNPAIRED - 2, None)
        total = full[j] + par.EXTERIOR_STEM[turned, y[:n], x[i + 1]]
        better = total < low[1:]
        low[1:][better], last[1:][better] = total[better], i
    low[low >= FAR // 2] = FAR
    return low, last


def hits(strand: str, target: str, most: int, apart: int = 10) -> list[tuple]:
    """(energy, start, end, target_start, target_end, structure) of the hits of at most the energy ``most``: places of the
    target lowest within ``apart`` bases, without those that overlap a better hit (of equal ones, the first)."""
    if not strand or not target:
        return []
    low, last = scan(strand, target)
    padded = np.r_[np.full(apart, FAR), low[1:], np.full(apart, FAR)]
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * apart + 1).min(1)
    found = []
    for j in np.flatnonzero((low[1:] <= most) & (low[1:] == around)) + 1:
        reach = len(strand) + 12
        while True:
            got = _traced(strand, target, int(last[j]), int(j), reach)
            if got and got[0] == low[j] or j + reach >= len(target):
                break
            reach *= 2
        found.append(got)
    kept: list[tuple] = []
    for hit in sorted(found, key=lambda h: (h[0], h[3])):
        if all(hit[4] < k[3] or k[4] < hit[3] for k in kept):
            kept.append(hit)
    return sorted(kept, key=lambda h: h[3])


def _traced(strand: str, target: str, i: int, j: int, reach: int):
    """The best duplex whose last pair is that of base i of the strand with place j, in a window of the target behind it."""
    first = max(j - 2, 0)
    window, keep = target[first : j + reach], {}
    scan(strand, window, keep)
    n, j = len(window), j - first
    c = np.stack([np.full_like(keep[1], FAR), *(keep[k] for k in range(1, len(strand) + 1))])
    x, y = (np.r_[5, par.CODE_OF[letters(s)], 5] for s in (strand, window))
    kind = par.TYPE_OF[x[:, None], y[None, :]]
    if c[i, j] >= FAR // 2:
        return None
    energy = int(c[i, j] + par.EXTERIOR_STEM[par.TURNED[kind[i, j]], y[j - 1], x[i + 1]])
    pairs = [(i, j)]
    while c[i, j] != DUPLEX_START + par.EXTERIOR_STEM[kind[i, j], x[i - 1], y[j + 1]]:
        k, m = i - 1 - SPLITS[0], j + 1 + SPLITS[1]
        real = np.flatnonzero((k > 0) & (m <= n))
        k, m = k[real], m[real]
        e = c[k, m] + interior(SPLITS[0, real], SPLITS[1, real], kind[k, m], par.TURNED[kind[i, j]], x[k + 1], y[m - 1], x[i - 1], y[j + 1])
        at = int(e.argmin())
        i, j = int(k[at]), int(m[at])
        pairs.append((i, j))
    (a, d), (b, e) = pairs[-1], pairs[0]
    left, right = ["."] * (b - a + 1), ["."] * (d - e + 1)
    for p, q in pairs:
        left[p - a], right[q - e] = "(", ")"
    return energy, a, b, e + first, d + first, "".join(left) + "&" + "".join(right)


def opening(target: str, sites: list[tuple[int, int]], window: int, span: int) -> list[float | None]:
    """Energies (0.01 kcal/mol) that open sites (first, last) of a target, by mean probabilities over windows; None where a
    site is longer than the window."""
    out: list[float | None] = [None] * len(sites)
    lengths = sorted({b - a + 1 for a, b in sites if b - a + 1 <= min(window, len(target))})
    for piece, first, low, high in _pieces(target, window) if lengths else ():
        own = [k for k, (a, b) in enumerate(sites) if low < a <= high and b - a + 1 in lengths]
        if own:
            w = Windows([piece], window, span)
            sums = dict(zip(lengths, w.unpaired(lengths)))
            for k in own:
                a, u = sites[k][0] - first, sites[k][1] - sites[k][0] + 1
                p = sums[u][int(w.bands.starts[0]) + a - 1] / w._count(0, u - 1)[a - 1]
                out[k] = float(-KT * np.log(max(p, 1e-300)))
    return out


def interactions(df: DataFrame, strand: str, target: str, most: int = -500, apart: int = 10, window: int = 70, span: int = 70, key: str = "doc_id") -> DataFrame:
    """key, energy, opening, total, start, end, target_start, target_end, structure of the hits of the strand on the target of
    every row; energies in 0.01 kcal/mol, total: of the duplex and of opening its place in the target."""

    def run(batches):
        for b in batches:
            out = []
            for k, s, t in zip(b["key"], b["strand"].fillna(""), b["target"].fillna("")):
                found = hits(s, t, most, apart)
                for h, o in zip(found, opening(t, [(h[3], h[4]) for h in found], window, span)):
                    out.append((k, h[0], o, None if o is None else h[0] + o, *h[1:]))
            x = pd.DataFrame(out, columns=["key", "energy", "opening", "total", "start", "end", "target_start", "target_end", "structure"])
            x["key"] = x["key"].astype(b["key"].dtype)
            yield x

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.select(F.col(key).alias("key"), F.upper(strand).alias("strand"), F.upper(target).alias("target")).repartition(n)
    return d.mapInPandas(run, f"key {dict(df.dtypes)[key]}, energy long, opening double, total double, start int, end int, target_start int, target_end int, structure string").withColumnRenamed("key", key)
