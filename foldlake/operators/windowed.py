"""Local folding of whole texts: pairs up to a span, in time and memory linear in the length.

Sequences behind one another, a border between two, are cut into tiles of TILE letters that overlap by the span, so that every
pair lies whole in the tile of its first base; the energies of the suffixes are handed on from tile to tile, from the end. No pair is lost at a border of tiles, and none is longer than the span.

Defined results: a null sequence counts as empty; letters other than A, C, G, U never pair; null and repeated keys are
rows like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bands import KT, LEAST, Windows
from .blocks import Block, Room
from .matching import spread

#: Letters of a tile, and of the sequences that are filled together; letters of those that are put behind one another for
#: tiles, and rows that are held.
TILE, STRIP, HELD = 8192, 1 << 18, 100_000


def _together(seqs: list[str], most: int | None = None):
    """Row numbers of sequences of at most so many letters in all, TILE by default, or of one longer sequence."""
    held, size = [], 0
    for k, s in enumerate(seqs):
        if held and size + len(s) > (most or TILE):
            yield held
            held, size = [], 0
        held.append(k)
        size += len(s)
    if held:
        yield held


def _suffixes(f: list[int], ext: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """Fills f from b - 1 down to a; (place, distance of the first pair) where the best suffix starts with a pair. ext[d - LEAST,
    x - a]: energies of pairs as stems; f only falls to the left, so those of no gain, or no better than a shorter one, are in no
    best suffix."""
    gains = ext < 0
    gains[1:] &= ext[1:] < np.minimum.accumulate(ext, 0)[:-1]
    far, at = np.nonzero(gains)
    order = np.lexsort((far, -at))
    pairs = zip((at[order] + a).tolist(), (far[order] + LEAST).tolist(), ext[far[order], at[order]].tolist())
    out, low, x = [], f[b], b
    place, d, e = next(pairs, (-1, 0, 0))
    while place >= a:
        for x in range(x - 1, place, -1):
            f[x] = low
        x, best, which = place, low, 0
        while place == x:
            if e + f[x + d + 1] < best:
                best, which = e + f[x + d + 1], d
            place, d, e = next(pairs, (-1, 0, 0))
        f[x] = best
        if which:
            out.append((x, which))
            low = best
    for x in range(x - 1, a - 1, -1):
        f[x] = low
    return out


def _stems(text: str, span: int, dangles: int = 2):
    """(f: least energies of the suffixes of sequences with blanks between them, hits from right to left), each hit as (place,
    distance, energy, structure): the first stem of a suffix that no further letter betters at once."""
    n = len(text)
    f, hits, room = [0] * (n + 1), [], Room()
    cuts = list(range(0, n, TILE)) + [n]
    open_ = []  # starts of the tile behind that the letter before decides on
    for a, b in reversed(list(zip(cuts, cuts[1:]))):
        # A tile holds a letter before its own and those that pairs and their neighbours reach.
        first = max(a - 1, 0)
        block = Block([text[first : b + span + 2]], span, strip=True, dangles=dangles, room=room)
        starts = _suffixes(f, block.ext[LEAST:, a - first + 1 : b - first + 1], a, b)
        found = [(x, d) for x, d in open_ + starts if not x or (x > a and f[x - 1] == f[x])]
        open_ = [(x, d) for x, d in starts[-1:] if x == a]
        if not found:
            continue
        x, d = np.array(found).T
        at = x - first + 1
        brackets = block.texts(len(x), span + 1, *block.traced(d, at, np.arange(len(x))), at)
        for k, (place, far) in enumerate(found):
            hits.append((place, far, f[place] - f[place + far + 1], brackets[k * (span + 1) : k * (span + 1) + far + 1]))
    return f, hits


def _kept(hits):
    """Hits without those that lie in the next one with the same pairs."""
    last = None
    for hit in hits:
        place, far, _, brackets = hit
        if last is not None and not (last[0] + last[1] <= place + far and brackets[last[0] - place : last[0] - place + last[1] + 1] == last[3]):
            yield last
        last = hit
    if last is not None:
        yield last


def local_hits(seq: str, span: int, dangles: int = 2) -> tuple[int, list[tuple[int, int, int, str]]]:
    """(least energy with pairs up to span, hits from right to left): a hit (start, end, energy, structure) is the first stem of
    a suffix that no further letter betters at once. One that lies in the next hit with the same pairs is left out."""
    f, hits = _stems(seq, span, dangles)
    return f[0], [(x + 1, x + d + 1, e, text) for x, d, e, text in _kept(hits)]


def _local(batches, span, rows_of, dangles):
    for batch in batches:
        seqs, out = batch["seq"].fillna("").tolist(), []
        keys = batch["key"].tolist() if batch["key"].dtype == object else batch["key"]
        for rows in _together(seqs, STRIP):
            text = " ".join(seqs[r].replace(" ", "N") for r in rows)
            starts = np.cumsum([0] + [len(seqs[r]) + 1 for r in rows])
            f, hits = _stems(text, span, dangles)
            found = [[] for _ in rows]
            for x, d, e, brackets in _kept(hits):
                k = bisect.bisect_right(starts, x) - 1
                found[k].append((x - int(starts[k]) + 1, x - int(starts[k]) + d + 1, e, brackets))
            for k, r in enumerate(rows):
                out.extend((keys[r], *y) for y in rows_of((f[starts[k]] - f[starts[k] + len(seqs[r])], found[k])))
            if len(out) > HELD:
                yield out
                out = []
        yield out


def local_folds(df: DataFrame, span: int = 70, key: str = "doc_id", seq: str = "seq", dangles: int = 2) -> DataFrame:
    """key, i, j, energy (0.01 kcal/mol), structure of the locally best structures of every row, in dot-bracket from i to j."""

    def run(batches):
        for out in _local(batches, span, lambda x: x[1], dangles):
            yield pd.DataFrame(out, columns=["key", "i", "j", "energy", "structure"])

    return spread(df, key, seq).mapInPandas(run, f"key {dict(df.dtypes)[key]}, i int, j int, energy long, structure string").withColumnRenamed("key", key)


def local_energy(df: DataFrame, span: int = 70, key: str = "doc_id", seq: str = "seq", dangles: int = 2) -> DataFrame:
    """key, energy, n_hits, n_paired (bases in pairs of hits): least energy of the whole row with pairs up to the span."""

    def run(batches):
        for out in _local(batches, span, lambda x: [(x[0], len(x[1]), sum(h[3].count("(") * 2 for h in x[1]))], dangles):
            yield pd.DataFrame(out, columns=["key", "energy", "n_hits", "n_paired"])

    return spread(df, key, seq).mapInPandas(run, f"key {dict(df.dtypes)[key]}, energy long, n_hits long, n_paired long").withColumnRenamed("key", key)


def _pieces(seq: str, window: int):
    """(letters, number of the first, core from, to): cores of TILE letters with all windows that touch them."""
    if len(seq) <= TILE:
        yield seq, 0, 0, len(seq)
        return
    for a in range(0, len(seq), TILE):
        b, first = min(a + TILE, len(seq)), max(a - window - 1, 0)
        yield seq[first : b + window + 1], first, a, b


def _windows(batches, window: int, span: int, rows_of):
    """Rows of rows_of(windows, number of a piece) of all pieces, with places in the whole sequence."""
    for batch in batches:
        parts = [(k, *p) for k, s in enumerate(batch["seq"].fillna("").tolist()) if s for p in _pieces(s, window)]
        for rows in _together([p[1] for p in parts]):
            group = [parts[r] for r in rows]
            w = Windows([p[1] for p in group], window, span)
            of = rows_of(w)
            for x, (k, _, first, a, b) in enumerate(group):
                got = of(x)
                got[0] += first
                got = got[:, (got[0] > a) & (got[0] <= b)]
                yield pd.Series([batch["key"].iloc[k]] * got.shape[1], dtype=batch["key"].dtype), got, first


def window_pairs(df: DataFrame, window: int = 70, span: int = 70, cutoff: float = 0.01, key: str = "doc_id", seq: str = "seq", stacked: bool = False) -> DataFrame:
    """key, i, j, p: mean probability of the pair over all windows of the sequence that hold it (of at least cutoff); a
    window is folded alone, but its stems see the bases beside it. A sequence shorter than the window is one window.
    ``stacked``: of the pair and the next one inside it, (i + 1, j - 1), together."""

    def run(batches):
        for keys, got, first in _windows(batches, window, span, lambda w: lambda x: (w.stacks if stacked else w.pairs)(x, cutoff)):
            yield pd.DataFrame({"key": keys, "i": got[0].astype(np.int32), "j": (got[1] + first).astype(np.int32), "p": got[2]})

    return spread(df, key, seq).mapInPandas(run, f"key {dict(df.dtypes)[key]}, i int, j int, p double").withColumnRenamed("key", key)


def accessibilities(df: DataFrame, lengths: list[int], window: int = 70, span: int = 70, key: str = "doc_id", seq: str = "seq") -> DataFrame:
    """key, i, u, p, energy: mean probability over all windows that the bases i to i + u - 1 are unpaired, for each length
    u, and the energy (kcal/mol) to open them. Stretches longer than the window have no row."""

    def run(batches):
        def rows_of(w):
            sums = w.unpaired(lengths)
            return lambda x: w.stretches(x, lengths, sums)

        for keys, got, _ in _windows(batches, window, span, rows_of):
            yield pd.DataFrame({"key": keys, "i": got[0].astype(np.int32), "u": got[1].astype(np.int32), "p": got[2]})

    out = spread(df, key, seq).mapInPandas(run, f"key {dict(df.dtypes)[key]}, i int, u int, p double").withColumnRenamed("key", key)
    return out.withColumn("energy", F.when(F.col("p") > 0, -KT / 100 * F.log("p")))


def accessibility_lines(rows: DataFrame, lengths: list[int], column: str = "p", key: str = "doc_id") -> DataFrame:
    """key, i and a line 'i p_1 p_2 ...' of each last base i of stretches, by length; NA where there is none."""
    r = rows.select(key, (F.col("i") + F.col("u") - 1).alias("i"), "u", F.col(column).alias("x"))
    g = r.groupBy(key, "i").agg(*[F.max(F.when(F.col("u") == u, F.format_string("%.7g", "x"))).alias(f"u{u}") for u in lengths])
    return g.select(key, "i", F.concat_ws("\t", F.col("i").cast("string"), *[F.coalesce(f"u{u}", F.lit("NA")) for u in lengths]).alias("line"))
