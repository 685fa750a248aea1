"""Periodic runs of words by internal pattern matching.

A run is a longest stretch of words that repeats with a smallest period. Every run holds an aligned block of a power of
two words (at most about half the period long) whose next occurrence is one period further on. So each block of a text
asks for its occurrences in the windows behind it: the suffix array, sorted by doubling, has the occurrences of a block
as one range, and a wavelet tree over it gives the first place at or after a position in that range (range successor).
In a window no wider than the block the occurrences are an arithmetic progression, known by its first, second and last
place; its members are the candidate periods, and the names of blocks from the doubling extend each to its whole stretch.

Defined results: a null or blank text has no words and no run; a null doc_id is a row like others and its words stay as
they are; repeated rows each have their row; other columns are ignored; an empty table gives no rows. A text is held by
one task, with as many others as fill SLICE bytes; a longer one is alone.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, table

#: Least length of a run, least number of periods in it, and bytes of texts that are searched together.
LEAST, TIMES, SLICE = 12, 2, 2 << 20


class Suffixes:
    """Suffix array of the words of several texts, which never match each other, and the names of their blocks."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray):
        n = len(codes)
        self.n, self.starts = n, starts
        self.doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.end = starts[1:][self.doc]
        key = self.doc * (int(codes.max(initial=0)) + 1) + codes
        sa = np.argsort(key, kind="stable")
        slots, key = np.arange(n), key[sa]
        rank = np.full(n + 1, -1, np.int64)  # first slot of the suffixes with the same first words; -1 behind the end
        #: names[k][i]: name of the block of 2**k words at i; alike[k]: its number of occurrences, by name
        self.names, self.alike, width = [], [], 1
        while True:
            new = np.r_[True, key[1:] != key[:-1]][: len(key)]
            at = np.flatnonzero(new)
            size = np.diff(np.r_[at, len(key)])
            rank[sa[slots]] = np.repeat(slots[at], size)
            self.names.append(rank.astype(np.int32))
            alike = np.ones(n, np.int32)
            alike[slots[at]] = size
            self.alike.append(alike)
            again = np.repeat(size > 1, size)
            slots = slots[again]
            if not len(slots):
                break
            i = sa[slots]
            after = i + width
            second = np.where(after < self.end[i], rank[np.minimum(after, n)], -1)
            key = rank[i] * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            sa[slots], key = i[order], key[order]
            width *= 2
        self.order = sa

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree from i and j on."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            same = self.names[k][np.minimum(i, self.n)] == self.names[k][np.minimum(j, self.n)]
            same &= j < self.n
            step = np.where(same, 1 << k, 0)
            i, j, out = i + step, j + step, out + step
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before i and before j, i < j, within the text of i."""
        first, out = self.starts[:-1][self.doc[i]], np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k), j - out - (1 << k)
            same = (a >= first) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
            out += np.where(same, 1 << k, 0)
        return out


class Wavelet:
    """Wavelet tree over numbers less than most; ranges [low, high) of places are asked for the next number from x on, or before x."""

    def __init__(self, values: np.ndarray, most: int):
        self.levels, self.most, v = [], most, values
        for bit in range(max(int(most).bit_length(), 1) - 1, -1, -1):
            one = (v >> bit & 1).astype(bool)
            zeros = np.zeros(len(v) + 1, np.int64)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            v = np.concatenate([v[~one], v[one]])

    def below(self, low, high, x):
        """How many numbers of the range are less than x."""
        x, out = np.minimum(x, self.most), np.zeros(len(x), np.int64)
        for bit, zeros, all_zeros in self.levels:
            z0, z1 = zeros[low], zeros[high]
            up = (x >> bit & 1).astype(bool)
            out += np.where(up, z1 - z0, 0)
            low, high = np.where(up, all_zeros + low - z0, z0), np.where(up, all_zeros + high - z1, z1)
        return out

    def smallest(self, low, high, k):
        """The k-th smallest number of the range, from 0."""
        k, out = k.copy(), np.zeros(len(k), np.int64)
        for bit, zeros, all_zeros in self.levels:
            z0, z1 = zeros[low], zeros[high]
            up = k >= z1 - z0
            k -= np.where(up, z1 - z0, 0)
            out |= np.where(up, 1 << bit, 0)
            low, high = np.where(up, all_zeros + low - z0, z0), np.where(up, all_zeros + high - z1, z1)
        return out

    def successor(self, low, high, x, none):
        k = self.below(low, high, x)
        found = k < high - low
        out = np.full(len(x), none, np.int64)
        out[found] = self.smallest(low[found], high[found], k[found])
        return out

    def predecessor(self, low, high, x):
        """The largest number before x, which the range has."""
        return self.smallest(low, high, self.below(low, high, x) - 1)


def _windows(k: int) -> list[tuple[int, int]]:
    """Distances behind a block of 2**k words at which the next occurrence tells a period: windows no wider than a block."""
    if k == 1:
        return [(6, 6)]
    if k == 2:  # runs of short periods are of LEAST words at least, so longer blocks find them too
        return [(1, 4), (5, 8), (9, 12), (13, 14)]
    b = 1 << k
    return [(2 * b - 1, 3 * b - 2), (3 * b - 1, 4 * b - 2)]


def candidates(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, candidate periods)."""
    nothing = np.empty(0, np.int64)
    if len(s.names) < 2:
        return nothing, nothing
    twice = s.alike[1] > 1  # names of pairs of words that occur again: only their suffixes can be asked for
    held = twice[s.names[1][:-1][s.order]]
    place = np.cumsum(held) - held  # slot -> place among those held
    tree = Wavelet(s.order[held], s.n)
    begin = s.starts[:-1][s.doc]
    here = np.arange(s.n)
    at, periods = [nothing], [nothing]
    for k in range(1, len(s.names)):
        b = 1 << k
        name = s.names[k][:-1]
        block = here[((here - begin) % b == 0) & (here + b <= s.end) & (s.alike[k][name] > 1)]
        if not len(block):
            continue
        low = place[name[block]]
        high = low + s.alike[k][name[block]]
        for near, far in _windows(k):
            first = tree.successor(low, high, block + near, s.n)
            hit = first <= block + far
            if not hit.any():
                continue
            x, lo, hi, first = block[hit], low[hit], high[hit], first[hit]
            second = tree.successor(lo, hi, first + 1, s.n)
            last = tree.predecessor(lo, hi, x + far + 1)
            more = last > first
            step = np.where(more, second - first, 1)
            count = np.where(more, (last - first) // step + 1, 1)
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at.append(np.repeat(x, count))
            periods.append(np.repeat(first - x, count) + nth * np.repeat(step, count))
    return np.concatenate(at), np.concatenate(periods)


def runs(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of texts codes[starts[t]:starts[t + 1]], by text, start and period."""
    if not len(codes):
        return np.empty((0, 4), np.int64)
    s = Suffixes(codes, starts)
    i, q = candidates(s)
    back = s.backward(i, i + q)
    length = back + q + s.forward(i, i + q)
    fits = length >= np.maximum(LEAST, TIMES * q)
    start, length, q = (i - back)[fits], length[fits], q[fits]
    order = np.lexsort((q, length, start))  # of one stretch, the smallest period
    start, length, q = start[order], length[order], q[order]
    own = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, q = start[own], length[own], q[own]
    doc = s.doc[start]
    out = np.stack([doc, start - starts[doc], length, q], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Numbers of the words that op11 reads in place of 0 to n - 1, or None for those themselves."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


SCHEMA = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [(c, pa.string()) for c in ("runs_sha256", "collapsed_sha256")])
DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _slices(batch):
    """Rows [from, to) of at most SLICE bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    at, held = 0, 0
    for r, n in enumerate(sizes):
        if held and held + n > SLICE:
            yield at, r
            at, held = r, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _found(batches, alter):
    for batch in batches:
        for low, high in _slices(batch):
            ids = batch.column(0).slice(low, high - low).to_pylist()
            texts = pc.fill_null(batch.column(1).slice(low, high - low).cast(pa.large_binary()), b"")
            # Words by Arrow; the empty ones before and behind leading and trailing white space go.
            cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
            flat, parents = cut.flatten().cast(pa.large_binary()), pc.list_parent_indices(cut)
            real = pc.greater(pc.binary_length(flat), 0)
            flat, parents = flat.filter(real), parents.filter(real).to_numpy()
            codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            starts = np.searchsorted(parents, np.arange(len(ids) + 1))
            altered = {}
            if alter:
                for t, doc_id in enumerate(ids):
                    to = planted(doc_id, int(starts[t + 1] - starts[t]))
                    if to is not None:
                        altered[t] = to
                        codes[starts[t] : starts[t + 1]] = codes[starts[t] + to]
            found = runs(codes, starts)
            change = np.zeros(len(codes) + 1, np.int64)
            begin = starts[found[:, 0]] + found[:, 1]
            np.add.at(change, begin + found[:, 3], 1)
            np.add.at(change, begin + found[:, 2], -1)
            kept = np.cumsum(change)[:-1] == 0
            bounds = np.searchsorted(found[:, 0], np.arange(len(ids) + 1))
            rows = []
            for t, doc_id in enumerate(ids):
                words, left = texts[t].as_py().split(), kept[starts[t] : starts[t + 1]]
                if t in altered:
                    words = [words[i] for i in altered[t][left]]
                elif not left.all():
                    words = compress(words, left.tolist())
                collapsed = hashlib.sha256(b" ".join(words)).hexdigest()
                mine = found[bounds[t] : bounds[t + 1], 1:]
                lines = "".join(f"{a},{b},{c}\n" for a, b, c in mine.tolist())
                best = (None,) * 4
                if len(mine):
                    a, b, c = min(mine.tolist(), key=lambda r: (-r[1], r[0], r[2]))
                    best = (a, b, c, 1000 * b // c)
                rows.append((doc_id, len(mine), *best, hashlib.sha256(lines.encode()).hexdigest(), collapsed))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def periodic_runs(docs: DataFrame, alter: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; null if there is none), and the SHA-256 of
    all runs and of the text without the repeats of its runs. ``alter`` first plants runs by doc_id, as op11 says."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(lambda batches: _found(batches, alter), DDL)


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs(table(spark, sf_dir, "documents"), alter=True)


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce({crc32_sql("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents),
x AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
y AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM x),
z AS (SELECT id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM y),
u AS (SELECT id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM z),
e AS (SELECT a.id, a.i, b.i - a.i AS q FROM u a JOIN u b ON a.id = b.id AND a.word = b.word AND b.i > a.i AND 2 * (b.i - a.i) <= a.n),
s AS (SELECT id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM e) GROUP BY id, q, island HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)),
r AS (SELECT id, start, length, min(q) AS period FROM s GROUP BY id, start, length),
g AS (SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines, first(struct_pack(start, length, period) ORDER BY length DESC, start, period) AS best FROM r GROUP BY id),
o AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT u.id, string_agg(word, ' ' ORDER BY u.i) AS text FROM u ANTI JOIN o ON u.id = o.id AND u.i = o.i GROUP BY u.id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256 FROM z LEFT JOIN g ON z.id = g.id LEFT JOIN k ON z.id = k.id
"""
