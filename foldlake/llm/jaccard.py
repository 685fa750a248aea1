"""N-gram Jaccard join by parity sketches: exact links, no capped groups.

A document's set holds the 64-bit hashes of its distinct word shingles. In the sketch of a size band the shingle
universe is dealt into D blocks and each block keeps the XOR of its shingles, so a shingle in one set only changes
one block: the number of unequal blocks is at most the symmetric difference. A similarity of t bounds that difference
by d = (1-t)/(1+t) * (|A|+|B|), so with D = d + 1 + spare + room blocks two similar sets agree on more than
``spare + room`` blocks. A document leaves out its blocks of fewest shingles, as long as they are no more than ``spare``:
an agreeing block holds the same shingles on both sides, so the blocks that either side leaves out are those of the side
that leaves out more, and more than ``room`` agreeing blocks stay. A document of size band q posts its blocks under bands
q and q + 1; similar sizes differ by one band at most, so every pair meets.

Each text is shingled once for its size and its posts. A task first looks through the posts that it holds: a key that
more than ``crowd`` of them share is crowded wherever else it turns up, so one row for the key and one count a document
go on instead of the posts. Posts then meet sorted by key, and one streaming pass gives the pairs of keys with few
documents and counts the crowded blocks of each document. A document with no more than ``room`` crowded blocks in either
band meets each of its partners under a key of few. Documents with more of them (large groups of copies, and texts that
share most of one passage) are paired by the prefixes of their sets too: rare shingles first, each pair needs a common
shingle among the first (1-t)|A| + 1, with at most d shingles before it on the two sides together. There each shingle
first links its documents to one central document, links are verified and joined into components, and only pairs across
components remain to be tried. With i shingles before, a document is early where i <= d/(|A|+|B|) * |A|: two that are
not early have too many shingles before, so only early ones are joined with others, under the size band as well. Texts
that share too little of a passage to be linked are never early there. All candidate pairs are verified on whole sets.

Texts that occur more often than ``hot_copies`` times are represented by their smallest doc_id from the start, so a
table of mostly one text costs no more than its distinct texts.

Defined results: a null or blank text has an empty set and no links; a null doc_id keeps its row, with a null
component; rows with the same doc_id count as one document that holds the links of all its texts; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialize, small, table
from .components import components

HOT_COPIES = 64
CROWD = 8
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEEN_KEPT = 125_000
_BYTES_AT_ONCE = 1 << 20
_POSTS_HELD = 1_000_000
SKETCH = 2048
SALTS, HOT_TOKEN, SIDE = 32, 512, 6
#: Kinds of rows: a post, the size of a row, crowded blocks of a document in even and odd bands, a copy and its representative.
POST, SIZE, CROWDED, COPY, PAIR = 0, 1, 2, 4, 5


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2^64."""
    inverse = pow(int(_MULTIPLY), -1, 1 << 64)
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (_MULTIPLY, np.uint64(inverse)))


class Words:
    """Hashes of the lower-cased words of texts, straight from the bytes of an Arrow column.

    A word's hash is a polynomial of its bytes (each replaced by a fixed random number) modulo 2^64, so one running sum
    over the bytes gives those of all words.
    """

    def __init__(self):
        self.value = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
        self.value[65:91] = self.value[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[[32, 9, 10, 11, 12, 13]] = True
        self.up, self.down = _powers(1 << 16)

    def runs(self, column):
        """(first row, hashes of all words, words in each row) for runs of rows of about _BYTES_AT_ONCE."""
        if not len(column):
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
        first = 0
        while first < len(column):
            stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BYTES_AT_ONCE, side="right")) - 1)
            stop = min(stop, len(column))
            yield first, *self._hashed(data[offsets[first] : offsets[stop]], (offsets[first : stop + 1] - offsets[first]).astype(np.int64))
            first = stop

    def _hashed(self, a: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.blank[a]
        edge = np.zeros(len(a) + 1, bool)
        edge[offsets] = True
        edge[1:] |= ~np.r_[inside, False][:-1] if len(a) else False
        starts = np.flatnonzero(inside & edge[:-1])
        edge = np.zeros(len(a) + 1, bool)
        edge[offsets] = True
        edge[:-1] |= ~inside
        ends = np.flatnonzero(inside & edge[1:]) + 1
        if len(a) > len(self.up):
            self.up, self.down = _powers(len(a))
        total = np.r_[np.uint64(0), np.cumsum(self.value[a] * self.up[: len(a)], dtype=np.uint64)]
        return mixed((total[ends] - total[starts]) * self.down[starts]), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts, n: int, words: Words):
    """(first row, sizes, sets) for runs of rows with a bounded number of bytes, or one row: the sorted distinct hashes
    of all runs of n words of each text, end to end; of the whole text where it has fewer."""
    for first, w, lengths in words.runs(texts):
        yield first, *_sets_of(w, lengths, n)


def _sets_of(w: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    padded = np.r_[w, np.zeros(n, np.uint64)]
    h = np.full(len(w), n, np.uint64)
    for i in range(n):
        h = h * _MULTIPLY + padded[i : i + len(w)]
    h = mixed(h)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    several = np.maximum(lengths - n + 1, lengths > 0)  # runs in each text
    for a, b in zip(begins[(lengths > 0) & (lengths < n)].tolist(), ends[(lengths > 0) & (lengths < n)].tolist()):
        x = np.array([b - a], np.uint64)
        for k in range(a, b):
            x = x * _MULTIPLY + w[k]
        h[a] = mixed(x)[0]
    owner = np.repeat(np.arange(len(lengths)), several)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(several) - several, several) + begins[owner]
    s, stop = h[at], np.cumsum(several)
    for a, b in zip((stop - several).tolist(), stop.tolist()):
        s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[keep], minlength=len(lengths)), s[keep]


class Bands:
    """Size bands and their sketch shapes for a similarity of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.width = -math.log(num / den - 1e-3)
        self.shapes: dict[int, tuple[int, int, int]] = {}

    def band(self, size: int) -> int:
        return int(math.log(size) / self.width)

    def difference(self, sizes: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes add up to ``sizes``."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def shape(self, band: int) -> tuple[int, int, int]:
        """(blocks, spare blocks, crowded blocks that a document may have) of the sketches of a band."""
        if band not in self.shapes:
            largest = math.ceil(math.exp(self.width * (band + 1))) + 1
            d = self.difference(2 * largest)
            spare, room = (1 + (d + 1) // 8, 1 + (d + 1) // 16) if d else (0, 0)
            self.shapes[band] = d + 1 + spare + room, spare, room
        return self.shapes[band]

    def room(self, size: int) -> int:
        """Crowded blocks that leave a set of this size another agreeing block in both of its bands."""
        return min(self.shape(self.band(size) + i)[2] for i in (0, 1))

    def keys(self, sizes: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of (band, block, XOR), set numbers) for both bands of sets that lie end to end; the lowest bit of a
        hash tells the bands of a set apart."""
        out, owners = [], []
        sets = np.flatnonzero(sizes)
        for step in (0, 1):
            q = np.array([self.band(x) + step for x in sizes[sets].tolist()], np.int64)
            shape = np.array([self.shape(x) for x in q.tolist()], np.int64).reshape(-1, 3)
            own = np.repeat(np.arange(len(sets)), sizes[sets])
            block = ((s >> np.uint64(32)) * shape[own, 0].astype(np.uint64)) >> np.uint64(32)  # in order, as s is
            starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (own[1:] != own[:-1])]) if len(s) else np.empty(0, np.int64)
            values = np.bitwise_xor.reduceat(s, starts) if len(s) else s
            counts, own, block = np.diff(np.r_[starts, len(s)]), own[starts], block[starts]
            left_out = shape[:, 0] - np.bincount(own, minlength=len(sets))  # the empty blocks go first
            sparse, least = left_out <= shape[:, 1], np.zeros(len(sets), np.int64)
            for c in range(1, int(counts.max(initial=0)) + 1):
                fits = left_out + np.bincount(own[counts <= c], minlength=len(sets)) <= shape[:, 1]
                if not fits.any():
                    break
                least[fits] = c
            keep = counts > least[own]
            values, own, block = values[keep], own[keep], block[keep]
            for k in np.flatnonzero(~sparse):  # more empty blocks than may be left out: these are posted too
                empty = np.setdiff1d(np.arange(shape[k, 0], dtype=np.uint64), block[own == k])
                values, own, block = np.r_[values, np.zeros(len(empty), np.uint64)], np.r_[own, np.full(len(empty), k)], np.r_[block, empty]
            key = mixed(mixed(values) + ((q[own].astype(np.uint64) << np.uint64(40)) + block) * _MULTIPLY)
            out.append(key >> np.uint64(1) << np.uint64(1) | (q[own] & 1).astype(np.uint64))
            owners.append(sets[own])
        return np.concatenate(out), np.concatenate(owners)


MET = "key long, doc_id long, kind int, x long"


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["key", "doc_id", "kind", "x"])


class Posts:
    """The posts of some rows: keys that too many of them share become one row each, without a document."""

    def __init__(self, crowd: int):
        self.crowd, self.keys, self.ids, self.rooms, self.held = crowd, [], [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, rooms: np.ndarray) -> None:
        self.keys.append(keys)
        self.ids.append(ids)
        self.rooms.append(rooms)
        self.held += len(keys)

    def flush(self):
        if not self.held:
            return
        key, ids, room = (np.concatenate(x) for x in (self.keys, self.ids, self.rooms))
        self.keys, self.ids, self.rooms, self.held = [], [], [], 0
        order = np.argsort(key)
        key, ids, room = key[order], ids[order], room[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        counts = np.diff(np.r_[starts, len(key)])
        crowded = np.repeat(counts > self.crowd, counts)
        lone = ~crowded
        yield _batch(pa.array(key[lone].view(np.int64)), pa.array(ids[lone]), pa.array(np.full(lone.sum(), POST, np.int32)), pa.array(room[lone]))
        tokens = key[starts[counts > self.crowd]].view(np.int64)
        if len(tokens):
            yield _batch(pa.array(tokens), pa.nulls(len(tokens), pa.int64()), pa.array(np.full(len(tokens), POST, np.int32)), pa.array(np.zeros(len(tokens), np.int64)))
            yield _counted(key[crowded], ids[crowded], room[crowded])


def _tally(ids, band, room) -> list[np.ndarray]:
    """Distinct (id, band, room) and how often each occurs."""
    order = np.lexsort((room, band, ids))
    rows = [x[order] for x in (ids, band, room)]
    starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in rows])])
    return [x[starts] for x in rows] + [np.diff(np.r_[starts, len(order)])]


def _counted(key, ids, room) -> pa.RecordBatch:
    """Rows of documents with crowded keys: x holds their number above 2^32 and the room below; dealt out by document."""
    ids, band, room, n = _tally(ids, (key & np.uint64(1)).astype(np.int64), room)
    return _batch(pa.array(mixed(ids.view(np.uint64)).view(np.int64)), pa.array(ids), pa.array((CROWDED + band).astype(np.int32)), pa.array((n << 32) + room))


class Seen(dict):
    """(document, set) of the last rows, so that repeated rows are worked on once a task; forgets all when it gets large."""

    def again(self, i: int, s: np.ndarray) -> bool:
        key = (i, hashlib.blake2b(s, digest_size=16).digest())
        if key in self:
            return True
        if len(self) > _SEEN_KEPT:
            self.clear()
        self[key] = True
        return False


def _posts(n: int, num: int, den: int, crowd: int):
    def run(batches):
        words, bands, posts, seen = Words(), Bands(num, den), Posts(crowd), Seen()
        for b in batches:
            ids, reps = b.column(0), b.column(2).to_pylist()
            known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            post = np.array([r is None for r in reps]) & ids.is_valid().to_numpy(zero_copy_only=False)
            for first, sizes, s in shingle_sets(b.column(1), n, words):
                rows, ends = slice(first, first + len(sizes)), np.cumsum(sizes)
                fresh = post[rows] & (sizes > 0)
                for k in np.flatnonzero(fresh).tolist():
                    fresh[k] = not seen.again(int(known[first + k]), s[ends[k] - sizes[k] : ends[k]])
                own = np.where(fresh, sizes, 0)
                keys, of = bands.keys(own, s[np.repeat(fresh, sizes)])
                rooms = np.array([bands.room(x) if x else 0 for x in own.tolist()], np.int64)
                posts.add(keys, known[rows][of], rooms[of])
                yield _batch(pa.array(mixed(known[rows].view(np.uint64)).view(np.int64)), ids[rows], pa.array(np.full(len(sizes), SIZE, np.int32)), pa.array(sizes.astype(np.int64)))
                copies = [(i, r) for i, r, k in zip(known[rows].tolist(), reps[rows], sizes.tolist()) if r is not None and k]
                if copies:
                    i, r = np.array(copies, np.int64).T
                    yield _batch(pa.array(mixed(i.view(np.uint64)).view(np.int64)), pa.array(i), pa.array(np.full(len(i), COPY, np.int32)), pa.array(r))
                if posts.held > _POSTS_HELD:
                    yield from posts.flush()
        yield from posts.flush()

    return run


def _met(crowd: int):
    """Rows sorted by key -> (kind, a, b, c): pairs of documents that share a key of few, sizes and copies (c rows of
    each), and how many crowded keys (c) a document has besides its room (b). Holds one batch and the start of a key."""

    def out(kind, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), a if isinstance(a, pa.Array) else pa.array(a), pa.array(b), pa.array(c)], ["kind", "a", "b", "c"])

    def crowded(key, ids, room):
        ids, band, room, n = _tally(ids, key & 1, room)
        return pa.RecordBatch.from_arrays([pa.array((CROWDED + band).astype(np.int32)), pa.array(ids), pa.array(room), pa.array(n)], ["kind", "a", "b", "c"])

    def settle(key, ids, room, token, starts, counts):
        many = (counts > crowd) | np.logical_or.reduceat(token, starts)
        use = np.repeat(many, counts) & ~token
        if use.any():
            yield crowded(key[use], ids[use], room[use])
        for k in range(2, crowd + 1):
            at = starts[(counts == k) & ~many]
            if len(at):
                d = np.sort(ids[at[:, None] + np.arange(k)], axis=1)
                i, j = np.triu_indices(k, 1)
                a, b = d[:, i].ravel(), d[:, j].ravel()
                a, b = a[a < b], b[a < b]
                if len(a):
                    yield out(PAIR, a, b, np.ones(len(a), np.int64))

    def run(batches):
        held = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]
        open_key = None  # its key is known to be crowded
        for batch in batches:
            kind = batch.column(2).to_numpy(zero_copy_only=False)
            other = kind != POST
            if other.any():
                for k in np.unique(kind[other]):
                    mask = kind == k
                    ids, x = batch.column(1).filter(pa.array(mask)), batch.column(3).to_numpy(zero_copy_only=False)[mask]
                    if k in (SIZE, COPY):
                        yield out(int(k), ids, x, np.ones(len(x), np.int64))
                    else:
                        yield out(int(k), ids, x & 0xFFFFFFFF, x >> 32)
            ids = batch.column(1)
            mine = [batch.column(0).to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)]
            key, doc, room, token = (np.concatenate([h, m[~other]]) for h, m in zip(held, mine))
            if open_key is not None and len(key):
                same = key == open_key
                if (same & ~token).any():
                    yield crowded(key[same & ~token], doc[same & ~token], room[same & ~token])
                if not same[-1]:
                    open_key = None
                key, doc, room, token = (x[~same] for x in (key, doc, room, token))
            held = [x[:0] for x in (key, doc, room, token)]
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = np.diff(np.r_[starts, len(key)])
            if counts[-1] > crowd or token[starts[-1] :].any():
                open_key = key[-1]
            else:  # the last key may go on
                held = [x[starts[-1] :] for x in (key, doc, room, token)]
                key, doc, room, token = (x[: starts[-1]] for x in (key, doc, room, token))
                starts, counts = starts[:-1], counts[:-1]
            if len(starts):
                yield from settle(key, doc, room, token, starts, counts)
        if len(held[0]):
            yield from settle(*held, np.array([0]), np.array([len(held[0])]))

    return run


def parity(sizes: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Sketches of SKETCH bits, as longs, of sets that lie end to end: each shingle toggles one bit."""
    bit = (s >> np.uint64(20)).astype(np.int64) % SKETCH + np.repeat(np.arange(len(sizes)), sizes) * SKETCH
    bits = np.bincount(bit, minlength=len(sizes) * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(n: int):
    def run(batches):
        words, seen = Words(), Seen()
        for b in batches:
            for first, sizes, s in shingle_sets(b.column(1), n, words):
                ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                at = np.arange(len(sizes) + 1, dtype=np.int32) * (SKETCH // 64)
                ids = b.column(0)[first : first + len(sizes)]
                rows = pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at), pa.array(parity(sizes, s))), pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))], ["doc_id", "sketch", "s"])
                yield rows.filter(pa.array([n > 0 and not seen.again(i, s[a : a + n]) for i, a, n in zip(ids.to_pylist(), ends.tolist(), sizes.tolist())]))

    return run


def _difference(sizes: Column, num: int, den: int) -> Column:
    return F.floor(sizes * (den - num) / (den + num))


def _both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with n_a, n_b and the column of both sides."""
    left, right = (sets.select(F.col("doc_id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col(column).alias(f"x_{x}")) for x in "ab")
    return pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, written; sketches that differ in too many bits go first."""
    apart = F.aggregate(F.zip_with("x_a", "x_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = _both(pairs, sets, "sketch").filter(apart <= _difference(F.col("n_a") + F.col("n_b"), num, den)).select("a", "b").distinct()
    near = materialize(near, "near")
    ids = materialize(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near_ids")
    sets = sets.join(small(ids), F.col("doc_id") == F.col("id"), "left_semi")
    both = F.size(F.array_intersect("x_a", "x_b"))
    linked = materialize(_both(near, sets, "s").filter(den * both >= num * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").distinct(), "links")
    discard(near, ids)
    return linked


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(token, doc_id, n, i, df): the shared tokens among the first of each set, rarest first; i tokens stand before,
    those of one document only (which need no row) included."""
    t = sets.select("doc_id", F.xxhash64("s").alias("set"), "n", F.explode("s").alias("token"))
    df = t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumnRenamed("token", "d_token")
    t = t.join(df.filter("df > 1"), F.col("token") == F.col("d_token")).drop("d_token")
    own = W.partitionBy("doc_id", "set")
    t = t.withColumn("r", F.dense_rank().over(own.orderBy("df", "token")))  # rows of one document may repeat
    t = t.withColumn("i", F.col("n") - F.max("r").over(own) + F.col("r") - 1)
    return t.filter(F.col("i") <= F.col("n") - F.ceil(F.col("n") * num / den)).select("token", "doc_id", "n", "i", "df").distinct()


def _fits(num: int, den: int) -> Column:
    """What holds at the first common token of two linked sets: the i + i2 tokens before are in one set only, and no
    more than the rest of the shorter remainder can be common."""
    sizes = F.col("n") + F.col("n2")
    apart = F.greatest(F.col("i") + F.col("i2"), sizes - 2 * F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2")))
    return apart <= _difference(sizes, num, den)


def _salt() -> Column:
    """Which of the SALTS parts of a frequent token a row belongs to; 0 for other tokens."""
    return F.when(F.col("df") > HOT_TOKEN, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")


def _salts(df: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.when(df > HOT_TOKEN, SALTS - 1).otherwise(0)))


def _parts(df: Column) -> Column:
    """Parts of each side of a token with df rows: one for each HOT_TOKEN of them, SIDE at most."""
    return F.least(F.lit(SIDE), F.ceil(df / HOT_TOKEN)).cast("int")


def _dealt(part: str, parts: Column, other: str) -> list[Column]:
    """The part of a row among those of its side, by its document, and one row for each part of the other side."""
    return [F.pmod(F.xxhash64("doc_id"), parts).alias(part), F.explode(F.sequence(F.lit(0), parts - 1)).alias(other)]


def _across(p: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different groups g that may be linked, from prefix rows p (token, doc_id, n, i, df, g).

    Rows that no early row of another group can fit go first, by the least i and the largest n of the early rows of their
    token and band. What is left of a frequent token meets in a square of parts, as each side is dealt into some.
    """
    width = -math.log(num / den - 1e-3)
    early = F.col("i") * (num + den) <= F.col("n") * (den - num)
    p = p.withColumn("band", F.floor(F.log("n") / width).cast("int")).withColumn("early", early)
    mine = p.filter("early").withColumn("at", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    heads = mine.groupBy(F.col("token").alias("t3"), F.col("at").alias("at3")).agg(F.min("i").alias("i3"), F.max("n").alias("n3"), F.min("g").alias("g3"), F.max("g").alias("g4"), F.max("df").alias("most"))
    heads = heads.select("t3", "at3", "i3", "n3", "g3", "g4", _salts(F.col("most")).alias("s3"))
    q = p.withColumn("salt", _salt()).join(heads, (F.col("token") == F.col("t3")) & (F.col("band") == F.col("at3")) & (F.col("salt") == F.col("s3")))
    q = q.filter(((F.col("g") != F.col("g3")) | (F.col("g") != F.col("g4"))) & (F.col("i") + F.col("i3") <= _difference(F.col("n") + F.col("n3"), num, den)))
    parts = _parts(F.col("df"))
    mine = mine.select("token", "doc_id", "n", "i", "g", "at", *_dealt("x", parts, "y"))
    q = q.select(F.col("token").alias("t2"), F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("i").alias("i2"), F.col("g").alias("g2"), F.col("band").alias("b2"), F.col("early").alias("e2"), *_dealt("y2", parts, "x2"))
    j = mine.join(q, (F.col("token") == F.col("t2")) & (F.col("at") == F.col("b2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
    j = j.filter((F.col("g") != F.col("g2")) & (~F.col("e2") | (F.col("g") < F.col("g2"))) & _fits(num, den))
    return j.select(F.least("doc_id", "d2").alias("a"), F.greatest("doc_id", "d2").alias("b")).distinct()


def links(docs: DataFrame, n: int, num: int, den: int, hot_copies: int = HOT_COPIES, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n) of every row, and edges (a, b) that connect exactly what the links connect."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = [F.xxhash64("text"), F.crc32(F.col("text").cast("binary"))]
    hot = d.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", key[0].alias("h1"), key[1].alias("h2")).groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("c"))
    hot = materialize(hot.filter(F.col("c") > hot_copies).drop("c"), "hot")
    d = d.join(small(hot), (key[0] == F.col("h1")) & (key[1] == F.col("h2")), "left")
    d = d.select("doc_id", "text", F.when(F.col("keeper") != F.col("doc_id"), F.col("keeper")).alias("rep"))
    met = d.mapInArrow(_posts(n, num, den, crowd), MET).repartition("key").sortWithinPartitions("key")
    met = met.mapInArrow(_met(crowd), "kind int, a long, b long, c long").groupBy("kind", "a", "b").agg(F.sum("c").alias("c"))
    met = materialize(met, "met")
    sizes = met.filter(F.col("kind") == SIZE).select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.explode(F.sequence(F.lit(1).cast("long"), "c"))).drop("col")
    copies = met.filter(F.col("kind") == COPY).select("a", "b")
    pairs = met.filter(F.col("kind") == PAIR).select("a", "b")
    many = materialize(met.filter(F.col("kind").isin(CROWDED, CROWDED + 1) & (F.col("c") > F.col("b"))).select(F.col("a").alias("id")).distinct(), "crowded")
    tried = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(many).distinct(), "tried")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(tried), F.col("doc_id") == F.col("id"), "left_semi")
    sets = materialize(texts.mapInArrow(_sets(n), "doc_id long, sketch array<long>, s array<long>"), "sets").withColumn("n", F.size("s"))
    if many.isEmpty():
        linked = _verified(pairs, sets, num, den)
        discard(sets, tried)
        return sizes, linked.unionByName(copies)
    crowded = sets.join(small(many), F.col("doc_id") == F.col("id"), "left_semi")
    prefix = materialize(_prefixes(crowded, num, den), "prefixes")
    centre = prefix.groupBy("token").agg(F.min(F.struct("i", "doc_id", "n")).alias("m"), F.max("df").alias("most"))
    centre = centre.select(F.col("token").alias("t2"), F.col("m.i").alias("i2"), F.col("m.doc_id").alias("d2"), F.col("m.n").alias("n2"), _salts(F.col("most")).alias("s2"))
    star = prefix.withColumn("salt", _salt()).join(centre, (F.col("token") == F.col("t2")) & (F.col("salt") == F.col("s2"))).filter((F.col("doc_id") != F.col("d2")) & _fits(num, den))
    star = star.select(F.least("doc_id", "d2").alias("a"), F.greatest("doc_id", "d2").alias("b")).distinct()
    first = _verified(pairs.unionByName(star).distinct(), sets, num, den)
    group = components(first)
    p = prefix.join(group, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", "n", "i", "df", F.coalesce("component", "doc_id").alias("g"))
    p = grouped = materialize(p, "grouped")
    split = p.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2"), F.max("df").alias("most")).filter("g1 <> g2").select(F.col("token").alias("t3"), _salts(F.col("most")).alias("s3"))
    p = p.withColumn("salt", _salt()).join(split, (F.col("token") == F.col("t3")) & (F.col("salt") == F.col("s3")), "left_semi").drop("salt")
    discard(prefix)
    second = _verified(_across(p, num, den), sets, num, den)
    discard(sets, grouped, tried, many, group)
    return sizes, first.unionByName(second).unionByName(copies)


def near_duplicates(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    sizes, edges = links(docs, n, num, den)
    c = components(edges)
    j = sizes.join(c, F.col("doc_id") == F.col("node"), "left")
    return j.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The documents without all but the smallest doc_id of each group; one row of repeated ids; null ids stay.

    The row of a repeated id is one with a text where there is any, and otherwise picked by a hash of its columns.
    """
    gone = components(links(docs, n, num, den)[1]).filter("node <> component").select(F.col("node").alias("__gone"))
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    again = docs.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("__c")).filter("__c > 1")
    again = materialize(again.select("__again"), "again")
    if again.isEmpty():
        return kept
    again = small(again)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.min_by(row, F.struct(F.col("text").isNull(), F.md5(F.to_json(row))))
    one = kept.join(again, F.col("doc_id") == F.col("__again"), "left_semi").groupBy(F.col("doc_id").alias("__id")).agg(first.alias("__row"))
    return kept.join(again, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(one.select("__row.*"))


def op10_parity_sketch_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
