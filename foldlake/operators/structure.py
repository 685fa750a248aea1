"""Operators on secondary structures: DataFrames with an id and a dot-bracket column, rows for positions and pairs.

A structure lies in one row, so each operator is one pass over Arrow batches without a shuffle: the arrays of a
structure (levels, partners, loops) come from running sums and one sort by level. Positions are 1-based.

Defined results: a null or empty structure has no positions and no pairs; null and repeated ids are rows like others;
brackets without a partner are read as unpaired; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROWS_HELD = 200_000


def letters(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)


def matched(opens: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The brackets that have a partner, out of positions that open and that close."""
    s = np.cumsum(opens.astype(np.int64) - closes)
    lowest = np.minimum.accumulate(np.r_[0, s])[:-1]
    after = np.minimum.accumulate(np.r_[s, np.iinfo(np.int64).max][::-1])[::-1][1:]
    return opens & (after < s), closes & (lowest <= s)


class Structure:
    """Arrays over the positions of one dot-bracket string."""

    def __init__(self, text: str | None, brackets: str = "()"):
        c = letters(text)
        self.n = len(c)
        self.opens, self.closes = matched(c == ord(brackets[0]), c == ord(brackets[1]))
        self.height = np.cumsum(self.opens.astype(np.int64) - self.closes)
        self.level = self.height + self.closes
        at = np.flatnonzero(self.opens | self.closes)
        at = at[np.argsort(self.level[at], kind="stable")]  # of each level: open, close, open, close ...
        self.partner = np.zeros(self.n, np.int64)
        self.partner[at[0::2]], self.partner[at[1::2]] = at[1::2] + 1, at[0::2] + 1

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.opens)
        return i + 1, self.partner[i]

    def opener(self, slot: np.ndarray) -> np.ndarray:
        """For each position, the last position at or before it that opens level ``slot`` (0-based; -1 where slot is 0)."""
        at = np.arange(self.n)
        keys = np.sort(self.level[self.opens] * (self.n + 1) + at[self.opens])
        k = np.searchsorted(keys, slot * (self.n + 1) + at, side="right") - 1
        return np.where(slot > 0, keys[np.maximum(k, 0)] % (self.n + 1) if len(keys) else -1, -1)

    def loop(self) -> np.ndarray:
        """Ordinal of the opening bracket of the pair that a position closes or lies in; 0 outside."""
        return np.where(self.level > 0, np.cumsum(self.opens)[self.opener(self.level)] if self.n else 0, 0)

    def around(self) -> np.ndarray:
        """For each pair, in the order of pairs(): the opening position (1-based) of the pair around it, or 0."""
        return self.opener(self.level - 1)[self.opens] + 1

    def helices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and lengths of maximal stacks."""
        i, j = self.pairs()
        first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] - 1)]) if len(i) else np.empty(0, np.int64)
        return i[first], j[first], np.diff(np.r_[first, len(i)])


def bracketed(opening: str, closing: str) -> Callable[[Column | str], Column]:
    """A column function: the structure that pairs the letters ``opening`` and ``closing`` of a sequence as brackets."""
    @F.pandas_udf("string")
    def run(seqs: pd.Series) -> pd.Series:
        out = []
        for t in seqs:
            c = letters(t)
            opens, closes = matched(c == ord(opening), c == ord(closing))
            out.append(np.where(opens, 40, np.where(closes, 41, 46)).astype(np.uint8).tobytes().decode())
        return pd.Series(out)

    return run


def by_row(df: DataFrame, key: str, columns: list[str], out: str, run: Callable) -> DataFrame:
    """key and the columns of ``out`` for each element of the arrays that run(values of columns) gives for a row."""
    kind = dict(df.dtypes)[key]

    def rows(batches):
        for b in batches:
            ids, held, size = [], [], 0
            for k in range(len(b)):
                arrays = run(*(b.column(c + 1)[k].as_py() for c in range(len(columns))))
                n = len(arrays[0])
                if n:
                    ids.append((k, n))
                    held.append(arrays)
                    size += n
                if held and (size > _ROWS_HELD or k + 1 == len(b)):
                    take = pa.array(np.repeat([i for i, _ in ids], [m for _, m in ids]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), *[pa.array(np.concatenate(x)) for x in zip(*held)]], names)
                    ids, held, size = [], [], 0

    names = [key, *[c.split()[0] for c in out.split(", ")]]
    return df.select(key, *columns).mapInArrow(rows, f"`{key}` {kind}, {out}")


def pair_table(df: DataFrame, key: str = "doc_id", structure: str = "structure") -> DataFrame:
    """key, i, partner for every position; partner 0 where unpaired."""
    def run(text):
        s = Structure(text)
        return np.arange(1, s.n + 1, dtype=np.int32), s.partner.astype(np.int32)

    return by_row(df, key, [structure], "i int, partner int", run)


def pairs(df: DataFrame, key: str = "doc_id", structure: str = "structure") -> DataFrame:
    """key, i, j with i < j."""
    return by_row(df, key, [structure], "i int, j int", lambda text: tuple(x.astype(np.int32) for x in Structure(text).pairs()))


def knotted_pairs(df: DataFrame, key: str = "doc_id", structure: str = "structure", brackets: tuple[str, ...] = ("()", "[]")) -> DataFrame:
    """key, i, j, layer of the pairs of each kind of bracket; layers may cross."""
    def run(text):
        out = [(*Structure(text, b).pairs(), k) for k, b in enumerate(brackets)]
        return *(np.concatenate([o[x] for o in out]).astype(np.int32) for x in (0, 1)), np.concatenate([np.full(len(o[0]), o[2], np.int32) for o in out])

    return by_row(df, key, [structure], "i int, j int, layer int", run)


def loop_index(df: DataFrame, key: str = "doc_id", structure: str = "structure") -> DataFrame:
    """key, i, loop: 0 outside, else the ordinal of the opening bracket of the pair that i closes with or lies in."""
    def run(text):
        s = Structure(text)
        return np.arange(1, s.n + 1, dtype=np.int32), s.loop()

    return by_row(df, key, [structure], "i int, loop long", run)


def mountain_heights(df: DataFrame, key: str = "doc_id", structure: str = "structure") -> DataFrame:
    """key, i, height: pairs open after i."""
    def run(text):
        s = Structure(text)
        return np.arange(1, s.n + 1, dtype=np.int32), s.height.astype(np.int32)

    return by_row(df, key, [structure], "i int, height int", run)


def helices(df: DataFrame, key: str = "doc_id", structure: str = "structure") -> DataFrame:
    """key, start, end, length of maximal stacks: pairs (i, j), (i + 1, j - 1), ..."""
    def run(text):
        i, j, n = Structure(text).helices()
        return i.astype(np.int32), j.astype(np.int32), n

    return by_row(df, key, [structure], "start int, end int, length long", run)


def merged_helices(df: DataFrame, most: int = 1, key: str = "doc_id", structure: str = "structure") -> DataFrame:
    """key, start, end, length (pairs), up5, up3: stacks joined across interior loops of at most ``most`` unpaired bases a side."""
    def run(text):
        s = Structure(text)
        i, j, n = s.helices()
        if not len(i):
            return (i,) * 5
        left, right = i[1:] - (i[:-1] + n[:-1]), (j[:-1] - n[:-1]) - j[1:]
        joins = (left >= 0) & (right >= 0) & (left <= most) & (right <= most) & (s.around()[np.searchsorted(s.pairs()[0], i[1:])] == i[:-1] + n[:-1] - 1)
        first = np.flatnonzero(np.r_[True, ~joins])
        up = [np.add.reduceat(np.r_[0, np.where(joins, x, 0)], first) for x in (left, right)]
        return i[first], j[first], np.add.reduceat(n, first), *up

    return by_row(df, key, [structure], "start long, end long, length long, up5 long, up3 long", run)


def pair_distance(df: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """key, distance: pairs in exactly one of the two structures of a row."""
    def run(x, y):
        p, q = (set(zip(*(v.tolist() for v in Structure(t).pairs()))) for t in (x, y))
        return (np.array([len(p ^ q)], np.int64),)

    return by_row(df, key, [a, b], "distance long", run)


def mountain_distance(df: DataFrame, a: str, b: str, key: str = "doc_id") -> DataFrame:
    """key, distance: sum over the positions of the first structure of the absolute difference of heights."""
    def run(x, y):
        p, q = Structure(x).height, Structure(y).height[: len(x or "")]
        return (np.array([np.abs(p - np.r_[q, np.zeros(len(p) - len(q), np.int64)]).sum()], np.int64),)

    return by_row(df, key, [a, b], "distance long", run)


def connect_table(df: DataFrame, key: str = "doc_id", seq: str = "seq", structure: str = "structure") -> DataFrame:
    """Rows of a connect table: key, i, base, before, after (0 at the end), partner."""
    def run(text, bases):
        s = Structure(text)
        i = np.arange(1, s.n + 1, dtype=np.int32)
        return i, np.array(list((bases or "").ljust(s.n)[: s.n]), object), i - 1, np.where(i < s.n, i + 1, 0).astype(np.int32), s.partner.astype(np.int32)

    return by_row(df, key, [structure, seq], "i int, base string, before int, after int, partner int", run)


#: What a position is called in an element string.
EXTERIOR, HAIRPIN, INTERIOR, MULTI = "ehim"


def element_text(text: str | None) -> str:
    """Letters e, h, i, m for unpaired positions of exterior, hairpin, interior and multiloops; in upper case for the pairs
    that close them."""
    s = Structure(text)
    if not s.n:
        return ""
    inner = np.bincount(s.around(), minlength=s.n + 1)  # stems directly inside each opening position
    own = s.opener(s.level) + 1
    kind = np.select([own == 0, inner[own] == 0, inner[own] == 1], [ord(EXTERIOR), ord(HAIRPIN), ord(INTERIOR)], ord(MULTI))
    return np.where(s.partner > 0, kind - 32, kind).astype(np.uint8).tobytes().decode()


def letter_text(text: str | None) -> str:
    """A letter for the pairs of each stack, in the order of their starts (A to Z, a to z, then again), '.' for others."""
    s = Structure(text)
    out = np.full(s.n, ord("."), np.uint8)
    names = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)
    for k, (i, j, n) in enumerate(zip(*s.helices())):
        out[i - 1 : i - 1 + n] = out[j - n : j] = names[k % len(names)]
    return out.tobytes().decode()


def tree_text(text: str | None) -> str:
    """Full tree in brackets: U for an unpaired position, P for a pair, R for the root around all."""
    s = Structure(text)
    return "(" + "".join(np.where(s.opens, "(", np.where(s.closes, "P)", "(U)")).tolist()) + "R)"


def homeomorphic_text(text: str | None) -> str:
    """Homeomorphic tree: runs of unpaired positions are (Un), stacks of n pairs one node Pn, the root R."""
    s, out, run = Structure(text), [], 0
    i, j, n = s.helices()
    at = {int(a) + int(m) - 1: int(m) for a, m in zip(i, n)}  # innermost opening position of a stack -> its pairs
    shut = {int(b): int(m) for b, m in zip(j, n)}
    for k in range(1, s.n + 2):
        if k <= s.n and not s.partner[k - 1]:
            run += 1
            continue
        if run:
            out.append(f"(U{run})")
            run = 0
        if k in at:
            out.append("(")
        if k in shut:
            out.append(f"P{shut[k]})")
    return "(" + "".join(out) + "R1)"


def coarse_text(text: str | None) -> str:
    """Coarse tree of loops: H, B, I and M for hairpins, bulges, interior and multiloops, nested by stems, R the root."""
    s, kids = Structure(text), {}
    i, j, n = s.helices()
    outer = s.around()[np.searchsorted(s.pairs()[0], i)] if len(i) else i
    end = {int(a + m - 1): int(b - m + 1) for a, b, m in zip(i, j, n)}
    for a, m, o in zip(i.tolist(), n.tolist(), outer.tolist()):
        kids.setdefault(o, []).append((a, a + m - 1))
    out, todo = [], [("close", "R"), *[("open", b) for _, b in reversed(kids.get(0, []))]]
    while todo:
        what, x = todo.pop()
        if what == "close":
            out.append(f"{x})")
            continue
        own = kids.get(x, [])
        if len(own) == 1:
            p = own[0][0]
            q = int(s.partner[p - 1])
            name = "B" if p == x + 1 or q == end[x] - 1 else "I"
        else:
            name = "M" if own else "H"
        out.append("(")
        todo += [("close", name), *[("open", b) for _, b in reversed(own)]]
    return "(" + "".join(out)


def per_text(name: Callable[[str | None], str]) -> Callable[[Column | str], Column]:
    """A column function out of a function of one structure text."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([name(t) for t in texts])

    return run


def _runs(batches):
    """(key, bytes of i and j by turns) of pair rows of one key that come one after another."""
    for b in batches:
        if b.num_rows:
            ends = pc.run_end_encode(b.column(0), run_end_type=pa.int32()).run_ends.to_numpy()
            ij = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in (1, 2)], 1).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends * 8].astype(np.int32)), pa.py_buffer(ij)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.r_[0, ends[:-1]])), held], ["k", "run"])


def from_pairs(p: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, structure from pair rows and (key, n). Keys are distinct. Pair rows are packed before they are sent, so no pair is a
    row of a shuffle or an object of its own."""
    runs = p.select(key, "i", "j").mapInArrow(_runs, f"k {dict(p.dtypes)[key]}, run binary")
    marks = runs.groupBy("k").agg(F.collect_list("run").alias("e"))
    j = lengths.join(marks, F.col(key) == F.col("k"), "left")

    @F.pandas_udf("string")
    def text(n: pd.Series, e: pd.Series) -> pd.Series:
        out = []
        for size, own in zip(n, e):
            t = np.full(int(size), 46, np.uint8)
            for x in own if own is not None else ():
                ij = np.frombuffer(x, np.int32)
                t[ij[0::2] - 1], t[ij[1::2] - 1] = 40, 41
            out.append(t.tobytes().decode())
        return pd.Series(out, dtype=object)

    return j.select(key, text("n", "e").alias("structure"))


def pack(structure: Column) -> Column:
    """Hex text of five positions a byte: '(' 0, '.' 1, ')' 2 in base three, plus one."""
    digits = F.rpad(F.translate(structure, "(.)", "012"), F.ceil(F.length(structure) / 5).cast("int") * 5, F.lit("0"))
    parts = F.regexp_extract_all(digits, F.lit("(.{5})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.hex(F.conv(x, 3, 10).cast("int") + 1), 2, "0")), "")


def unpack(packed: Column, n: Column) -> Column:
    """The first n positions of a packed structure."""
    parts = F.regexp_extract_all(packed, F.lit("(.{2})"), F.lit(1))
    digits = F.array_join(F.transform(parts, lambda x: F.lpad(F.conv((F.conv(x, 16, 10).cast("int") - 1).cast("string"), 10, 3), 5, "0")), "")
    return F.translate(F.substring(digits, F.lit(1), n), "012", "(.)")


def ensemble(p: DataFrame, key: str = "id") -> DataFrame:
    """key, diversity, centroid_pairs, centroid_distance from pair rows with probability p."""
    in_it = F.col("p") > 0.5
    return p.groupBy(key).agg(
        (2 * F.sum(F.col("p") * (1 - F.col("p")))).alias("diversity"),
        F.sum(in_it.cast("int")).alias("centroid_pairs"),
        F.sum(F.when(in_it, 1 - F.col("p")).otherwise(F.col("p"))).alias("centroid_distance"),
    )


def pair_list(df: DataFrame, p: float = 1.0, key: str = "doc_id", structure: str = "structure") -> DataFrame:
    """key, i, j, p of every pair, all with the probability p: the list that pair probabilities come in."""
    return pairs(df, key, structure).withColumn("p", F.lit(float(p)))


def joined_lists(one: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of both pair lists; a list may have further columns, which are null for the other's rows."""
    return one.unionByName(other, allowMissingColumns=True)
