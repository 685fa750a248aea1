"""Hidden Markov language model over whole texts.

Tokens are lower-cased words and one end per text. The ``head`` most frequent training tokens are classes of their
own; every other word belongs to one of ``tails`` classes by a hash of its last bytes, which hold one more place each
for words never seen. A hidden state emits a class, a class emits its words by their smoothed training counts, so the
probabilities of all known words and unseen places add up to one. Baum-Welch runs over every whole training text (long
ones from stored states): tasks return expected counts per class, Spark adds them up, and only tables of bounded size (classes x states) reach the
driver. Scores come from the scaled forward recursion and are exact for the model.

Word counts never leave Spark: texts are encoded once as class numbers plus the words outside the head; those words
are joined with the count table and only sums per text come back.

Defined results: a null text is empty (its one token is the end); a null doc_id counts as the empty text in the
training split; repeated rows are separate texts; without any training text all tokens are unknown and the model is the
base; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_words, materialize, table

STATES, ROUNDS, HEAD, TAILS, SUFFIX = 8, 3, 20_000, 2048, 3
END = b""
_COUNTS_HELD = 400_000
LONG = 1 << 16  # longer texts go through the recursions in pieces of so many tokens, which hand their states on
_CELLS_HELD = 600_000
PRIOR = 50.0  # pseudo-count of the overall class shares in each state's emissions


def _counted(batches):
    """(word, n) sums of the batches; tables of bounded size."""
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for t in b.column(0):
            held.update(byte_words(t.as_py()))
            held[END] += 1
            if len(held) > _COUNTS_HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) over all tokens of the texts; the empty word is the end."""
    return texts.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tail_class(word: bytes, head: int, tails: int) -> int:
    return head + zlib.crc32(word[-SUFFIX:]) % tails


def tail_class_sql(word: Column, head: int, tails: int) -> Column:
    last = F.when(F.length(word) > SUFFIX, F.substring(word, -SUFFIX, SUFFIX)).otherwise(word)
    return (F.lit(head) + F.crc32(last) % tails).cast("int")


def _encoded(head: dict[bytes, int], n_head: int, tails: int):
    def run(batches):
        for b in batches:
            ends, flat, tail_ends, tail_words = [0], [], [0], []
            for t in b.column(0):
                words = byte_words(t.as_py())
                words.append(END)
                own = [head.get(w, -1) for w in words]
                for i, c in enumerate(own):
                    if c < 0:
                        own[i] = tail_class(words[i], n_head, tails)
                        tail_words.append(words[i])
                flat.append(np.array(own, np.int32))
                ends.append(ends[-1] + len(own))
                tail_ends.append(len(tail_words))
            classes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)) if flat else pa.array([], pa.int32()))
            tail = pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), pa.array(tail_words, pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), classes, tail], ["doc_id", "held_out", "classes", "tail"])

    return run


def blocks(column: pa.ListArray, most: int = _CELLS_HELD):
    """(row numbers, padded matrix positions x rows, lengths) of class lists of like lengths, longest first; lists
    longer than LONG come alone."""
    ends, values = np.asarray(column.offsets), np.asarray(column.values)
    lengths, begins = np.diff(ends), ends[:-1]
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        longest = int(lengths[order[at]])
        rows = order[at : at + (1 if longest > LONG else max(1, most // max(1, longest)))]
        t = np.arange(longest)[:, None]
        x = values[np.minimum(begins[rows] + t, len(values) - 1)]
        x[t >= lengths[rows]] = 0
        yield rows, x, lengths[rows]
        at += len(rows)


def forward(x: np.ndarray, lengths: np.ndarray, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Scaled forward probabilities, scales (1 past the end) and natural log likelihoods; first: rows x states."""
    e = emit[x]
    alpha, scale = np.zeros_like(e), np.ones(x.shape, e.dtype)
    live = np.searchsorted(-lengths, -np.arange(len(x)), side="left")  # rows longer than t come first
    ones = np.ones(e.shape[2], e.dtype)
    for t in range(len(x)):
        n = live[t]
        a = first[:n] * e[0, :n] if t == 0 else (alpha[t - 1, :n] @ move) * e[t, :n]
        s = scale[t, :n] = a @ ones
        np.divide(a, s[:, None], out=alpha[t, :n])
    return e, alpha, scale, live, np.log(scale, dtype=np.float64).sum(0)


def likelihood(x: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log likelihoods; the state probabilities of a long text are handed on from piece to piece."""
    first, total = np.broadcast_to(start, (len(lengths), len(start))), 0.0
    for t in range(0, max(1, len(x)), LONG):
        _, alpha, _, _, own = forward(x[t : t + LONG], np.clip(lengths - t, 0, LONG), first, move, emit)
        total = total + own
        if t + LONG < len(x):
            first = alpha[-1] @ move
    return total


def expected(x, lengths, start, move, emit):
    """Baum-Welch counts of one block of whole texts: first states, moves, (classes, and their emissions by state)."""
    if len(x) <= LONG:
        first, moves, gamma, _ = _counts(x, lengths, np.broadcast_to(start, (len(lengths), len(start))).astype(emit.dtype), move, emit, None)
        return first, moves, *_by_class(x, lengths, gamma)
    firsts, lasts = [start[None].astype(emit.dtype)], []  # one long text: its pieces begin from stored states
    for t in range(0, len(x), LONG):
        alpha = forward(x[t : t + LONG], np.minimum(lengths - t, LONG), firsts[-1], move, emit)[1]
        lasts.append(alpha[-1])
        firsts.append(alpha[-1] @ move)
    moves, after, out = np.zeros((len(start), len(start))), None, []
    for k in reversed(range(len(lasts))):
        piece = x[k * LONG : (k + 1) * LONG]
        n = np.array([len(piece)])
        first, own, gamma, ahead = _counts(piece, n, firsts[k], move, emit, after)
        moves += own
        if k:
            moves += move * (lasts[k - 1].T @ ahead)
        after = ahead @ move.T
        out.append(_by_class(piece, n, gamma))
    ids, inverse = np.unique(np.concatenate([i for i, _ in out]), return_inverse=True)
    emissions = np.zeros((len(ids), len(start)))
    np.add.at(emissions, inverse, np.concatenate([e for _, e in out]))
    return first, moves, ids, emissions


def _counts(x, lengths, first, move, emit, after):
    """(first states, moves, state probabilities, what the first position passes back); after: what follows the last."""
    k = len(move)
    e, alpha, scale, live, _ = forward(x, lengths, first, move, emit)
    beta, ahead, back = np.ones_like(e), np.zeros_like(e), np.ascontiguousarray(move.T)
    if after is not None:
        beta[-1] = after
    e /= scale[:, :, None]
    for t in range(len(x) - 2, -1, -1):
        n = live[t + 1]
        np.multiply(e[t + 1, :n], beta[t + 1, :n], out=ahead[t + 1, :n])
        np.matmul(ahead[t + 1, :n], back, out=beta[t, :n])
    moves = move * (alpha[:-1].reshape(-1, k).T @ ahead[1:].reshape(-1, k))
    gamma = alpha * beta
    return gamma[0].sum(0), moves, gamma, e[0] * beta[0]


def _by_class(x, lengths, gamma) -> tuple[np.ndarray, np.ndarray]:
    used = (np.arange(len(x))[:, None] < lengths).ravel()
    rows = gamma.reshape(-1, gamma.shape[2])[used]
    ids, inverse = np.unique(x.ravel()[used], return_inverse=True)
    return ids, np.stack([np.bincount(inverse, weights=rows[:, s], minlength=len(ids)) for s in range(rows.shape[1])], 1)


def _expectations(start, move, emit):
    k = len(start)
    names = ["id", *[f"s{i}" for i in range(k)]]

    def run(batches):
        first, moves, total = np.zeros(k), np.zeros((k, k)), np.zeros(emit.shape)
        for b in batches:
            for _, x, lengths in blocks(b.column(0)):
                f, m, ids, e = expected(x, lengths, start, move, emit)
                first, moves = first + f, moves + m
                total[ids] += e
        used = np.flatnonzero(total.any(1))
        ids = np.r_[used, -1, -2 - np.arange(k)].astype(np.int64)
        rows = np.vstack([total[used], first, moves])
        yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(np.ascontiguousarray(rows[:, i])) for i in range(k)]], names)

    return run


def train(classes: DataFrame, shares: np.ndarray, states: int = STATES, rounds: int = ROUNDS, seed: int = 7):
    """start, move, emit of a model after ``rounds`` of Baum-Welch over all rows of classes (array<int>)."""
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * np.exp(rng.normal(0, 1, (len(shares), states)))
    emit, start, move = emit / emit.sum(0), np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    for _ in range(rounds):
        sums = classes.mapInArrow(_expectations(*(a.astype(np.float32) for a in (start, move, emit))), "id long, " + ", ".join(f"s{i} double" for i in range(states)))
        got = sums.groupBy("id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(states)]).toArrow()  # classes + states + 1 rows at most
        ids, v = np.asarray(got["id"]), np.stack([np.asarray(got[f"s{i}"]) for i in range(states)], 1)
        counts = np.zeros_like(emit)
        counts[ids[ids >= 0]] = v[ids >= 0]
        row = {int(i): v[k] for k, i in enumerate(ids) if i < 0}
        start = (row[-1] + 0.1) / (row[-1] + 0.1).sum()
        move = np.stack([row[-2 - s] for s in range(states)]) + 0.1
        move = move / move.sum(1, keepdims=True)
        emit = (counts + PRIOR * shares[:, None]) / (counts.sum(0) + PRIOR)
    return start, move, emit


def _scored(start, move, emit, n_head, log_mass):
    known_head = log_mass[:n_head]

    def run(batches):
        for b in batches:
            c = b.column(1)
            out = np.zeros((len(c), 4))
            for rows, x, lengths in blocks(c):
                ll = likelihood(x, lengths, start, move, emit)
                used = np.arange(len(x))[:, None] < lengths
                is_head = used & (x < n_head)
                mass = np.where(used, log_mass[x], 0)
                out[rows, 0] = ll / math.log(10)
                out[rows, 1] = is_head.sum(0)
                out[rows, 2] = np.where(is_head, mass, 0).sum(0)
                out[rows, 3] = np.where(used & ~is_head, mass, 0).sum(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(np.asarray(c.offsets)).astype(np.int64)), *[pa.array(np.ascontiguousarray(out[:, i])) for i in range(4)]], ["row", "n_tokens", "log_classes", "n_head", "log_head", "log_tail_mass"])

    return run


def score(docs: DataFrame, training: Column, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, tails: int = TAILS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. training: true for rows to learn from."""
    spark = docs.sparkSession
    d = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), (~training).alias("held_out"))
    counts = materialize(word_counts(d.filter(~F.col("held_out"))), "counts")
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    top = counts.orderBy(F.desc("n"), "word").limit(head).collect()  # ``head`` rows at most
    n_head = len(top)
    index = {bytes(r["word"]): i for i, r in enumerate(top)}
    mass = np.ones(n_head + tails)
    mass[:n_head] = [r["n"] + 1 for r in top]
    heads = F.broadcast(spark.createDataFrame([(bytes(r["word"]),) for r in top], T.StructType([T.StructField("word", T.BinaryType())])))  # ``head`` rows at most
    rare = counts.join(heads, "word", "left_anti")
    for r in rare.groupBy(tail_class_sql(F.col("word"), n_head, tails).alias("c")).agg(F.sum(F.col("n") + 1).alias("m")).collect():  # ``tails`` rows at most
        mass[r["c"]] += r["m"]
    encoded = d.mapInArrow(_encoded(index, n_head, tails), "doc_id long, held_out boolean, classes array<int>, tail array<binary>")
    encoded = materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    if total:
        start, move, emit = train(encoded.filter(~F.col("held_out")).select("classes"), mass / mass.sum(), states, rounds)
    else:
        start, move, emit = np.ones(1), np.ones((1, 1)), np.ones((len(mass), 1))
    found = encoded.select("row", F.explode("tail").alias("word"))
    c = rare.select(F.col("word").alias("w"), "n")
    found = found.join(c, F.col("word") == F.col("w")).groupBy("row").agg(F.count(F.lit(1)).alias("n_tail"), F.sum(F.log10(F.col("n") + 1)).alias("log_tail"))
    found = found.select(F.col("row").alias("r"), "n_tail", "log_tail")
    s = encoded.select("row", "classes").mapInArrow(_scored(start, move, emit, n_head, np.log10(mass)), "row long, n_tokens long, log_classes double, n_head double, log_head double, log_tail_mass double")
    s = s.join(encoded.select(F.col("row").alias("e_row"), "doc_id", "held_out"), F.col("row") == F.col("e_row")).join(found, F.col("row") == F.col("r"), "left")
    log_tail = F.coalesce("log_tail", F.lit(0.0))
    base = F.col("log_head") + log_tail - F.col("n_tokens") * math.log10(total + distinct + 1)
    known = (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long")
    own = F.col("log_classes") + log_tail - F.col("log_tail_mass") if total else base
    return s.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), own.alias("score"))


def split(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_hmm_likelihood(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), split(7) != 2)
