"""Chat formatting: minimum-cost role repair over a legal-turn automaton.

Legal: an optional system message, then user and assistant in turn, user first, assistant last. A dynamic programme
over the automaton's states chooses, turn by turn, to keep the role, relabel the turn, merge it into the message
before, or insert an empty message, at least cost. The programme is a product of small (min, +) matrices, so a
conversation of any length is cut into chunks of a bounded number of rows, whatever its turn numbers are: chunks give
their matrices in parallel, one short pass per conversation over the matrices fixes each chunk's entry and exit state,
and chunks then trace their own best path and render their pieces. The conversation is the concatenation of its pieces
in (chunk, piece) order. Rows of conversations of more than one chunk are numbered by ranges of one sort over all of them.

Defined results: turns are ordered by turn (null last), then role and text, so ties and repeated rows have one order;
a null text is empty; an unknown or null role can only be relabelled or merged; a null conv_id is one conversation;
other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, materialize, small, stream_groups, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> states that a new message may lead to
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FINAL = ASSISTANT
RELABEL, MERGE, INSERT = 3, 1, 2
CHUNK_TURNS = 256
FAR = 10**9
PIECES = "conv_id long, chunk long, piece int, turn long, action string, role string, rendered string, cost long"


def _inserts() -> list[list[list[int]]]:
    """Shortest lists of states of inserted empty messages from each state to each other."""
    out = [[None] * 4 for _ in range(4)]
    for s in range(4):
        out[s][s], todo = [], [s]
        while todo:
            a = todo.pop(0)
            for b in LEGAL[a]:
                if out[s][b] is None:
                    out[s][b] = out[s][a] + [b]
                    todo.append(b)
    return out


INSERTS = _inserts()


def moves(role: str | None) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, action) of one turn, after any insertions."""
    own = ROLES.index(role) + 1 if role in ROLES else None
    out = []
    for a in range(4):
        for b in LEGAL[a]:
            out.append((a, b, 0 if b == own else RELABEL, "keep" if b == own else "relabel"))
        if a != START:
            out.append((a, a, MERGE + (0 if a == own else RELABEL), "merge"))
    return out


MOVES = {r: moves(r) for r in (*ROLES, None)}


def step(costs: list[int], role: str | None) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Costs of the states after one more turn, and for each the (state before, state after insertions, action)."""
    mid, via = list(costs), list(range(4))
    for a in range(4):
        for b in range(4):
            if a != b and INSERTS[a][b] is not None and costs[a] + INSERT * len(INSERTS[a][b]) < mid[b]:
                mid[b], via[b] = costs[a] + INSERT * len(INSERTS[a][b]), a
    new, back = [FAR] * 4, [None] * 4
    for a, b, c, action in MOVES.get(role, MOVES[None]):
        if mid[a] + c < new[b]:
            new[b], back[b] = mid[a] + c, (via[a], a, action)
    return new, back


def trace(roles: list[str | None], entry: int, leave: int) -> list[list[tuple[str, int]]]:
    """The (action, state) list of each turn on the best path from entry to leave."""
    costs, backs = [0 if s == entry else FAR for s in range(4)], []
    for r in roles:
        costs, back = step(costs, r)
        backs.append(back)
    state, out = leave, []
    for back in reversed(backs):
        before, mid, action = back[state]
        out.append([("insert", s) for s in INSERTS[before][mid]] + [(action, state)])
        state = before
    return out[::-1]


def closing(costs: list[int]) -> list[int]:
    """Costs with the empty messages that a legal end still needs."""
    return [c + INSERT * len(INSERTS[s][FINAL]) if INSERTS[s][FINAL] is not None else FAR for s, c in enumerate(costs)]


def _matrices(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("costs", pa.list_(pa.int64()))])

    def rows():
        for (conv, chunk), turns in stream_groups(batches, ["conv_id", "chunk"]):
            flat = []
            for s in range(4):
                c = [0 if x == s else FAR for x in range(4)]
                for t in turns:
                    c = step(c, t["role"])[0]
                flat += [min(x, FAR) for x in c]
            yield (conv, chunk, flat), 200

    yield from arrow_rows(rows(), schema)


def _states(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()), ("cost", pa.int64())])

    def placed(conv, chunks, costs, backs):
        total, state = min((x, s) for s, x in enumerate(closing(costs)))
        out = bytearray([state])
        for back in reversed(backs):
            out.append(back[out[-1]])
        out.reverse()
        for k, chunk in enumerate(chunks):
            yield (conv, chunk, out[k], out[k + 1], k + 1 == len(chunks), total), 60

    def rows():  # keeps four bytes and a number of each chunk of a conversation
        conv, chunks, costs, backs = None, [], [], []
        for batch in batches:
            for c in batch.to_pylist():
                if chunks and c["conv_id"] != conv:
                    yield from placed(conv, chunks, costs, backs)
                    chunks = []
                if not chunks:
                    conv, costs, backs = c["conv_id"], [0, FAR, FAR, FAR], []
                m = c["costs"]
                best = [min((costs[a] + m[4 * a + b], a) for a in range(4)) for b in range(4)]
                costs = [min(x, FAR) for x, _ in best]
                backs.append(bytes(a for _, a in best))
                chunks.append(c["chunk"])
        if chunks:
            yield from placed(conv, chunks, costs, backs)

    yield from arrow_rows(rows(), schema)


def render(pieces: list[tuple[str, int, str]], fresh: bool, last: bool) -> list[str]:
    """Texts of (action, state, text) pieces; fresh: nothing is open before the first."""
    out = []
    for action, state, text in pieces:
        if action == "merge":
            out.append("\n" + text)
        else:
            out.append(("" if fresh else "<|end|>\n") + f"<|{ROLES[state - 1]}|>\n{text}")
        fresh = False
    if last and out:
        out[-1] += "<|end|>\n"
    return out


def _pieces(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("piece", pa.int32()), ("turn", pa.int64()), ("action", pa.string()), ("role", pa.string()), ("rendered", pa.string()), ("cost", pa.int64())])

    def rows():
        for (conv, chunk), turns in stream_groups(batches, ["conv_id", "chunk"]):
            entry, leave, last, cost = (turns[0][k] for k in ("entry", "leave", "last", "cost"))
            acts = [(a, s, t["text"] or "" if a != "insert" else "", None if a == "insert" else t["turn"]) for t, path in zip(turns, trace([t["role"] for t in turns], entry, leave)) for a, s in path]
            acts += [("insert", s, "", None) for s in INSERTS[leave][FINAL]] if last else []
            for k, ((action, state, _, turn), text) in enumerate(zip(acts, render([a[:3] for a in acts], entry == START, last))):
                yield (conv, chunk, k, turn, action, ROLES[state - 1], text, cost), len(text) + 60

    yield from arrow_rows(rows(), schema)


def _order() -> list:
    """Order of the rows of a conversation."""
    return [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]


def _chunked(t: DataFrame, chunk_turns: int) -> DataFrame:
    """t with chunk: the number of the row in its conversation, divided by chunk_turns.

    Only conversations of more rows than that are sorted: all together by ranges, which cut long conversations and equal
    rows too, so that the number is the count of the ranges before and the place in the range.
    """
    long = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > chunk_turns)
    long = materialize(long.select(F.col("conv_id").alias("l_conv"), F.lit(True).alias("long")), "long")
    if long.isEmpty():
        return t.withColumn("chunk", F.lit(0).cast("long"))
    j = t.withColumn("salt", F.rand(1)).join(small(long), F.col("conv_id").eqNullSafe(F.col("l_conv")), "left").drop("l_conv")
    order = [*_order(), F.col("salt")]
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = j.filter("long").repartitionByRange(n, F.col("conv_id"), *order).sortWithinPartitions("conv_id", *order)
    r = materialize(r.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranges")
    s = r.groupBy(F.col("conv_id").alias("s_conv"), F.col("range").alias("s_range")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy("s_conv").orderBy("s_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = materialize(s.select("s_conv", "s_range", (before - F.col("first")).alias("shift")), "starts")
    r = r.join(small(s), F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("range") == F.col("s_range")))
    r = r.select("conv_id", "turn", "role", "text", F.floor((F.col("at") + F.col("shift")) / chunk_turns).alias("chunk"))
    return j.filter("long IS NULL").select("conv_id", "turn", "role", "text", F.lit(0).cast("long").alias("chunk")).unionByName(r)


def repair(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Pieces of the repaired and rendered conversations."""
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    t = _chunked(t, chunk_turns)
    order = ["conv_id", "chunk", *_order()]
    m = t.repartition("conv_id", "chunk").sortWithinPartitions(*order).select("conv_id", "chunk", "role").mapInArrow(_matrices, "conv_id long, chunk long, costs array<long>")
    s = m.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_states, "conv_id long, chunk long, entry int, leave int, last boolean, cost long")
    s = s.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "entry", "leave", "last", "cost")
    j = t.join(s, t["conv_id"].eqNullSafe(s["c"]) & (t["chunk"] == s["k"])).drop("c", "k")
    return j.repartition("conv_id", "chunk").sortWithinPartitions(*order).mapInArrow(_pieces, PIECES)


def op7_role_repair(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations"))
