"""Refolding paths against the lowest barrier over all orders of moves."""

import heapq
import random

from foldlake.operators import folding, paths
from foldlake.operators.bands import Minimum
from foldlake.operators.energy import Loops


def exact(f, start, goal):
    """Lowest barrier by search over all intermediates."""
    best, todo = {start: f.energy(start)}, [(f.energy(start), 0, start)]
    count = 0
    while todo:
        high, _, now = heapq.heappop(todo)
        if now == goal:
            return high
        for then in paths._moves(now, goal):
            x = max(high, f.energy(then))
            if x < best.get(then, 1e9):
                best[then] = x
                count += 1
                heapq.heappush(todo, (x, count, then))


def cases():
    rng = random.Random(6)
    for _ in range(12):
        s = "".join(rng.choice("GGCCAU") for _ in range(rng.randint(18, 30)))
        low = folding._filled([s], Minimum)
        z = folding._filled([s], folding.bands.Sum)
        yield s, folding._best(low, 0)[1], folding._drawn(z, 0, 1, __import__("numpy").random.default_rng(len(s)))[0]


def test_barriers_against_all_orders():
    for s, a, b in cases():
        f = paths.Folded(s, len(s))
        want = exact(f, paths._pairs(a), paths._pairs(b))
        barrier, path = paths.refold(s, a, b, 4096)
        assert barrier == want == max(e for _, e in path)
        assert path[0][0] == a and path[-1][0] == b and len(path) == len(paths._pairs(a) ^ paths._pairs(b)) + 1
        assert all(e == (Loops(t, s).energies()[1].sum() if "(" in t else 0) for t, e in path)
        assert all(len(paths._pairs(x[0]) ^ paths._pairs(y[0])) == 1 for x, y in zip(path, path[1:]))
        assert paths.refold(s, a, b, 2)[0] >= want


def test_rows_of_paths(spark):
    s = "GGGAAACCCAAAGGGUUUCCC"
    rows = [(1, s, "(((...)))............", "............(((...)))"), (None, s, "." * 21, None), (1, s, "(((...)))............", "(((...)))............"), (2, None, None, "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, seq string, a string, b string, at int")
    got = {(r["doc_id"], r["n_steps"]): r for r in paths.refolding_paths(df, "a", "b").collect()}
    assert got[1, 6]["barrier"] == max(p["energy"] for p in got[1, 6]["path"]) and got[1, 0]["path"][0]["structure"].startswith("(((")
    assert got[None, 0]["barrier"] == 0 and got[2, 0]["path"][0]["structure"] == ""
    assert paths.refolding_paths(df.limit(0), "a", "b").collect() == []
