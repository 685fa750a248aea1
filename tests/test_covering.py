"""Best structures through every pair, and the structures that cover them, against every structure."""

import random

import numpy as np
from test_windowed import energy, structures

from foldlake.operators import bands, landscape


def test_best_through_every_pair():
    rng = random.Random(4)
    for s in ["GGAAGGAAACCAAGGAAACCAACC", *("".join(rng.choice("GCGCAU") for _ in range(17)) for _ in range(6))]:
        all_of = [(energy(s, x), x) for x in structures(s, 0, len(s) - 1, len(s))]
        want: dict = {}
        for e, x in all_of:
            for i, j in x:
                want[i + 1, j + 1] = min(e, want.get((i + 1, j + 1), 10**9))
        low = bands.Bands([s, s[:9]], len(s), bands.Minimum)
        q = low.segments(len(s))
        seeds = np.full_like(q, bands.Minimum.zero)
        for k, t in enumerate(low.seqs):
            seeds[len(t), low.starts[k]] = 0
        low.derivatives(q, seeds)
        assert landscape.best_through_pairs(low, 0) == want
        best, delta = min(e for e, _ in all_of), 400
        got = landscape.covering(s, delta, together=3)
        assert got == landscape.covering(s, delta, together=50)
        seen: set = set()
        for text, e in got:
            pairs = {p for x in [landscape.Structure(text).pairs()] for p in zip(*(v.tolist() for v in x))}
            assert energy(s, [(i - 1, j - 1) for i, j in pairs]) == e and e <= best + delta
            assert not pairs or any(want[p] == e for p in pairs - seen)
            seen |= pairs
        assert seen == seen | {p for p, e in want.items() if e <= best + delta}
        assert [e for _, e in got] == sorted(e for _, e in got)


def test_rows_of_covering_structures(spark):
    rows = [(1, "GGGAAACCCAAAGGGUUUCCC"), (None, None), (2, ""), (3, "AAAAAAA"), (1, "GGGAAACCCAAAGGGUUUCCC")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, seq string, rank string")
    got = [tuple(r) for r in landscape.covering_structures(df, 300).collect()]
    assert (None, 1, "", 0) in got and (2, 1, "", 0) in got and (3, 1, ".......", 0) in got
    one = sorted(r for r in got if r[0] == 1)
    assert one[0] == one[1] and len(one) == 2 * len(set(one)) and one[0][1] == 1
    assert landscape.covering_structures(df.limit(0), 300).collect() == []
