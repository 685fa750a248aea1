"""op13: fixed patterns against Python's re, EM against votes of known reliability, further spans by hand."""

import hashlib
import random
import re

import pytest

from foldlake.llm import personal_data as pd13
from foldlake.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def random_text(rng):
    parts = ["4111 1111 1111 1111", "4111111111111111", "49927398716", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0001.02.3.255", "a.b@c.de", "x@y.z_w@v.u", "@", "a@b", "é", "😀", "+1 (555) 010-9999", "+", "12", " ", "-", ".", "(", "\n", "+49 30 1234567890123456", "5500-0000-0000-0004", "7"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 25)))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "doc_id long, text string, kind int, spans string, base int")
    return [(r["doc_id"], [(pd13.KINDS[x["kind"]], x["s"], x["e"], x["base"]) for x in r["spans"]]) for r in pd13.personal_data(df).collect()]


def test_fixed_patterns(spark):
    rng = random.Random(3)
    rows = [(k, random_text(rng)) for k in range(400)] + [(None, "a@b.cd"), (1000, None), (1001, ""), (1001, "")]
    long = [(1002, "a" * 200_000 + "1" * 200_000), (1003, "1 2 " * 20_000 + "x.y" * 20_000)]  # Python's re is slow on these
    got = run(spark, rows + long)
    assert [x for k, x in got if k is None] == [[("email", 0, 6, True)]]
    got = sorted((k, [f"{a}:{b}:{c}" for a, b, c, base in x if base]) for k, x in got if k is not None)
    assert got == sorted([(k, plain(t)) for k, t in rows if k is not None] + [(k, []) for k, _ in long])
    assert run(spark, []) == []


def test_candidates_that_the_labelers_accept(spark):
    rng = random.Random(1)
    card = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15)), 0) if luhn(c))
    fails = lambda: next(c for c in iter(lambda: "9" + "".join(rng.choice("0123456789") for _ in range(15)), 0) if not luhn(c))
    rows = [(k, f"pay with {card()} today") for k in range(60)] + [(100 + k, f"some {fails()} number") for k in range(60)]
    two = f"{card()} {card()}"
    rows += [(500, two), (501, "no data here, 2024-01-15 and 12:30:45"), (502, "ab" + fails() + "cd")]
    got = dict(run(spark, rows))
    assert got[500] == [("card", 0, 16, False), ("card", 17, 33, False)] and not got[501] and not got[502]
    assert all(len(got[k]) == 1 for k in range(60)) and not any(got[100 + k] for k in range(60))


def test_em_finds_reliable_labelers():
    rng = random.Random(2)
    right = [0.95, 0.9, 0.85, 0.6, 0.55]
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = sum((1 if (rng.random() < r) == y else 2) * 3**k for k, r in enumerate(right))
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(y)
    post, chances = pd13.reliabilities([(2, v, n) for v, n in counts.items()], 100)
    assert [chances[2, 1][k][1] for k in range(5)] == pytest.approx(right, abs=0.04)
    wrong = sum(min(sum(ys), len(ys) - sum(ys)) for ys in truth.values())
    assert sum((post[2, v] > 0.5) != y for v, ys in truth.items() for y in ys) <= wrong * 1.1 + 20


def test_query_holds_every_document(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in pd13.op13_personal_data(spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, row = plain(d["text"]), got[d["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(row["spans"].split(",")) or not want
