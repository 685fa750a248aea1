"""Nearest-neighbour parameters at 37 C in units of 0.01 kcal/mol, as arrays by pair type and bases.

Pair types: 1 to 6 as in ``PAIR_TYPES``, 7 any other pair. Bases: 1 to 4 for A, C, G, U, 0 any other letter, 5 none (beyond
an end). Any other letter or pair has the largest value of those known.

Loops of one against two and of two against two unpaired bases follow the rules below instead of their measured tables.
"""

from __future__ import annotations

import math

import numpy as np

# Fixed values from here to the class: nearest-neighbour parameters.
# Stacks: types CG GC GU UG AU UA and any other pair; the second pair seen from inside.
STACK = [
    [-240, -330, -210, -140, -210, -210, -140],
    [-330, -340, -250, -150, -220, -240, -150],
    [-210, -250, 130, -50, -140, -130, 130],
    [-140, -150, -50, 30, -60, -100, 30],
    [-210, -220, -140, -60, -110, -90, -60],
    [-210, -240, -130, -100, -90, -130, -90],
    [-140, -150, 130, 30, -60, -90, 130],
]
FORBIDDEN = 1_000_000
# Loop initiation by size, 0 to 30.
HAIRPIN = [FORBIDDEN] * 3 + [540, 560, 570, 540, 600, 550, 640, 650, 660, 670, 680, 690, 690, 700, 710, 710, 720, 720, 730, 730, 740, 740, 750, 750, 750, 760, 760, 770]
BULGE = [FORBIDDEN, 380, 280, 320, 360, 400, 440, 460, 470, 480, 490, 500, 510, 520, 530, 540, 540, 550, 550, 560, 570, 570, 580, 580, 580, 590, 590, 600, 600, 600, 610]
INTERIOR = [FORBIDDEN] * 2 + [100, 100, 110, 200, 200, 210, 230, 240, 250, 260, 270, 280, 290, 290, 300, 310, 310, 320, 330, 330, 340, 340, 350, 350, 350, 360, 360, 370, 370]
LONGER = 107.856
ASYMMETRY, MOST_ASYMMETRY = 60, 300
TERMINAL_AU = 50
MULTI_CLOSING, MULTI_STEM = 930, -90
# Hairpins with an energy of their own.
SPECIAL_HAIRPINS = {
    "CAACG": 680, "GUUAC": 690,
    "CAACGG": 550, "CCAAGG": 330, "CCACGG": 370, "CCCAGG": 340, "CCGAGG": 350, "CCGCGG": 360, "CCUAGG": 370, "CCUCGG": 250,
    "CUAAGG": 360, "CUACGG": 280, "CUCAGG": 370, "CUCCGG": 270, "CUGCGG": 280, "CUUAGG": 350, "CUUCGG": 370, "CUUUGG": 370,
    "ACAGUACU": 280, "ACAGUGAU": 360, "ACAGUGCU": 290, "ACAGUGUU": 180,
}
# Terminal mismatches of hairpins by type; rows: base after i, columns: base before j; A, C, G, U.
HAIRPIN_MISMATCH = """
CG  -150 -150 -140 -150  -100 -110 -100  -80  -230 -150 -240 -150  -100 -140 -100 -210
GC  -110 -150 -130 -150  -110  -70 -110  -50  -250 -150 -220 -150  -110 -100 -110 -160
GU    20  -50  -30  -50   -10  -20  -10  -20  -100  -50 -110  -50   -10  -30  -10 -100
UG   -50  -30  -60  -30   -20  -10  -20    0   -90  -30 -110  -30   -20  -10  -20  -90
AU   -30  -50  -30  -50   -10  -20  -10  -20  -120  -50 -110  -50   -10  -30  -10 -120
UA   -50  -30  -50  -30   -20  -10  -20    0  -150  -30 -150  -30   -20  -10  -20  -90
"""
# Mismatches of stems in exterior and multiloops by type; rows: base before i, columns: base after j.
STEM_MISMATCH = """
CG  -110 -110 -160 -110  -150  -70 -150 -100  -130 -110 -140 -110  -150  -50 -150  -70
GC  -150 -100 -140 -100  -150 -110 -150 -140  -140 -100 -160 -100  -150  -80 -150 -120
GU  -100  -70  -50  -70   -80  -60  -80  -60  -110  -70  -80  -70   -80  -50  -80  -50
UG   -30  -60  -60  -60  -100  -70 -100  -80   -80  -60  -80  -60  -100  -70 -100  -60
AU  -100  -70 -110  -70   -80  -60  -80  -60  -110  -70 -120  -70   -80  -50  -80  -50
UA   -80  -60  -80  -60  -100  -70 -100  -80   -80  -60  -80  -60  -100  -70 -100  -80
"""
# One dangling base before i, or after j, by type.
DANGLE_BEFORE = """
CG  -50 -30 -20 -10
GC  -20 -30   0   0
GU  -30 -30 -40 -20
UG  -30 -10 -20 -20
AU  -30 -30 -40 -20
UA  -30 -10 -20 -20
"""
DANGLE_AFTER = """
CG  -110 -40 -130  -60
GC  -170 -80 -170 -120
GU   -70 -10  -70  -10
UG   -80 -50  -80  -60
AU   -70 -10  -70  -10
UA   -80 -50  -80  -60
"""
# Interior loops: closing pairs other than CG and GC; mismatches (base after i, base before j) of long loops and of 2 x 3 ones.
INTERIOR_AU = 70
INTERIOR_MISMATCH = {"AG": -80, "GA": -100, "GG": -100, "UU": -60}
INTERIOR_23 = {"GA": -110, "GG": -70, "UU": -30}
INTERIOR_23_AG, INTERIOR_23_AG_TYPES, INTERIOR_23_GA_GC = -50, ("CG", "UG", "UA"), -120
# Loops of one against one: two strong pairs, one, none; the other mismatches of each two types (the second seen from inside).
ONE_STRONG, ONE_MIXED, ONE_WEAK, ONE_MIXED_GG, ONE_WEAK_GG = 50, 120, 190, -140, -70
ONE_BY_ONE = {
    "CG CG": "AA 90 GG -140 UU 40",
    "CG GC": "AA 90 AC -40 CA 30 CU 60 GA -10 GG -220 UC 0 UU -10",
    "GC GC": "AA 80 GG -230 UU -60",
    "CG GU": "AA 60 AC 50 GA -20 UC 100 UU 110",
    "CG UG": "AA 220 AC 130 CC 170 UU 110",
    "CG AU": "UU 80",
    "GC GU": "AA 190 AG 150 UU 150",
    "GC UG": "AA 160 AG 100 UU 70",
    "GC AU": "UU 80",
    "GU GU": "UU 120", "GU UG": "UU 160", "GU AU": "UU 120", "GU UA": "UU 160", "UG UG": "UU 190", "UG AU": "UU 160",
    "AU AU": "UU 120", "AU UA": "UU 150", "UA UA": "UU 170",
}
# Loops of one against two: by number of pairs other than CG and GC; mismatches of the single base with either end.
ONE_BY_TWO = [230, 300, 370]
ONE_BY_TWO_MISMATCH = [{"AG": -120, "GA": -120, "GG": -120, "UU": -80}, {"AG": -110, "GA": -110, "GG": -110, "UU": -80}, {"AG": -110, "GA": -110, "GG": -110, "UU": -80}]
#: Type of a pair seen from the other side.
REVERSE = [2, 1, 4, 3, 6, 5, 7]

TYPES = ["CG", "GC", "GU", "UG", "AU", "UA"]
BASES = "ACGU"


def _with_any(known: np.ndarray, type_axes: int) -> np.ndarray:
    """Adds to arrays over types 1-6 and bases 1-4 the other types and letters, with the largest known value; index 0 of a
    type axis is not used."""
    x = known
    for axis in range(x.ndim):
        most = x.max(axis, keepdims=True)
        x = np.concatenate([most, x, most] if axis < type_axes else [most, x], axis)
    return x


def _by_type(text: str, *shape: int) -> np.ndarray:
    rows = {r.split()[0]: r.split()[1:] for r in text.strip().splitlines()}
    return _with_any(np.array([[int(v) for v in rows[t]] for t in TYPES]).reshape(6, *shape), 1)


def _interior(bonus) -> np.ndarray:
    """Mismatch array of interior loops; bonus(type, pair of bases)."""
    return _with_any(np.array([[[(INTERIOR_AU if t > 1 else 0) + bonus(TYPES[t], a + b) for b in BASES] for a in BASES] for t in range(6)]), 1)


def _one_by_one() -> np.ndarray:
    out = np.zeros((6, 6, 4, 4), np.int64)
    for t, s in np.ndindex(6, 6):
        weak = (t > 1) + (s > 1)
        out[t, s] = [ONE_STRONG, ONE_MIXED, ONE_WEAK][weak]
        if weak:
            out[t, s, 2, 2] = [0, ONE_MIXED_GG, ONE_WEAK_GG][weak]
        straight, turned = (ONE_BY_ONE.get(f"{TYPES[x]} {TYPES[y]}", "").split() for x, y in ((t, s), (s, t)))
        for words, back in ((straight, False), (turned, True)):
            for ab, v in zip(words[::2], words[1::2]):
                a, b = (BASES.index(c) for c in (ab[::-1] if back else ab))
                out[t, s, a, b] = int(v)
    return _with_any(out, 2)


def _one_by_two() -> np.ndarray:
    """By types, the single base, and the bases across it: the one beside the inner pair, the one beside the outer pair."""
    out = np.zeros((6, 6, 4, 4, 4), np.int64)
    for t, s, a, b, c in np.ndindex(out.shape):
        weak = (t > 1) + (s > 1)
        bonus = ONE_BY_TWO_MISMATCH[weak]
        out[t, s, a, b, c] = ONE_BY_TWO[weak] + min(bonus.get(BASES[a] + BASES[x], 0) for x in (b, c))
    return _with_any(out, 2)


def by_size(values: list[int], n: int) -> int:
    return values[n] if n <= 30 else values[30] + int(LONGER * math.log(n / 30))


def _stems() -> np.ndarray:
    """Terminal pairs with their neighbours, by type, base before i and base after j; 5 where there is none."""
    out = np.zeros((8, 6, 6), np.int64)
    out[:, :5, :5] = _by_type(STEM_MISMATCH, 4, 4)
    out[:, :5, 5] = _by_type(DANGLE_BEFORE, 4)
    out[:, 5, :5] = _by_type(DANGLE_AFTER, 4)
    return out


NO_AU = np.array([0, 0, 0] + [TERMINAL_AU] * 5)
TURNED = np.array([7, *REVERSE])
STACKS = np.full((8, 8), FORBIDDEN)
STACKS[1:, 1:] = STACK
HAIRPINS = _by_type(HAIRPIN_MISMATCH, 4, 4)
LONG = _interior(lambda t, ab: INTERIOR_MISMATCH.get(ab, 0))
ONE_LONG = _interior(lambda t, ab: 0)
TWO_THREE = _interior(lambda t, ab: INTERIOR_23_GA_GC if (t, ab) == ("GC", "GA") else INTERIOR_23_AG if ab == "AG" and t in INTERIOR_23_AG_TYPES else INTERIOR_23.get(ab, 0))
ONE_ONE = _one_by_one()
ONE_TWO = _one_by_two()
#: Stems of the exterior loop and of multiloops (closing pairs turned), with terminal AU and dangling ends on both sides.
EXTERIOR_STEM = NO_AU[:, None, None] + _stems()
MULTI_STEMS = EXTERIOR_STEM + MULTI_STEM


def stems(dangles: int) -> tuple[np.ndarray, np.ndarray]:
    """EXTERIOR_STEM and MULTI_STEMS with dangling ends on both sides (2) or without any (0)."""
    if dangles not in (0, 2):
        raise ValueError("dangles is 0 or 2")
    bare = np.broadcast_to(NO_AU[:, None, None], EXTERIOR_STEM.shape)
    return (EXTERIOR_STEM, MULTI_STEMS) if dangles else (bare, bare + MULTI_STEM)


CODE_OF = np.zeros(256, np.int64)
for _k, _b in enumerate(BASES, 1):
    CODE_OF[ord(_b)] = _k
TYPE_OF = np.full((6, 6), 7)
for _k, _t in enumerate(TYPES, 1):
    TYPE_OF[BASES.index(_t[0]) + 1, BASES.index(_t[1]) + 1] = _k
