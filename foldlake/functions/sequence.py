"""Column functions over nucleotide sequences (strings), structures (dot-bracket strings) and scalar units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Nucleotide codes, IUPAC sets.
CODES = {"A": 1, "C": 2, "G": 3, "U": 4}
IUPAC = {"A": "A", "C": "C", "G": "G", "U": "U", "T": "U", "R": "AG", "Y": "CU", "S": "CG", "W": "AU", "K": "GU", "M": "AC", "B": "CGU", "D": "AGU", "H": "ACU", "V": "ACG", "N": "ACGU"}
#: Pair types by the two bases.
PAIR_TYPES = {"CG": 1, "GC": 2, "GU": 3, "UG": 4, "AU": 5, "UA": 6}
#: Joules in one unit of energy.
ENERGY_UNITS = {"J": 1.0, "kJ": 1000.0, "cal": 4.184, "kcal": 4184.0, "dcal": 41.84, "eV": 1.602176565e-19, "Wh": 3600.0, "kWh": 3.6e6}


def from_text(text: Column) -> Column:
    """A sequence out of any text: all its letters a-z, mapped round-robin to A, C, G, U."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, ("ACGU" * 7)[:26])


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def ungapped(seq: Column) -> Column:
    return F.translate(seq, "-_~.", "")


def encoded(seq: Column) -> Column:
    """Codes 1-4 of A, C, G, U (T as U), 0 for anything else."""
    code = F.create_map(*[x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(F.filter(F.split(F.upper(to_rna(seq)), ""), lambda c: c != ""), lambda c: F.coalesce(code[c], F.lit(0)))


def decoded(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit("_ACGU"), c + 1, F.lit(1))), "")


def cut_point(seq: Column) -> Column:
    """1-based start of the second strand of 'first&second'; -1 without one, or where nothing follows."""
    at = F.instr(seq, "&")
    return F.when((at == 0) | (at == F.length(seq)), F.lit(-1)).otherwise(at)


def with_cut(seq: Column, cut: Column) -> Column:
    """seq with '&' before position cut (from 1); as it is where cut is null, below 1 or beyond the end."""
    fits = (cut >= 1) & (cut <= F.length(seq))
    return F.when(fits, F.concat(F.left(seq, cut - 1), F.lit("&"), F.substr(seq, cut))).otherwise(seq)


def count_of(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def hamming(a: Column, b: Column) -> Column:
    """Unequal positions of the common prefix length."""
    unequal = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != "") & (y != "") & (x != y))  # linear, unlike substring(i)
    return F.size(F.filter(unequal, lambda u: u))


def hamming_within(a: Column, b: Column, most: Column) -> Column:
    """Unequal positions among the first ``most`` of the common prefix length."""
    return hamming(F.left(a, most), F.left(b, most))


def iupac_regex(motif: str) -> str:
    return "".join(f"[{IUPAC[c]}]" for c in motif.upper())


def motif_starts(seq: Column, motif: str) -> Column:
    """1-based starts of an IUPAC motif, overlapping ones included."""
    spots = None
    for k, c in enumerate(motif.upper()):
        fits = F.transform(F.split(F.substring(seq, k + 1, 2**31 - 1), ""), lambda x: x.isin(*IUPAC[c]))  # noqa: B023
        spots = fits if spots is None else F.zip_with(spots, fits, lambda x, y: x & y)
    return F.filter(F.transform(spots, lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())


def pair_type(a: Column, b: Column) -> Column:
    types = F.create_map(*[x for k, v in PAIR_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(types[F.concat(a, b)], F.lit(0))


def convert_energy(value: Column, source: str, target: str) -> Column:
    return value * (ENERGY_UNITS[source] / ENERGY_UNITS[target])


def convert_temperature(celsius: Column, target: str) -> Column:
    """Celsius to K, F, R (Rankine), De (Delisle), N (Newton), Re (Reaumur) or Ro (Romer)."""
    return {
        "C": celsius,
        "K": celsius + 273.15,
        "F": celsius * 9 / 5 + 32,
        "R": (celsius + 273.15) * 9 / 5,
        "De": (F.lit(100.0) - celsius) * 3 / 2,
        "N": celsius * 33 / 100,
        "Re": celsius * 4 / 5,
        "Ro": celsius * 21 / 40 + 7.5,
    }[target]


def shape_probability(reactivity: Column, method: str, default: float = 0.5) -> Column:
    """Pairing-free probability from a reactivity: S as is, M piecewise, C cutoff, L linear, O logarithmic."""
    r = reactivity
    # Breakpoints and slopes of the conversions.
    piecewise = F.when(r < 0.25, r * (0.35 / 0.25)).when(r < 0.3, 0.35 + (r - 0.25) * (0.2 / 0.05)).when(r < 0.7, 0.55 + (r - 0.3) * (0.3 / 0.4)).otherwise(0.85 + (r - 0.7) * (0.15 / 0.3))
    p = {
        "S": r,
        "M": piecewise,
        "C": F.when(r < 0.25, 0.0).otherwise(1.0),
        "L": (r - 0.2) / 0.68,
        "O": (F.log(F.greatest(r, F.lit(1e-300))) + 2.29) / 1.6,
    }[method]
    return F.when(r < 0, F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def shape_energy(reactivity: Column, m: float = 1.8, b: float = -0.6) -> Column:
    """Pseudo-energy of a stacked nucleotide; 0 where the reactivity is missing (negative)."""
    return F.when(reactivity < 0, 0.0).otherwise(m * F.log(F.greatest(reactivity, F.lit(0.0)) + 1) + b)


def pair_symbol(unpaired: Column, up: Column, down: Column) -> Column:
    """Symbol of a position from its probabilities of being unpaired, opening and closing."""
    t, paired = 0.667, up + down
    return (
        F.when(unpaired > t, ".").when(up > t, "(").when(down > t, ")")
        .when((paired > unpaired) & (up > t * paired), "{").when((paired > unpaired) & (down > t * paired), "}").when(paired > unpaired, "|")
        .when(unpaired > paired, ",").otherwise(":")
    )
