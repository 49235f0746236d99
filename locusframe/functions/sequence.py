"""Scalar functions over DNA, RNA and protein strings as columns, and the tables they need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in order of T, C, A, G at each place.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: Monoisotopic residue masses in Da, and water.
RESIDUE_MASS = {"G": 57.02146, "A": 71.03711, "S": 87.03203, "P": 97.05276, "V": 99.06841, "T": 101.04768, "C": 103.00919, "L": 113.08406, "I": 113.08406, "N": 114.04293,
                "D": 115.02694, "Q": 128.05858, "K": 128.09496, "E": 129.04259, "M": 131.04049, "H": 137.05891, "F": 147.06841, "R": 156.10111, "Y": 163.06333, "W": 186.07931}
WATER = 18.01056
#: Hydropathy of residues.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}


def codons() -> dict[str, str]:
    return {a + b + c: GENETIC_CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def count_of(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def gc_content(seq: Column) -> Column:
    """Share of G and C among A, C, G, T; 0 without any."""
    gc, at = count_of(seq, "G") + count_of(seq, "C"), count_of(seq, "A") + count_of(seq, "T")
    return F.coalesce(F.try_divide(gc, gc + at), F.lit(0.0))


def gc_skew(seq: Column) -> Column:
    g, c = count_of(seq, "G"), count_of(seq, "C")
    return F.coalesce(F.try_divide(g - c, g + c), F.lit(0.0))


def entropy(seq: Column, letters: str = "ACGT") -> Column:
    """Shannon entropy in bits over the letters."""
    counts = [count_of(seq, x) for x in letters]
    n = sum(counts[1:], counts[0])
    return sum((F.when(c > 0, -c / n * F.log2(c / n)).otherwise(0.0) for c in counts), F.lit(0.0))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa"))


def transcribe(seq: Column) -> Column:
    return F.translate(seq, "Tt", "Uu")


def occurrences(seq: Column, motif: str) -> Column:
    """Places of a motif of plain letters, overlapping ones too."""
    return F.regexp_count(seq, F.lit(f"(?={motif})"))


def fragments(seq: Column, site: str, offset: int) -> Column:
    """Restriction fragments: the sequence cut `offset` letters into every site."""
    marked = F.replace(seq, F.lit(site), F.lit(site[:offset] + "|" + site[offset:]))
    return F.split(marked, r"\|")


def peptides(protein: Column) -> Column:
    """Tryptic peptides: cuts after K or R, not before P."""
    return F.filter(F.split(protein, "(?<=[KR])(?!P)"), lambda x: x != "")


def weighted(seq: Column, weights: dict[str, float]) -> Column:
    return sum((count_of(seq, x) * F.lit(w) for x, w in weights.items()), F.lit(0.0))


def peptide_mass(protein: Column) -> Column:
    return weighted(protein, RESIDUE_MASS) + WATER


def gravy(protein: Column) -> Column:
    """Mean hydropathy; 0 for an empty sequence."""
    return F.coalesce(F.try_divide(weighted(protein, HYDROPATHY), F.length(protein)), F.lit(0.0))


def melting_temperature(seq: Column) -> Column:
    """Wallace's rule up to 13 bases, else the GC formula."""
    gc, n = count_of(seq, "G") + count_of(seq, "C"), F.length(seq)
    return F.when(n < 14, 2.0 * (n - gc) + 4.0 * gc).otherwise(64.9 + 41 * (gc - 16.4) / n)


def hamming(a: Column, b: Column) -> Column:
    """Differing places of equally long strings; null otherwise."""
    return F.when(F.length(a) == F.length(b), F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda t, x: t + x))
