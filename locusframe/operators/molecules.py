"""Molecules as SMILES, mass spectra and three-dimensional structures."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusframe.functions.sequence import RESIDUE_MASS, WATER

from . import tiles
from .staging import cut

#: Standard atomic weights and usual valences.
WEIGHT = {"H": 1.008, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Mg": 24.305, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Br": 79.904, "I": 126.904}
VALENCE = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "F": (1,), "P": (3, 5), "S": (2, 4, 6), "Cl": (1,), "Br": (1,), "I": (1,)}
PROTON = 1.00728
TOKEN = re.compile(r"\[(?P<iso>\d+)?(?P<sym>[A-Z][a-z]?|[a-z]{1,2})(?P<chi>@+)?(?P<h>H\d*)?(?P<chg>[+-]+\d*)?(?::\d+)?\]|(?P<org>Br|Cl|[BCNOPSFIbcnops])|(?P<bond>[-=#:/\\])|(?P<ring>%\d\d|\d)|(?P<mark>[().])")
ORDER = {"-": 1, "=": 2, "#": 3, ":": 1.5, "/": 1, "\\": 1}


def parse_smiles(text: str) -> tuple[list[dict], list[tuple[int, int, float]]]:
    """Atoms (element, aromatic, charge, hydrogens) and bonds (i, j, order)."""
    atoms: list[dict] = []
    bonds: list[tuple[int, int, float]] = []
    stack: list[int] = []
    rings: dict[str, tuple[int, str | None]] = {}
    last, bond, at = -1, None, 0

    def tie(i: int, j: int, b: str | None) -> None:
        bonds.append((i, j, ORDER[b] if b else 1.5 if atoms[i]["aromatic"] and atoms[j]["aromatic"] else 1))

    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read SMILES at {at}: {text[at:at + 8]!r}")
        at = m.end()
        if m["org"] or m["sym"]:
            symbol = m["org"] or m["sym"]
            charge = m["chg"] or ""
            size = int(charge.strip("+-") or len(charge)) if charge else 0
            h = None if m["org"] else int((m["h"] or "H0")[1:] or 1)
            atoms.append({"element": symbol.capitalize(), "aromatic": symbol[0].islower(), "charge": -size if "-" in charge else size, "hydrogens": h})
            if last >= 0:
                tie(last, len(atoms) - 1, bond)
            last, bond = len(atoms) - 1, None
        elif m["bond"]:
            bond = m["bond"]
        elif m["ring"]:
            if m["ring"] in rings:
                other, b = rings.pop(m["ring"])
                tie(other, last, bond or b)
            else:
                rings[m["ring"]] = (last, bond)
            bond = None
        elif m["mark"] == "(":
            stack.append(last)
        elif m["mark"] == ")":
            last = stack.pop()
        else:
            last = -1
    if rings or stack:
        raise ValueError("an open ring or branch")
    for i, a in enumerate(atoms):
        if a["hydrogens"] is None:
            used = sum(b for x, y, b in bonds if i in (x, y))
            used = int(used + 0.5) if a["aromatic"] and used % 1 else int(used)
            a["hydrogens"] = next((v - used for v in VALENCE[a["element"]] if v >= used), 0)
    return atoms, bonds


def formula(atoms: list[dict]) -> str:
    """Hill order."""
    n: dict[str, int] = {}
    for a in atoms:
        n[a["element"]] = n.get(a["element"], 0) + 1
        if a["hydrogens"]:
            n["H"] = n.get("H", 0) + a["hydrogens"]
    order = [e for e in ("C", "H") if e in n and "C" in n] + sorted(e for e in n if "C" not in n or e not in ("C", "H"))
    return "".join(f"{e}{n[e] if n[e] > 1 else ''}" for e in order)


def weight(atoms: list[dict]) -> float:
    return sum(WEIGHT[a["element"]] + a["hydrogens"] * WEIGHT["H"] for a in atoms)


def fingerprint(atoms: list[dict], bonds: list[tuple[int, int, float]], radius: int = 2, bits: int = 1024) -> list[int]:
    """Set bits of the circular environments up to `radius` bonds."""
    near: dict[int, list[tuple[float, int]]] = {i: [] for i in range(len(atoms))}
    for i, j, b in bonds:
        near[i].append((b, j))
        near[j].append((b, i))
    code = {i: zlib.crc32(f"{a['element']}{a['aromatic']}{a['charge']}{a['hydrogens']}{len(near[i])}".encode()) for i, a in enumerate(atoms)}
    found = set(code.values())
    for _ in range(radius):
        code = {i: zlib.crc32(f"{code[i]}{sorted((b, code[j]) for b, j in near[i])}".encode()) for i in code}
        found |= set(code.values())
    return sorted({c % bits for c in found})


def describe_molecules(df: DataFrame) -> DataFrame:
    """Rows (id, formula, weight, heavy_atoms, rings, fingerprint) of rows (id, smiles)."""
    from .sequences import by_batch

    def rows(batch: list[tuple]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("id", "formula", "weight", "heavy_atoms", "rings", "fingerprint")}
        for i, s in batch:
            atoms, bonds = parse_smiles(s)
            parts = len({find(k, len(atoms), bonds) for k in range(len(atoms))})
            for c, v in zip(out, (i, formula(atoms), weight(atoms), len(atoms), len(bonds) - len(atoms) + parts, fingerprint(atoms, bonds)), strict=True):
                out[c].append(v)
        return out

    return by_batch(df, ["id", "smiles"], f"id {dict(df.dtypes)['id']}, formula string, weight double, heavy_atoms int, rings int, fingerprint array<int>", rows)


def find(start: int, n: int, bonds: list[tuple[int, int, float]]) -> int:
    """Least atom connected to `start`."""
    seen, stack = {start}, [start]
    while stack:
        i = stack.pop()
        for x, y, _ in bonds:
            for a, b in ((x, y), (y, x)):
                if a == i and b not in seen:
                    seen.add(b)
                    stack.append(b)
    return min(seen)


def tanimoto(a: Column, b: Column) -> Column:
    """Shared set bits over all; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def similar_sets(df: DataFrame, least: float, tile: int = 4096) -> DataFrame:
    """Pairs id_a < id_b of rows (id, bits) with Tanimoto >= least > 0: tiles of sets are multiplied, so shared bits are never shuffled by pair."""
    kind = dict(df.dtypes)["id"]
    sets = cut(df.select("id", F.array_distinct("bits").alias("bits")))
    bits = cut(sets.select(F.explode("bits").alias("bit")).where("bit is not null").distinct().withColumn("k", F.monotonically_increasing_id()))
    coded = sets.select("id", F.size("bits").alias("n"), F.explode("bits").alias("bit")).join(bits, "bit").groupBy("id", "n").agg(F.collect_list(F.struct("k")).alias("items"))

    def run(a: tiles.Tile, b: tiles.Tile, same: bool) -> Iterator[dict]:
        n, m = (t.field("n").to_numpy(zero_copy_only=False) for t in (a, b))
        for at in tiles.stripes(a, b, 1 << 21):
            shared, _ = tiles.products(a, b, at)
            score = shared / (n[at, None] + m - shared)
            i, j, out = tiles.ordered(a, b, same, at, (shared > 0) & (score >= least))
            yield out | {"tanimoto": score[i, j]}

    return tiles.tile_pairs(coded.withColumn("_g", F.lit(0)), ["_g"], run, f"id_a {kind}, id_b {kind}, tanimoto double", tile).drop("_g")


def fragment_ions(peptide: Column) -> Column:
    """array<struct<ion, number, mz>> of singly charged b and y ions."""
    mass = F.create_map(*[F.lit(x) for kv in RESIDUE_MASS.items() for x in kv])
    masses = F.transform(F.filter(F.split(peptide, ""), lambda c: c != ""), lambda c: mass[c])
    sums = F.aggregate(masses, F.array(F.lit(0.0)), lambda t, x: F.array_append(t, F.element_at(t, -1) + x))  # of the first 0, 1, ... residues
    ions = F.transform(F.array(sums), lambda s: F.flatten(F.transform(F.sequence(F.lit(1), F.length(peptide) - 1), lambda i: F.array(
        F.struct(F.lit("b").alias("ion"), i.alias("number"), (F.get(s, i) + PROTON).alias("mz")),
        F.struct(F.lit("y").alias("ion"), i.alias("number"), (F.element_at(s, -1) - F.get(s, F.length(peptide) - i) + WATER + PROTON).alias("mz"))))))
    return F.when(F.length(peptide) > 1, F.get(ions, F.lit(0)))


def fragment_table(df: DataFrame) -> DataFrame:
    """Rows (peptide, ion, number, mz): the singly charged b and y ions of distinct peptides of a column `peptide`, by running sums of residues."""
    mass = F.create_map(*[F.lit(x) for kv in RESIDUE_MASS.items() for x in kv])
    x = df.select("peptide", F.length("peptide").alias("n"), F.posexplode(F.filter(F.split("peptide", ""), lambda c: c != "")).alias("i", "aa")).withColumn("m", mass[F.col("aa")])
    part = W.partitionBy("peptide")
    b, all_ = F.sum("m").over(part.orderBy("i").rowsBetween(W.unboundedPreceding, 0)), F.sum("m").over(part)
    x = x.withColumn("b", b).withColumn("y", all_ - F.col("b")).where(F.col("i") + 1 < F.col("n"))
    ions = F.array(F.struct(F.lit("b").alias("ion"), (F.col("i") + 1).alias("number"), (F.col("b") + PROTON).alias("mz")), F.struct(F.lit("y").alias("ion"), (F.col("n") - F.col("i") - 1).alias("number"), (F.col("y") + WATER + PROTON).alias("mz")))
    return x.select("peptide", F.explode(ions).alias("f")).select("peptide", "f.ion", "f.number", "f.mz")


def tolerance_join(a: DataFrame, b: DataFrame, ppm: float) -> DataFrame:
    """Pairs of a(id, mz) and b(id, mz), b's columns named b_*, within ppm of b's mz; an equi-join on logarithmic buckets."""
    width = ppm * 1.1e-6
    key = F.floor(F.ln("mz") / width)
    left = a.where("mz > 0").withColumn("_k", F.explode(F.array(key - 1, key, key + 1)))
    right = b.where("mz > 0").withColumn("_k", key).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.col("_k"))
    return left.join(right, "_k").where(F.abs(F.col("mz") - F.col("b_mz")) <= F.col("b_mz") * ppm * 1e-6).drop("_k")


def contacts(df: DataFrame, cutoff: float, by: list[str]) -> DataFrame:
    """Pairs id_a < id_b of points (id, x, y, z) at most `cutoff` apart, through a grid of that width."""
    cell = lambda c: F.floor(F.col(c) / cutoff)
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = df.select(*by, F.col("id").alias("id_a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[cell(c).alias(f"_{c}") for c in "xyz"])
    b = df.select(*by, F.col("id").alias("id_b"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *[cell(c).alias(f"k{c}") for c in "xyz"])
    for c in "xyz":
        b = b.withColumn("_s", F.explode(step)).withColumn(f"_{c}", F.col(f"k{c}") + F.col("_s")).drop("_s", f"k{c}")
    d = F.sqrt(sum((F.pow(F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return a.join(b, [*by, "_x", "_y", "_z"]).where("id_a < id_b").withColumn("distance", d).where(F.col("distance") <= cutoff).select(*by, "id_a", "id_b", "distance")


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot3(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def angle(p: list[Column], q: list[Column], r: list[Column]) -> Column:
    """Degrees at q."""
    a, b = [x - y for x, y in zip(p, q, strict=True)], [x - y for x, y in zip(r, q, strict=True)]
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot3(a, b) / F.sqrt(dot3(a, a) * dot3(b, b))))))


def dihedral(p: list[Column], q: list[Column], r: list[Column], s: list[Column]) -> Column:
    """Degrees of the torsion about q-r, within (-180, 180]."""
    sub = lambda u, v: [x - y for x, y in zip(u, v, strict=True)]
    b1, b2, b3 = sub(q, p), sub(r, q), sub(s, r)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.degrees(F.atan2(dot3(cross(n1, n2), b2) / F.sqrt(dot3(b2, b2)), dot3(n1, n2)))


def rmsd(df: DataFrame, by: list[str]) -> DataFrame:
    """Root mean square deviation of paired points (ax, ay, az, bx, by, bz) without superposition."""
    d = sum((F.pow(F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in "xyz"), F.lit(0.0))
    return df.groupBy(*by).agg(F.sqrt(F.avg(d)).alias("rmsd"))
