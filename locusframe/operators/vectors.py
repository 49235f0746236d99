"""Distances, neighbours, clustering and evaluation of vectors (id, v array<double>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import tiles
from .stats import div


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, kind: str) -> Column:
    """euclidean, manhattan, chebyshev, cosine or hamming distance of two arrays."""
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda t, x: t + x)
    if kind == "euclidean":
        return F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if kind == "manhattan":
        return total(lambda x, y: F.abs(x - y))
    if kind == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if kind == "hamming":
        return total(lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
    if kind == "cosine":
        return 1 - div(dot(a, b), norm(a) * norm(b))
    raise ValueError(f"no distance {kind!r}")


def pairwise(df: DataFrame, kinds: list[str], by: list[str], tile: int = 2048) -> DataFrame:
    """All pairs id_a < id_b within the groups `by`, with a column per distance."""
    if unknown := set(kinds) - {"euclidean", "manhattan", "chebyshev", "hamming", "cosine"}:
        raise ValueError(f"no distance {unknown.pop()!r}")
    kind = dict(df.dtypes)["id"]

    def run(a: tiles.Tile, b: tiles.Tile, same: bool) -> Iterator[dict]:
        (x, m), (y, n) = tiles.matrix(a), tiles.matrix(b)
        for at in tiles.stripes(a, b):
            total = tiles.gaps(x[at], m[at], y, n, kinds)
            unknown = (m[at, None] != n) | (m[at, None] < 0)
            i, j, out = tiles.ordered(a, b, same, at, np.ones((len(x[at]), len(y)), bool))
            yield out | {k: pa.array(t[i, j], mask=unknown[i, j]) for k, t in total.items()}

    return tiles.tile_pairs(df.select(*by, "id", "v"), by, run, ", ".join([f"id_a {kind}", f"id_b {kind}", *[f"{k} double" for k in kinds]]), tile)


def knn_join(queries: DataFrame, base: DataFrame, k: int, by: list[str], kind: str = "euclidean", tile: int = 2048) -> DataFrame:
    """The k nearest rows of base in the same group for each query, itself excluded; ties by id."""
    one = dict(queries.dtypes)["id"]
    both = queries.select(*by, "id", "v", F.lit(True).alias("q"), F.lit(False).alias("b")).union(base.select(*by, "id", "v", F.lit(False), F.lit(True)))
    if queries is base:
        both = base.select(*by, "id", "v", F.lit(True).alias("q"), F.lit(True).alias("b"))

    def half(a: tiles.Tile, b: tiles.Tile) -> Iterator[dict]:
        a = a.filter(a.field("q"))
        b = b.filter(b.field("b"))
        if not len(a) or not len(b):
            return
        (x, m), (y, n) = tiles.matrix(a), tiles.matrix(b)
        (p, u), (r, w) = tiles.ids(a), tiles.ids(b)
        order = np.argsort(w, kind="stable")
        r, w, y, n = r.take(pa.array(order)), w[order], y[order], n[order]
        for at in tiles.stripes(a, b):
            d = tiles.gaps(x[at], m[at], y, n, [kind])[kind]
            # null is least and NaN greatest in the order of distances; a row itself comes last and is dropped
            unknown = (m[at, None] != n) | (m[at, None] < 0)
            key = np.where(unknown, -np.inf, np.where(np.isnan(d), np.inf, d))
            itself = u[at, None] == w
            near = np.argsort(np.where(itself, np.inf, key), axis=1, kind="stable")[:, : k + 1] if len(w) <= 4 * k else _least(np.where(itself, np.inf, key), k + 1)
            i = np.repeat(np.arange(len(key)), near.shape[1])
            j = near.ravel()
            stay = ~itself[i, j]
            i, j = i[stay], j[stay]
            yield {"id": p.take(pa.array(i + at.start)), "neighbour": r.take(pa.array(j)), "distance": pa.array(d[i, j], mask=unknown[i, j])}

    def run(a: tiles.Tile, b: tiles.Tile, same: bool) -> Iterator[dict]:
        yield from half(a, b)
        if not same:
            yield from half(b, a)

    x = tiles.tile_pairs(both, by, run, f"id {one}, neighbour {dict(base.dtypes)['id']}, distance double", tile)
    return x.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))).where(F.col("rank") <= k).select("id", "neighbour", "rank", "distance")


def _least(key: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, the leftmost of ties."""
    bound = np.partition(key, k - 1, axis=1)[:, k - 1, None]
    level = np.where(key < bound, 0, np.where(key == bound, 1, 2)).astype(np.int8)
    return np.argsort(level, axis=1, kind="stable")[:, :k]


def centroids(df: DataFrame, label: str) -> DataFrame:
    """Mean vector per label as rows (label, dim, mean)."""
    return df.select(label, F.posexplode("v").alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("mean"))


def assign(df: DataFrame, centers: DataFrame) -> DataFrame:
    """Rows (id, label, squared, v): the nearest of centers(label, c array<double>), k rows, for each row of df(id, v); ties by label.

    The centers are one array beside every row, so nothing is shuffled.
    """
    every = F.broadcast(centers.agg(F.collect_list(F.struct("label", "c")).alias("_all")))
    gap = lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, y: t + y)
    best = F.array_min(F.transform("_all", lambda s: F.struct(gap(s["c"]).alias("squared"), s["label"].alias("label"))))
    return df.crossJoin(every).withColumn("_b", best).select("id", "_b.label", "_b.squared", "v")


def spread_seeds(df: DataFrame, k: int, seed: str = "0") -> DataFrame:
    """k starting centers (label, c) of rows (id, v) as k-means++ draws them: each with odds of its squared distance to the nearest so far.

    A draw is the greatest of log(squared distance) plus Gumbel noise of a hash of seed, round and
    id, so a round is one pass with a maximum, the same in every run. The centers are k rows.
    """
    chosen: list[list[float]] = []
    for i in range(k):
        u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{i}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
        gaps = [F.aggregate(F.zip_with("v", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, y: t + y) for c in chosen]
        least = F.least(*gaps) if len(gaps) > 1 else gaps[0] if gaps else F.lit(1.0)
        draw = F.when(least > 0, F.log(least) - F.log(-F.log(u)))
        best = df.agg(F.max_by(F.col("v"), F.struct(draw, F.col("id"))).alias("v"), F.max(draw).alias("d")).first()
        if best is None or best["d"] is None:
            break  # fewer distinct rows than k
        chosen.append([float(x) for x in best["v"]])
    return df.sparkSession.createDataFrame(list(enumerate(chosen)), "label long, c array<double>")


def kmeans(df: DataFrame, seeds: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Lloyd's algorithm from seeds(label, c) for a fixed number of rounds: (assignment, centers). The centers are k rows."""
    centers = seeds
    for _ in range(rounds):
        placed = assign(df, centers).select("label", F.posexplode("v").alias("dim", "x"))
        means = placed.groupBy("label", "dim").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))
        rows = centers.join(means.withColumnRenamed("c", "_c"), "label", "left").select("label", F.coalesce("_c", "c").alias("c")).collect()
        centers = df.sparkSession.createDataFrame([(r["label"], list(r["c"])) for r in rows], seeds.schema)
    return assign(df, centers).drop("v"), centers


def distance_sums(df: DataFrame, label: str, tile: int = 1024) -> DataFrame:
    """Rows (id, l, m, n, total): number and sum of the Euclidean distances of each row, whose label is l, to the other rows of label m.

    Rows are dealt to tiles of about `tile` vectors; a pair of tiles is one row for a worker, which
    takes a matrix product of it. All pairs are what the measure asks for, the tiles bound memory.
    """
    count = df.count()
    tiles = df.select(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // tile)))).alias("t"), "id", F.col(label).alias("l"), "v").groupBy("t").agg(F.collect_list(F.struct("id", "l", "v")).alias("rows"))
    pairs = tiles.select(F.col("rows").alias("a")).crossJoin(tiles.select(F.col("rows").alias("b"))).repartition(max(1, (-(-count // tile)) ** 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = batch.column("a")[k].as_py(), batch.column("b")[k].as_py()
                x, y = np.array([r["v"] for r in a]), np.array([r["v"] for r in b])
                d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))
                same = np.array([r["id"] for r in a])[:, None] == np.array([r["id"] for r in b])
                d[same] = 0
                labels, at = np.unique([r["l"] for r in b], return_inverse=True)
                one = np.eye(len(labels))[at]
                total, n = d @ one, (~same).astype(float) @ one
                out = [(r["id"], r["l"], m, int(n[i, c]), float(total[i, c])) for i, r in enumerate(a) for c, m in enumerate(labels.tolist()) if n[i, c]]
                yield pa.RecordBatch.from_pydict(dict(zip(("id", "l", "m", "n", "total"), map(list, zip(*out, strict=True)) if out else [[]] * 5, strict=True)), schema=arrow)

    kinds = dict(df.dtypes)
    schema = f"id {kinds['id']}, l {kinds[label]}, m {kinds[label]}, n bigint, total double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return pairs.mapInArrow(run, schema).groupBy("id", "l", "m").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def silhouette(df: DataFrame, label: str) -> DataFrame:
    """Silhouette of each row from Euclidean distances; a singleton's a is 0, so its score is 1."""
    x = distance_sums(df, label).withColumn("d", F.col("total") / F.col("n"))
    s = x.groupBy("id", "l").agg(F.coalesce(F.max(F.when(F.col("l") == F.col("m"), F.col("d"))), F.lit(0.0)).alias("a"), F.min(F.when(F.col("l") != F.col("m"), F.col("d"))).alias("b"))
    return s.select("id", div(F.col("b") - F.col("a"), F.greatest("a", "b")).alias("silhouette"))


def dbscan_core(pairs: DataFrame, points: DataFrame, eps: float, least: int) -> DataFrame:
    """How many points lie within eps of each (itself included) and whether that makes it a core point."""
    near = pairs.where(F.col("distance") <= eps)
    both = near.select(F.col("id_a").alias("id")).union(near.select("id_b"))
    n = both.groupBy("id").agg(F.count("*").alias("k"))
    return points.select("id").join(n, "id", "left").select("id", (F.coalesce("k", F.lit(0)) + 1).alias("neighbours")).withColumn("core", F.col("neighbours") >= least)


def neighbour_counts(df: DataFrame, by: list[str], eps: float, tile: int = 2048) -> DataFrame:
    """How many rows of the same group are within eps of each row (id, v), itself not counted: (id, k), without those that have none."""

    def run(a: tiles.Tile, b: tiles.Tile, same: bool, found: np.ndarray) -> dict:
        x, n = a.field("id"), found.sum(1)
        if not same:
            x, n = pa.concat_arrays([x, b.field("id")]), np.concatenate([n, found.sum(0)])
        return {"id": x.filter(pa.array(n > 0)), "k": n[n > 0]}

    x = tiles.within(df.select(*by, "id", "v"), by, eps, run, f"id {dict(df.dtypes)['id']}, k bigint", tile)
    return x.groupBy("id").agg(F.sum("k").alias("k"))


def density_core(df: DataFrame, by: list[str], eps: float, least: int) -> DataFrame:
    """dbscan_core() of the rows (id, v) within their groups, counted by tiles without a row per pair."""
    n = neighbour_counts(df, by, eps)
    return df.select("id").join(n, "id", "left").select("id", (F.coalesce("k", F.lit(0)) + 1).alias("neighbours")).withColumn("core", F.col("neighbours") >= least)


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information (nats), the entropies and the normalised score of two label columns."""
    n = df.agg(F.count("*").alias("n"))
    j = df.groupBy(a, b).agg(F.count("*").alias("j"))
    j = j.withColumn("ra", F.sum("j").over(W.partitionBy(a))).withColumn("rb", F.sum("j").over(W.partitionBy(b))).crossJoin(F.broadcast(n))
    mi = j.agg(F.sum(F.col("j") / F.col("n") * F.ln(F.col("j") * F.col("n") / (F.col("ra") * F.col("rb")))).alias("mi"))
    entropy = lambda c, name: df.groupBy(c).agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).agg((-F.sum(F.col("k") / F.col("n") * F.ln(F.col("k") / F.col("n")))).alias(name))
    return mi.crossJoin(entropy(a, "entropy_a")).crossJoin(entropy(b, "entropy_b")).withColumn("nmi", div(2 * F.col("mi"), F.col("entropy_a") + F.col("entropy_b")))
