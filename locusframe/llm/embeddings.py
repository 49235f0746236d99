"""Embedding near-dedup over a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside_group, components, staged

#: How many nearest reference points describe a vector, and how many of them two vectors must share.
NEAREST, SHARED = 6, 3
#: Reference points: the square root of the number of vectors, within these bounds.
FEWEST, MOST = 256, 1 << 15
#: Vectors of a list that one task compares with as many.
TILE = 8192


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, padded by zeros to width; their lengths) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out, size


def pivots(classes: DataFrame, count: int, width: int) -> np.ndarray:
    """`count` vectors at most, those that hash lowest, as unit vectors: a bounded sample of the table."""
    rows = classes.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(count).collect()
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r[0])] = r[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def hooked(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, given those so far and further links (a, b)."""
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return top
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (up := top[top]).tobytes() != top.tobytes():
            top = up


def near_vectors(vectors: DataFrame, threshold: float = 0.98, count: int | None = None, nearest: int = NEAREST, share: int = SHARED, tile: int = TILE) -> DataFrame:
    """Rows (vec_id, label, n_links, component_id, kept), one per row of vectors(vec_id, embedding, label).

    Two vectors link when their labels are equal and not null, they are equally long, their cosine in double precision is
    at least `threshold` and they share at least `share` of their `nearest` nearest of `count`
    pivots (as many as the square root of the distinct vectors, 256 to 32768). n_links counts the other
    vectors linked directly, component_id is the smallest vec_id
    reachable by links, kept says that it is the vector's own.

    Equal vectors of a label are one class from the start. Pivots are put in order, those with the
    shortest lists first, and a class is posted to the inverted lists of its first
    nearest - share + 1 pivots: the first pivot that two vectors share is among them, and in its
    list they are compared. A long list is cut into tiles and each pair of tiles is a task of its
    own. Lists give back counts and the edges of a spanning forest, never pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without
    label, link with nothing: their n_links is 0 and component_id their own. A null vec_id is
    never a smallest one unless its component has no other. Repeated rows count as other vectors.
    An empty table gives an empty result; other columns are not read, whatever their names.
    """
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = staged(vectors.select("vec_id", "label", "embedding").withColumn("fine", F.coalesce(fine, F.lit(False))), "vectors")
    classes = rows.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("size"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    points = pivots(classes, count or max(FEWEST, min(MOST, int(n**0.5))), width)
    near, common = min(nearest, len(points)), min(share, len(points))

    def describe(batches):  # noqa: ANN001, ANN202
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                x, _ = matrix(b.column("embedding"), width)
                far = -(x @ points.T)
                some = np.argpartition(far, near - 1, axis=1)[:, :near] if near < len(points) else np.tile(np.arange(near), (len(x), 1))
                by = np.lexsort((some, np.take_along_axis(far, some, axis=1)))
                order = np.take_along_axis(some, by, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("label"), b.column("size"), b.column("embedding"), pa.array(list(order), pa.list_(pa.int32()))], names=["cid", "label", "size", "embedding", "nearest"])

    kinds = dict(rows.dtypes)
    index = staged(classes.select("cid", "label", "size", "embedding").mapInArrow(
        describe, f"cid bigint, label {kinds['label']}, size bigint, embedding {kinds['embedding']}, nearest array<int>"), "index")
    held = {r["p"]: r["count"] for r in index.select(F.explode("nearest").alias("p")).groupBy("p").count().collect()}  # one row per pivot
    rank = np.empty(len(points), np.int64)
    rank[sorted(range(len(points)), key=lambda p: (held.get(p, 0), p))] = np.arange(len(points))

    def post(batches):  # noqa: ANN001, ANN202
        for b in batches:
            order = np.sort(rank[b.column("nearest").flatten().to_numpy().reshape(b.num_rows, near)], axis=1)
            leads = pa.array(list(order[:, : near - common + 1]), pa.list_(pa.int64()))
            marks = pa.array([x.astype(np.int32).tobytes() for x in order], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("cid", "label", "size", "embedding")] + [marks, leads], names=["cid", "label", "size", "embedding", "marks", "leads"])

    posted = index.mapInArrow(post, f"cid bigint, label {kinds['label']}, size bigint, embedding {kinds['embedding']}, marks binary, leads array<bigint>") if near else index.selectExpr("*", "cast(null as binary) as marks", "cast(nearest as array<bigint>) as leads").drop("nearest")
    posted = posted.withColumn("lead", F.explode("leads")).drop("leads").withColumn("dim", F.size("embedding"))
    lengths = staged(posted.groupBy("label", "dim", "lead").agg(F.count("*").alias("length")).where("length > 1"), "lengths")
    posted = posted.join(lengths, ["label", "dim", "lead"]).withColumn("tiles", F.ceil(F.col("length") / tile).cast("int")).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", "lead", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"), "tile", "cid", "size", "embedding", "marks")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        dim, lead, first, second = (k.as_py() for k in key[1:])
        x, _ = matrix(table.column("embedding"), dim)
        norm = np.sqrt((x * x).sum(axis=1))
        part, cid, weight = (table.column(c).to_numpy() for c in ("tile", "cid", "size"))
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.int32).reshape(len(x), near)
        left, right = np.flatnonzero(part == first), np.flatnonzero(part == second)
        links, top = np.zeros(len(x), np.int64), np.arange(len(x))
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            i, j = np.nonzero(x[own] @ x[right].T >= threshold * np.outer(norm[own], norm[right]) * (1 - 1e-12))
            i, j = own[i], right[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 18):
                a, b = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
                both = (marks[a][:, :, None] == marks[b][:, None, :]).any(axis=2)
                # the pair belongs to the list of the first pivot that it shares
                mine = (both.sum(axis=1) >= common) & (marks[a, both.argmax(axis=1)] == lead)
                a, b = a[mine], b[mine]
                exact = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
                a, b = a[exact], b[exact]
                links += np.bincount(a, weight[b], len(x)).astype(np.int64) + np.bincount(b, weight[a], len(x)).astype(np.int64)
                top = hooked(top, a, b)
        some = np.flatnonzero(links)
        return pa.table({"cid": cid[some], "links": links[some], "head": cid[top[some]]}, schema=pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("head", pa.int64())]))

    found = staged(posted.groupBy("label", "dim", "lead", "first", "second").applyInArrow(compare, "cid bigint, links bigint, head bigint"), "links")
    member = components(found.select(F.col("cid").alias("a"), F.col("head").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = classes.join(counts, "cid", "left").join(member, classes.cid == member.id, "left").select(
        "label", "embedding", "low", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component"))
    placed = beside_group(staged(placed, "placed"), ["component"], [F.min("low").alias("component_id")], n).select(
        "label", "embedding", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id")
    good = rows.where("fine").join(placed, ["label", "embedding"]).select("vec_id", "label", "n_links", "component_id")
    alone = rows.where("not fine").select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", "kept")
