"""What several corpus operators share: staged tables, connected components, word counting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the corpus contracts define it.
SPACE = r"\x20\x09-\x0D"


def work_dir(spark: SparkSession) -> str:
    """The folder for staged tables: a subfolder of spark.checkpoint.dir, which all executors share.

    Where that setting is absent a temporary folder is set, but only under a local master, where
    one machine does all; elsewhere that is an error. The subfolder is deleted when the
    application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def count_runs(text: Column, word: str, other: str) -> Column:
    """Number of maximal runs of the character class body `word`; `other` is its complement.

    One possessive pass replaces each run and what follows it by one character, so no array of
    words is built.
    """
    t = F.coalesce(text, F.lit(""))
    packed = F.regexp_replace(t, f"[{word}]++[{other}]*+", "x")
    return (F.length(packed) - F.length(F.regexp_extract(t, f"^[{other}]*+", 0))).cast("long")


def beside_group(df: DataFrame, key: list[str], aggregates: list[Column], rows: int, spread: str | None = None) -> DataFrame:
    """df with aggregates of each row's group beside it; no task holds the rows of a large group.

    rows: at least the number of rows of df. Of groups with more than a thousandth of that there
    are fewer than a thousand: their aggregates are broadcast, and their rows spread out, by the
    column spread or all of them. Those of the others meet their rows in a shuffle. Null keys are
    groups of their own.
    """
    grouped = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.count("*").alias("_n"), *aggregates)
    added = grouped.columns[len(key) + 1 :]
    grouped = grouped.select(F.xxhash64(*grouped.columns[: len(key)]).alias("_h"), *grouped.columns[: len(key)], "_n", F.struct(*added).alias("_a"))
    same = lambda x: reduce(lambda c, i: c & F.col(key[i]).eqNullSafe(F.col(f"{x}{i}")), range(len(key)), F.lit(True))
    large = grouped.where(F.col("_n") * 1000 > rows).select(*[F.col(f"_k{i}").alias(f"_l{i}") for i in range(len(key))], F.col("_a").alias("_large"))
    out = df.join(F.broadcast(large), same("_l"), "left")
    out = out.withColumn("_at", F.when(F.col("_large").isNull(), F.xxhash64(*key)).otherwise(F.xxhash64(*([spread] if spread else df.columns))))
    out = out.join(grouped, (F.col("_at") == F.col("_h")) & same("_k"), "left")
    return out.select(*df.columns, *[F.when(F.col("_large").isNull(), F.col(f"_a.{c}")).otherwise(F.col(f"_large.{c}")).alias(c) for c in added])


#: Edges in a file of a round of components(), about: a file costs more than these do, most on disks where its mode is set by a process.
ROWS = 100_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (id, component), the smallest id.

    Alternating large-star and small-star rounds of grouped minima, see beside_group(), so no
    node's neighbours meet in one task. Nodes without an edge are absent. Self-loops and repeated
    edges are harmless.
    """
    spark = edges.sparkSession
    e = edges.select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    ).where("u != v").distinct()
    e = staged(e, "edges")
    check = (F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)))
    state = e.agg(*check).first()
    low = [F.min("v").alias("m")]
    for _ in range(max_rounds):
        both = beside_group(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), ["u"], low, 2 * state[0])
        large = both.select(F.when(F.col("v") > F.col("u"), F.col("v")).otherwise(F.col("u")).alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
        small = beside_group(large, ["u"], low, 2 * state[0])
        small = small.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        e = staged(small.coalesce(max(spark.sparkContext.defaultParallelism, state[0] // ROWS)), "stars")
        now = e.agg(*check).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


#: Tables that this Python worker holds, by owner: key, tables, and how many tasks it did since it used them last.
_held: dict[str, list] = {}
#: After so many tasks without a use tables go.
UNUSED = 8


def held(owner: str, key: Any, build: Callable[[], Any]) -> Any:
    """The tables that build() gives for key, one of an owner at a time in a Python worker, until lean tasks don't use them."""
    if owner not in _held or _held[owner][0] != key:
        _held.pop(owner, None)
        _held[owner] = [key, build(), 0]
    mine = _held[owner]
    mine[0], mine[2] = key, 0  # the same object compares fast
    return mine[1]


def drop_unused() -> None:
    """Count a task; drop tables that have gone UNUSED tasks without a use."""
    for owner, mine in list(_held.items()):
        mine[2] += 1
        if mine[2] > UNUSED:
            del _held[owner]


def give_back() -> None:
    """Return memory that this process has freed to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow: workers outlive their tasks, so each gives back at its end what it has freed, and tables long unused.

    Else a worker keeps the most that any earlier task took, and the tables of all operators before.
    """

    @wraps(run)
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_unused()
        try:
            yield from run(batches)
        finally:
            give_back()

    return call


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run, for applyInArrow: after groups of a MB or more what was freed is given back."""

    @wraps(run)
    def call(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes >> 20:
            give_back()
        return out

    return call


def tile_pairs(rows: DataFrame, near: Column, weight: Column, side: int, many: int) -> DataFrame:
    """Rows of (token, set_id, cell, ...) with (one, two, first): each pair of tiles that the item's tile is in, and whether it is one.

    The items of a token's cell are dealt by hash to tiles of about `many` items and `side` in
    weight. near: the cells that linked items can be in, the own one included, as an array. Each
    pair of tiles of a token in such cells is a block to compare, without its items being paired.
    """
    size = F.greatest(F.ceil(F.sum(weight) / side), F.ceil(F.count("*") / many)).cast("int")
    tiles = staged(rows.groupBy(F.col("token").alias("_t"), F.col("cell").alias("_c")).agg(size.alias("_tiles")), "tiles")
    own = rows.join(tiles, (F.col("token") == F.col("_t")) & (F.col("cell") == F.col("_c"))).drop("_t", "_c")
    own = own.withColumn("_own", F.struct("cell", F.pmod(F.xxhash64("set_id"), "_tiles").cast("int").alias("tile"))).drop("_tiles").withColumn("_near", F.explode(near))
    both = own.join(tiles, (F.col("token") == F.col("_t")) & (F.col("_near") == F.col("_c"))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    both = both.withColumn("_other", F.struct(F.col("_near").alias("cell"), F.col("_other").alias("tile")))
    return both.withColumn("one", F.least("_own", "_other")).withColumn("two", F.greatest("_own", "_other")).withColumn("first", F.col("_own") == F.col("one")).drop(
        "_t", "_c", "_tiles", "_near", "_own", "_other", "cell")


#: Items outside a token's largest component that are compared with all others there pair by pair, if not said otherwise.
FEW = 32


def linked_components(met: DataFrame, extras: list[str], allowed: Column, verify: Callable[[DataFrame], DataFrame],
                      blocks: Callable[[DataFrame], DataFrame], rank: str = "0", few: int | None = None) -> DataFrame:
    """Components (id, component) of all pairs of items that share a token, are allowed and pass verify.

    met: rows (token, set_id, *extras). allowed: a condition on a pair, the second item's extras
    named other_*. verify: keeps the linked ones of pairs (a, b). rank: an expression over met,
    least for the items that likely link with most others. Items without a link are absent.

    1. Each token's items are compared with its item of least rank, ties drawn per token by hash.
    2. Where the items of a token are still in several components, those outside its largest
       component are compared with one drawn from that.
    3. Where they still are, and at most `few` (FEW) are outside the largest, these are compared
       with all others there that are allowed.
    4. The rows of the other tokens, with component, go to blocks, which returns links (a, b) that
       connect what is linked within each token.

    So every allowed pair is in one component already or compared, and the pairs are at most
    FEW + 2 times the rows of met: no group is expanded into all its pairs.
    """
    pair = (F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b"))
    other = [F.col("o.set_id").alias("other"), *[F.col(f"o.{x}").alias(f"other_{x}") for x in extras]]
    drawn = lambda first: F.min(F.struct(first.alias("r"), F.xxhash64("token", "set_id").alias("h"), "set_id", *extras)).alias("o")
    spark, tried, member = met.sparkSession, None, None

    def compare(pairs: DataFrame) -> bool:
        """Verify the pairs not tried before; whether components changed."""
        nonlocal tried, member
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        if pairs.isEmpty():
            return False
        tried = pairs if tried is None else tried.union(pairs)
        more = staged(verify(pairs), "links")
        if more.isEmpty():
            return False
        member = joined(more)
        return True

    def joined(more: DataFrame) -> DataFrame:
        """Components with further links: those so far are stars already."""
        return components(more if member is None else more.union(member.select(F.col("id").alias("a"), F.col("component").alias("b"))))

    def unsettled(rows: DataFrame, count: int) -> DataFrame:
        """rows of the tokens whose items are in several components, with component, minor (whether not in the largest), o (one of that) and minors (how many aren't)."""
        if member is None:
            placed = rows.withColumn("component", F.col("set_id"))
        else:
            placed = rows.join(member.select(F.col("id").alias("_id"), F.col("component")), F.col("set_id") == F.col("_id"), "left").drop("_id").withColumn("component", F.coalesce("component", "set_id"))
        placed = staged(placed, "placed")
        held = placed.groupBy("token", "component").agg(F.count("*").alias("c"), drawn(F.lit(0)))
        held = held.groupBy("token").agg(F.count("*").alias("several"), F.sum("c").alias("all"), F.max(F.struct("c", "component", "o")).alias("most")).where("several > 1")
        held = staged(held.select(F.col("token").alias("_t"), (F.col("all") - F.col("most.c")).alias("minors"), F.col("most.component").alias("_c"), F.col("most.o").alias("o"), "all"), "held")
        large = F.broadcast(held.where(F.col("all") * 1000 > count))  # fewer than a thousand
        same = F.col("token") == F.col("_t")
        found = placed.join(large, same).union(placed.join(large, same, "left_anti").join(held.where(F.col("all") * 1000 <= count), same))
        return staged(found.withColumn("minor", F.col("component") != F.col("_c")).drop("_t", "_c", "all"), "open")

    count = met.count()
    beside = beside_group(met, ["token"], [F.count("*").alias("c"), drawn(F.expr(rank))], count).where("c > 1")
    compare(beside.select("set_id", *extras, *other).where((F.col("set_id") != F.col("other")) & allowed).select(*pair))
    open_ = unsettled(met, count)
    if compare(open_.where("minor").select("set_id", *extras, *other).where(allowed).select(*pair)):
        open_ = unsettled(met, count)
    most = FEW if few is None else few
    some = open_.where(F.col("minors") <= most)
    one = some.where("minor").select("token", "set_id", "component", *extras)
    every = some.select("token", F.col("set_id").alias("other"), "minor", F.col("component").alias("other_component"), *[F.col(x).alias(f"other_{x}") for x in extras])
    apart = (F.col("component") != F.col("other_component")) & (~F.col("minor") | (F.col("set_id") < F.col("other")))
    compare(one.join(every, "token").where(apart & allowed).select(*pair))
    rest = open_.where(F.col("minors") > most).drop("o", "minors", "minor")
    if not rest.isEmpty():
        # of tokens with the same items, told by their number and the sum of their hashes, one is enough
        alike = rest.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).alias("h"), F.min("set_id").alias("i"))
        one = alike.groupBy("n", "h", "i").agg(F.min("token").alias("_t")).select("_t")
        more = staged(blocks(rest.join(one, F.col("token") == F.col("_t"), "left_semi")), "links")
        if not more.isEmpty():
            member = joined(more)
    if member is None:
        return spark.createDataFrame([], "id bigint, component bigint")
    return member
