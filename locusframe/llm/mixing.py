"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, count_runs, documents, staged


def water_fill(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Add weight and target to rows (source, source_size, n).

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating. Targets
    share the sum of all sizes by weight and stop at cap times the source's size; the excess goes
    to the others by weight. Ordered by cap * size / weight, the sources before the first one
    whose share fits are capped and the rest share what is left: one pass of running sums.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("pos", F.row_number().over(order))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]),
                                       ((F.col("pos") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap)
    ratio = W.orderBy((F.col("most") / F.col("w")).asc(), F.col("pos").asc())
    everything = W.partitionBy()
    s = (s.withColumn("before", F.coalesce(F.sum("most").over(ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("w_rest", F.sum("w").over(ratio.rowsBetween(0, W.unboundedFollowing)))
         .withColumn("rank", F.row_number().over(ratio))
         .withColumn("all_size", F.sum("source_size").over(everything)))
    fits = (F.col("all_size") - F.col("before")) * F.col("w") <= F.col("most") * F.col("w_rest")
    s = s.withColumn("first", F.min(F.when(fits, F.struct("rank", "before", "w_rest"))).over(everything))
    shared = (F.col("w") * (F.col("all_size") - F.col("first.before"))).cast("double") / F.col("first.w_rest")
    return s.withColumn("target", F.when(F.col("rank") < F.col("first.rank"), F.col("most").cast("double")).otherwise(shared)).select(
        "source", "pos", "source_size", "n", "target", "all_size")


def sainte_lague(items: DataFrame, group: list[str], order: str, votes: str, seats: Column) -> DataFrame:
    """Add quota: seats of each group go one by one to the highest votes / (2 * taken + 1).

    Rounded shares differ from the result by at most half the number of items in sum, so only
    quotients within that difference of an item's rounded share are ranked, not all of them.
    Ties go to the smaller order. Groups without votes get 0.
    """
    part = W.partitionBy(*group)
    x = items.withColumn("_seats", seats.cast("long")).withColumn("_all", F.sum(votes).over(part))
    share = F.when(F.col("_all") > 0, F.floor(F.col(votes).cast("double") * F.col("_seats") / F.col("_all") + 0.5)).otherwise(F.lit(0))
    x = x.withColumn("_r", share.cast("long")).withColumn("_diff", F.when(F.col("_all") > 0, F.col("_seats") - F.sum("_r").over(part)).otherwise(F.lit(0)))
    x = (x.withColumn("_lo", F.greatest(F.lit(0), F.col("_r") + F.least(F.lit(0), F.col("_diff"))))
         .withColumn("_hi", F.col("_r") + F.greatest(F.lit(0), F.col("_diff"))))
    x = x.withColumn("_left", F.when(F.col("_all") > 0, F.col("_seats") - F.sum("_lo").over(part)).otherwise(F.lit(0)))
    tries = x.where("_hi > _lo").select(*group, order, votes, "_left", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_k"))
    best = W.partitionBy(*group).orderBy((F.col(votes).cast("double") / (2 * F.col("_k") + 1)).desc(), F.col(order).asc(), F.col("_k").asc())
    won = (tries.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left")
           .groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(order).alias("_o")).agg(F.count("*").alias("_won")))
    on = F.col(order) == F.col("_o")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return x.join(won, on, "left").withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0))).drop(
        "_seats", "_all", "_r", "_diff", "_lo", "_hi", "_left", "_o", "_won", *[f"_g{i}" for i in range(len(group))])


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 16, seed: int = 17,
        shard_rows: int = 1024, payload: str | None = None) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken[, payload]) of docs(doc_id, text, source).

    Size is the number of `[^\\x20\\x09-\\x0D]+` runs of the text. Each source's words are dealt to
    shards of about `shard_rows` documents by a seeded hash of doc_id, lined up in hash order and cut into blocks
    of `block` words. Sainte-Lague gives every source a number of blocks near its target and every
    shard its part; a shard passes all its blocks quota // blocks times and takes the rest once
    more at seeded, evenly spaced places. A document's `taken` is the words of those blocks that
    are its own, repeats counted: at most cap times its size.

    Null text or no word: size 0, taken 0. Null source is a source of its own, ordered last. A
    null doc_id hashes as the word null. Repeated rows are mixed one by one. Very long texts are
    counted whole. An empty table gives an empty table. The sources, and the shards of one source,
    are lined up in one task each: rows of a few numbers. Other columns of docs are not read, whatever their names, except the struct named by payload.
    """
    keep = [payload] if payload else []
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = staged(docs.select("doc_id", "source", count_runs(F.col("text"), f"^{SPACE}", SPACE).alias("size"), key.alias("key"), *keep), "sizes")
    src = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    src = water_fill(src, weights, cap).withColumn("one", F.lit(1))
    src = sainte_lague(src, ["one"], "pos", "target", F.floor(F.col("all_size") / block + 0.5))
    src = src.select(F.col("source").alias("s_source"), "pos", "source_size", "target", F.col("quota").alias("blocks"),
                     F.ceil(F.col("n") / shard_rows).alias("n_shards"))
    src = staged(src, "sources")
    shard = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("n_shards")
    d = d.join(src, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("shard", shard)
    parts = d.groupBy("pos", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    parts = sainte_lague(parts, ["pos"], "shard", "shard_size", F.col("blocks"))
    m = F.ceil(F.col("shard_size") / block).cast("long")
    parts = parts.where("shard_size > 0").select(
        F.col("pos").alias("p_pos"), F.col("shard").alias("p_shard"), m.alias("m"), F.least(F.col("quota"), m * cap).alias("q"))
    parts = parts.withColumn("offset", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "p_pos", "p_shard")), 1, 8), 16, 10).cast("long") % F.col("m"))
    line = W.partitionBy("pos", "shard").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("end", F.sum("size").over(line))
    d = d.join(parts, (F.col("pos") == F.col("p_pos")) & (F.col("shard") == F.col("p_shard")), "left")
    whole = F.expr("q div m")

    def chosen(k: str) -> str:
        return f"((({k}) + offset) * (q % m)) div m - (offset * (q % m)) div m"

    def words(x: str) -> Column:
        k = f"(({x}) div {block})"
        return F.expr(f"{block} * ({chosen(k)}) + (({x}) % {block}) * (({chosen(k + ' + 1')}) - ({chosen(k)}))")

    taken = whole * F.col("size") + words("end") - words("end - size")
    return d.select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.when(F.col("size") > 0, taken), F.lit(0)).cast("long").alias("taken"), *keep)


def copies(mixed: DataFrame, seed: int = 17, rows: int = 4096) -> DataFrame:
    """Rows (doc_id, source, size, times) of mix's output: how often each document comes as a whole, 0 to 3.

    Rows alike in the three first columns are one item and come equally often. Along each source's
    items, most words first, times is the step of the rounded running sum of taken / size. So a
    source's words differ from its taken ones by at most half of its longest item, up to `rows` items
    of about one length. Items of about one length are one part of the line, more than `rows` of
    them several by hash; a part's start comes from the sums of the parts before it. Shares are
    whole numbers of 2^-20, so the sums are exact in any order.
    """
    unit = 1 << 20
    x = mixed.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("c")).where("taken > 0")
    x = x.select("doc_id", "source", "size", (F.col("c") * F.col("size")).alias("words"), F.expr(f"taken * {unit} div (c * size)").alias("x"))
    x = staged(x.withColumn("band", F.floor(16 * F.log2("words")).cast("int")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")), "items")
    parts = x.groupBy(F.col("source").alias("s"), F.col("band").alias("b")).agg(F.ceil(F.count("*") / rows).cast("long").alias("parts"))
    x = x.join(F.broadcast(parts), F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b"))).withColumn("part", F.pmod("h", "parts")).drop("s", "b")
    line = W.partitionBy("s").orderBy(F.col("b").desc(), "p").rowsBetween(W.unboundedPreceding, -1)
    start = x.groupBy(F.col("source").alias("s"), F.col("band").alias("b"), F.col("part").alias("p")).agg(F.sum("x").alias("of_part"))
    start = start.withColumn("start", F.coalesce(F.sum("of_part").over(line), F.lit(0)))
    x = x.join(F.broadcast(start), F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (F.col("part") == F.col("p")))
    within = W.partitionBy("source", "band", "part").orderBy(F.col("words").desc(), "h", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("end", F.col("start") + F.sum("x").over(within) + unit // 2)
    return x.select("doc_id", "source", "size", F.expr(f"cast(end div {unit} - (end - x) div {unit} as int)").alias("times"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


_SIZE = r"length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*', 'x', 'g')) - length(regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*'))"


def _lague(table: str, group: str, order: str, votes: str, seats: str, name: str) -> str:
    return f"""
{name}_a as (select *, cast({seats} as bigint) as _seats, sum({votes}) over (partition by {group}) as _all from {table}),
{name}_b as (select *, case when _all > 0 then cast(floor(cast({votes} as double) * _seats / _all + 0.5) as bigint) else 0 end as _r from {name}_a),
{name}_c as (select *, case when _all > 0 then _seats - sum(_r) over (partition by {group}) else 0 end as _diff from {name}_b),
{name}_d as (select *, greatest(0, _r + least(0, _diff)) as _lo, _r + greatest(0, _diff) as _hi from {name}_c),
{name}_e as (select *, case when _all > 0 then _seats - sum(_lo) over (partition by {group}) else 0 end as _left from {name}_d),
{name}_f as (select {group}, {order}, {votes}, _left, unnest(generate_series(cast(_lo as bigint), cast(_hi - 1 as bigint))) as _k from {name}_e where _hi > _lo),
{name}_g as (select *, row_number() over (partition by {group} order by cast({votes} as double) / (2 * _k + 1) desc, {order}, _k) as _rank from {name}_f),
{name}_h as (select {group} as _g, {order} as _o, count(*) as _won from {name}_g where _rank <= _left group by 1, 2),
{name} as (select e.*, _lo + coalesce(_won, 0) as quota from {name}_e e left join {name}_h h on e.{group} = h._g and e.{order} = h._o)"""


def _chosen(k: str) -> str:
    return f"((({k}) + off) * (q % m)) // m - (off * (q % m)) // m"


def _words(x: str) -> str:
    k = f"(({x}) // 16)"
    return f"(16 * ({_chosen(k)}) + (({x}) % 16) * (({_chosen(k + ' + 1')}) - ({_chosen(k)})))"


ORACLE = f"""
with d as (select doc_id, source, cast({_SIZE} as bigint) as size, md5('17:' || coalesce(cast(doc_id as varchar), 'null')) as key from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size, count(*) as n from d group by source),
s1 as (select *, row_number() over (order by source nulls last) as pos from s0),
s2 as (select *, (pos - 1) % 3 + 1 as w, source_size * 3 as most, 1 as one from s1),
s3 as (select *, coalesce(sum(most) over (order by most / w, pos rows between unbounded preceding and 1 preceding), 0) as before,
  sum(w) over (order by most / w, pos rows between current row and unbounded following) as w_rest,
  row_number() over (order by most / w, pos) as rk, sum(source_size) over () as all_size from s2),
s4 as (select *, min(case when (all_size - before) * w <= most * w_rest then rk end) over () as frk from s3),
s5 as (select s4.*, case when s4.rk < s4.frk then cast(s4.most as double) else cast(s4.w * (s4.all_size - f.before) as double) / cast(f.w_rest as double) end as target
  from s4, (select before, w_rest from s4 where rk = frk) f),
{_lague("s5", "one", "pos", "target", "floor(all_size / 16 + 0.5)", "s6")},
s7 as (select source as s_source, pos, source_size, target, quota as blocks, cast(ceil(n / 1024) as bigint) as n_shards from s6),
d1 as (select d.*, s7.*, cast('0x' || substr(key, 1, 8) as bigint) % n_shards as shard from d join s7 on d.source is not distinct from s7.s_source),
p0 as (select pos, shard, cast(sum(size) as bigint) as shard_size, min(blocks) as blocks from d1 group by pos, shard),
{_lague("p0", "pos", "shard", "shard_size", "blocks", "p1")},
p2 as (select pos as p_pos, shard as p_shard, cast(ceil(shard_size / 16) as bigint) as m, cast(quota as bigint) as quota from p1 where shard_size > 0),
p3 as (select *, least(quota, m * 3) as q, cast('0x' || substr(md5('17:' || p_pos || ':' || p_shard), 1, 8) as bigint) % m as off from p2),
d2 as (select *, cast(sum(size) over (partition by pos, shard order by key, doc_id, size rows between unbounded preceding and current row) as bigint) as e from d1)
select doc_id, size, cast(source_size as bigint) as source_size, target,
  cast(coalesce(case when size > 0 then (q // m) * size + {_words("e")} - {_words("e - size")} end, 0) as bigint) as taken
from d2 left join p3 on d2.pos = p3.p_pos and d2.shard = p3.p_shard
"""
