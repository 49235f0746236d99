"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside_group, documents, lean, lean_group, linked_components, staged, tile_pairs
from .shingles import U, set_digest, shingle_sets

#: Bytes of text whose postings go out together, and postings that one range or set partition gets.
BLOCK, SHARE = 6 << 20, 1_000_000
BITS = 48


def need(n, percent: int):  # noqa: ANN001, ANN201
    """The fewest shingles of a set of n that a partner must share: intersection >= percent of the union >= percent of n."""
    return (percent * n + 99) // 100


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def small(tokens: np.ndarray) -> bytes:
    return tokens.astype(U).view(np.uint8).reshape(-1, 8)[:, : BITS // 8].tobytes()


def large(b: bytes) -> np.ndarray:
    x = np.zeros((len(b) // (BITS // 8), 8), np.uint8)
    x[:, : BITS // 8] = np.frombuffer(b, np.uint8).reshape(-1, BITS // 8)
    return x.view(U).ravel()


def cut(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of a sorted array of numbers from 0."""
    if len(part):
        at = np.flatnonzero(np.diff(part, prepend=-1))
        yield from zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=True)


def texts_of(column: pa.Array) -> list[bytes]:
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


#: A shingle is common if one in so many documents or more has it.
COMMON = 100
#: Shingles that are held at once to count them, or on each side of a block of the product, about.
SIDE = 1_000_000


def shingle_ids(docs: DataFrame, text: str, width: int) -> DataFrame:
    """Rows (doc_id, n_shingles, set_id, token, count): the size of each document's set and its digest, or a shingle hash that is common among some documents and how many of these have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "set_id", "token", "count"]

        def common(sets: dict[int, np.ndarray], documents: int, kind: pa.DataType) -> pa.RecordBatch:
            tokens, count = np.unique(np.concatenate([*sets.values()]) >> U(64 - BITS), return_counts=True)
            some = count >= max(2, documents // COMMON + 1)
            none = pa.nulls(int(some.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(none), kind), none, none, pa.array(tokens[some].astype(np.int64)), pa.array(count[some].astype(np.int64))], names=names)

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                kind = b.schema.field("doc_id").type
                n, ids = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                sets, held, documents = {}, 0, 0
                for i, s in shingle_sets(texts_of(b.column("text")), width):
                    n[i], ids[i] = len(s), set_digest(s)
                    documents += 1
                    if int(ids[i]) not in sets:
                        sets[int(ids[i])] = s
                        held += len(s)
                    if held > SIDE:
                        yield common(sets, documents, kind)
                        sets, held, documents = {}, 0, 0
                if sets:
                    yield common(sets, documents, kind)
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(ids), none, none], names=names)

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles bigint, set_id bigint, token bigint, count bigint")


def common_shingles(counted: DataFrame, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the common shingles of rows (token, count).

    Only counts of up to 1024 documents among which a shingle is common are summed. So all that one in 50
    of all documents has are here, and at most COMMON for each shingle of a document of mean length.
    """
    found = counted.where("token is not null").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") * COMMON >= documents).orderBy("token").collect()
    return np.array([r["token"] for r in found], U), np.array([r["c"] for r in found], np.uint32)


def postings(docs: DataFrame, text: str, width: int, ranges: int, parts: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (part, tokens, at, ids, sizes, df): a block's incidence columns of one range of hashes.

    tokens: differences of the sorted 48-bit shingle hashes; at: which of the block's sets each is
    in; ids and sizes: those sets. Equal sets of a block go out once. Common shingles needn't meet,
    as it is known that they are shared: they go out by set as rows of shared(), their parts after
    the ranges, so that no task gets all that have one.
    """
    hot, hot_df = common

    def flush(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids = np.array(list(sets), np.int64)
        sizes = np.array([len(s) for s in sets.values()], np.uint32)
        tokens = np.concatenate([*sets.values()]) >> U(64 - BITS)
        at = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
        rows = []
        if len(hot):
            place = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
            known = hot[place] == tokens
            i, n, t, df = ids[at[known]], sizes[at[known]], tokens[known], hot_df[place[known]]
            rows += [(ranges + p, t, count, i, n, df) for p, i, n, count, t, df in by_set(i, n, t, df, parts)]
            tokens, at = tokens[~known], at[~known]
        order = np.argsort(tokens)
        tokens, at = tokens[order], at[order]
        for p, a, b in cut(((tokens * U(ranges)) >> U(BITS)).astype(np.int64)):
            used, local = np.unique(at[a:b], return_inverse=True)
            rows.append((p, pack(np.diff(tokens[a:b], prepend=U(0))), pack(local.astype(np.uint32)), pack(ids[used]), pack(sizes[used]), None))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32()] + [pa.binary()] * 5, strict=True)],
                                         names=["part", "tokens", "at", "ids", "sizes", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for _, s in shingle_sets(texts_of(whole.slice(at, 256).column(text)), width):
                    if len(s) and (d := set_digest(s)) not in sets:
                        sets[d] = s
                        held += 8 * len(s)
                if held > BLOCK:
                    yield from flush(sets)
                    sets, held = {}, 0
        if sets:
            yield from flush(sets)

    return docs.select(text).mapInArrow(lean(run), "part int, tokens binary, at binary, ids binary, sizes binary, df binary")


def by_set(i: np.ndarray, n: np.ndarray, t: np.ndarray, df: np.ndarray, parts: int) -> list[tuple]:
    """(part, ids, sizes, counts, tokens, df) of the shingles t of sets i, dealt by set."""
    part = (i.view(U) % U(parts)).astype(np.int64)
    order = np.lexsort((t, i, part))
    t, i, n, df, part = t[order], i[order], n[order], df[order], part[order]
    rows = []
    for p, a, b in cut(part):
        begin = np.flatnonzero(np.diff(i[a:b], prepend=i[a] ^ 1))
        rows.append((p, pack(i[a:b][begin]), pack(n[a:b][begin]), pack(np.diff(begin, append=b - a).astype(np.uint32)), pack(t[a:b]), pack(df[a:b])))
    return rows


def shared(posted: DataFrame, ranges: int, parts: int) -> DataFrame:
    """Rows (part, ids, sizes, counts, tokens, df): shingles of two sets or more, dealt by set.

    The number of sets that have a shingle is its df; shingles of a single set can't overlap and
    end here. Common ones, which are dealt by set already, are passed on.
    """
    names = ["part", "ids", "sizes", "counts", "tokens", "df"]

    def run(table: pa.Table) -> pa.Table:
        if (p := table.column("part")[0].as_py()) >= ranges:
            return pa.table([pa.array([p - ranges] * table.num_rows, pa.int32()), *(table.column(c) for c in ("ids", "sizes", "at", "tokens", "df"))], names=names)
        tokens, ids, sizes = [], [], []
        for row in table.select(["tokens", "at", "ids", "sizes"]).to_pylist():
            at = unpack(row["at"], np.uint32)
            tokens.append(np.cumsum(unpack(row["tokens"], U)))
            ids.append(unpack(row["ids"], np.int64)[at])
            sizes.append(unpack(row["sizes"], np.uint32)[at])
        t, i, n = np.concatenate(tokens), np.concatenate(ids), np.concatenate(sizes)
        del tokens, ids, sizes
        order = np.argsort(t, kind="stable")
        s = t[order]
        again = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        again[1:] |= same
        again[:-1] |= same
        order = order[again]
        t, i, n = t[order], i[order], n[order]
        order = np.lexsort((i, t))
        t, i, n = t[order], i[order], n[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1])
        t, i, n = t[new], i[new], n[new]
        first = np.flatnonzero(np.diff(t, prepend=U(1 << 63)))
        df = np.diff(first, append=len(t))
        df = np.repeat(df, df)
        keep = df > 1
        t, i, n, df = t[keep], i[keep], n[keep], df[keep].astype(np.uint32)
        rows = by_set(i, n, t, df, parts)
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32()] + [pa.binary()] * 5, strict=True)], names=names)

    return posted.groupBy("part").applyInArrow(lean_group(run), "part int, ids binary, sizes binary, counts binary, tokens binary, df binary")


def candidates(dealt: DataFrame, percent: int) -> DataFrame:
    """Rows (set_id, n, shared, tokens, prefix) of the sets that can have a partner at all.

    A set needs need(n) shared shingles. In order of df, single ones first, two linked sets share
    one of their first n - need(n) + 1 shingles; `prefix` is what of these is shared, as
    array<struct<token, pos>>.
    """

    def run(table: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for row in table.select(["ids", "sizes", "counts", "tokens", "df"]).to_pylist():
            counts = unpack(row["counts"], np.uint32)
            for c, x in zip(cols, (np.repeat(unpack(row["ids"], np.int64), counts), np.repeat(unpack(row["sizes"], np.uint32), counts),
                                   unpack(row["tokens"], U), unpack(row["df"], np.uint32)), strict=True):
                c.append(x)
        i, n, t, df = map(np.concatenate, cols)
        order = np.lexsort((t, i))
        i, n, t, df = i[order], n[order].astype(np.int64), t[order], df[order]
        new = np.ones(len(i), bool)  # equal sets of several blocks
        new[1:] = (i[1:] != i[:-1]) | (t[1:] != t[:-1])
        i, n, t, df = i[new], n[new], t[new], df[new]
        begin = np.flatnonzero(np.diff(i, prepend=i[0] ^ 1))
        count = np.diff(begin, append=len(i))
        out: list[tuple] = []
        for a, c in zip(begin, count, strict=True):
            size = int(n[a])
            if c < need(size, percent):
                continue
            tokens, rare = t[a : a + c], np.lexsort((t[a : a + c], df[a : a + c]))
            single = size - c
            first = tokens[rare[: size - need(size, percent) + 1 - single]]
            out.append((int(i[a]), size, int(c), small(np.sort(tokens)), [{"token": int(x), "pos": single + k} for k, x in enumerate(first)]))
        cols2 = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int64())]))]
        return pa.table([pa.array(c, k) for c, k in zip(cols2, kinds, strict=True)], names=["set_id", "n", "shared", "tokens", "prefix"])

    return dealt.groupBy("part").applyInArrow(lean_group(run), "set_id bigint, n bigint, shared bigint, tokens binary, prefix array<struct<token:bigint,pos:bigint>>")


def can_link(percent: int) -> Column:
    """Size-derived bounds of a pair that meets at positions pos and other_pos.

    At the first shingle in order that both have, their overlap is at most the lesser number of
    shingles from there on. Later common ones needn't pass.
    """
    return F.expr(f"100 * least(n, other_n) >= {percent} * greatest(n, other_n) and (100 + {percent}) * least(n - pos, other_n - other_pos) >= {percent} * (n + other_n)")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap count reaches percent of the union.

    A batch of pairs is a block of the product: the incidence rows of its right sets are one
    sorted list of (row, shingle), in which all shingles of the left sets are looked up at once;
    the hits are summed by row.
    """
    side = lambda k: sets.select(F.col("set_id").alias(k), F.col("n").alias(f"n{k}"), F.col("tokens").alias(f"t{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                left, right = ([large(x) for x in b.column(c).to_pylist()] for c in ("ta", "tb"))
                na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
                overlap = np.zeros(b.num_rows, np.int64)
                for k in range(0, b.num_rows, 1 << 15):  # rows of a block fit above the hash bits
                    row = lambda x: np.repeat(np.arange(len(x), dtype=U), [len(y) for y in x]) << U(BITS)
                    la, rb = left[k : k + (1 << 15)], right[k : k + (1 << 15)]
                    keys, wanted = np.concatenate(rb) | row(rb), np.concatenate(la) | row(la)
                    hit = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
                    overlap[k : k + len(la)] = np.bincount((wanted >> U(BITS)).astype(np.int64), weights=hit, minlength=len(la)).astype(np.int64)
                yes = 100 * overlap >= percent * (na + nb - overlap)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(yes)), b.column("b").filter(pa.array(yes))], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ta", "tb").mapInArrow(lean(run), "a bigint, b bigint")


#: Sets that a block of the product has on each side, about, and how many of a shingle's sets are compared pair by pair instead:
#: sizes and positions leave few pairs of these.
ROWS, FEW = 384, 1024
#: Sets that have a shingle from which on its column counts as dense.
DENSE = 32


def product(tokens: list[np.ndarray]) -> np.ndarray:
    """Overlaps of all pairs of sets: the incidence matrix by its transpose, rare columns pair by pair, dense ones in blocks."""
    n = len(tokens)
    row = np.repeat(np.arange(n), [len(t) for t in tokens])
    t = np.concatenate(tokens)
    by = np.argsort(t, kind="stable")
    t, row = t[by], row[by]
    begin = np.flatnonzero(np.diff(t, prepend=t[:1] ^ U(1)) != 0)
    df = np.diff(begin, append=len(t))
    out = np.zeros((n, n), np.float32)  # counts under 2 ** 24
    rare = np.repeat(df < DENSE, df)
    a, r = t[rare], row[rare]
    for d in range(1, min(DENSE, len(a))):
        same = np.flatnonzero(a[d:] == a[:-d])
        if not len(same):
            break
        np.add.at(out, (r[same], r[same + d]), 1)
    out += out.T
    column = np.repeat(np.cumsum(df >= DENSE) - 1, df)[~rare]
    r = row[~rare]
    for k in range(0, int((df >= DENSE).sum()), 1024):
        here = slice(*np.searchsorted(column, [k, k + 1024]))
        x = np.zeros((n, 1024), np.float32)
        x[r[here], column[here] - k] = 1
        out += x @ x.T
    return out.astype(np.int32)


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all linked sets within each token of rows (token, set_id, n).

    The sets of a token are parted by size, so that linked ones are in one band or in neighbouring
    bands, and bands by hash into tiles of bounded volume; each pair of tiles that sizes allow is a
    block of the product of its own, which gives back a spanning forest, never its pairs.
    """
    band = F.struct(F.floor(F.log("n") / float(np.log(100.1 / percent))).cast("int").alias("x"))
    near = F.array(*[F.struct((F.col("cell.x") + d).alias("x")) for d in (-1, 0, 1)])
    rows = tile_pairs(rows.select("token", "set_id", "n", band.alias("cell")), near, F.col("n"), SIDE, ROWS)
    rows = rows.join(sets.select(F.col("set_id").alias("_s"), F.col("tokens")), F.col("set_id") == F.col("_s"))

    def run(block: pa.Table) -> pa.Table:
        ids, size = block.column("set_id").to_numpy(), block.column("n").to_numpy()
        overlap = product([large(x) for x in block.column("tokens").to_pylist()])
        a, b = np.nonzero(np.triu(100 * overlap >= percent * (size[:, None] + size[None, :] - overlap), 1))  # of tiles with themselves too: a link less for other blocks
        root = np.arange(len(ids))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = find(i), find(j)
            root[max(i, j)] = min(i, j)
        top = np.array([find(i) for i in range(len(ids))], np.int64)
        some = np.flatnonzero(top != np.arange(len(ids)))
        return pa.table({"a": ids[top[some]], "b": ids[some]})

    return rows.select("token", "set_id", "one", "two", "n", "tokens").groupBy("token", "one", "two").applyInArrow(lean_group(run), "a bigint, b bigint")


def jaccard_components(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, set_id, component_id), one per row of docs.

    Documents link when 100 * |intersection| >= percent * |union| of their sets of `width`-word
    shingles (words are runs of non-space bytes, A-Z taken as a-z); component_id is the smallest
    doc_id reachable by links. Equal sets are one class from the start. Then, in blocks:

    1. Shingle hashes with their sets, by range of hash; those of a single set end there. Shingles
       that are common from the start don't meet, see common_shingles().
    2. By set: sets with too few shared shingles for any partner end; the others give a prefix.
    3. Sets that share a prefix shingle are compared, first with the one of fewest single shingles,
       if sizes and positions allow a link, then where they are still in several components; see
       linked_components(). Overlaps are counted in blocks of the incidence product, where many
       sets that aren't linked share a shingle by tiles of them. Every pair that can link is in
       one component already or counted.

    Shingles are told apart by 64-bit hashes, in the product by 48 of these bits together with the
    pair. Null and empty texts and texts of spaces have no shingles and link with nothing. Repeated rows and ties
    share a component; a null doc_id is never a smallest one unless its component has no other.
    Very long texts are read whole. Other columns are not read, whatever their names. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    every = staged(shingle_ids(docs, text, width), "sets")
    ids = every.where("token is null").drop("token", "count")
    total, count = ids.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))
    dealt = shared(postings(docs, text, width, parts, parts, common_shingles(every, count)), parts, parts)
    sets = staged(candidates(dealt, percent), "candidates")
    met = staged(sets.select("set_id", "n", "shared", F.explode("prefix").alias("p")).select("set_id", "n", "shared", "p.token", "p.pos"), "prefixes")
    member = linked_components(met, ["n", "shared", "pos"], can_link(percent), lambda pairs: linked(pairs, sets, percent),
                               lambda rows: block_links(rows, sets, percent), "n - shared", FEW)
    placed = ids.join(member, ids.set_id == member.id, "left").select("doc_id", "n_shingles", "set_id", F.coalesce("component", "set_id").alias("_c"))
    placed = staged(placed, "documents")
    some = beside_group(placed.where("n_shingles > 0"), ["_c"], [F.min("doc_id").alias("component_id")], count)
    return some.select("doc_id", "n_shingles", "set_id", "component_id").union(
        placed.where("n_shingles = 0").select("doc_id", "n_shingles", "set_id", F.col("doc_id").alias("component_id")))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(documents(spark, sf_dir).select("doc_id", "text"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")
