"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, linked_components, staged, tile_pairs
from .jaccard import cut, pack, texts_of, unpack
from .repeats import SHARE, bucket_of, keys_of, opened, packed
from .shingles import PIECE, U, _stream, mixed, powers

KIND, PLACE_IN = (U(x) for x in _stream(21, 2))
#: Keys of lines that go out together, and most words of the bit map that marks wanted lines (8 MB): 4 for each, a power of two.
HELD, WORDS = 3_000_000, 1 << 20
#: Classes of code points that are counted to rule pairs out.
LETTERS = 12


def line_id(line: bytes) -> int:
    """Spark's xxhash64 of the line."""
    return int(np.uint64(xxhash.xxh64_intdigest(line, 42)).astype(np.int64))


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes [edits + 1, n] of the even partition of lines of these lengths; longer segments come last."""
    parts = edits + 1
    short, longer = length // parts, length % parts
    size = np.array([short + (k >= parts - longer) for k in range(parts)])
    return np.cumsum(size, axis=0) - size, size


def points_of(line: bytes) -> str:
    """The line's code points; each byte that isn't UTF-8 is one of its own kind."""
    return line.decode(errors="surrogateescape")


def numbers(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def line_keys(lines: list[bytes], edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line index, key, whether it is an index key) of lines, group by group."""
    group: list[int] = []
    size = 0
    for i, x in enumerate(lines):
        group.append(i)
        size += len(x)
        if size >= PIECE or i == len(lines) - 1:
            text = [points_of(lines[k]) for k in group]
            row, key, kind = segment_keys(numbers("".join(text)), np.array([len(x) for x in text]), edits)
            yield np.array(group)[row], key, kind
            group, size = [], 0


def segment_keys(points: np.ndarray, length: np.ndarray, edits: int) -> tuple[np.ndarray, ...]:
    """(index, key, whether it is an index key) of strings of these lengths, one after the other in points.

    A string is indexed by its edits + 1 segments under its length; it probes the indexes of all
    lengths up to `edits` below its own with the substrings that the k-th segment can have moved
    to: at most k places by edits on its left and at most edits - k by those on its right.
    """
    points = points.astype(U)
    begin = np.cumsum(length) - length
    up, down = powers(len(points))
    sums = np.empty(len(points) + 1, U)
    sums[0] = 0
    np.cumsum(mixed(points + U(1)) * up[: len(points)], out=sums[1:])
    found: list[tuple] = []

    def add(which: np.ndarray, start: np.ndarray, size: np.ndarray, of: np.ndarray, k: int, indexed: bool) -> None:
        a = begin[which] + start
        h = (sums[a + size] - sums[a]) * down[a] + of.astype(U) * KIND + np.array([k], U) * PLACE_IN
        found.append((which, mixed(h), np.full(len(which), indexed)))

    for below in range(edits + 1):
        which = np.flatnonzero(length - below > edits)
        of = length[which] - below
        starts, sizes = segments(of, edits)
        for k in range(edits + 1):
            if not below:
                add(which, starts[k], sizes[k], of, k, True)
            for shift in range(max(-k, below - (edits - k)), min(k, below + edits - k) + 1):
                place = starts[k] + shift
                ok = (place >= 0) & (place + sizes[k] <= length[which])
                if below or shift:  # the line's own segments are index keys already
                    add(which[ok], place[ok], sizes[k][ok], of[ok], k, False)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def plain_distance(a: list[int], b: list[int]) -> int:
    """Edit distance row by row, for strings no longer than the band is wide."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edit_within(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair of code-point arrays is at most `edits`.

    Hyyro's banded bit-parallel recurrence, all pairs at once: 64-bit vertical differences that
    slide down one row per column; the distance is followed along the band's lowest diagonal and
    then along the last row. Only the 2 * edits + 1 rows of the band are matched.
    """
    n = len(left)
    m, w = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    out = np.abs(m - w) <= edits
    lanes = np.flatnonzero(out & (m > edits) & (w > edits))
    for i in np.flatnonzero(out & ((m <= edits) | (w <= edits))):
        out[i] = plain_distance(left[i].tolist(), right[i].tolist()) <= edits
    lanes = lanes[np.argsort(w[lanes], kind="stable")]
    at = 0
    while at < len(lanes):
        end = at + 1
        while end < len(lanes) and (end - at + 1) * (w[lanes[end]] + 2 * edits) <= 1 << 21:
            end += 1
        out[lanes[at:end]] = _banded([left[i] for i in lanes[at:end]], [right[i] for i in lanes[at:end]], edits)
        at = end
    return out[:n]


def _banded(left: list[np.ndarray], right: list[np.ndarray], edits: int) -> np.ndarray:
    m, w = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    rows = np.full((len(left), int(m.max()) + 2 * edits + int(w.max() - w.min()) + 2 * edits + 2), 0xFFFFFFFF, np.uint32)
    columns = np.full((len(left), int(w.max())), 0xFFFFFFFE, np.uint32)
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        rows[k, edits : edits + len(a)] = a
        columns[k, : len(b)] = b
    one = U(1)
    plus = np.full(len(left), (((1 << 64) - 1) << (63 - edits)) & ((1 << 64) - 1), U)
    minus = np.zeros(len(left), U)
    distance = np.full(len(left), edits)
    along = np.full(len(left), 1 << 62, U)
    for j in range(columns.shape[1]):
        c = columns[:, j]
        equal = np.zeros(len(left), U)
        for t in range(2 * edits + 1):  # bit 63 - t is row j + edits - t, counted from 0
            column = j + 2 * edits - t
            if column < rows.shape[1]:
                equal |= (rows[:, column] == c).astype(U) << U(63 - t)
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(zero | plus)
        down = zero & plus
        live = j < w
        diagonal = live & (j < m - edits)
        last = live & ~diagonal
        distance += diagonal & ((zero >> U(63)) == 0)
        distance += last & ((up & along) != 0)
        distance -= last & ((down & along) != 0)
        along = np.where(last, along >> one, along)
        plus, minus = down | ~((zero >> one) | up), (zero >> one) & up
    return distance <= edits


def lines_of(text: bytes, shortest: int) -> Iterator[tuple[int, bytes]]:
    for k, x in enumerate(text.split(b"\n")):
        if len(x) >= 4 * shortest or len(x) >= shortest and len(points_of(x)) >= shortest:
            yield k, x


def occurrences(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """Rows (part, ord, hash, line, id): where each line that isn't blank stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                body = texts_of(b.column("text"))
                order, hashed = keys_of(b.column("doc_id"), body)
                found = [(i, k, line_id(x)) for i, t in enumerate(body) for k, x in lines_of(t, 1) if not x.isspace()]
                i, k, ids = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(bucket_of(order, hashed, parts)[i].astype(np.int32)), pa.array(order[i]), pa.array(hashed.view(np.int64)[i]), pa.array(k), pa.array(ids)],
                                                 names=["part", "ord", "hash", "line", "id"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "part int, ord bigint, hash bigint, line bigint, id bigint")


def shared_keys(docs: DataFrame, text: str, shortest: int, edits: int, parts: int) -> DataFrame:
    """Rows (token, set_id, n): keys that an indexed line has and another line has too."""

    def flush(lines: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids = np.array(list(lines), np.int64)
        got = [np.concatenate(x) for x in zip(*line_keys(list(lines.values()), edits), strict=True)]
        row, key, kind = got
        sizes = np.array([len(points_of(x)) for x in lines.values()], np.uint32)
        by = np.argsort(key)
        row, key, kind = row[by], key[by], kind[by]
        out = []
        for p, a, b in cut(((key >> U(32)) * U(parts) >> U(32)).astype(np.int64)):
            used, local = np.unique(row[a:b], return_inverse=True)
            out.append((p, pack(np.diff(key[a:b], prepend=U(0))), pack(local.astype(np.uint32) << 1 | kind[a:b]), pack(ids[used]), pack(sizes[used])))
        cols = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32()] + [pa.binary()] * 4, strict=True)], names=["part", "keys", "rows", "ids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, bytes] = {}
        held = 0
        per_line = (edits + 1) * (edits + 3)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for t in texts_of(whole.slice(at, 256).column("text")):
                    for _, x in lines_of(t, shortest):
                        if (i := line_id(x)) not in lines:
                            lines[i] = x
                            held += per_line + len(x) // 16
                    if held > HELD // 4:
                        yield from flush(lines)
                        lines, held = {}, 0
        if lines:
            yield from flush(lines)

    def meet(table: pa.Table) -> pa.Table:
        keys, rows, ids, sizes = [], [], [], []
        for r in table.select(["keys", "rows", "ids", "sizes"]).to_pylist():
            row = unpack(r["rows"], np.uint32)
            keys.append(np.cumsum(unpack(r["keys"], U)))
            rows.append((row & 1).astype(bool))
            ids.append(unpack(r["ids"], np.int64)[row >> 1])
            sizes.append(unpack(r["sizes"], np.uint32)[row >> 1])
        k, indexed, i, n = map(np.concatenate, (keys, rows, ids, sizes))
        by = np.argsort(k, kind="stable")
        same = k[by][1:] == k[by][:-1]
        again = np.zeros(len(by), bool)
        again[1:] |= same
        again[:-1] |= same
        by = by[again]
        by = by[np.lexsort((i[by], k[by]))]
        k, indexed, i, n = k[by], indexed[by], i[by], n[by]
        if len(k):
            first = np.flatnonzero(np.diff(k, prepend=k[0] ^ U(1)) != 0)
            has_index = np.logical_or.reduceat(indexed, first)
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
            several = np.add.reduceat(new.astype(np.int64), first) > 1
            keep = new & np.repeat(has_index & several, np.diff(first, append=len(k)))
            k, i, n = k[keep], i[keep], n[keep]
        return pa.table({"token": k.view(np.int64), "set_id": i, "n": n.astype(np.int64)})

    sent = docs.select(F.col(text).alias("text")).mapInArrow(run, "part int, keys binary, rows binary, ids binary, sizes binary")
    return sent.groupBy("part").applyInArrow(meet, "token bigint, set_id bigint, n bigint")


def line_texts(docs: DataFrame, text: str, shortest: int, wanted: DataFrame) -> DataFrame:
    """Rows (id, body) of the wanted ids; a bit map of bounded size keeps most other lines out of the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                found = {line_id(x): x for t in texts_of(whole.slice(at, 1024).column("text")) for _, x in lines_of(t, shortest)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["id", "body"])

    every = docs.select(F.col(text).alias("text")).mapInArrow(run, "id bigint, body binary")
    words = min(WORDS, max(1 << 10, 1 << (4 * wanted.count()).bit_length()))
    word, bit = F.expr(f"id >>> 6 & {words - 1}"), F.expr("shiftleft(1L, cast(id & 63 as int))")
    marks = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("marks"))
    some = every.withColumn("word", word).join(F.broadcast(marks), "word").where(F.col("marks").bitwiseAND(bit) != 0).select("id", "body")
    once = some.groupBy("id").agg(F.first("body").alias("body"))
    # an inner join: a semi-join would be moved below the bit map's
    return once.join(wanted.select(F.col("id").alias("_id")), F.col("id") == F.col("_id")).drop("_id")


def letter_counts(bodies: DataFrame) -> DataFrame:
    """Rows (id, c0, c1, ...): code points of each line by remainder; an edit changes their sum of differences by at most 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.bincount(numbers(points_of(x)) % LETTERS, minlength=LETTERS) for x in b.column("body").to_pylist()]
            table = np.array(counts, np.int32).reshape(-1, LETTERS)
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(table[:, k]) for k in range(LETTERS)]], names=["id", *[f"c{k}" for k in range(LETTERS)]])

    return bodies.mapInArrow(run, "id bigint, " + ", ".join(f"c{k} int" for k in range(LETTERS)))


def near_lines(pairs: DataFrame, bodies: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of lines within `edits`."""
    side = lambda k: bodies.select(F.col("id").alias(k), F.col("body").alias(f"x{k}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                left, right = ([numbers(points_of(x)) for x in b.column(c).to_pylist()] for c in ("xa", "xb"))
                yes = pa.array(edit_within(left, right, edits))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(yes), b.column("b").filter(yes)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


#: Lines, and letters, that a block compares on each side, about.
ROWS, SIDE = 1024, 1 << 20


def block_links(rows: DataFrame, bodies: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) that connect all lines within `edits` within each token of rows (token, set_id, component, n, c0, ...).

    The lines of a token are dealt to cells by their length and by how many of their letters are
    in half of the classes, both of which `edits` change by as much at most, so that linked lines
    are in neighbouring cells. Each pair of tiles of such cells is a block: lengths and letters
    are compared all at once, and what they leave in different components by edit distance. A
    block gives back the links that joined components, never its pairs.
    """
    width = edits + 1
    half = sum((F.col(f"c{k}") for k in range(0, LETTERS, 2)), F.lit(0))
    cell = F.struct(F.floor(F.col("n") / width).cast("int").alias("x"), F.floor(half / width).cast("int").alias("y"))
    names = ["component", "n", *[f"c{k}" for k in range(LETTERS)]]
    near = F.array(*[F.struct((F.col("cell.x") + dx).alias("x"), (F.col("cell.y") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    dealt = tile_pairs(rows.select("token", "set_id", *names, cell.alias("cell")), near, F.col("n"), SIDE, ROWS)
    dealt = dealt.join(bodies.select(F.col("id").alias("_id"), "body"), F.col("set_id") == F.col("_id")).drop("_id")

    def run(block: pa.Table) -> pa.Table:
        ids, n, first = (block.column(c).to_numpy() for c in ("set_id", "n", "first"))
        letters = np.stack([block.column(f"c{k}").to_numpy() for k in range(LETTERS)], axis=1)
        body = [numbers(points_of(x)) for x in block.column("body").to_pylist()]
        _, part = np.unique(block.column("component").to_numpy(), return_inverse=True)
        root = np.arange(part.max() + 1)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        alone = not len(right) or block.column("one")[0] == block.column("two")[0]
        right = left if alone else right
        links: list[tuple[int, int]] = []
        for at in range(0, len(left), 128):
            i = left[at : at + 128]
            top = np.array([find(k) for k in range(len(root))])[part]
            maybe = (np.abs(n[i][:, None] - n[right]) <= edits) & (top[i][:, None] != top[right])
            if alone:
                maybe &= i[:, None] < right
            a, b = np.nonzero(maybe)
            a, b = i[a], right[b]
            near = np.abs(letters[a] - letters[b]).sum(axis=1) <= 2 * edits
            a, b = a[near], b[near]
            for k in range(0, len(a), 4096):
                x, y = a[k : k + 4096], b[k : k + 4096]
                yes = edit_within([body[j] for j in x], [body[j] for j in y], edits)
                for u, v in zip(x[yes].tolist(), y[yes].tolist(), strict=True):
                    p, q = find(part[u]), find(part[v])
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        links.append((int(ids[u]), int(ids[v])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return dealt.groupBy("token", "one", "two").applyInArrow(run, "a bigint, b bigint")


def dedup_lines(docs: DataFrame, text: str = "text", edits: int = 2, shortest: int = 16, with_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_lines, n_removed, kept_sha256[, removed, kept]), one per row of docs.

    Lines are what newlines part. Lines of at least `shortest` code points link when their edit
    distance is at most `edits`, shorter ones when they are equal; of all lines reachable by links
    the first one stays, by doc_id (null last) and place, copies and near copies of it go, also
    within a document. Lines of white space alone stay. removed: the numbers of the lines that
    went, from 0; kept: the others joined by newlines.

    Distinct lines meet by segment keys; pairs that share one, and whose lengths and counts of
    letters allow a link, are verified by edit distance, with linked_components() so that a common
    segment isn't expanded into all pairs: where many lines that aren't linked share one, they
    meet in blocks. Lines are told apart by 64-bit hashes.

    Null text counts as empty: one line, which stays. A byte that isn't UTF-8 counts as a code
    point of its own. Very long texts and lines are read whole. Rows alike in doc_id and text count as one
    document; a repeated one loses the same lines. doc_id is an integer. Other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))
    stand = staged(occurrences(docs, text, parts), "lines")
    met = staged(shared_keys(docs, text, shortest, edits, parts), "keys")
    bodies = staged(line_texts(docs, text, shortest, staged(met.select(F.col("set_id").alias("id")).distinct(), "wanted")), "bodies")
    counts = letter_counts(bodies)
    met = staged(met.join(counts, met.set_id == counts.id).drop("id"), "keys")
    apart = sum((F.abs(F.col(f"c{k}") - F.col(f"other_c{k}")) for k in range(LETTERS)), F.lit(0))
    close = (F.abs(F.col("n") - F.col("other_n")) <= edits) & (apart <= 2 * edits)
    member = linked_components(met, ["n", *[f"c{k}" for k in range(LETTERS)]], close, lambda pairs: near_lines(pairs, bodies, edits), lambda rows: block_links(rows, bodies, edits))
    seen = stand.groupBy("id").agg(F.min(F.struct("ord", "line", "hash")).alias("first"), F.count("*").alias("times"))
    seen = seen.join(member.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").select("id", "first", "times", F.coalesce("component", "id").alias("class"))
    seen = staged(seen, "seen")
    heads = seen.groupBy("class").agg(F.min("first").alias("head"), F.sum("times").alias("all")).where("all > 1")
    heads = staged(seen.join(heads, "class").select(F.col("id").alias("_id"), "head"), "heads")
    gone = stand.join(heads, F.col("id") == F.col("_id")).where(F.struct("ord", "line", "hash") != F.col("head")).select("part", "ord", "hash", "line")
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_lines", "n_removed", "kept_sha256"] + ["removed", "kept"] * with_text

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        gone_of: dict[tuple[int, int], list[int]] = {}
        for o, h, k in zip(*(right.column(c).to_pylist() for c in ("ord", "hash", "line")), strict=True):
            gone_of.setdefault((o, h), []).append(k)
        ids, out = [], []
        for blob in left.column("documents").to_pylist():
            t = opened(blob)
            body = texts_of(t.column("text"))
            ids += t.column("doc_id").to_pylist()
            order, hashed = keys_of(t.column("doc_id"), body)
            for o, h, x in zip(order.tolist(), hashed.view(np.int64).tolist(), body, strict=True):
                lines, drop = x.split(b"\n"), sorted(set(gone_of.get((o, h), ())))
                omit = set(drop)
                kept = b"\n".join(y for k, y in enumerate(lines) if k not in omit)
                out.append((len(lines), len(drop), hashlib.sha256(kept).hexdigest(), drop if with_text else None, kept if with_text else None))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(ids, pa.int64() if kind == "bigint" else pa.int32()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]][: len(names)], names=names)

    result = f"doc_id {kind}, n_lines bigint, n_removed bigint, kept_sha256 string" + ", removed array<bigint>, kept binary" * with_text
    return packed(docs, text, parts).groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(run, result)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
