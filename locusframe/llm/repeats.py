"""Suffix-array dedup: removes long byte strings that an earlier document has, by maximal repeat groups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, staged
from .jaccard import cut, pack, texts_of, unpack
from .shingles import U, _stream, mixed, powers

#: Bytes of a gram; a repeat of `length` bytes holds one that is the least of its grams.
GRAM = 20
#: Bytes hashed in one go, text that one bucket holds, anchors that go out together.
PIECE, SHARE, HELD = 1 << 20, 16 << 20, 400_000
LAST = np.iinfo(np.int64).max
BYTE = np.array(_stream(11, 256), U)
OTHER = U(_stream(12, 1)[0])


def intervals(lcp: list[int], least: int) -> np.ndarray:
    """Rows (length, first, stop): the nodes of at least `least` bytes of the common-prefix interval tree, inner ones first.

    lcp[i] is the common prefix of suffixes i - 1 and i; a node's occurrences are the suffixes
    first to stop - 1. One scan with a stack of the open nodes.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            length, first = stack.pop()
            found.append((length, first, i))
        if depth >= max(1, least) and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return np.array(found, np.int64).reshape(-1, 3)


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> np.ndarray:
    """The intervals() that are maximal repeats: their occurrences don't all follow one byte.

    left[i] is the byte before suffix i, or negative where none is known, which differs from all.
    """
    found = intervals(lcp.tolist(), least)
    change = np.zeros(len(left) + 1, np.int64)
    change[2:] = np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))
    return found[change[found[:, 2]] > change[found[:, 1] + 1]]


def words_at(rows: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Big-endian 8-byte words [count, len(starts)] of the flat zero-padded bytes from each start."""
    flat = rows.ravel()
    out = np.empty((count, len(starts)), U)
    for k in range(count):
        word = np.zeros(len(starts), U)
        for j in range(8):
            word = (word << U(8)) | flat[starts + (8 * k + j)].astype(U)
        out[k] = word
    return out


class Groups(NamedTuple):
    """Maximal repeat groups of contexts, each with all its occurrences.

    Equal contexts are a class of sizes[k] bytes from begins[k]; its occurrences are the next
    counts[k] of orders, hashes and places (of its anchor), in order of documents. A suffix is an
    offset in a class and stands wherever the class does. A group is its length and its suffixes
    first to stop - 1.
    """

    begins: np.ndarray
    sizes: np.ndarray
    counts: np.ndarray
    orders: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    classes: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    firsts: np.ndarray
    stops: np.ndarray

    def occurrences(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into k, index into orders) of where the classes k stand."""
        n, begin = self.counts[k], np.cumsum(self.counts) - self.counts
        row = np.repeat(np.arange(len(k)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[k][row]


def repeat_groups(rows: np.ndarray, begin: np.ndarray, end: np.ndarray, counts: np.ndarray, orders: np.ndarray, hashes: np.ndarray, places: np.ndarray, least: int) -> Groups:
    """The maximal repeats of at least `least` bytes in contexts, the bytes [begin, end) of each row.

    The enhanced suffix array holds the places of the classes whose strings of `least` bytes have
    their anchor here; so wherever such a string stands, it is in this array. What stands in one
    class only, by hash, is left out before sorting: of such strings the first one's suffix is the
    maximal repeat, if the class has several occurrences.
    """
    width = rows.shape[1]
    wide = -(-width // 8) * 8
    key = np.zeros((len(rows), wide + 8), np.uint8)
    key[:, :width] = np.where((np.arange(width) >= begin[:, None]) & (np.arange(width) < end[:, None]), rows, 0)
    key[:, wide], key[:, wide + 1] = begin, end
    by = np.lexsort(key.view(">u8").T)
    head = np.concatenate([[True], (key[by][1:] != key[by][:-1]).any(axis=1)])
    of = np.empty(len(rows), np.int64)
    of[by] = np.cumsum(head) - 1
    key, begin, end = key[by][head], begin[by][head], end[by][head]
    of = np.repeat(of, counts)
    by = np.lexsort((places, hashes, orders, of))
    counts, orders, hashes, places = np.bincount(of, minlength=len(key)), orders[by], hashes[by], places[by]

    span = width + 8
    flat = np.zeros((len(key), span), np.uint8)
    flat[:, :width] = key[:, :width]
    flat = np.concatenate([flat.ravel(), np.zeros(width + 16, np.uint8)])
    up, down = powers(len(flat))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[flat] * up[: len(flat)])])
    reach, j = least - GRAM, np.arange(2 * (least - GRAM) + 1)
    at = np.arange(len(key))[:, None] * span + j
    gram = mixed((sums[at + GRAM] - sums[at]) * down[at]) >> U(23)
    real = (j >= begin[:, None]) & (j <= end[:, None] - GRAM)
    before = real & (j < reach) & (gram <= gram[:, reach : reach + 1])
    after = real & (j > reach) & (gram < gram[:, reach : reach + 1])
    own = np.maximum(begin, np.where(before.any(axis=1), len(j) - before[:, ::-1].argmax(axis=1), 0))
    fits = np.minimum(end - least, np.where(after.any(axis=1), after.argmax(axis=1) - reach - 1, width)) - own + 1
    row = np.repeat(np.arange(len(key)), fits)
    place = np.arange(len(row)) - np.repeat(np.cumsum(fits) - fits, fits) + own[row]
    at = row * span + place
    hashed = mixed((sums[at + least] - sums[at]) * down[at])
    order = np.argsort(hashed)
    same = hashed[order][1:] == hashed[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    keep = np.sort(order[again])
    row, place, at = row[keep], place[keep], at[keep]
    found, part = np.empty((0, 3), np.int64), row[:0]
    if len(row):
        count = wide // 8
        rest = end[row] - place
        words = words_at(flat, at, count)
        for k in range(count):  # bytes past a context's end, or of the next row, don't count
            over = np.clip(8 * (k + 1) - rest, 0, 8)
            words[k] = np.where(over == 8, 0, (words[k] >> (over.clip(max=7) * 8).astype(U)) << (over.clip(max=7) * 8).astype(U))
        order = np.lexsort((rest, *words[::-1]))
        row, place, rest, words, at = row[order], place[order], rest[order], words[:, order], at[order]
        lcp = np.zeros(len(row), np.int64)
        equal = np.ones(len(row) - 1, bool)
        for k in range(count):
            differ = words[k, 1:] ^ words[k, :-1]
            here = np.full(len(differ), 8)
            for j in range(8):
                here = np.where((here == 8) & ((differ >> U(8 * (7 - j))) != 0), j, here)
            lcp[1:] += np.where(equal, here, 0)
            equal &= differ == 0
        lcp[1:] = np.minimum(lcp[1:], np.minimum(rest[1:], rest[:-1]))
        found = maximal_repeats(lcp, np.where(place > own[row], flat[np.maximum(at - 1, 0)].astype(np.int64), -1), least)
        inner = np.maximum(lcp, np.append(lcp[1:], 0)) >= rest
        part = row[inner & (place == own[row])]
    several = np.flatnonzero((counts > 1) & ~np.isin(np.arange(len(counts)), part))
    alone = len(row) + np.arange(len(several))
    return Groups(begin, end - begin, counts, orders, hashes, places, np.concatenate([row, several]), np.concatenate([place, own[several]]),
                  np.concatenate([found[:, 0], (end - own)[several]]), np.concatenate([found[:, 1], alone]), np.concatenate([found[:, 2], alone + 1]))


def earlier_cover(g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, offset, length) of the strings of groups that stand in an earlier document too, the longest at each place."""
    low = g.orders[np.cumsum(g.counts) - g.counts]
    # of a class the later documents have all that the first one has
    k = np.flatnonzero(g.counts > 1)
    row, o = g.occurrences(k)
    later = g.orders[o] > low[k][row]
    out = [(o[later], g.begins[k][row[later]], g.sizes[k][row[later]])]
    # and the first one has the longest group that an earlier document is in; an inner group is a longer one
    of, longest = low[g.classes], np.zeros(len(g.classes), np.int64)
    inner = np.flatnonzero(g.stops - g.firsts > 1)
    for i in inner[np.argsort(g.lengths[inner], kind="stable")].tolist():
        a, b = g.firsts[i], g.stops[i]
        longest[a:b][of[a:b] > of[a:b].min()] = g.lengths[i]
    s = np.flatnonzero(longest)
    row, o = g.occurrences(g.classes[s])
    first = g.orders[o] == of[s][row]
    out.append((o[first], g.offsets[s][row[first]], longest[s][row[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, place, gram hash) of the anchors of texts, piece by piece.

    Every string of `length` bytes has one anchor, its first gram of least hash, so equal strings
    have theirs at the same place. It lies in the anchor's context, the 2 * length - GRAM bytes
    around it, cut at the ends of the text.
    """
    reach = length - GRAM  # from an anchor back to the furthest start of a string
    segments = []
    for i, t in enumerate(texts):
        for s in range(0, max(0, len(t) - length + 1), PIECE):
            lo, hi = max(0, s - reach), min(len(t), s + PIECE + reach + length)
            segments.append((i, lo, t[lo:hi], s - lo, min(PIECE, len(t) - length + 1 - s)))
    group: list[tuple] = []
    size = 0
    for k, segment in enumerate(segments):
        group.append(segment)
        size += len(segment[2])
        if size >= PIECE or k == len(segments) - 1:
            yield _anchors(group, length)
            group, size = [], 0


def _anchors(group: list[tuple], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    window = length - GRAM + 1
    b = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
    begin = np.cumsum([0] + [len(g[2]) for g in group])
    up, down = powers(len(b))
    sums = np.empty(len(b) + 1, U)
    sums[0] = 0
    np.cumsum(BYTE[b] * up[: len(b)], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1])
    key = (grams >> U(23) << U(23)) | np.arange(len(grams), dtype=U)
    low, span = key, 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(key) - window + 1], low[window - span : window - span + len(key) - window + 1])
    starts = np.concatenate([begin[k] + g[3] + np.arange(g[4]) for k, g in enumerate(group)])
    at = (low[starts] & U((1 << 23) - 1)).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    segment = np.searchsorted(begin, at, side="right") - 1
    index = np.array([g[0] for g in group])[segment]
    place = at - begin[segment] + np.array([g[1] for g in group])[segment]
    return index, place, mixed(grams[at] * OTHER)


def keys_of(ids: pa.Array, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order (doc_id, a null one last) and text hash of rows; equal rows get equal results, so these name a row."""
    order = np.array([LAST if i is None else i for i in ids.to_pylist()], np.int64)
    return order, np.array([xxhash.xxh3_64_intdigest(t) for t in texts], U)


def bucket_of(order: np.ndarray, hashed: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(order.view(U) * OTHER + hashed.view(U)) % U(parts)).astype(np.int64)


def table(rows: list[dict], names: list[str]) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in rows], pa.int32() if n == "part" else pa.binary()) for n in names})


def schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'int' if n == 'part' else 'binary'}" for n in names)


POSTED = ["part", "grams", "rows", "places", "orders", "hashes"]
MARKED = ["part", "orders", "hashes", "counts", "places", "lengths"]
WANTED = ["part", "contexts", "begins", "ends", "counts", "orders", "hashes", "places"]
GROUPED = {"begins": np.uint32, "sizes": np.uint32, "counts": np.uint32, "orders": np.int64, "hashes": U, "places": np.uint32, "classes": np.uint32, "offsets": np.uint32, "lengths": np.uint32, "firsts": np.uint32, "stops": np.uint32}


def posted(docs: DataFrame, text: str, length: int, parts: int) -> DataFrame:
    """Anchors of blocks of documents, dealt by gram hash."""

    def flush(held: list[tuple], orders: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, place, gram = (np.concatenate(x) for x in zip(*held, strict=True))
        gram = gram >> U(16)
        order = np.argsort(gram)
        row, place, gram = row[order], place[order], gram[order]
        rows = []
        for p, a, b in cut(((gram * U(parts)) >> U(48)).astype(np.int64)):
            used, local = np.unique(row[a:b], return_inverse=True)
            rows.append({"part": p, "grams": pack(np.diff(gram[a:b], prepend=U(0))), "rows": pack(local.astype(np.uint32)),
                         "places": pack(place[a:b].astype(np.uint32)), "orders": pack(orders[used]), "hashes": pack(hashes[used])})
        yield from table(rows, POSTED).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, orders, hashes, count, base = [], [], [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = texts_of(b.column("text"))
                o, h = keys_of(b.column("doc_id"), texts)
                for row, place, gram in anchors(texts, length):
                    held.append((row + base, place, gram))
                    count += len(row)
                orders.append(o)
                hashes.append(h)
                base += len(texts)
                if count > HELD:
                    yield from flush(held, np.concatenate(orders), np.concatenate(hashes))
                    held, orders, hashes, count, base = [], [], [], 0, 0
        if count:
            yield from flush(held, np.concatenate(orders), np.concatenate(hashes))

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema(POSTED))


def marks(rows: list[dict], parts: int, order: np.ndarray, hashed: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> None:
    """Append places by bucket and document to rows."""
    part = bucket_of(order, hashed, parts)
    by = np.lexsort((place, hashed, order, part))
    part, order, hashed, place, lengths = part[by], order[by], hashed[by], place[by], lengths[by]
    for p, a, b in cut(part):
        first = np.flatnonzero(np.diff(order[a:b], prepend=order[a] ^ 1) | (np.diff(hashed[a:b], prepend=hashed[a] ^ U(1)) != 0))
        rows.append({"part": p, "orders": pack(order[a:b][first]), "hashes": pack(hashed[a:b][first]), "counts": pack(np.diff(first, append=b - a).astype(np.uint32)),
                     "places": pack(place[a:b].astype(np.uint32)), "lengths": pack(lengths[a:b].astype(np.uint32))})


def shared(anchored: DataFrame, parts: int) -> DataFrame:
    """Marks of the anchors whose gram stands in documents of several doc_ids."""

    def run(group: pa.Table) -> pa.Table:
        grams, orders, hashes, places = [], [], [], []
        for r in group.select(POSTED[1:]).to_pylist():
            row = unpack(r["rows"], np.uint32)
            grams.append(np.cumsum(unpack(r["grams"], U)))
            orders.append(unpack(r["orders"], np.int64)[row])
            hashes.append(unpack(r["hashes"], U)[row])
            places.append(unpack(r["places"], np.uint32))
        g, o, h, p = map(np.concatenate, (grams, orders, hashes, places))
        by = np.argsort(g, kind="stable")
        same = g[by][1:] == g[by][:-1]
        again = np.zeros(len(by), bool)
        again[1:] |= same
        again[:-1] |= same
        by = by[again]
        g, o, h, p = g[by], o[by], h[by], p[by]
        rows: list = []
        if len(g):
            new = np.diff(g, prepend=g[:1] ^ U(1)) != 0
            first = np.flatnonzero(new)
            several = (np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first))[np.cumsum(new) - 1]
            if several.any():
                marks(rows, parts, o[several], h[several], p[several], np.zeros(several.sum(), np.uint32))
        return table(rows, MARKED)

    return anchored.groupBy("part").applyInArrow(run, schema(MARKED))


def packed(docs: DataFrame, text: str, parts: int) -> DataFrame:
    """Rows (part, documents): compressed documents by bucket, for the joins with marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                part = bucket_of(*keys_of(b.column("doc_id"), texts_of(b.column("text"))), parts)
                by = np.argsort(part, kind="stable")
                rows = []
                for p, x, y in cut(part[by]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, b.schema) as w:
                        w.write_batch(b.take(pa.array(by[x:y])))
                    rows.append({"part": p, "documents": zstandard.compress(sink.getvalue(), 3)})
                yield from table(rows, ["part", "documents"]).to_batches()

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema(["part", "documents"]))


def opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


def by_document(marked: pa.Table) -> dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]]:
    found: dict = {}
    for r in marked.select(MARKED[1:]).to_pylist():
        orders, hashes, counts = unpack(r["orders"], np.int64), unpack(r["hashes"], U), unpack(r["counts"], np.uint32)
        places, lengths = unpack(r["places"], np.uint32).astype(np.int64), unpack(r["lengths"], np.uint32).astype(np.int64)
        ends = np.cumsum(counts)
        for o, h, a, b in zip(orders.tolist(), hashes.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            found.setdefault((o, h), []).append((places[a:b], lengths[a:b]))
    return found


PLACES = np.array(_stream(13, 256), U)


def contexts(texts: DataFrame, marked: DataFrame, length: int, parts: int) -> DataFrame:
    """The contexts of marked anchors with their occurrences, dealt by gram; those that a task has several times go out once."""
    reach, width = length - GRAM, 2 * length - GRAM

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        marks_of = by_document(right)
        got: list[tuple] = []
        for blob in left.column("documents").to_pylist() if marks_of else []:
            t = opened(blob)
            body = texts_of(t.column("text"))
            for o, h, x in zip(*(k.tolist() for k in keys_of(t.column("doc_id"), body)), body, strict=True):
                for places, _ in marks_of.pop((o, h), ()):
                    b = np.frombuffer(bytes(reach) + x + bytes(length), np.uint8)
                    rows = b[places[:, None] + np.arange(width)]
                    begin, end = np.maximum(0, reach - places), np.minimum(width, len(x) - places + reach)
                    got.append((rows, begin, end, np.full(len(places), o), np.full(len(places), h, U), places))
        if not got:
            return table([], WANTED)
        rows, begin, end, o, h, p = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        part = (mixed(sum(rows[:, reach + k].astype(U) * PLACES[k] for k in range(GRAM))) % U(parts)).astype(np.int64)
        whole = mixed(sum((rows[:, k].astype(U) * PLACES[k % 256] + U(k) for k in range(width)), begin.astype(U) * PLACES[254] + end.astype(U) * PLACES[255]))
        alike = sum(rows[:, reach + k].astype(U) << U(56 - 8 * k) for k in range(8))  # contexts that begin alike side by side pack better
        by = np.lexsort((whole, alike, part))
        out = []
        for v, a, b in cut(part[by]):
            i = by[a:b]
            head = np.concatenate([[True], (rows[i[1:]] != rows[i[:-1]]).any(axis=1) | (begin[i[1:]] != begin[i[:-1]]) | (end[i[1:]] != end[i[:-1]])])
            at = np.flatnonzero(head)
            out.append({"part": v, "contexts": zstandard.compress(np.ascontiguousarray(rows[i[at]]).tobytes(), 3), "begins": pack(begin[i[at]].astype(np.uint32)), "ends": pack(end[i[at]].astype(np.uint32)),
                        "counts": pack(np.diff(at, append=len(i)).astype(np.uint32)), "orders": pack(o[i]), "hashes": pack(h[i]), "places": pack(p[i].astype(np.uint32))})
        return table(out, WANTED)

    return texts.groupBy("part").cogroup(marked.groupBy("part")).applyInArrow(run, schema(WANTED))


def grouped(wanted: DataFrame, length: int) -> DataFrame:
    """Rows of Groups: an enhanced suffix array for each range of grams, and its maximal repeat groups."""
    reach, width = length - GRAM, 2 * length - GRAM

    def run(group: pa.Table) -> pa.Table:
        cols = []
        for r in group.select(WANTED[1:]).to_pylist():
            rows = np.frombuffer(zstandard.decompress(r["contexts"]), np.uint8).reshape(-1, width)
            cols.append((rows, *(unpack(r[c], np.uint32).astype(np.int64) for c in ("begins", "ends", "counts")), unpack(r["orders"], np.int64), unpack(r["hashes"], U), unpack(r["places"], np.uint32).astype(np.int64)))
        rows, begin, end, counts, o, h, p = (np.concatenate(x) for x in zip(*cols, strict=True))
        del cols
        at = np.cumsum(counts) - counts
        gram = mixed(sum(rows[:, reach + k].astype(U) * PLACES[k] for k in range(GRAM)))
        by = np.argsort(gram, kind="stable")
        out: list = []

        def flush(i: np.ndarray) -> None:
            n = counts[i]
            each = np.repeat(at[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            g = repeat_groups(rows[i], begin[i], end[i], n, o[each], h[each], p[each], length)
            if len(g.lengths):
                out.append({k: pack(getattr(g, k).astype(kind)) for k, kind in GROUPED.items()})

        size, pending = 0, []
        for _, a, b in cut((np.cumsum(np.diff(gram[by], prepend=gram[by][:1] ^ U(1)) != 0)).astype(np.int64)):
            if size and size + b - a > 40_000:
                flush(np.concatenate(pending))
                pending, size = [], 0
            pending.append(by[a:b])
            size += b - a
        if size:
            flush(np.concatenate(pending))
        return table(out, list(GROUPED))

    return wanted.groupBy("part").applyInArrow(run, schema(list(GROUPED)))


def read_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Groups]:
    for b in batches:
        for i in range(b.num_rows):
            cols = {k: unpack(b.column(k)[i].as_py(), kind) for k, kind in GROUPED.items()}
            yield Groups(**{k: x if x.dtype == U else x.astype(np.int64) for k, x in cols.items()})


def covered(groups: DataFrame, length: int, parts: int) -> DataFrame:
    """Marks of the strings (place, length) that groups show in an earlier document."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in read_groups(batches):
            o, offset, size = earlier_cover(g)
            out: list = []
            if len(o):
                marks(out, parts, g.orders[o], g.hashes[o], g.places[o] - reach + offset, size)
            yield from table(out, MARKED).to_batches()

    return groups.mapInArrow(run, schema(MARKED))


def groups_of(docs: DataFrame, text: str, length: int) -> tuple[DataFrame, DataFrame, int]:
    """The documents by bucket, the Groups of their contexts, and the number of buckets."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))
    marked = staged(shared(posted(docs, text, length, parts), parts), "anchors")
    texts = packed(docs, text, parts)
    return texts, staged(grouped(contexts(texts, marked, length, parts), length), "groups"), parts


def repeats(docs: DataFrame, text: str = "text", length: int = 50) -> DataFrame:
    """Rows (group, length, doc_id, start): every occurrence of the maximal repeats of at least `length` bytes that documents of several doc_ids share.

    A repeat is maximal when its occurrences neither all follow nor all precede one byte, from the
    first string of `length` bytes with its anchor to `length` bytes after that. A longer repeat
    is therefore a chain of groups with the same documents, one for each anchor in it. Null text
    counts as empty; rows alike in doc_id and text are listed each. Other columns are not read.
    """
    reach = length - GRAM
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in read_groups(batches):
            for first, stop, size in zip(g.firsts.tolist(), g.stops.tolist(), g.lengths.tolist(), strict=True):
                row, o = g.occurrences(g.classes[first:stop])
                start = g.places[o] - reach + g.offsets[first:stop][row]
                order = g.orders[o]
                name = xxhash.xxh3_64_intdigest(np.array([order[0], g.hashes[o][0].view(np.int64), start[0], size], np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(o), name, U).view(np.int64)), pa.array(np.full(len(o), size)), pa.array(order, mask=order == LAST).cast(pa.int64() if kind == "bigint" else pa.int32()), pa.array(start)],
                                                 names=["group", "length", "doc_id", "start"])

    return groups_of(docs, text, length)[1].mapInArrow(run, f"group bigint, length bigint, doc_id {kind}, start bigint")


def union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals cover; touching ones are one run."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.concatenate([new[1:] - 1, [len(ends) - 1]])]


def removed_spans(docs: DataFrame, text: str = "text", length: int = 50, with_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]), one per row of docs.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller
    doc_id; strings are judged on the input and lie within one document. spans are the maximal
    removed runs (start, stop) in bytes, kept the other bytes.

    1. Each string has an anchor, the least gram in it; only 2 / (length - 18) of the places are
       anchors. Grams meet by hash; those of one doc_id end there.
    2. The bytes around the other anchors, their contexts, are dealt by gram, so that all suffixes
       with a common prefix of `length` bytes are in one enhanced suffix array. Its common-prefix
       interval tree gives the maximal repeat groups with all their occurrences, see repeats().
    3. Of each group, the occurrences outside its first document are covered. What is covered is
       united and cut out by document.

    Null text counts as empty. Very long texts are read piece by piece. Rows with equal doc_id don't remove one another's bytes; a null
    doc_id counts as largest, and such rows don't either. Repeated rows get equal results. doc_id is an integer. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    texts, groups, parts = groups_of(docs, text, length)
    every = covered(groups, length, parts)
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * with_text

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        marks_of = by_document(right)
        ids, out = [], []
        for blob in left.column("documents").to_pylist():
            t = opened(blob)
            body = texts_of(t.column("text"))
            ids += t.column("doc_id").to_pylist()
            for o, h, x in zip(*(k.tolist() for k in keys_of(t.column("doc_id"), body)), body, strict=True):
                starts, ends = [], []
                for places, lengths in marks_of.get((o, h), ()):
                    starts.append(places)
                    ends.append(places + lengths)
                a, b = union(np.concatenate(starts), np.concatenate(ends)) if starts else (np.empty(0, np.int64),) * 2
                spans = list(zip(a.tolist(), b.tolist(), strict=True))
                kept = b"".join(x[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(x)], strict=True))
                out.append((len(x), int((b - a).sum()), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": i, "stop": j} for i, j in spans] if with_text else None, kept if with_text else None))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
        return pa.table([pa.array(ids, pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.int32()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]][: len(names)], names=names)

    result = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<start:bigint,stop:bigint>>, kept binary" * with_text
    return texts.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(run, result)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
