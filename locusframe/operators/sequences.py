"""Operators over sequences (id, seq): k-mers, minimizers, sketches, reading frames, motifs, trimming.

What needs every position of a sequence runs over Arrow batches in numpy; results of a batch are
summed before they are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.sequence import GENETIC_CODE

CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i


def kmer_codes(seq: str, k: int) -> np.ndarray:
    """2-bit codes of the k-mers of a sequence in order; k-mers with other letters are left out. k at most 31."""
    x = CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    if len(x) < k:
        return np.empty(0, np.int64)
    code = np.zeros(len(x) - k + 1, np.int64)
    for i in range(k):
        code = code << 2 | x[i : len(x) - k + 1 + i]
    bad = np.concatenate([[0], np.cumsum(x > 3)])
    return code[bad[k:] == bad[:-k]]


def by_batch(df: DataFrame, columns: list[str], schema: str, rows: Callable[[list[tuple]], dict[str, list]]) -> DataFrame:
    """mapInArrow over Python tuples of the columns, 512 rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                yield pa.RecordBatch.from_pydict(rows(list(zip(*(b.column(c).to_pylist() for c in columns), strict=True))), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(*columns).mapInArrow(run, schema)


def kmer_counts(df: DataFrame, k: int) -> DataFrame:
    """Rows (kmer, n) over all sequences."""

    def rows(batch: list[tuple]) -> dict[str, list]:
        codes = [kmer_codes(s or "", k) for (s,) in batch]
        values, n = np.unique(np.concatenate(codes), return_counts=True)
        return {"kmer": spelled(values, k), "n": n.tolist()}

    return by_batch(df, ["seq"], "kmer string, n bigint", rows).groupBy("kmer").agg(F.sum("n").alias("n"))


def canonical(codes: np.ndarray, k: int) -> np.ndarray:
    """The lesser of each k-mer and its reverse complement."""
    rest, back = codes.copy(), np.zeros_like(codes)
    for _ in range(k):
        back = back << 2 | (3 - (rest & 3))
        rest >>= 2
    return np.minimum(codes, back)


def mix64(x: np.ndarray) -> np.ndarray:
    """An invertible 64-bit mix, the hash of minimizers and sketches."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def spelled(codes: np.ndarray, k: int) -> list[str]:
    letters = np.frombuffer(b"ACGT", np.uint8)[codes[:, None] >> 2 * np.arange(k - 1, -1, -1) & 3]
    return [x.decode("ascii") for x in np.ascontiguousarray(letters).view(f"S{k}").ravel().tolist()]


def minimizers(df: DataFrame, k: int, window: int) -> DataFrame:
    """Rows (id, at, kmer): the least-hash canonical k-mer, leftmost of ties, of every window of consecutive k-mers, once each.

    at is its place in the sequence. A letter other than A, C, G and T ends a run of k-mers; windows lie within one run.
    """

    def rows(batch: list[tuple]) -> dict[str, list]:
        text = "N".join((s or "") for _, s in batch)
        x = CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        none: dict[str, list] = {"id": [], "at": [], "kmer": []}
        if len(x) < k + window - 1:
            return none
        code = np.zeros(len(x) - k + 1, np.int64)
        for i in range(k):
            code = code << 2 | x[i : len(x) - k + 1 + i] & 3
        bad = np.concatenate([[0], np.cumsum(x > 3)])
        whole = bad[k + window - 1 :] == bad[: len(bad) - (k + window - 1)]  # windows without a break
        code = canonical(code, k)
        h = mix64(code)
        best, span = np.arange(len(h)), 1
        while span < window:  # least of 2 * span, then of the window, from two that overlap
            step = min(span, window - span)
            left, right = best[: len(best) - step], best[step:]
            best = np.where(h[right] < h[left], right, left)
            span += step
        at = np.unique(best[whole])
        begin = np.cumsum([0] + [len(s or "") + 1 for _, s in batch])
        of = np.searchsorted(begin, at, side="right") - 1
        return {"id": [batch[i][0] for i in of.tolist()], "at": (at - begin[of]).tolist(), "kmer": spelled(code[at], k)}

    return by_batch(df, ["id", "seq"], f"id {dict(df.dtypes)['id']}, at bigint, kmer string", rows)


def sketches(df: DataFrame, k: int, size: int) -> DataFrame:
    """Rows (id, sketch): the `size` least hashes of the distinct canonical k-mers, ascending as unsigned numbers in signed form."""

    def rows(batch: list[tuple]) -> dict[str, list]:
        return {"id": [i for i, _ in batch], "sketch": [np.unique(mix64(canonical(kmer_codes(s or "", k), k)))[:size].view(np.int64).tolist() for _, s in batch]}

    return by_batch(df, ["id", "seq"], f"id {dict(df.dtypes)['id']}, sketch array<bigint>", rows)


def sketch_jaccard(a: list[int], b: list[int], size: int) -> float:
    """Share of common hashes among the least `size` of both sketches."""
    x, y = (np.array(s, np.int64).view(np.uint64) for s in (a, b))
    both = np.union1d(x, y)[:size]
    return float(len(np.intersect1d(np.intersect1d(x, y), both)) / len(both)) if len(both) else 0.0


LETTER = np.full(256, 64, np.uint8)
for _i, _c in enumerate("TCAG"):
    LETTER[[ord(_c), ord(_c.lower())]] = _i
LETTER[[ord("U"), ord("u")]] = 0


def codon_codes(seq: str, frame: int = 0) -> np.ndarray:
    """Numbers of the codons of a reading frame in the order of GENETIC_CODE, 64 for those with other letters."""
    x = LETTER[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)][frame:]
    x = x[: len(x) // 3 * 3].reshape(-1, 3).astype(np.int64)
    return np.where((x < 64).all(axis=1), 16 * x[:, 0] + 4 * x[:, 1] + x[:, 2], 64)


def translate(df: DataFrame) -> DataFrame:
    """Add protein, the first reading frame in one-letter code; codons with other letters are X."""
    residues = np.frombuffer((GENETIC_CODE + "X").encode("ascii"), np.uint8)

    def rows(batch: list[tuple]) -> dict[str, list]:
        return {"id": [i for i, _ in batch], "protein": [residues[codon_codes(s or "")].tobytes().decode("ascii") for _, s in batch]}

    return by_batch(df, ["id", "seq"], f"id {dict(df.dtypes)['id']}, protein string", rows)


def reading_frames(df: DataFrame, least: int) -> DataFrame:
    """Open reading frames (id, strand, frame, start, stop): ATG to the next stop codon in frame, both strands, at least `least` bases.

    Places count on the given strand, half-open; nested starts are part of the first one's frame.
    """
    start = GENETIC_CODE.index("M")
    stops = np.array([c == "*" for c in GENETIC_CODE] + [False])
    flip = str.maketrans("ACGTacgtUu", "TGCAtgcaAa")

    def rows(batch: list[tuple]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("id", "strand", "frame", "start", "stop")}
        for i, s in batch:
            s = s or ""
            for strand, t in (("+", s), ("-", s[::-1].translate(flip))):
                for frame in range(3):
                    code = codon_codes(t, frame)
                    starts, ends = np.flatnonzero(code == start), np.flatnonzero(stops[code])
                    if not len(starts) or not len(ends):
                        continue
                    first = np.searchsorted(starts, np.concatenate([[-1], ends[:-1]]), side="right")
                    begin = np.append(starts, len(code))[first]
                    ok = (begin < ends) & (3 * (ends + 1 - begin) >= least)
                    a, b = frame + 3 * begin[ok], frame + 3 * (ends[ok] + 1)
                    a, b = (a, b) if strand == "+" else (len(t) - b, len(t) - a)
                    for c, v in zip(out, ([i] * len(a), [strand] * len(a), [frame] * len(a), a.tolist(), b.tolist()), strict=True):
                        out[c] += v
        return out

    return by_batch(df, ["id", "seq"], f"id {dict(df.dtypes)['id']}, strand string, frame int, start bigint, stop bigint", rows)


def scan_matrix(df: DataFrame, counts: list[dict[str, float]], least: float, pseudo: float = 0.5) -> DataFrame:
    """Rows (id, at, score) where a position weight matrix (log2 odds over uniform) scores at least `least`."""
    w = np.array([[math.log2((c.get(x, 0) + pseudo) / (sum(c.values()) + 4 * pseudo) / 0.25) for x in "ACGT"] + [-np.inf] for c in counts])

    def rows(batch: list[tuple]) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "at": [], "score": []}
        for i, s in batch:
            x = np.minimum(CODE[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)], 4)
            if len(x) < len(w):
                continue
            score = sum(w[k][x[k : len(x) - len(w) + 1 + k]] for k in range(len(w)))
            at = np.flatnonzero(score >= least)
            out["id"] += [i] * len(at)
            out["at"] += at.tolist()
            out["score"] += score[at].tolist()
        return out

    return by_batch(df, ["id", "seq"], f"id {dict(df.dtypes)['id']}, at bigint, score double", rows)


def trim_reads(df: DataFrame, adapter: str, quality: int, window: int, least: int) -> DataFrame:
    """Reads (id, seq, qual array<int>) cut at the adapter, at low ends, and where a window's mean quality falls; short ones go.

    Ends: leading and trailing bases under `quality`. Window: from the first window of `window`
    bases whose mean is under `quality`.
    """
    def rows(batch: list[tuple]) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "seq": [], "qual": []}
        for i, s, q in batch:
            s, q = s or "", list(q or [])
            cut = s.find(adapter) if adapter else -1
            stop = min(len(q), len(s) if cut < 0 else cut)
            start = 0
            while start < stop and q[start] < quality:
                start += 1
            while stop > start and q[stop - 1] < quality:
                stop -= 1
            if stop - start >= window:
                means = np.convolve(q[start:stop], np.ones(window) / window, "valid")
                low = np.flatnonzero(means < quality)
                stop = start + int(low[0]) if len(low) else stop
            if stop - start >= least:
                for c, v in zip(out, (i, s[start:stop], q[start:stop]), strict=True):
                    out[c].append(v)
        return out

    return by_batch(df, ["id", "seq", "qual"], f"id {dict(df.dtypes)['id']}, seq string, qual array<int>", rows)


def approximate_hits(df: DataFrame, pattern: str, mismatches: int) -> DataFrame:
    """Rows (id, start, mismatches): every place where a pattern of plain letters stands with at most so many letters changed."""
    p = np.frombuffer(pattern.encode("ascii"), np.uint8)

    def rows(batch: list[tuple]) -> dict[str, list]:
        out: dict[str, list] = {"id": [], "start": [], "mismatches": []}
        for i, s in batch:
            x = np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)
            if len(x) < len(p):
                continue
            n = sum((x[k : len(x) - len(p) + 1 + k] != p[k]).astype(np.int64) for k in range(len(p)))
            at = np.flatnonzero(n <= mismatches)
            out["id"] += [i] * len(at)
            out["start"] += at.tolist()
            out["mismatches"] += n[at].tolist()
        return out

    return by_batch(df, ["id", "seq"], f"id {dict(df.dtypes)['id']}, start bigint, mismatches bigint", rows)
