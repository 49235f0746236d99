"""BAM files as rows of reads: block-compressed records decoded in Python workers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed codes of the format: bases by 4 bits, and CIGAR operations.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SCHEMA = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, sequence string, quality string"


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of the gzip members of a file, one at a time."""
    rest = data
    while rest:
        member = zlib.decompressobj(31)
        yield member.decompress(rest)
        if not member.eof:
            raise ValueError("truncated block")
        rest = member.unused_data


def records(data: bytes) -> Iterator[tuple]:
    """The reads of one file in the columns of SAM; * and 0 as the text format has them, quality null where it is absent."""
    blocks, held = inflated(data), b""

    def take(n: int) -> bytes:
        nonlocal held
        while len(held) < n:
            more = next(blocks, None)
            if more is None:
                raise EOFError
            held += more
        out, held = held[:n], held[n:]
        return out

    if take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    take(struct.unpack("<i", take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0])[:-1].decode())
        take(4)
    pairs = np.array([a + b for a in BASES for b in BASES])
    while True:
        try:
            size = struct.unpack("<i", take(4))[0]
        except EOFError:
            return
        b = take(size)
        ref, pos, name, mapq, _, cigars, flag, length, mate, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", b[:32])
        at = 32 + name
        ops = struct.unpack(f"<{cigars}I", b[at : at + 4 * cigars])
        at += 4 * cigars
        seq = "".join(pairs[np.frombuffer(b, np.uint8, (length + 1) // 2, at)])[:length]
        at += (length + 1) // 2
        quality = np.frombuffer(b, np.uint8, length, at)
        yield (b[32 : 32 + name - 1].decode(), flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*",
               "*" if mate < 0 else "=" if mate == ref else names[mate], mate_pos + 1, tlen, seq or "*", None if not length or quality[0] == 255 else (quality + 33).tobytes().decode("latin-1"))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Reads in the columns of SAM; a file is decoded by one task, block by block, and 2 GB at most."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows: list[tuple] = []
                for r in records(data.as_buffer().to_pybytes()):
                    rows.append(r)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=shape)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=shape)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
