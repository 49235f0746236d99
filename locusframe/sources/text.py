"""Readers and writers of line- and record-based life-science formats as DataFrames.

Readers are lazy. Line formats are split by Spark's text source; record formats (FASTA, MGF,
motifs) use the record mark as line separator, so that one file is still read by many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PHRED = 33


def lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """Rows (value, cells): lines that aren't empty or a comment, split at tabs."""
    x = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", "")).where("value != ''")
    if comment:
        x = x.where(~F.startswith("value", F.lit(comment)))
    return x.withColumn("cells", F.split("value", "\t"))


def cell(i: int, kind: str = "string", missing: str | None = None) -> Column:
    c = F.get("cells", F.lit(i))
    if missing is not None:
        c = F.nullif(c, F.lit(missing))
    return c if kind == "string" else c.try_cast(kind)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED3 to BED6; lines without start < stop are left out, as are track and browser lines."""
    x = lines(spark, path).where(~F.rlike("value", F.lit("^(track|browser)")))
    return x.select(cell(0).alias("chrom"), cell(1, "bigint").alias("start"), cell(2, "bigint").alias("stop"), cell(3, missing=".").alias("name"), cell(4, "double", ".").alias("score"),
                    F.coalesce(cell(5), F.lit(".")).alias("strand")).where("start < stop")


def read_bedpe(spark: SparkSession, path: str) -> DataFrame:
    names = [("chrom1", "string"), ("start1", "bigint"), ("stop1", "bigint"), ("chrom2", "string"), ("start2", "bigint"), ("stop2", "bigint"), ("name", "string"), ("score", "double"), ("strand1", "string"), ("strand2", "string")]
    return lines(spark, path).select(*[cell(i, k, "." if k == "double" else None).alias(n) for i, (n, k) in enumerate(names)])


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    x = lines(spark, path).where(~F.rlike("value", F.lit("^(track|browser)"))).withColumn("cells", F.split("value", r"\s+"))
    return x.select(cell(0).alias("chrom"), cell(1, "bigint").alias("start"), cell(2, "bigint").alias("stop"), cell(3, "double").alias("value"))


def attributes(text: Column, style: str) -> Column:
    """Map of GFF3 (k=v;) or GTF (k "v";) attributes."""
    if style == "gff3":
        return F.map_from_entries(F.transform(F.filter(F.split(text, ";"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)), F.url_decode(F.regexp_replace(F.substring(x, F.instr(x, "=") + 1, F.length(x)), r"\+", "%2B")))))
    pairs = F.regexp_extract_all(text, F.lit(r'(\S+) "([^"]*)"'), F.lit(0))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, " ", 1), F.regexp_extract(x, '"([^"]*)"', 1))))


def read_gff(spark: SparkSession, path: str, style: str = "gff3") -> DataFrame:
    """GFF3 or GTF features; start is made 0-based, so intervals are half-open."""
    x = lines(spark, path).where(F.size("cells") >= 9)
    return x.select(cell(0).alias("chrom"), cell(1).alias("source"), cell(2).alias("type"), (cell(3, "bigint") - 1).alias("start"), cell(4, "bigint").alias("stop"), cell(5, "double", ".").alias("score"),
                    cell(6).alias("strand"), cell(7, "int", ".").alias("phase"), attributes(cell(8), style).alias("attributes"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants with 1-based position, alts as array, info as map and the sample cells as array."""
    x = lines(spark, path)
    info = F.map_from_entries(F.transform(F.filter(F.split(cell(7), ";"), lambda x: ~x.isin("", ".")), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))))))
    return x.select(cell(0).alias("chrom"), cell(1, "bigint").alias("position"), cell(2, missing=".").alias("id"), F.upper(cell(3)).alias("ref"), F.split(F.upper(cell(4)), ",").alias("alts"),
                    cell(5, "double", ".").alias("quality"), cell(6).alias("filter"), info.alias("info"), cell(8).alias("format"), F.slice("cells", 10, F.greatest(F.size("cells") - 9, F.lit(0))).alias("samples"))


def read_vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, id, value) of the ## lines."""
    x = spark.read.text(path).where(F.startswith("value", F.lit("##")))
    return x.select(F.regexp_extract("value", "^##([^=]+)=", 1).alias("key"), F.nullif(F.regexp_extract("value", "<ID=([^,>]+)", 1), F.lit("")).alias("id"), F.regexp_extract("value", "^##[^=]+=(.*)$", 1).alias("value"))


SAM = [("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "bigint"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "bigint"), ("tlen", "bigint"), ("sequence", "string"), ("quality", "string")]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, "@").where(F.size("cells") >= 11).select(*[cell(i, k).alias(n) for i, (n, k) in enumerate(SAM)])


def reference_length(cigar: Column) -> Column:
    """Reference bases that a CIGAR string covers."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit("([0-9]+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda t, x: t + x.cast("long"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, description, seq); upper case, line breaks taken out."""
    x = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) != ''")
    head = F.regexp_replace(F.substring_index("v", "\n", 1), "\r$", "")
    body = F.when(F.instr("v", "\n") > 0, F.substring(F.col("v"), F.instr("v", "\n") + 1, F.length("v"))).otherwise("")
    return x.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.nullif(F.regexp_extract(head, r"^\S+\s+(.*)$", 1), F.lit("")).alias("description"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"))


def phred(quality: Column) -> Column:
    return F.transform(F.filter(F.split(quality, ""), lambda x: x != ""), lambda x: F.ascii(x) - PHRED)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, description, seq, qual array<int>) of four-line records; a large file is read by many tasks.

    First the lines of each split are counted, so that every split knows how many lines of its file
    come before it; then each gives its whole records. The lines of a record that two splits share
    meet by its number. One row per split is broadcast.
    """
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))
    count = x.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.join(F.broadcast(count.select("file", "block", before.alias("before"))), ["file", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, where, open_ = 0, None, []
        names = ["file", "record", "line", "head", "seq", "plus", "q"]
        for b in batches:
            out: list[tuple] = []
            for file, block, first, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "before", "value")), strict=True):
                if (file, block) != where:
                    out += [(*part, None, None, None) for part in open_]
                    at, where, open_ = first, (file, block), []
                open_.append((file, at // 4, at % 4, value))
                at += 1
                if at % 4 == 0:
                    if len(open_) == 4:
                        out.append((file, at // 4 - 1, None, *(v for *_, v in open_)))
                    else:
                        out += [(*part, None, None, None) for part in open_]
                    open_ = []
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)) if out else [[]] * 7, strict=True)), schema=shape)
        if open_:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*[(*part, None, None, None) for part in open_], strict=True)), strict=True)), schema=shape)

    shape = pa.schema([("file", pa.string()), ("record", pa.int64()), ("line", pa.int32()), *[(c, pa.string()) for c in ("head", "seq", "plus", "q")]])
    x = x.select("file", "block", "before", "value").mapInArrow(run, "file string, record bigint, line int, head string, seq string, plus string, q string")
    line = lambda k: F.max(F.when(F.col("line") == k, F.col("head")))
    split = x.where("line is not null").groupBy("file", "record").agg(line(0).alias("head"), line(1).alias("seq"), line(3).alias("q")).select("head", "seq", "q")
    x = x.where("line is null").select("head", "seq", "q").union(split).where("head like '@%'")
    return x.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), F.nullif(F.regexp_extract("head", r"^@\S+\s+(.*)$", 1), F.lit("")).alias("description"), F.coalesce("seq", F.lit("")).alias("seq"), phred(F.coalesce("q", F.lit(""))).alias("qual"))


def paired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates of two FASTQ tables by name, without a trailing /1 or /2: (name, seq1, qual1, seq2, qual2)."""
    side = lambda df, k: df.select(F.regexp_replace("name", "/[12]$", "").alias("name"), F.col("seq").alias(f"seq{k}"), F.col("qual").alias(f"qual{k}"))
    return side(first, 1).join(side(second, 2), "name")


def fasta_index(df: DataFrame) -> DataFrame:
    """Names and lengths of the sequences, as an index has them."""
    return df.select("name", F.length("seq").cast("bigint").alias("length"))


BLAST = ["query", "subject", "identity", "length", "mismatches", "gaps", "q_start", "q_end", "s_start", "s_end", "evalue", "bits"]


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    kinds = ["string", "string", "double"] + ["bigint"] * 7 + ["double"] * 2
    return lines(spark, path).select(*[cell(i, k).alias(n) for i, (n, k) in enumerate(zip(BLAST, kinds, strict=True))])


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (name, seq, length) and links (src, src_strand, dst, dst_strand, overlap)."""
    x = lines(spark, path)
    tag = F.regexp_extract("value", r"\tLN:i:(\d+)", 1)
    segments = x.where(cell(0) == "S").select(cell(1).alias("name"), cell(2, missing="*").alias("seq"), F.coalesce(tag.try_cast("bigint"), F.length(cell(2)).cast("bigint")).alias("length"))
    return segments, x.where(cell(0) == "L").select(cell(1).alias("src"), cell(2).alias("src_strand"), cell(3).alias("dst"), cell(4).alias("dst_strand"), cell(5).alias("overlap"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """Matrix Market coordinates (row, col, value), from 1; the size line is left out."""
    x = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at")).where("trim(value) != ''")
    mark = F.startswith("value", F.lit("%"))
    size = x.where("block = 0").groupBy("file").agg(F.min(F.when(~mark, F.col("at"))).alias("_size"), F.max(F.startswith("value", F.lit("%%MatrixMarket"))).alias("_head")).where("_head").select("file", "_size")
    x = x.where(~mark).join(F.broadcast(size), "file", "left").where("_size is null or at != _size")  # a row per file
    return x.withColumn("cells", F.split(F.trim("value"), r"\s+")).select(cell(0, "bigint").alias("row"), cell(1, "bigint").alias("col"), F.coalesce(cell(2, "double"), F.lit(1.0)).alias("value"))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Spectra (title, pepmass, charge, peaks array<struct<mz, intensity>> by mz)."""
    x = spark.read.option("lineSep", "BEGIN IONS").text(path).where(F.contains("value", F.lit("END IONS"))).select(F.substring_index("value", "END IONS", 1).alias("v"))
    field = lambda k: F.nullif(F.regexp_extract("v", rf"(?m)^{k}=(.*?)\r?$", 1), F.lit(""))
    rows = F.regexp_extract_all("v", F.lit(r"(?m)^([0-9.eE+]+[ \t]+[0-9.eE+]+)"), F.lit(1))
    peaks = F.array_sort(F.transform(rows, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("mz"), F.split(p, r"\s+")[1].cast("double").alias("intensity"))))
    return x.select(field("TITLE").alias("title"), F.split(field("PEPMASS"), r"\s+")[0].cast("double").alias("pepmass"), F.regexp_extract(field("CHARGE"), r"(\d+)", 1).try_cast("int").alias("charge"), peaks.alias("peaks"))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of ATOM and HETATM records by their fixed columns."""
    x = spark.read.text(path).where(F.rlike("value", F.lit("^(ATOM  |HETATM)")))
    part = lambda a, b, k: F.trim(F.substring("value", a, b - a + 1)).try_cast(k)
    names = [("serial", 7, 11, "int"), ("atom", 13, 16, "string"), ("residue", 18, 20, "string"), ("chain", 22, 22, "string"), ("residue_number", 23, 26, "int"), ("x", 31, 38, "double"), ("y", 39, 46, "double"), ("z", 47, 54, "double"),
             ("occupancy", 55, 60, "double"), ("b_factor", 61, 66, "double"), ("element", 77, 78, "string")]
    return x.select(F.trim(F.substring("value", 1, 6)).alias("record"), *[part(a, b, k).alias(n) for n, a, b, k in names])


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """Gene sets (name, description, genes array)."""
    return lines(spark, path, "").select(cell(0).alias("name"), cell(1).alias("description"), F.filter(F.slice("cells", 3, F.greatest(F.size("cells") - 2, F.lit(0))), lambda x: x != "").alias("genes"))


def read_sif(spark: SparkSession, path: str) -> DataFrame:
    """Edges (src, type, dst); a line may name several targets."""
    x = lines(spark, path).withColumn("cells", F.split("value", r"\t|(?<!\t) +(?!\t)"))
    return x.select(cell(0).alias("src"), cell(1).alias("type"), F.explode(F.slice("cells", 3, F.greatest(F.size("cells") - 2, F.lit(0)))).alias("dst"))


def read_jaspar(spark: SparkSession, path: str) -> DataFrame:
    """Count matrices (id, name, a, c, g, t arrays)."""
    x = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) != ''")
    row = lambda b: F.transform(F.regexp_extract_all(F.regexp_extract("v", rf"(?m)^{b}\s*\[?([^\]\n]*)", 1), F.lit(r"[0-9.]+"), F.lit(0)), lambda n: n.cast("double"))
    return x.select(F.regexp_extract("v", r"^(\S+)", 1).alias("id"), F.regexp_extract("v", r"^\S+[ \t]+([^\r\n]*)", 1).alias("name"), *[row(b).alias(b.lower()) for b in "ACGT"])


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Aligned blocks of a chain file: (chain_id, score, chrom, start, stop, t_chrom, t_start, strand, t_size); a chain is one record."""
    x = spark.read.option("lineSep", "chain ").text(path).where("trim(value) != ''").select(F.split(F.trim("value"), "\r?\n").alias("v"))
    head = F.split(F.col("v")[0], " ")
    rows = F.transform(F.filter(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), lambda r: F.trim(r) != ""), lambda r: F.transform(F.split(F.trim(r), r"\s+"), lambda c: c.cast("bigint")))
    start = F.struct(head[4].cast("bigint").alias("s"), head[9].cast("bigint").alias("t"), F.array().cast("array<struct<start:bigint,size:bigint,t_start:bigint>>").alias("out"))
    gap = lambda r, i: F.coalesce(F.get(r, F.lit(i)), F.lit(0).cast("bigint"))
    blocks = F.aggregate(rows, start, lambda a, r: F.struct((a["s"] + gap(r, 0) + gap(r, 1)).alias("s"), (a["t"] + gap(r, 0) + gap(r, 2)).alias("t"),
                                                            F.concat(a["out"], F.array(F.struct(a["s"].alias("start"), gap(r, 0).alias("size"), a["t"].alias("t_start")))).alias("out")), lambda a: a["out"])
    x = x.select(head[11].cast("bigint").alias("chain_id"), head[0].cast("bigint").alias("score"), head[1].alias("chrom"), head[6].alias("t_chrom"), head[8].alias("strand"), head[7].cast("bigint").alias("t_size"), F.explode(blocks).alias("b"))
    return x.select("chain_id", "score", "chrom", F.col("b.start").alias("start"), (F.col("b.start") + F.col("b.size")).alias("stop"), "t_chrom", F.col("b.t_start").alias("t_start"), "strand", "t_size")


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """Rows of alignment blocks: (block, score, src, start, size, strand, src_size, text)."""
    x = spark.read.option("lineSep", "\na ").text(path).withColumn("block", F.monotonically_increasing_id()).where(F.rlike("value", F.lit(r"(?m)^s\s")))
    rows = F.regexp_extract_all("value", F.lit(r"(?m)^s[ \t]+(\S+[ \t]+\d+[ \t]+\d+[ \t]+[+-][ \t]+\d+[ \t]+\S+)"), F.lit(1))
    x = x.select("block", F.regexp_extract("value", r"score=([-0-9.]+)", 1).try_cast("double").alias("score"), F.explode(rows).alias("r")).withColumn("cells", F.split("r", r"\s+"))
    return x.select("block", "score", cell(0).alias("src"), cell(1, "bigint").alias("start"), cell(2, "bigint").alias("size"), cell(3).alias("strand"), cell(4, "bigint").alias("src_size"), cell(5).alias("text"))


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """Molecules (title, atoms array<struct<x, y, z, element>>, bonds array<struct<a, b, order>> from 1, properties map)."""
    x = spark.read.option("lineSep", "$$$$\n").text(path).where("trim(value) != ''").select(F.split("value", "\r?\n").alias("v"), "value")
    count = lambda at: F.trim(F.substring(F.get("v", F.lit(3)), at, 3)).try_cast("int")
    part = lambda r, at, n, kind: F.trim(F.substring(r, at, n)).try_cast(kind)
    x = x.withColumn("na", count(1)).withColumn("nb", count(4)).where("na is not null and nb is not null")
    atoms = F.transform(F.slice("v", F.lit(5), F.col("na")), lambda r: F.struct(*[part(r, 1 + 10 * i, 10, "double").alias(c) for i, c in enumerate("xyz")], F.trim(F.substring(r, 32, 3)).alias("element")))
    bonds = F.transform(F.slice("v", F.col("na") + 5, F.col("nb")), lambda r: F.struct(*[part(r, 1 + 3 * i, 3, "int").alias(c) for i, c in enumerate(("a", "b", "order"))]))
    fields = F.regexp_extract_all("value", F.lit(r"(?m)^> +<([^>]+)>[^\n]*\n([^\n]*)"), F.lit(0))
    entry = lambda t: F.struct(F.regexp_extract(t, "<([^>]+)>", 1), F.rtrim(F.substring_index(t, "\n", -1)))
    return x.select(F.trim(F.get("v", F.lit(0))).alias("title"), atoms.alias("atoms"), bonds.alias("bonds"), F.map_from_entries(F.transform(fields, entry)).alias("properties"))


def read_nexus_trees(spark: SparkSession, path: str) -> DataFrame:
    """Trees (name, newick) of the trees blocks; a file is read by one task."""
    rows = F.regexp_extract_all("value", F.lit(r"(?im)^\s*u?tree\s+\*?\s*(\S+)\s*=\s*(?:\[[^\]]*\]\s*)*([^;]*;)"), F.lit(0))
    x = spark.read.text(path, wholetext=True).select(F.explode(rows).alias("t"))
    return x.select(F.regexp_extract("t", r"(?i)u?tree\s+\*?\s*([^\s=]+)", 1).alias("name"), F.regexp_extract("t", r"=\s*(?:\[[^\]]*\]\s*)*([^;]*;)", 1).alias("newick"))


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """Motifs (id, name, width, sites, matrix array<array<double>> in order of A, C, G, T)."""
    x = spark.read.option("lineSep", "MOTIF ").text(path).where(F.contains("value", F.lit("letter-probability matrix")))
    rows = F.regexp_extract_all("value", F.lit(r"(?m)^[ \t]*((?:[0-9.eE+-]+[ \t]*){4})\r?$"), F.lit(1))
    matrix = F.transform(rows, lambda r: F.transform(F.split(F.trim(r), r"\s+"), lambda c: c.cast("double")))
    return x.select(F.regexp_extract("value", r"^(\S+)", 1).alias("id"), F.nullif(F.regexp_extract("value", r"^\S+[ \t]+([^\r\n]+)", 1), F.lit("")).alias("name"),
                    F.regexp_extract("value", r"w= *(\d+)", 1).try_cast("int").alias("width"), F.regexp_extract("value", r"nsites= *([0-9.]+)", 1).try_cast("double").alias("sites"), matrix.alias("matrix"))


def flat_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of flat files that end in a line //, one a row."""
    return spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", "\r", "").alias("v")).where("trim(translate(v, '\n', '')) != ''")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Records (name, accession, definition, organism, features array<struct<type, place>>, seq)."""
    x = flat_records(spark, path)
    one = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("v", p, 1), r"\s+", " ")), F.lit(""))
    features = F.transform(F.regexp_extract_all(F.regexp_extract("v", r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\nORIGIN|$)", 1), F.lit(r"(?m)^ {5}(\S+ +\S+)"), F.lit(1)), lambda f: F.struct(F.substring_index(f, " ", 1).alias("type"), F.substring_index(f, " ", -1).alias("place")))
    seq = F.upper(F.regexp_replace(F.regexp_extract("v", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[^A-Za-z]", ""))
    return x.select(one(r"(?m)^LOCUS +(\S+)").alias("name"), one(r"(?m)^ACCESSION +(\S+)").alias("accession"), one(r"(?ms)^DEFINITION +(.*?)\n\S").alias("definition"), one(r"(?m)^ +ORGANISM +(.*)$").alias("organism"), features.alias("features"), seq.alias("seq"))


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """Records (name, accession, description, organism, seq)."""
    x = flat_records(spark, path)
    one = lambda p: F.nullif(F.regexp_extract("v", p, 1), F.lit(""))
    words = F.array_join(F.regexp_extract_all("v", F.lit(r"(?m)^DE +(.*)$"), F.lit(1)), " ")
    seq = F.upper(F.regexp_replace(F.regexp_extract("v", r"(?s)\nSQ [^\n]*\n(.*)$", 1), r"[^A-Za-z]", ""))
    return x.select(one(r"(?m)^ID +([^;\s]+)").alias("name"), one(r"(?m)^AC +([^;\s]+)").alias("accession"), F.nullif(words, F.lit("")).alias("description"), one(r"(?m)^OS +(.*)$").alias("organism"), seq.alias("seq"))


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """Aligned sequences (alignment, name, seq); lines of one name are joined in order."""
    x = flat_records(spark, path).withColumn("a", F.nullif(F.regexp_extract("v", r"(?m)^#=GF +ID +(\S+)", 1), F.lit("")))
    return joined_rows(x.select("a", F.filter(F.split("v", "\n"), lambda r: ~F.rlike(r, F.lit(r"^(#|\s*$)"))).alias("rows")), "a").withColumnRenamed("a", "alignment")


def joined_rows(x: DataFrame, by: str) -> DataFrame:
    """Rows of `name letters` lines, those of one name joined in order."""
    x = x.select(by, F.posexplode("rows").alias("i", "r")).select(by, "i", F.split(F.trim("r"), r"\s+").alias("c")).where("size(c) >= 2")
    x = x.groupBy(by, F.col("c")[0].alias("name")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("c")[1].alias("s")))).alias("s"))
    return x.select(by, "name", F.array_join(F.transform("s", lambda t: t["s"]), "").alias("seq"))


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """Aligned sequences (file, name, seq); an alignment is one file, read by one task."""
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", "\r?\n"), lambda r: ~F.rlike(r, F.lit(r"^(CLUSTAL|MUSCLE|[\s*:.]*$|\s)"))).alias("rows"))
    return joined_rows(x, "file")


def read_phylip(spark: SparkSession, path: str) -> DataFrame:
    """Sequences (file, name, seq) of sequential PHYLIP alignments with a name and letters a line, read by one task each."""
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", "\r?\n"), lambda r: ~F.rlike(r, F.lit(r"^\s*(\d+\s+\d+\s*)?$"))).alias("rows"))
    return joined_rows(x, "file")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst)."""
    nodes, edges = (spark.read.format("xml").option("rowTag", t).schema(s).load(path) for t, s in (("node", "_id string"), ("edge", "_source string, _target string")))
    return nodes.select(F.col("_id").alias("id")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"))


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Spectra (id, ms_level, rt, peaks array<struct<mz, intensity>>) of mzML; arrays of 32 or 64 bits, plain or zlib."""
    param = "array<struct<_accession:string,_name:string,_value:string>>"
    schema = f"_id string, cvParam {param}, scanList struct<scan:array<struct<cvParam:{param}>>>, binaryDataArrayList struct<binaryDataArray:array<struct<cvParam:{param},binary:string>>>"
    x = spark.read.format("xml").option("rowTag", "spectrum").schema(schema).load(path)
    value = lambda params, name: F.get(F.transform(F.filter(params, lambda p: p["_name"] == name), lambda p: p["_value"]), F.lit(0))
    x = x.select(F.col("_id").alias("id"), value(F.col("cvParam"), "ms level").cast("int").alias("ms_level"), value(F.col("scanList.scan")[0]["cvParam"], "scan start time").cast("double").alias("rt"),
                 F.transform("binaryDataArrayList.binaryDataArray", lambda a: F.struct(F.transform(a["cvParam"], lambda p: p["_name"]).alias("kinds"), F.unbase64(F.regexp_replace(a["binary"], r"\s", "")).alias("data"))).alias("arrays"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            peaks = []
            for arrays in b.column("arrays").to_pylist():
                got = {}
                for a in arrays or []:
                    data = zlib.decompress(a["data"]) if "zlib compression" in a["kinds"] else a["data"]
                    got["mz" if "m/z array" in a["kinds"] else "intensity"] = np.frombuffer(data, "<f4" if "32-bit float" in a["kinds"] else "<f8").astype(float)
                peaks.append([{"mz": m, "intensity": i} for m, i in zip(got.get("mz", []), got.get("intensity", []), strict=False)])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ms_level"), b.column("rt"), pa.array(peaks, pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())])))], names=["id", "ms_level", "rt", "peaks"])

    return x.mapInArrow(run, "id string, ms_level int, rt double, peaks array<struct<mz:double,intensity:double>>")


def read_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms (record, serial, element, atom, residue, chain, residue_number, x, y, z, b_factor) of mmCIF files with one column order."""
    lines_ = spark.read.text(path)
    names = [r[0] for r in lines_.select(F.regexp_extract("value", r"^_atom_site\.(\S+)", 1).alias("n"), F.monotonically_increasing_id().alias("i")).where("n != ''").groupBy("n").agg(F.min("i").alias("i")).orderBy("i").collect()]
    x = lines_.where(F.rlike("value", F.lit("^(ATOM|HETATM)\\s"))).withColumn("cells", F.split(F.trim("value"), r"\s+"))
    at = lambda n, k="string": (cell(names.index(n), k) if n in names else F.lit(None).cast(k))
    return x.select(at("group_PDB").alias("record"), at("id", "int").alias("serial"), at("type_symbol").alias("element"), at("label_atom_id").alias("atom"), at("label_comp_id").alias("residue"), at("auth_asym_id").alias("chain"),
                    at("auth_seq_id", "int").alias("residue_number"), at("Cartn_x", "double").alias("x"), at("Cartn_y", "double").alias("y"), at("Cartn_z", "double").alias("z"), at("B_iso_or_equiv", "double").alias("b_factor"))


#: Schemas of Parquet tables by kind.
KINDS = {
    "variants": "chrom string, position bigint, id string, ref string, alts array<string>, quality double, filter string",
    "intervals": "chrom string, start bigint, stop bigint, name string, score double, strand string",
    "expression": "gene string, sample string, value double",
    "reads": "qname string, flag int, rname string, pos bigint, mapq int, cigar string, tlen bigint, sequence string, quality string",
}


def write_typed(df: DataFrame, kind: str, path: str) -> None:
    """A table of one kind as Parquet, in order of place, so that row groups of a region are together."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(KINDS[kind])
    order = [c for c in ("chrom", "rname", "position", "start", "pos", "gene", "sample") if c in fields.names]
    df.select(*[F.col(f.name).cast(f.dataType) for f in fields]).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def read_typed(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.schema(KINDS[kind]).parquet(path)


def read_region(spark: SparkSession, kind: str, path: str, chrom: str, start: int, stop: int) -> DataFrame:
    """The rows of a half-open region: variants whose 1-based place is in it, intervals that overlap it. The filters reach the Parquet scan."""
    x = read_typed(spark, kind, path)
    if kind == "variants":
        return x.where((F.col("chrom") == chrom) & (F.col("position") > start) & (F.col("position") <= stop))
    return x.where((F.col("chrom") == chrom) & (F.col("start") < stop) & (F.col("stop") > start))


def write_lines(df: DataFrame, columns: list[Column], path: str, missing: str = ".") -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(missing)) for c in columns]).alias("value")).write.text(path)


def write_bed(df: DataFrame, path: str) -> None:
    write_lines(df, [F.col(c) for c in ("chrom", "start", "stop", "name", "score", "strand")], path)


def write_bedgraph(df: DataFrame, path: str) -> None:
    write_lines(df, [F.col(c) for c in ("chrom", "start", "stop", "value")], path)


def write_gff3(df: DataFrame, path: str) -> None:
    """Features with a map of attributes, in order of their keys; reserved letters of values are escaped."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "%", "%25"), ";", "%3B"), "=", "%3D"), "\t", "%09")
    notes = F.array_join(F.transform(F.array_sort(F.map_keys("attributes")), lambda k: F.concat(k, F.lit("="), safe(F.col("attributes")[k]))), ";")
    cells = [F.col("chrom"), F.col("source"), F.col("type"), F.col("start") + 1, F.col("stop"), F.col("score"), F.col("strand"), F.col("phase"), notes]
    with_head(["##gff-version 3"], df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(".")) for c in cells]).alias("value")), path)


def write_sam(df: DataFrame, references: list[tuple[str, int]], path: str) -> None:
    """Reads with a header that names the references and their lengths."""
    defaults = {"flag": "0", "pos": "0", "mapq": "255", "pnext": "0", "tlen": "0"}
    cells = [F.coalesce(F.col(n).cast("string"), F.lit(defaults.get(n, "*"))) for n, _ in SAM]
    with_head(["@HD\tVN:1.6", *[f"@SQ\tSN:{n}\tLN:{k}" for n, k in references]], df.select(F.concat_ws("\t", *cells).alias("value")), path)


def write_gmt(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "name", F.coalesce("description", F.lit("")), F.array_join("genes", "\t")).alias("value")).write.text(path)


def write_sif(df: DataFrame, path: str) -> None:
    write_lines(df, [F.col(c) for c in ("src", "type", "dst")], path)


def write_mtx(df: DataFrame, rows: int, cols: int, path: str) -> None:
    """Coordinates (row, col, value) from 1, after the size line."""
    body = df.select(F.concat_ws(" ", "row", "col", F.col("value").cast("string")).alias("value"))
    with_head(["%%MatrixMarket matrix coordinate real general", f"{rows} {cols} {df.count()}"], body, path)


def write_mgf(df: DataFrame, path: str) -> None:
    peaks = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")
    df.select(F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), "title"), F.concat(F.lit("PEPMASS="), F.col("pepmass").cast("string")), F.concat(F.lit("CHARGE="), F.col("charge").cast("string"), F.lit("+")), peaks, F.lit("END IONS")).alias("value")).write.text(path)


def write_gfa(segments: DataFrame, links: DataFrame, path: str) -> None:
    s = segments.select(F.concat_ws("\t", F.lit("S"), "name", F.coalesce("seq", F.lit("*")), F.concat(F.lit("LN:i:"), F.col("length").cast("string"))).alias("value"))
    with_head(["H\tVN:Z:1.0"], s.union(links.select(F.concat_ws("\t", F.lit("L"), "src", "src_strand", "dst", "dst_strand", "overlap").alias("value"))), path)


def with_head(head: list[str], body: DataFrame, path: str) -> None:
    """Write lines: the head is a part of its own that sorts first, so the parts in order of name are the file."""
    body.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).union(body.select("value")).write.text(path)


def write_vcf(df: DataFrame, path: str, head: list[str] | None = None) -> None:
    """The header (## lines, if given, after the file format) and the eight fixed columns; info is a map."""
    info = F.nullif(F.array_join(F.transform(F.array_sort(F.map_keys("info")), lambda k: F.concat(k, F.coalesce(F.concat(F.lit("="), F.col("info")[k]), F.lit("")))), ";"), F.lit(""))
    cells = [F.col("chrom"), F.col("position"), F.col("id"), F.col("ref"), F.array_join("alts", ","), F.col("quality"), F.col("filter"), info]
    body = df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(".")) for c in cells]).alias("value"))
    with_head(["##fileformat=VCFv4.3", *(head or []), "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"], body, path)


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), F.concat_ws(" ", "name", "description"), F.lit("\n"), "seq").alias("value")).write.text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    q = F.array_join(F.transform("qual", lambda x: F.chr(x + PHRED)), "")
    df.select(F.concat(F.lit("@"), F.concat_ws(" ", "name", "description"), F.lit("\n"), "seq", F.lit("\n+\n"), q).alias("value")).write.text(path)


def write_wide(df: DataFrame, item: str, sample: str, value: str, path: str) -> None:
    """A long matrix as wide Parquet, a column per sample."""
    df.groupBy(item).pivot(sample).agg(F.first(value)).write.parquet(path)


def read_wide(spark: SparkSession, path: str, item: str, sample: str, value: str) -> DataFrame:
    x = spark.read.parquet(path)
    return x.unpivot([item], [c for c in x.columns if c != item], sample, value).where(F.col(value).isNotNull())
