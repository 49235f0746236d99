"""Readers of record, alignment and XML formats; files that many tasks read."""

import base64
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from locusframe.sources import text as T


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(p)


def test_fastq_in_many_splits(spark, tmp_path):
    rnd = random.Random(1)
    reads = [(f"r{i}", "".join(rnd.choice("ACGT") for _ in range(n)), "".join(chr(rnd.choice([64, 43, *range(33, 74)])) for _ in range(n))) for i, n in enumerate(rnd.randint(1, 90) for _ in range(200))]
    for name, end in (("a", "\n"), ("b", "\r\n")):
        put(tmp_path, f"{name}.fq", "".join(f"@{n} x{end}{s}{end}+{end}{q}{end}" for n, s, q in reads))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = T.read_fastq(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert sorted((r.name, r.seq, tuple(r.qual)) for r in found.collect()) == sorted((n, s, tuple(ord(c) - 33 for c in q)) for n, s, q in reads * 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    one, two = (spark.createDataFrame([(f"p/{k}", "ACGT", [1, 2, 3, 4])], "name string, seq string, qual array<int>") for k in (1, 2))
    assert [tuple(r) for r in T.paired(one, two).collect()] == [("p", "ACGT", [1, 2, 3, 4], "ACGT", [1, 2, 3, 4])]
    assert [tuple(r) for r in T.fasta_index(one).collect()] == [("p/1", 4)]


def test_flat_records(spark, tmp_path):
    g = "LOCUS       AB1  12 bp DNA\nDEFINITION  A made\n            record.\nACCESSION   AB000001\n  ORGANISM  Homo sapiens\nFEATURES             Location/Qualifiers\n     gene            1..12\n                     /gene=\"x\"\n     CDS             3..9\nORIGIN\n        1 acgtac gtacgt\n//\n"
    r = T.read_genbank(spark, put(tmp_path, "a.gb", g + g.replace("AB1", "AB2"))).orderBy("name").collect()
    assert [x.name for x in r] == ["AB1", "AB2"] and (r[0].accession, r[0].definition, r[0].organism, r[0].seq) == ("AB000001", "A made record.", "Homo sapiens", "ACGTACGTACGT")
    assert [tuple(f) for f in r[1].features] == [("gene", "1..12"), ("CDS", "3..9")]
    e = "ID   X1; SV 1; linear; DNA; 8 BP.\nAC   X00001;\nDE   first part\nDE   second part\nOS   Mus musculus\nSQ   Sequence 8 BP;\n     acgtacgt        8\n//\n"
    assert [tuple(x) for x in T.read_embl(spark, put(tmp_path, "a.embl", e)).collect()] == [("X1", "X00001", "first part second part", "Mus musculus", "ACGTACGT")]


def test_alignments(spark, tmp_path):
    s = "# STOCKHOLM 1.0\n#=GF ID fam\nseq1 AC-G\nseq2 ACTG\n#=GC SS ....\n\nseq1 TT\nseq2 T-\n//\n"
    assert sorted(tuple(r) for r in T.read_stockholm(spark, put(tmp_path, "a.sto", s)).collect()) == [("fam", "seq1", "AC-GTT"), ("fam", "seq2", "ACTGT-")]
    c = "CLUSTAL W (1.8)\n\nseq1   AC-G 4\nseq2   ACTG 4\n       ** *\n\nseq1   TT\nseq2   T-\n"
    assert sorted((r.name, r.seq) for r in T.read_clustal(spark, put(tmp_path, "a.aln", c)).collect()) == [("seq1", "AC-GTT"), ("seq2", "ACTGT-")]
    p = " 2 6\nseq1 ACGTAC\nseq2 ACGTA-\n"
    assert sorted((r.name, r.seq) for r in T.read_phylip(spark, put(tmp_path, "a.phy", p)).collect()) == [("seq1", "ACGTAC"), ("seq2", "ACGTA-")]


def test_xml_formats(spark, tmp_path):
    g = '<graphml><graph edgedefault="directed"><node id="a"/><node id="b"></node><edge source="a" target="b"/></graph></graphml>'
    nodes, edges = T.read_graphml(spark, put(tmp_path, "a.graphml", g))
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"] and [tuple(r) for r in edges.collect()] == [("a", "b")]

    def array(values, kind, packed, name):
        data = np.array(values, kind).tobytes()
        data = base64.b64encode(zlib.compress(data) if packed else data).decode()
        return f'<binaryDataArray><cvParam accession="x" name="{"32" if kind == "<f4" else "64"}-bit float" value=""/><cvParam accession="y" name="{"zlib compression" if packed else "no compression"}" value=""/><cvParam accession="z" name="{name}" value=""/><binary>{data}</binary></binaryDataArray>'

    spectrum = lambda i, packed: (f'<spectrum id="s{i}"><cvParam accession="l" name="ms level" value="{i}"/><scanList count="1"><scan><cvParam accession="t" name="scan start time" value="1.5"/></scan></scanList><binaryDataArrayList count="2">'
                                  + array([100.5, 200.25], "<f8", packed, "m/z array") + array([7.0, 9.0], "<f4", packed, "intensity array") + "</binaryDataArrayList></spectrum>")
    found = T.read_mzml(spark, put(tmp_path, "a.mzML", f"<mzML><run><spectrumList>{spectrum(1, False)}{spectrum(2, True)}</spectrumList></run></mzML>")).orderBy("id").collect()
    assert [(r.id, r.ms_level, r.rt, [tuple(p) for p in r.peaks]) for r in found] == [(f"s{i}", i, 1.5, [(100.5, 7.0), (200.25, 9.0)]) for i in (1, 2)]


def test_atoms(spark, tmp_path):
    body = "data_x\nloop_\n" + "".join(f"_atom_site.{n}\n" for n in ("group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "Cartn_x", "Cartn_y", "Cartn_z", "auth_seq_id", "auth_asym_id")) + "ATOM 1 C CA ALA 1.5 2.5 -3.5 10 A\nHETATM 2 O O HOH 0 0 1 20 B\n#\n"
    found = T.read_mmcif(spark, put(tmp_path, "a.cif", body)).orderBy("serial").collect()
    assert [(r.record, r.atom, r.residue, r.chain, r.residue_number, r.x, r.z, r.b_factor) for r in found] == [("ATOM", "CA", "ALA", "A", 10, 1.5, -3.5, None), ("HETATM", "O", "HOH", "B", 20, 0.0, 1.0, None)]


def test_regions_reach_the_scan(spark, tmp_path):
    x = spark.range(2000).select(F.concat(F.lit("chr"), (F.col("id") % 3).cast("string")).alias("chrom"), F.col("id").alias("start"), (F.col("id") + 10).alias("stop"), F.lit(None).alias("name"), F.lit(1).alias("score"), F.lit("+").alias("strand"))
    T.write_typed(x, "intervals", str(tmp_path / "t"))
    found = T.read_region(spark, "intervals", str(tmp_path / "t"), "chr1", 100, 130)
    assert sorted(r.start for r in found.collect()) == [i for i in range(91, 130) if i % 3 == 1]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(chrom,chr1)" in plan and "LessThan(start,130)" in plan
