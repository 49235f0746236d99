"""Reads, spectra, quality and order-dependent measures on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from locusframe.operators import alignment, genetics, ordering, quality, reads, spectra


def test_running_totals_over_partitions(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(-9, 9)) for i in rnd.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k long, v long")
    for parts in (1, 7):
        found = {r.k: (r.s, r.m, r.p, r.n) for r in ordering.running(df, [F.desc("k")], {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "p": ("lag", F.col("v")), "n": ("sum", F.lit(1))}, parts).collect()}
        total, least, before = 0, None, None
        for n, (k, v) in enumerate(sorted(rows, reverse=True), 1):
            total, least = total + v, v if least is None else min(least, v)
            assert found[k] == (total, least, before, n)
            before = v
    assert ordering.positions(df.where("false"), [F.asc("k")]).collect() == []


def test_cigar_and_mates(spark):
    x = spark.createDataFrame([("3M2I4D1S", 6, 7), ("*", 0, 0), (None, 0, 0), ("10M5N2=1X", 13, 18)], "c string, r long, f long")
    for r in x.select("r", "f", reads.cigar_sum(F.col("c"), reads.READ).alias("a"), reads.cigar_sum(F.col("c"), reads.REFERENCE).alias("b")).collect():
        assert (r.a, r.b) == (r.r, r.f)
    pair = [("p", 65, "c", 100, "10M"), ("p", 129, "c", 150, "20M"), ("p", 65 + 256, "c", 1, "10M"), ("q", 65, "c", 90, "5M"), ("q", 129, "d", 10, "5M"), ("s", 129, "c", 10, "5M2D3M"), ("s", 65, "c", 40, "5M")]
    found = {r.qname: (r.pos, r.pnext, r.tlen) for r in reads.fix_mates(spark.createDataFrame(pair, "qname string, flag int, rname string, pos long, cigar string")).collect()}
    assert found == {"p": (100, 150, 70), "q": (90, 10, 0), "s": (40, 10, -35)}


def test_trim_point(spark):
    def expected(q, t):
        best, at, s = 0, len(q), 0
        for i in range(len(q) - 1, -1, -1):
            s += t - q[i]
            if s < 0:
                break
            if s > best:
                best, at = s, i
        return at

    rnd = random.Random(2)
    rows = [([rnd.randint(0, 40) for _ in range(rnd.randint(0, 12))],) for _ in range(60)]
    for r in spark.createDataFrame(rows, "q array<int>").select("q", quality.trim_point(F.col("q"), 20).alias("n"), quality.mean_quality(F.col("q")).alias("m")).collect():
        assert r.n == expected(r.q, 20) and r.m == pytest.approx(sum(r.q) / len(r.q) if r.q else 0)


def test_best_matches_and_peaks(spark):
    m = spark.createDataFrame([(1, "A", 5.0), (1, "B", 9.0), (1, "C", 9.0), (2, "D", 1.0)], "spectrum int, peptide string, score double")
    assert sorted((r.spectrum, r.peptide, r.delta) for r in spectra.best_matches(m, "score", "peptide").collect()) == [(1, "B", 0.0), (2, "D", 0.0)]
    p = spark.createDataFrame([(1, 10.0, 5.0), (1, 20.0, 50.0), (1, 30.0, 50.0)], "id int, mz double, intensity double")
    assert [r.mz for r in spectra.top_peaks(p, 1).collect()] == [20.0] and sorted(r.mz for r in spectra.above(p, 0.5).collect()) == [20.0, 30.0]
    assert spectra.total_ion_current(p).first()[1:] == (3, 105.0, 50.0, 20.0)


def test_variants_in_shortest_form(spark):
    cases = {(10, "ATT", "AT"): (10, "AT", "A"), (10, "GCAT", "GTAT"): (11, "C", "T"), (5, "A", "T"): (5, "A", "T"), (5, "AAA", "A"): (5, "AAA", "A"), (7, "CAT", "CATCAT"): (7, "C", "CATC"), (3, "TTTT", "TT"): (3, "TTT", "T")}
    x = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "id int, position long, ref string, alt string")
    assert {r.id: (r.position, r.ref, r.alt) for r in genetics.normalise_variants(x).collect()} == dict(enumerate(cases.values()))


def test_alignments_of_a_batch_are_those_of_each_pair():
    rnd = random.Random(4)
    pairs = [("".join(rnd.choice("ACG") for _ in range(rnd.randint(0, n))), "".join(rnd.choice("ACG") for _ in range(rnd.randint(0, n)))) for n in (3, 30, 90) for _ in range(40)] + [("", ""), ("A", ""), ("", "A")]
    for mode in ("global", "local", "semiglobal"):
        many = alignment.align_many(pairs, mode)
        assert many == [alignment.align(a, b, mode) for a, b in pairs]
        assert alignment.align_many(pairs, mode, band=200) == many
    # within the band the best path is the best path
    for a, b in pairs:
        near = a[: len(a) // 2] + "G" + a[len(a) // 2 :]
        assert alignment.align(a, near, band=3)[0] == alignment.align(a, near)[0] and alignment.align(a, b, band=0)[0] <= alignment.align(a, b)[0]


def consequence(v, t, beside=5000, splice=8):
    """One variant on one transcript, base by base."""
    from locusframe.functions.sequence import codons

    _, chrom, position, ref, alt = v
    name, c, start, stop, strand, coding, exons, cs, ce, cds = t
    p, back = position - 1, strand == "-"
    if chrom != c or not start - beside <= p < stop + beside:
        return None
    if p < start:
        return "downstream" if back else "upstream"
    if p >= stop:
        return "upstream" if back else "downstream"
    if not coding:
        return "non_coding"
    inside = [q for a, b in exons for q in range(a, b)]
    if p not in inside:
        left, right = max((p - q for q in inside if q < p), default=99) and min(p - q for q in inside if q < p) - 1, min(q - p for q in inside if q > p) - 1
        donor, acceptor = (right, left) if back else (left, right)
        return "splice_donor" if donor < 2 else "splice_acceptor" if acceptor < 2 else "splice_region" if min(left, right) < splice else "intron"
    if not cs <= p < ce:
        return "utr_5" if (p < cs) != back else "utr_3"
    bases = [q for q in inside if cs <= q < ce]
    at = (bases[::-1] if back else bases).index(p)
    if len(ref) != 1 or len(alt) != 1:
        grown = len(alt) - len(ref)
        return "frameshift" if grown % 3 else "inframe_insertion" if grown > 0 else "inframe_deletion" if grown < 0 else "block_substitution"
    old = cds[at // 3 * 3 : at // 3 * 3 + 3]
    letter = alt.translate(str.maketrans("ACGT", "TGCA")) if back else alt
    new = old[: at % 3] + letter + old[at % 3 + 1 :]
    a, b = (codons()[x] for x in (old, new))
    return "start_lost" if at < 3 and a != b else "synonymous" if a == b else "stop_gained" if b == "*" else "stop_lost" if a == "*" else "missense"


def test_consequences_base_by_base(spark):
    from locusframe.operators import effects

    rnd = random.Random(9)
    t = []
    for i in range(4):
        start = 100 + 150 * i
        exons = [(start, start + 30), (start + 60, start + 95), (start + 97, start + 120)]
        cds = "ATG" + "".join(rnd.choice(["GCA", "TTG", "AAA", "TAT", "CAG"]) for _ in range(24)) + "TAA"
        bases = [q for a, b in exons for q in range(a, b)]
        t.append((f"t{i}", "c1" if i < 3 else "c2", start, start + 120, "+-"[i % 2], i != 2, exons, bases[3], bases[3 + 78 - 1] + 1, cds))
    v = [(i, rnd.choice(["c1", "c2"]), rnd.randint(60, 720), *rnd.choice([("A", "C"), ("A", "G"), ("C", "T"), ("G", "A"), ("T", "A"), ("A", "AC"), ("ACGT", "A"), ("A", "ACGT"), ("AC", "GT")])) for i in range(700)]
    df = spark.createDataFrame(v, "id long, chrom string, position long, ref string, alt string")
    tt = spark.createDataFrame(t, "transcript string, chrom string, start long, stop long, strand string, coding boolean, exons array<struct<start:long,stop:long>>, cds_start long, cds_stop long, cds string")
    found = {(r.id, r.transcript): r.effect for r in effects.variant_effects(df, tt, 20, 64).collect()}
    expected = {(x[0], y[0]): e for x in v for y in t if (e := consequence(x, y, 20))}
    assert found == expected and len(set(expected.values())) >= 14


def test_bam_is_read(spark, tmp_path):
    import gzip
    import struct

    from locusframe.sources import bam

    def record(name, flag, ref, pos, mapq, ops, mate, mate_pos, tlen, seq, qual):
        packed = bytes((bam.BASES.index(a) << 4 | (bam.BASES.index(b) if b else 0)) for a, b in zip(seq[::2], [*seq[1::2], ""] if len(seq) % 2 else seq[1::2]))
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(seq), mate, mate_pos - 1, tlen) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(o)) for n, o in ops) + packed + (bytes(qual) if qual else b"\xff" * len(seq)) + b"XXi\1\0\0\0"
        return struct.pack("<i", len(body)) + body

    head = b"BAM\1" + struct.pack("<i", 5) + b"@HD\tX" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + b"\0" + struct.pack("<i", 1000) for n in (b"chr1", b"chr2"))
    reads_ = [record(f"r{i}", 99, 0, 7 + i, 30, [(3, "M"), (2, "D"), (2, "S")], 0, 37, 39, "ACGTN", [1, 2, 3, 4, 40]) for i in range(300)]
    reads_ += [record("m", 1, 1, 5, 9, [(4, "M")], 0, 2, 0, "ACGT", None), record("u", 4, -1, 0, 0, [], -1, 0, 0, "", None)]
    data = head + b"".join(reads_)
    (tmp_path / "a.bam").write_bytes(b"".join(gzip.compress(data[i : i + 4000]) for i in range(0, len(data), 4000)) + gzip.compress(b""))
    found = {r.qname: r for r in bam.read_bam(spark, str(tmp_path / "a.bam")).collect()}
    assert len(found) == 302 and tuple(found["r2"]) == ("r2", 99, "chr1", 9, 30, "3M2D2S", "=", 37, 39, "ACGTN", "\"#$%I")
    assert tuple(found["m"])[:9] == ("m", 1, "chr2", 5, 9, "4M", "chr1", 2, 0) and found["m"].quality is None
    assert tuple(found["u"]) == ("u", 4, "*", 0, 0, "*", "*", 0, 0, "*", None)


def test_fragment_rows_are_those_of_the_column(spark):
    from locusframe.operators import molecules

    x = spark.createDataFrame([("PEPTIDE",), ("K",), ("GG",), ("",)], "peptide string")
    rows = {(r.peptide, r.ion, r.number): r.mz for r in molecules.fragment_table(x).collect()}
    column = x.select("peptide", F.explode(molecules.fragment_ions(F.col("peptide"))).alias("f")).collect()
    assert rows == {(r.peptide, r.f.ion, r.f.number): pytest.approx(r.f.mz) for r in column} and len(rows) == 14
