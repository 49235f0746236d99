"""Readers on small files and write-read round trips."""

from pyspark.sql import functions as F

from locusframe.sources import text as T


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def test_bed_and_graph(spark, tmp_path):
    p = put(tmp_path, "a.bed", "track name=x\n# note\nchr1\t10\t20\tn1\t5\t+\nchr1\t30\t30\tbad\nchr2\t1\t9\n")
    assert rows(T.read_bed(spark, p)) == [("chr1", 10, 20, "n1", 5.0, "+"), ("chr2", 1, 9, None, None, ".")]
    assert rows(T.read_bedgraph(spark, put(tmp_path, "a.bg", "chr1 0 5 1.5\nchr1\t5\t9\t2\n"))) == [("chr1", 0, 5, 1.5), ("chr1", 5, 9, 2.0)]
    assert rows(T.read_bedpe(spark, put(tmp_path, "a.bedpe", "c1\t1\t2\tc2\t3\t4\tn\t.\t+\t-\n"))) == [("c1", 1, 2, "c2", 3, 4, "n", None, "+", "-")]


def test_features(spark, tmp_path):
    p = put(tmp_path, "a.gff3", "##gff-version 3\nchr1\tsrc\tgene\t11\t20\t.\t+\t.\tID=g1;Name=a%20b\n")
    assert rows(T.read_gff(spark, p), "start", "stop", "score", F.col("attributes")["Name"]) == [(10, 20, None, "a b")]
    p = put(tmp_path, "a.gtf", 'chr1\tsrc\texon\t11\t20\t.\t-\t0\tgene_id "g 1"; transcript_id "t1";\n')
    assert rows(T.read_gff(spark, p, "gtf"), "phase", F.col("attributes")["gene_id"], F.col("attributes")["transcript_id"]) == [(0, "g 1", "t1")]


def test_variants_round_trip(spark, tmp_path):
    p = put(tmp_path, "a.vcf", "##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t100\trs1\ta\tT,G\t30\tPASS\tDP=5;DB\nchr1\t200\t.\tG\tC\t.\tq10\t.\n")
    v = T.read_vcf(spark, p)
    found = rows(v, "chrom", "position", "id", "ref", "alts", "quality", "filter")
    assert found == [("chr1", 100, "rs1", "A", ["T", "G"], 30.0, "PASS"), ("chr1", 200, None, "G", ["C"], None, "q10")]
    assert v.first().info == {"DP": "5", "DB": None}
    assert rows(T.read_vcf_header(spark, p), "key", "id") == [("fileformat", None), ("INFO", "DP")]
    T.write_vcf(v.coalesce(1), str(tmp_path / "b.vcf"))
    again = T.read_vcf(spark, str(tmp_path / "b.vcf"))
    assert rows(again, "chrom", "position", "id", "ref", "alts", "quality", "filter") == found and again.first().info == {"DP": "5", "DB": None}


def test_reads(spark, tmp_path):
    p = put(tmp_path, "a.sam", "@HD\tVN:1\nr1\t99\tchr1\t7\t30\t3M2D4M1S\t=\t37\t39\tTTAGATAA\t*\n")
    assert rows(T.read_sam(spark, p), "qname", "flag", "pos", T.reference_length(F.col("cigar"))) == [("r1", 99, 7, 9)]
    p = put(tmp_path, "a.fa", ">s1 first one\nACgt\nAC\n>s2\nTT\n")
    f = T.read_fasta(spark, p)
    assert rows(f) == [("s1", "first one", "ACGTAC"), ("s2", None, "TT")]
    T.write_fasta(f.coalesce(1), str(tmp_path / "b.fa"))
    assert sorted(rows(T.read_fasta(spark, str(tmp_path / "b.fa")))) == rows(f)
    q = T.read_fastq(spark, put(tmp_path, "a.fq", "@r1 x\nACG\n+\nI!@\n@r2\nT\n+\n@\n"))
    assert rows(q) == [("r1", "x", "ACG", [40, 0, 31]), ("r2", None, "T", [31])]
    T.write_fastq(q.coalesce(1), str(tmp_path / "b.fq"))
    assert rows(T.read_fastq(spark, str(tmp_path / "b.fq"))) == rows(q)


def test_graphs_sets_and_matrices(spark, tmp_path):
    s, links = T.read_gfa(spark, put(tmp_path, "a.gfa", "H\tVN:Z:1.0\nS\ta\tACGT\nS\tb\t*\tLN:i:9\nL\ta\t+\tb\t-\t4M\n"))
    assert rows(s) == [("a", "ACGT", 4), ("b", None, 9)] and rows(links) == [("a", "+", "b", "-", "4M")]
    assert rows(T.read_gmt(spark, put(tmp_path, "a.gmt", "set1\tdesc\tg1\tg2\n"))) == [("set1", "desc", ["g1", "g2"])]
    assert rows(T.read_sif(spark, put(tmp_path, "a.sif", "A\tpp\tB\tC\n"))) == [("A", "pp", "B"), ("A", "pp", "C")]
    assert rows(T.read_mtx(spark, put(tmp_path, "a.mtx", "%%MatrixMarket\n2 2 2\n1 1 5\n2 1 3.5\n"))) == [(1, 1, 5.0), (2, 1, 3.5)]
    m = T.read_jaspar(spark, put(tmp_path, "a.jaspar", ">MA1 name\nA [ 1 2 ]\nC [ 3 4 ]\nG [ 5 6 ]\nT [ 7 8 ]\n")).first()
    assert (m.id, m.name, m.a, m.t) == ("MA1", "name", [1.0, 2.0], [7.0, 8.0])
    wide = str(tmp_path / "wide")
    long = spark.createDataFrame([("g1", "s1", 1.0), ("g1", "s2", 2.0), ("g2", "s1", 3.0)], "gene string, sample string, value double")
    T.write_wide(long, "gene", "sample", "value", wide)
    assert sorted(rows(T.read_wide(spark, wide, "gene", "sample", "value"))) == sorted(rows(long))


def test_spectra_structures_chains(spark, tmp_path):
    m = T.read_mgf(spark, put(tmp_path, "a.mgf", "BEGIN IONS\nTITLE=t1\nPEPMASS=500.5 10\nCHARGE=2+\n200.1 5\n100.2 7\nEND IONS\nBEGIN IONS\nTITLE=t2\nPEPMASS=1\n1 2\nEND IONS\n"))
    assert [(r.title, r.pepmass, r.charge, [(p.mz, p.intensity) for p in r.peaks]) for r in m.collect()] == [("t1", 500.5, 2, [(100.2, 7.0), (200.1, 5.0)]), ("t2", 1.0, None, [(1.0, 2.0)])]
    line = "ATOM      1  CA  ALA A  10      11.104   6.134  -6.504  1.00  0.50           C"
    assert rows(T.read_pdb(spark, put(tmp_path, "a.pdb", line + "\nTER\n")), "atom", "residue", "chain", "residue_number", "x", "element") == [("CA", "ALA", "A", 10, 11.104, "C")]
    c = T.read_chain(spark, put(tmp_path, "a.chain", "chain 100 chr1 1000 + 100 600 chrA 800 + 50 500 7\n200 100 50\n200\n\n"))
    assert rows(c, "chain_id", "start", "stop", "t_chrom", "t_start") == [(7, 100, 300, "chrA", 50), (7, 400, 600, "chrA", 300)]
    a = T.read_maf(spark, put(tmp_path, "a.maf", "##maf version=1\na score=5.0\ns hg.chr1 10 4 + 100 AC-GT\ns mm.chr2 20 5 - 90 ACTGT\n\n"))
    assert rows(a, "score", "src", "start", "size", "text") == [(5.0, "hg.chr1", 10, 4, "AC-GT"), (5.0, "mm.chr2", 20, 5, "ACTGT")]
    assert rows(T.read_blast(spark, put(tmp_path, "a.tsv", "q\ts\t99.5\t10\t0\t0\t1\t10\t1\t10\t1e-5\t50\n")), "identity", "evalue") == [(99.5, 1e-5)]


def test_molecules_trees_motifs(spark, tmp_path):
    atom = lambda x, e: f"{x:10.4f}{0:10.4f}{0:10.4f} {e:<3} 0  0"
    body = "ethanol\n  prog\n\n  3  2  0\n" + "\n".join([atom(0, "C"), atom(1.5, "C"), atom(2, "O"), "  1  2  1  0", "  2  3  1  0", "M  END", "> <ID>", "E1", "", "> <MW>", "46.07", ""]) + "\n$$$$\n"
    m = T.read_sdf(spark, put(tmp_path, "a.sdf", body + body.replace("ethanol", "two"))).collect()
    assert [r.title for r in m] == ["ethanol", "two"] and [a.element for a in m[0].atoms] == ["C", "C", "O"] and m[0].atoms[1].x == 1.5
    assert [tuple(b) for b in m[1].bonds] == [(1, 2, 1), (2, 3, 1)] and m[0].properties == {"ID": "E1", "MW": "46.07"}
    t = T.read_nexus_trees(spark, put(tmp_path, "a.nex", "#NEXUS\nbegin trees;\n  tree one = [&R] ((A,B),C);\n  tree two = (A,(B,C));\nend;\n"))
    assert rows(t) == [("one", "((A,B),C);"), ("two", "(A,(B,C));")]
    q = T.read_meme(spark, put(tmp_path, "a.meme", "MEME version 4\n\nMOTIF M1 first\nletter-probability matrix: alength= 4 w= 2 nsites= 20\n 0.1 0.2 0.3 0.4\n 1.0 0 0 0\n\nMOTIF M2\nletter-probability matrix: w= 1\n 0.25 0.25 0.25 0.25\n")).collect()
    assert [(r.id, r.name, r.width, r.sites) for r in q] == [("M1", "first", 2, 20.0), ("M2", None, 1, None)] and q[0].matrix == [[0.1, 0.2, 0.3, 0.4], [1.0, 0.0, 0.0, 0.0]]
