"""Library operators against brute force and hand-computed values on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import sequence as Q
from locusframe.operators import alignment, ecology, genetics, graphs, intervals, molecules, sequences, stats, trees, vectors


@pytest.fixture(scope="module")
def sets(spark):
    rnd = random.Random(2)
    make = lambda n: [(f"c{rnd.randrange(3)}", s := rnd.randrange(80), s + rnd.randrange(1, 12), f"i{k}") for k in range(n)]
    a, b = make(60), make(25)
    frame = lambda rows: spark.createDataFrame(rows, "chrom string, start long, stop long, id string")
    return a, b, frame(a), frame(b)


def bases(rows):
    return {(c, p) for c, s, e, *_ in rows for p in range(s, e)}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_algebra(sets, width):
    a, b, da, db = sets
    merged = [tuple(r) for r in intervals.merge(da, bin_width=width).select("chrom", "start", "stop").collect()]
    assert bases(merged) == bases(a) and sum(e - s for _, s, e in merged) == len(bases(a))
    assert sorted(intervals.merge(intervals.merge(da), bin_width=width).select("chrom", "start", "stop").collect()) == sorted(merged)
    over = [(x, y) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]]
    assert sorted((r.id, r.b_id) for r in intervals.range_join(da, db, width).collect()) == sorted((x[3], y[3]) for x, y in over)
    hit = {x[3] for x, _ in over}
    assert {r.id for r in intervals.range_join(da, db, width, "left_semi").collect()} == hit
    assert {r.id for r in intervals.range_join(da, db, width, "left_anti").collect()} == {x[3] for x in a} - hit
    cut = intervals.subtract(da, db, width).select("chrom", "start", "stop", "id").collect()
    for x in a:
        assert bases([tuple(r) for r in cut if r.id == x[3]]) == bases([x]) - bases(b)
    near = {r.id: r for r in intervals.closest(da, db, width).collect()}
    for x in a:
        best = min((max(0, y[1] - x[2], x[1] - y[2]), y[1], y[2]) for y in b if y[0] == x[0])
        assert (near[x[3]].distance, near[x[3]].b_start, near[x[3]].b_stop) == best
    j = intervals.jaccard(da, db, width).first()
    assert (j.shared, j.either) == (len(bases(a) & bases(b)), len(bases(a) | bases(b)))


def test_coverage_and_complement(sets, spark):
    a, _, da, _ = sets
    depth = {}
    for c, s, e, _ in a:
        for p in range(s, e):
            depth[c, p] = depth.get((c, p), 0) + 1
    found = {(r.chrom, p): r.depth for r in intervals.coverage(da).collect() for p in range(r.start, r.stop)}
    assert found == depth
    genome = spark.createDataFrame([("c0", 100), ("c1", 100), ("c2", 100), ("c9", 10)], "chrom string, size long")
    gaps = [tuple(r) for r in intervals.complement(da, genome).collect()]
    assert bases(gaps) == {(c, p) for c, n in (("c0", 100), ("c1", 100), ("c2", 100), ("c9", 10)) for p in range(n)} - bases(a)
    assert intervals.merge(da.where("false")).collect() == []


def test_statistics(spark):
    x = spark.createDataFrame([(float(i * i), 1) for i in range(10)] + [(5.0, 2)] * 3, "v double, g int")
    d = {r.g: r for r in stats.describe(x, "v", ["g"]).collect()}
    assert d[1].median == 20.5 and round(d[1].skewness, 5) == 0.67357 and round(d[1].kurtosis, 5) == -0.86002
    assert (d[2].sd, d[2].skewness, d[2].kurtosis) == (0, 0, 0)
    p = spark.createDataFrame([(i, 1, v) for i, v in enumerate([0.01, 0.04, 0.03, 0.04, 0.5])], "i int, g int, p double")
    adjusted = {r.i: r for r in stats.adjust(p, "p", ["g"]).collect()}
    assert [round(adjusted[i].bh, 6) for i in range(5)] == [0.05, 0.05, 0.05, 0.05, 0.5]
    assert adjusted[0].bonferroni == 0.05 and adjusted[4].bonferroni == 1.0 and adjusted[1].holm == adjusted[3].holm
    flat = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 3.0, 1)], "x double, y double, g int")
    assert stats.pearson(flat, "x", "y", ["g"]).first().r == 0
    assert {r.z for r in stats.z_scores(flat, "x", ["g"]).collect()} == {0.0}


def test_ecology(spark):
    x = spark.createDataFrame([("S1", "a", 10), ("S1", "b", 5), ("S1", "d", 1), ("S2", "a", 20), ("S2", "c", 3), ("S2", "d", 2)], "sample string, taxon string, n long")
    d = {r.sample: r for r in ecology.diversity(x).collect()}
    p = np.array([10, 5, 1]) / 16
    assert d["S1"].observed == 3 and d["S1"].shannon == pytest.approx(-(p * np.log(p)).sum()) and d["S1"].chao1 == 3
    b = ecology.between(x).first()
    assert b.bray_curtis == pytest.approx((10 + 5 + 3 + 1) / 41) and b.jaccard == pytest.approx(0.5)
    assert {r.sample: r.s for r in ecology.rarefy(x, 8).groupBy("sample").agg(F.sum("rarefied").alias("s")).collect()} == {"S1": 8, "S2": 8}
    with pytest.raises(Exception, match="clr needs positive"):
        ecology.clr(x.withColumn("n", F.col("n") - 1)).collect()


def test_filter_language(spark):
    x = spark.createDataFrame([(1, 30.0, "SNV", "PASS"), (2, None, "SNV", "PASS"), (3, 50.0, "INS", "q10")], "i int, quality double, type string, filter string").withColumn("chrom", F.lit("1"))
    keep = lambda t: [r.i for r in x.where(genetics.compile_filter(t)).orderBy("i").collect()]
    assert keep("QUAL >= 30") == [1, 3] and keep("QUAL < 1") == [2]
    assert keep('TYPE == "INS" || QUAL > 10 && FILTER == "PASS"') == [1, 3] and keep('!(TYPE == "SNV")') == [3]
    for bad in ("QUAL >>= 3", "SIZE > 1", "(QUAL > 1", "QUAL > 1 QUAL", ""):
        with pytest.raises(ValueError):
            genetics.compile_filter(bad)


def test_survival_and_scores(spark):
    x = spark.createDataFrame([(float(t), True, 1) for t in range(1, 6)], "time double, event boolean, g int")
    assert [round(r.survival, 9) for r in genetics.kaplan_meier(x, ["g"]).orderBy("time").collect()] == [0.8, 0.6, 0.4, 0.2, 0.0]
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, pos boolean")
    assert genetics.area(genetics.roc(s, "score", "pos"), "fpr", "tpr").first().auc == pytest.approx(0.875)
    c = genetics.confusion(s.withColumn("g", F.col("score") > 0.5), "pos", "g").first()
    assert (c.tp, c.fp, c.fn, c.tn) == (2, 1, 0, 1) and c.mcc == pytest.approx(2 / math.sqrt(12))
    n = genetics.n50(spark.createDataFrame([(v, 1) for v in (2, 3, 5, 10)], "l long, g int"), "l", ["g"]).first()
    assert (n.total, n.n50, n.l50, n.n90) == (20, 10, 1, 3)


def test_sequences(spark):
    seq = "ATGAAACGTTAGCCNATGTTTTAACATG"
    df = spark.createDataFrame([(1, seq), (2, ""), (3, None), (4, "acg")], "id long, seq string")
    counts = {r.kmer: r.n for r in sequences.kmer_counts(df, 3).collect()}
    expected = {}
    for s in (seq, "ACG"):
        for i in range(len(s) - 2):
            if "N" not in s[i : i + 3]:
                expected[s[i : i + 3]] = expected.get(s[i : i + 3], 0) + 1
    assert counts == expected
    frames = {(r.strand, r.frame, r.start, r.stop) for r in sequences.reading_frames(df, 6).collect()}
    assert ("+", 0, 0, 12) in frames
    r = df.where("id = 1").select(Q.reverse_complement(F.col("seq")).alias("r"), Q.gc_content(F.col("seq")).alias("gc"), Q.occurrences(F.col("seq"), "TT").alias("n")).first()
    assert r.r == seq[::-1].translate(str.maketrans("ACGT", "TGCA")) and r.n == 4 and r.gc == pytest.approx(9 / 27)
    assert {r.id: r.protein for r in sequences.translate(df).collect()}[1] == "MKR*XMF*H"
    k = sequences.kmer_codes("ACGTT", 3)
    assert [x for x in sequences.spelled(sequences.canonical(k, 3), 3)] == ["ACG", "ACG", "AAC"]
    a, b = ([r.sketch for r in sequences.sketches(spark.createDataFrame([(1, s)], "id long, seq string"), 3, 8).collect()][0] for s in ("ACGTACGA", "ACGTACGA"))
    assert sequences.sketch_jaccard(a, b, 8) == 1.0
    reads = spark.createDataFrame([(1, "AACCGGTTAD", [2, 30, 30, 30, 30, 30, 30, 5, 30, 2]), (2, "AC", [1, 1])], "id long, seq string, qual array<int>")
    assert [(r.id, r.seq) for r in sequences.trim_reads(reads, "TTA", 20, 3, 2).collect()] == [(1, "ACCGG")]
    assert Q.WATER > 18


def brute_global(a, b, match=2, mismatch=-1, gap_open=-5, gap_extend=-2):
    from functools import lru_cache

    @lru_cache(None)
    def best(i, j, state):
        if i == 0 and j == 0:
            return 0 if state == "h" else -10**9
        options = []
        if state == "h":
            if i and j:
                options.append(best(i - 1, j - 1, "h") + (match if a[i - 1] == b[j - 1] else mismatch))
            options += [best(i, j, "e"), best(i, j, "f")]
        elif state == "e" and j:
            options += [best(i, j - 1, "h") + gap_open + gap_extend, best(i, j - 1, "e") + gap_extend]
        elif state == "f" and i:
            options += [best(i - 1, j, "h") + gap_open + gap_extend, best(i - 1, j, "f") + gap_extend]
        return max(options, default=-10**9)

    return best(len(a), len(b), "h")


def test_alignment():
    rnd = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rnd.choice("ACG") for _ in range(rnd.randrange(0, 12))) for _ in range(2))
        score, cigar, i, j = alignment.align(a, b)
        assert score == brute_global(a, b) and (i, j) == (0, 0)
        spent = {"M": (1, 1), "I": (1, 0), "D": (0, 1)}
        import re

        used = [(int(n), op) for n, op in re.findall(r"(\d+)([MID])", cigar)]
        assert (sum(n * spent[o][0] for n, o in used), sum(n * spent[o][1] for n, o in used)) == (len(a), len(b))
        local = alignment.align(a, b, "local")[0]
        assert local == max([0] + [brute_global(a[p:q], b[r:s]) for p in range(len(a)) for q in range(p, len(a) + 1) for r in range(len(b)) for s in range(r, len(b) + 1)]) if len(a) * len(b) < 40 else local >= 0


def test_trees():
    text = "((A:1,B:2)x:0.5,('C d':3,E)[note]:1.25);"
    nodes = trees.parse_newick(text)
    assert trees.write_newick(nodes) == "((A:1,B:2)x:0.5,('C d':3,E):1.25);"
    assert trees.robinson_foulds("((A,B),(C,D),E);", "((A,C),(B,D),E);") == 4 and trees.robinson_foulds("((A,B),(C,D),E);", "(E,(D,C),(B,A));") == 0
    d = {("a", "b"): 2, ("a", "c"): 6, ("a", "d"): 6, ("b", "c"): 6, ("b", "d"): 6, ("c", "d"): 4}
    assert trees.upgma(list("abcd"), d) == "((a:1.000000,b:1.000000):2.000000,(c:2.000000,d:2.000000):1.000000);"
    assert trees.robinson_foulds(trees.neighbor_joining(list("abcd"), d), "((a,b),(c,d));") == 0
    t = trees.parse_newick("((A:1,B:1):1,(C:1,D:1):1);")
    assert trees.unifrac(t, {"A": 1, "B": 1}, {"C": 1, "D": 1}) == (1.0, 1.0) and trees.unifrac(t, {"A": 1}, {"A": 5}) == (0.0, 0.0)
    for bad in ("((A,B);", "(A,B));", "A,B;"):
        with pytest.raises(ValueError):
            trees.parse_newick(bad)


def test_molecules(spark):
    cases = {"CCO": ("C2H6O", 46.069, 0), "c1ccccc1": ("C6H6", 78.114, 1), "CC(=O)Oc1ccccc1C(=O)O": ("C9H8O4", 180.159, 1), "C[N+](C)(C)C": ("C4H12N", 74.147, 0), "ClC(Cl)Cl": ("CHCl3", 119.37, 0), "C1CC1.O": ("C3H8O", 60.096, 1), "c1cc[nH]c1": ("C4H5N", 67.091, 1)}
    df = spark.createDataFrame(list(enumerate(cases)), "id long, smiles string")
    for r, (f, w, rings) in zip(molecules.describe_molecules(df).orderBy("id").collect(), cases.values(), strict=True):
        assert (r.formula, r.rings) == (f, rings) and r.weight == pytest.approx(w, abs=0.01)
    same = [molecules.fingerprint(*molecules.parse_smiles(s)) for s in ("OCC", "CCO")]
    assert same[0] == same[1]
    with pytest.raises(ValueError):
        molecules.parse_smiles("C1CC")
    x = spark.createDataFrame([("PEPTIDE",), ("K",)], "p string").select("p", molecules.fragment_ions(F.col("p")).alias("f")).collect()
    b = {(i.ion, i.number): i.mz for i in x[0].f}
    assert b["b", 2] == pytest.approx(227.1026, abs=1e-3) and b["y", 1] == pytest.approx(148.0604, abs=1e-3) and x[1].f is None


def test_graphs_and_vectors(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("D", "C"), ("A", "A")], "src string, dst string")
    assert [tuple(r) for r in graphs.triangles(e).collect()] == [("A", "B", "C")]
    assert {r.node: round(r.clustering, 6) for r in graphs.clustering(e).collect()} == {"A": 1.0, "B": 1.0, "C": 0.333333, "D": 0.0}
    assert {r.node: r.distance for r in graphs.bfs(e, "A", 3).collect()} == {"A": 0, "B": 1, "C": 1, "D": 2}
    assert sum(r.rank for r in graphs.page_rank(e, 8).collect()) == pytest.approx(1.0)
    pts = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(0, 0), (0.1, 0.1), (0.2, 0), (10, 10), (10.1, 10.1), (10.2, 10)])]
    v = spark.createDataFrame(pts, "id long, v array<double>")
    seeds = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 10.0])], "label long, c array<double>")
    placed, centers = vectors.kmeans(v, seeds, 2)
    assert {r.id: r.label for r in placed.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    s = vectors.silhouette(v.withColumn("l", (F.col("id") > 2).cast("int")), "l").collect()
    assert min(r.silhouette for r in s) > 0.9
    assert {(r.id, r.neighbour) for r in vectors.knn_join(v.withColumn("g", F.lit(1)), v.withColumn("g", F.lit(1)), 1, ["g"]).collect()} >= {(0, 1), (3, 4)}
