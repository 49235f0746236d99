"""Special functions against known values, learners on separable data."""

import itertools
import math

import pytest

from locusframe.functions import distributions as D
from locusframe.operators import learning as L


def test_distributions(spark):
    assert D.normal_p(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert D.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8) and D.t_p(0.0, 5) == pytest.approx(1.0)
    assert D.chi2_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-9) and D.chi2_p(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25)
    assert D.f_p(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert D.poisson_tail(3, 2.0) == pytest.approx(1 - math.exp(-2) * 5) and D.poisson_tail(0, 1.0) == 1.0
    assert D.hypergeometric_tail(2, 3, 4, 10) == pytest.approx((36 + 4) / 120)
    got = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "x double, df double").select(D.column(D.chi2_p)("x", "df").alias("p")).collect()
    assert got[0].p == pytest.approx(math.exp(-0.5)) and got[1].p is None


def test_viterbi_against_all_paths(spark):
    start, move, emit = [0.6, 0.4], [[0.7, 0.3], [0.2, 0.8]], [{"A": 0.9, "B": 0.1}, {"A": 0.3, "B": 0.7}]
    seq = "ABBAB"
    every = {}
    for path in itertools.product(range(2), repeat=len(seq)):
        p = start[path[0]] * emit[path[0]][seq[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= move[a][b] * emit[b][c]
        every[path] = p
    r = L.viterbi(spark.createDataFrame([(1, seq), (2, "")], "id long, seq string"), start, move, emit).orderBy("id").collect()
    assert tuple(r[0].path) == max(every, key=every.get) and r[0].log_probability == pytest.approx(math.log(max(every.values())))
    assert r[0].log_likelihood == pytest.approx(math.log(sum(every.values()))) and r[1].path == []


def test_learners(spark):
    rows = [(i, [float(i % 2), float(i % 3)], i % 2) for i in range(60)]
    x = L.folds(spark.createDataFrame(rows, "id long, v array<double>, label int"), 3)
    for kind in L.MODELS:
        assert L.classify(x.where("fold > 0"), x.where("fold = 0"), kind).where("label != prediction").count() == 0
    scores, share = L.principal_components(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "id long, v array<double>"), 1)
    assert share[0] == pytest.approx(1.0) and scores.count() == 5
    c, b = L.least_squares(spark.createDataFrame([([float(i), float(i * i)], 3.0 * i - 2.0 * i * i + 1) for i in range(6)], "v array<double>, y double"))
    assert c == pytest.approx([3.0, -2.0]) and b == pytest.approx(1.0)
    p = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1), (4, 5, 0.1), (3, 6, 0.4)], "id_a long, id_b long, distance double")
    got = {r.id: r.cluster for r in L.dbscan(p, spark.createDataFrame([(i,) for i in range(1, 8)], "id long"), 0.2, 3, 3).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: -1, 5: -1, 6: -1, 7: -1}


def test_louvain_parts_cliques(spark):
    from locusframe.operators import communities, graphs

    cliques = [(a + 10 * g, b + 10 * g) for g in range(4) for a in range(6) for b in range(a)]
    e = spark.createDataFrame([*cliques, (0, 10), (10, 20), (20, 30), (30, 0), (50, 50)], "src long, dst long")
    found = {r.node: r.community for r in communities.louvain(e).collect()}
    assert found == {a + 10 * g: 10 * g for g in range(4) for a in range(6)} | {50: 50}
    band = spark.createDataFrame([(i, i + j) for i in range(60) for j in (1, 2)], "src long, dst long")
    parts = communities.louvain(band)
    assert graphs.modularity(band, parts.withColumnRenamed("community", "label")).first()[0] > 0.6


def test_agglomerate_is_brute_force(spark):
    import itertools
    import random

    import numpy as np

    from locusframe.operators import trees

    rnd = random.Random(5)
    rows = [(g, i, [rnd.random(), rnd.random()]) for g in (1, 2) for i in range(14)]
    df = spark.createDataFrame(rows, "g int, id int, v array<double>")
    for method, link in (("single", min), ("complete", max), ("average", lambda d: sum(d) / len(d))):
        expected = set()
        for g in (1, 2):
            point = {i: np.array(v) for k, i, v in rows if k == g}
            clusters = [[i] for i in point]
            while len(clusters) > 3:
                a, b = min(itertools.combinations(range(len(clusters)), 2), key=lambda p: link([np.linalg.norm(point[x] - point[y]) for x in clusters[p[0]] for y in clusters[p[1]]]))
                clusters[a] += clusters.pop(b)
            for n, c in enumerate(sorted(clusters, key=min)):
                expected |= {(g, i, n) for i in c}
        assert {tuple(r) for r in trees.agglomerate(df, "g", 3, method).collect()} == expected


def test_spread_seeds_reach_every_cluster(spark):
    from locusframe.operators import vectors

    rows = [(i, [100.0 * (i % 4) + i / 1000, float(i % 7) / 100]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for seed in "abc":
        assert {round(r.c[0] / 100) for r in vectors.spread_seeds(df, 4, seed).collect()} == {0, 1, 2, 3}
    assert vectors.spread_seeds(df.where("id < 2"), 4).count() == 2


def test_principal_components_are_those_of_numpy(spark):
    import numpy as np

    from locusframe.operators import learning

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    scores, _ = learning.principal_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), 2)
    found = np.array([r.pc for r in scores.orderBy("id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for k in range(2):
        for expected in ((x - x.mean(axis=0)) @ axes[k], x @ axes[k]):
            if np.allclose(np.abs(found[:, k] - found[:, k].mean()), np.abs(expected - expected.mean()), atol=1e-6):
                break
        else:
            raise AssertionError(k)
