"""Operators on pairs: results by brute force, and plans that don't grow with the pairs."""

import itertools
import math
import random
import time

import pytest

from locusframe.operators import intervals, learning, molecules, omics, trees, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_liftover_never_broadcasts_its_buckets(spark):
    a = spark.createDataFrame([(1, "c", 10, 30), (2, "c", 95, 105), (3, "d", 0, 5)], "id long, chrom string, start long, stop long")
    blocks = spark.createDataFrame([("c", 0, 100, "t", 1000, "+", 5000)], "chrom string, start long, stop long, t_chrom string, t_start long, strand string, t_size long")
    x = intervals.liftover(a, blocks, 64)
    assert "Broadcast" not in plan(x)
    assert [tuple(r) for r in x.collect()] == [(1, "t", 1010, 1030, "+")]


@pytest.fixture(scope="module")
def points(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 2, None]), [rnd.randrange(12) / 4 for _ in range(2)]) for i in range(90)]
    return rows, spark.createDataFrame(rows, "id long, g int, v array<double>")


def near_rows(rows, eps):
    return {a: {b for b, h, y in rows if b != a and g is not None and g == h and math.dist(x, y) <= eps} for a, g, x in rows}


def test_pairwise_by_tiles(spark, points):
    rows, df = points
    expected = {(g, a, b, math.dist(x, y), sum(abs(p - q) for p, q in zip(x, y))) for (a, g, x), (b, h, y) in itertools.combinations(rows, 2) if g is not None and g == h}
    for tile in (7, 2048):
        x = vectors.pairwise(df, ["euclidean", "manhattan"], ["g"], tile)
        assert "MapInArrow" in plan(x)
        assert sorted((r.g, r.id_a, r.id_b, pytest.approx(r.euclidean), pytest.approx(r.manhattan)) for r in x.collect()) == sorted(expected)
    odd = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [1.0]), (3, 1, None), (4, 1, [0.0, 0.0]), (5, 1, [2.0])], "id long, g int, v array<double>")
    found = {(r.id_a, r.id_b): (r.euclidean, r.cosine) for r in vectors.pairwise(odd, ["euclidean", "cosine"], ["g"]).collect()}
    assert len(found) == 10 and found[1, 2] == found[1, 3] == (None, None) and found[2, 5] == (1.0, 0.0) and found[1, 4] == (math.sqrt(5), 1.0)


def test_knn_by_tiles(spark, points):
    rows, df = points
    expected = {(a, b, k + 1) for a, g, x in rows for k, (_, b) in enumerate(sorted((math.dist(x, y), b) for b, h, y in rows if b != a and g is not None and g == h)[:4])}
    for tile in (7, 2048):
        x = vectors.knn_join(df, df, 4, ["g"], tile=tile)
        assert "MapInArrow" in plan(x)
        assert {(r.id, r.neighbour, r["rank"]) for r in x.collect()} == expected
    some = vectors.knn_join(df.where("id % 10 = 0"), df, 4, ["g"], tile=7)
    assert {(r.id, r.neighbour, r["rank"]) for r in some.collect()} == {e for e in expected if e[0] % 10 == 0}


def test_density_core_by_tiles(spark, points):
    rows, df = points
    near = near_rows(rows, 0.5)  # distances of exactly 0.5 occur
    x = vectors.density_core(df, ["g"], 0.5, 5)
    assert "MapInArrow" in plan(x)
    assert {(r.id, r.neighbours, r.core) for r in x.collect()} == {(a, len(n) + 1, len(n) >= 4) for a, n in near.items()}
    assert {r.id: r.k for r in vectors.neighbour_counts(df, ["g"], 0.5, 7).collect()} == {a: len(n) for a, n in near.items() if n}


def test_dbscan_of_vectors_by_tiles(spark, points):
    rows, df = points
    for eps, least in ((0.25, 4), (0.5, 5), (0.3, 1)):
        near = near_rows(rows, eps)
        core = {a for a, n in near.items() if len(n) + 1 >= least}
        name = {a: a for a in core}
        for _ in rows:
            name = {a: min([name[a], *(name[b] for b in near[a] & core)]) for a in core}
        expected = {a: name[a] if a in core else min((name[b] for b in n & core), default=-1) for a, n in near.items()}
        assert {r.id: r.cluster for r in learning.dbscan_vectors(df, ["g"], eps, least, 7).collect()} == expected


def test_agglomerate_of_thousands(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(1, i, [100.0 * (i % 4) + rnd.random(), rnd.random()]) for i in range(5000)], "g int, id int, v array<double>")
    started = time.monotonic()
    assert {(r.id % 4, r.cluster) for r in trees.agglomerate(df, "g", 4, "complete").collect()} == {(k, k) for k in range(4)}
    assert time.monotonic() - started < 30


def test_similar_sets_by_tiles(spark):
    rnd = random.Random(5)
    rows = [(i, [f"b{rnd.randrange(30)}" for _ in range(rnd.randrange(9))]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, bits array<string>")
    expected = {(a, b, round(len(set(x) & set(y)) / len(set(x) | set(y)), 9)) for (a, x), (b, y) in itertools.combinations(rows[:60], 2) if set(x) & set(y)}
    for tile in (7, 4096):
        x = molecules.similar_sets(df, 0.2, tile)
        assert "MapInArrow" in plan(x)
        assert {(r.id_a, r.id_b, round(r.tanimoto, 9)) for r in x.collect()} == {e for e in expected if e[2] >= 0.2}


def test_spectra_by_tiles(spark):
    rnd = random.Random(6)
    rows = [(i, float(rnd.randrange(20)), float(rnd.randrange(1, 50))) for i in range(40) for _ in range(rnd.randrange(6))]
    spectra = {}
    for i, mz, v in rows:
        spectra.setdefault(i, {}).setdefault(mz // 2, []).append(v)
    unit = {i: {k: sum(v) / math.sqrt(sum(sum(w) ** 2 for w in s.values())) for k, v in s.items()} for i, s in spectra.items()}
    expected = {(a, b, len(unit[a].keys() & unit[b].keys()), round(sum(unit[a][k] * unit[b][k] for k in unit[a].keys() & unit[b].keys()), 9)) for a, b in itertools.combinations(sorted(unit), 2) if unit[a].keys() & unit[b].keys()}
    df = spark.createDataFrame(rows, "id long, mz double, intensity double")
    for tile in (7, 4096):
        x = omics.spectrum_cosine(df, 2.0, tile)
        assert "MapInArrow" in plan(x)
        assert {(r.id_a, r.id_b, r.shared, round(r.cosine, 9)) for r in x.collect()} == expected
