"""Iterative operators run until nothing changes, on graphs that need many rounds."""

from collections import Counter

from locusframe.operators import graphs
from locusframe.operators import learning as L


def test_k_core_peels_to_the_end(spark):
    band = [(i, i + j) for i in range(60) for j in (1, 2, 3)]
    clique = [(a, b) for a in range(100, 106) for b in range(100, a)]
    e = [*band, *clique, (62, 100)]
    left = {x for p in e for x in p}
    while True:
        degree = Counter(x for p in e if set(p) <= left for x in p)
        stay = {x for x in left if degree[x] >= 4}
        if stay == left:
            break
        left = stay
    df = spark.createDataFrame(e, "src long, dst long")
    assert left == set(range(100, 106))
    assert {r.node: r.degree for r in L.k_core(df, 4).collect()} == {x: degree[x] for x in left}
    short = spark.createDataFrame([p for p in e if p[0] >= 50], "src long, dst long")
    assert {r.node: r.degree for r in L.k_core(short, 4, small=0).collect()} == {x: degree[x] for x in left}
    assert L.k_core(df, 9).collect() == []


def test_bfs_reaches_the_end(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 0), (50, 51), (3, 3)], "src long, dst long")
    assert {r.node: r.distance for r in graphs.bfs(df, 0).collect()} == {i: min(i, 21 - i) for i in range(21)}
    assert {r.node: r.distance for r in graphs.bfs(df, 50, 1).collect()} == {50: 0, 51: 1}
    assert graphs.bfs(df, 99).collect() == []


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(40)]
    df = spark.createDataFrame(chain + [(60, 61), (70, 70)], "src long, dst long")
    assert {r.node: r.component for r in graphs.label_components(df).collect()} == dict.fromkeys(range(41), 0) | {60: 60, 61: 60}
    pairs = spark.createDataFrame([(a, b, 0.1) for a, b in chain], "id_a long, id_b long, distance double")
    points = spark.createDataFrame([(i,) for i in range(42)], "id long")
    assert {r.id: r.cluster for r in L.dbscan(pairs, points, 0.2, 3).collect()} == dict.fromkeys(range(41), 1) | {41: -1}
