"""Phylogenetic trees: Newick, clustering of distance matrices, and comparison of trees."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None]]:
    """Nodes (node, parent, name, length), the root first; quoted names and comments are understood."""
    tokens = re.findall(r"\[[^\]]*\]|'(?:[^']|'')*'|[(),;:]|[^\s(),;:\[']+", text)
    tokens = [t for t in tokens if t[0] != "["]
    nodes: list[list] = [[0, None, None, None]]
    at, here, last = 0, 0, ""
    while at < len(tokens):
        t = tokens[at]
        if t in "(,":
            parent = here if t == "(" else nodes[here][1]
            if parent is None:
                raise ValueError("a comma outside of parentheses")
            nodes.append([len(nodes), parent, None, None])
            here = len(nodes) - 1
        elif t == ")":
            if nodes[here][1] is None:
                raise ValueError("unbalanced parentheses")
            here = nodes[here][1]
        elif t == ";":
            break
        elif last == ":":
            nodes[here][3] = float(t)
        elif t != ":":
            nodes[here][2] = t[1:-1].replace("''", "'") if t[0] == "'" else t
        last = t
        at += 1
    if here != 0 or "".join(tokens).count("(") != "".join(tokens).count(")"):
        raise ValueError("unbalanced parentheses")
    return [tuple(n) for n in nodes]


def write_newick(nodes: list[tuple]) -> str:
    children: dict[int | None, list[tuple]] = {}
    for n in nodes:
        children.setdefault(n[1], []).append(n)

    def show(n: tuple) -> str:
        inner = ",".join(show(c) for c in children.get(n[0], []))
        name = n[2] or ""
        if re.search(r"[\s(),;:\[\]']", name):
            name = "'" + name.replace("'", "''") + "'"
        return (f"({inner})" if inner else "") + name + (f":{n[3]:.10g}" if n[3] is not None else "")

    return show(children[None][0]) + ";"


def leaf_sets(nodes: list[tuple]) -> dict[int, frozenset]:
    """Names of the leaves under each node."""
    parent = {n[0]: n[1] for n in nodes}
    inner = set(parent.values())
    found: dict[int, set] = {n[0]: set() for n in nodes}
    for n in nodes:
        if n[0] not in inner:
            at: int | None = n[0]
            while at is not None:
                found[at].add(n[2])
                at = parent[at]
    return {k: frozenset(v) for k, v in found.items()}


def robinson_foulds(a: str, b: str) -> int:
    """Bipartitions in one of two unrooted trees on the same leaves only."""
    def splits(text: str) -> set[frozenset]:
        sets = leaf_sets(parse_newick(text))
        every = sets[0]
        return {min(s, every - s, key=lambda x: (len(x), sorted(x))) for s in sets.values() if 1 < len(s) < len(every) - 1}

    return len(splits(a) ^ splits(b))


def unifrac(nodes: list[tuple], a: dict[str, float], b: dict[str, float]) -> tuple[float, float]:
    """Unweighted and normalised weighted UniFrac of two leaf abundances."""
    sets = leaf_sets(nodes)
    ta, tb = sum(a.values()) or 1.0, sum(b.values()) or 1.0
    only = either = apart = total = 0.0
    for n in nodes:
        length = n[3] or 0.0
        x, y = sum(a.get(s, 0) for s in sets[n[0]]) / ta, sum(b.get(s, 0) for s in sets[n[0]]) / tb
        if x > 0 or y > 0:
            either += length
            only += length * ((x > 0) != (y > 0))
        apart += length * abs(x - y)
        total += length * (x + y)
    return (only / either if either else 0.0, apart / total if total else 0.0)


def upgma(names: list[str], d: dict[tuple[str, str], float]) -> str:
    """The ultrametric tree of a distance matrix as Newick; ties by name."""
    size, height, text = {n: 1 for n in names}, {n: 0.0 for n in names}, {n: n for n in names}
    dist = {tuple(sorted(k)): v for k, v in d.items()}
    while len(size) > 1:
        (a, b), x = min(dist.items(), key=lambda kv: (kv[1], kv[0]))
        new = f"{a}+{b}"
        text[new] = f"({text[a]}:{x / 2 - height[a]:.6f},{text[b]}:{x / 2 - height[b]:.6f})"
        height[new] = x / 2
        for c in size:
            if c not in (a, b):
                dist[tuple(sorted((new, c)))] = (dist[tuple(sorted((a, c)))] * size[a] + dist[tuple(sorted((b, c)))] * size[b]) / (size[a] + size[b])
        size[new] = size.pop(a) + size.pop(b)
        dist = {k: v for k, v in dist.items() if a not in k and b not in k}
    return text[next(iter(size))] + ";"


def neighbor_joining(names: list[str], d: dict[tuple[str, str], float]) -> str:
    """The neighbour-joining tree as Newick, rooted at the last three; ties by name."""
    text = {n: n for n in names}
    dist = {tuple(sorted(k)): v for k, v in d.items()}
    get = lambda a, b: dist[tuple(sorted((a, b)))] if a != b else 0.0
    while len(text) > 3:
        n, r = len(text), {a: sum(get(a, b) for b in text) for a in text}
        a, b = min(((a, b) for a in text for b in text if a < b), key=lambda p: ((n - 2) * get(*p) - r[p[0]] - r[p[1]], p))
        la = get(a, b) / 2 + (r[a] - r[b]) / (2 * (n - 2))
        new = f"{a}+{b}"
        for c in text:
            if c not in (a, b):
                dist[tuple(sorted((new, c)))] = (get(a, c) + get(b, c) - get(a, b)) / 2
        text[new] = f"({text[a]}:{la:.6f},{text[b]}:{get(a, b) - la:.6f})"
        del text[a], text[b]
    rest = sorted(text)
    if len(rest) == 3:
        x, y, z = rest
        at = {x: (get(x, y) + get(x, z) - get(y, z)) / 2, y: (get(x, y) + get(y, z) - get(x, z)) / 2, z: (get(x, z) + get(y, z) - get(x, y)) / 2}
        return "(" + ",".join(f"{text[k]}:{at[k]:.6f}" for k in rest) + ");"
    return "(" + ",".join(f"{text[k]}:{get(*rest) / 2 if len(rest) == 2 else 0:.6f}" for k in rest) + ");"


def cluster_groups(pairs: DataFrame, by: str, method: Callable[[list[str], dict], str]) -> DataFrame:
    """Rows (by, newick): the tree of each group's distances (item_a, item_b, distance). A group's matrix is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = {(a, b): float(x) for a, b, x in zip(pdf.item_a, pdf.item_b, pdf.distance, strict=True)}
        return pd.DataFrame({by: [pdf[by].iloc[0]], "newick": [method(sorted({n for k in d for n in k}), d)]})

    return pairs.select(by, "item_a", "item_b", "distance").groupBy(by).applyInPandas(run, f"{by} {dict(pairs.dtypes)[by]}, newick string")


def newick_nodes(df: DataFrame) -> DataFrame:
    """Rows (id, node, parent, name, length) of rows (id, newick)."""
    from .sequences import by_batch

    def rows(batch: list[tuple]) -> dict[str, list]:
        found = [(i, *n) for i, t in batch for n in parse_newick(t)]
        return {c: [r[k] for r in found] for k, c in enumerate(("id", "node", "parent", "name", "length"))}

    return by_batch(df, ["id", "newick"], f"id {dict(df.dtypes)['id']}, node int, parent int, name string, length double", rows)


def agglomerate(df: DataFrame, by: str, count: int, method: str = "average") -> DataFrame:
    """Rows (by, id, cluster) of rows (by, id, v array<double>): each group's vectors joined, nearest clusters first, until `count` are left.

    Distances are Euclidean; method single, complete or average, updated by Lance and Williams'
    formula; ties go to the lowest pair. Clusters are numbered by their smallest id from 0. A group
    is one task with a matrix of its distances (800 MB for 10,000 rows); each row's nearest is kept, so a join looks at
    the rows that it changes, not at the whole matrix.
    """
    kinds = dict(df.dtypes)

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(np.array(group.column("id").to_pylist(), object), kind="stable")
        x = np.array(group.column("v").to_pylist(), float)[order]
        if len(x) <= 256:
            d = np.sqrt(np.maximum(0, ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)))
        else:
            squares = (x * x).sum(1)
            d = 2 * x @ x.T
            for k in range(len(x)):  # row by row: one matrix is held, not three
                d[k] = np.sqrt(np.maximum(0, squares[k] + squares - d[k]))
        np.fill_diagonal(d, np.inf)
        size, label = np.ones(len(x)), np.arange(len(x))
        nearest = d.argmin(axis=1) if len(x) else np.zeros(0, int)
        least = d[np.arange(len(x)), nearest]
        for _ in range(max(0, len(x) - count)):
            i = int(least.argmin())
            j = int(nearest[i])
            i, j = min(i, j), max(i, j)
            a, b = d[i], d[j]
            joined = np.minimum(a, b) if method == "single" else np.maximum(a, b) if method == "complete" else (size[i] * a + size[j] * b) / (size[i] + size[j])
            d[i], d[:, i] = joined, joined
            d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
            stale = (nearest == i) | (nearest == j)
            nearer = (d[i] < least) | ((d[i] == least) & (i < nearest))
            nearest[nearer], least[nearer] = i, d[i][nearer]
            stale[[i, j]] = True
            for k in np.nonzero(stale & (least < np.inf))[0].tolist():
                nearest[k] = d[k].argmin()
                least[k] = d[k, nearest[k]]
            size[i] += size[j]
            label[label == j] = i
        _, cluster = np.unique(label, return_inverse=True)
        index = pa.array(order)
        return pa.table({by: group.column(by).take(index), "id": group.column("id").take(index), "cluster": pa.array(cluster.astype(np.int64))})

    return df.select(by, "id", "v").groupBy(by).applyInArrow(run, f"{by} {kinds[by]}, id {kinds['id']}, cluster bigint")
