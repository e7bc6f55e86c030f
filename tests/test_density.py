"""Graph steps and density topics against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlprism.operators import density, graph


def kruskal(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    taken = []
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges if a != b):
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            taken.append((a, b, w))
    return sorted(taken), {n: top(n) for n in list(root)}


def test_spanning_forest_and_components_equal_kruskal(spark):
    pick = random.Random(2)
    edges = [(pick.randrange(60) + 100 * g, pick.randrange(60) + 100 * g, float(pick.randrange(9))) for g in range(2) for _ in range(150)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    tree, root = kruskal(edges)
    assert sorted(map(tuple, graph.spanning_forest(df).collect())) == tree
    smallest = {}
    for n, r in root.items():
        smallest[r] = min(n, smallest.get(r, n))
    assert {r.node: r.root for r in graph.components(df).collect()} == {n: smallest[r] for n, r in root.items()}
    two = df.withColumn("g", F.explode(F.array(F.lit(1), F.lit(2)))).where("g = 1 OR w < 2")
    by = {(r.g, r.node): r.root for r in graph.components(two, by=["g"]).collect()}
    assert {n: r for (g, n), r in by.items() if g == 1} == {n: smallest[r] for n, r in root.items()}
    light = kruskal([e for e in edges if e[2] < 2])[1]
    assert len({r for (g, _), r in by.items() if g == 2}) == len(set(light.values()))
    assert graph.spanning_forest(df.limit(0)).collect() == [] == graph.components(df.limit(0)).collect()


def brute_topics(x: np.ndarray, m: int, cuts: list[float]) -> np.ndarray:
    """The same definition, recursively from the top, on all distances."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, m - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    np.fill_diagonal(w, 0)
    levels = [-1.0, *cuts]

    def parts(members, cut):
        left, out = set(members), []
        while left:
            seed = left.pop()
            group, front = [seed], [seed]
            while front:
                i = front.pop()
                new = [j for j in left if w[i, j] <= cut + 1e-6]  # a cut is an edge of its own
                left -= set(new)
                group += new
                front += new
            out.append(group)
        return [g for g in out if len(g) >= m]

    def best(members, level):
        """(score, clusters) of the component `members` at a level, going down to finer ones."""
        stable, now = 0.0, members
        while True:
            density_here = 1 / levels[level]
            outer = 1 / levels[level + 1] if level + 1 < len(levels) else 0.0
            stable += len(now) * (density_here - outer)
            below = parts(now, levels[level - 1]) if level > 1 else []
            level -= 1
            if len(below) != 1:
                break
            now = below[0]
        split = [best(b, level) for b in below]
        if stable >= sum(s for s, _ in split):
            return stable, [members]
        return sum(s for s, _ in split), [c for _, cs in split for c in cs]

    label = np.full(n, -1)
    roots = parts(range(n), levels[-1])
    if len(roots) == 1:  # the whole table is no cluster
        now, level = roots[0], len(levels) - 1
        while len(roots) == 1 and level > 1:
            now, level = roots[0], level - 1
            roots = parts(now, levels[level])
        found = [best(r, level) for r in roots] if len(roots) > 1 else []
    else:
        found = [best(r, len(levels) - 1) for r in roots]
    for i, c in enumerate(c for _, cs in found for c in cs):
        label[c] = i
    return label


def same_partition(a, b) -> bool:
    pairs = set(zip(a.tolist(), b.tolist()))
    return len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) and all((x == -1) == (y == -1) for x, y in pairs)


def planted(seed=0):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(4, 6)) * 5
    shapes = [(70, 0.3), (50, 0.7), (40, 0.2), (30, 0.5)]
    x = np.concatenate([centres[i] + pick.normal(size=(n, 6)) * s for i, (n, s) in enumerate(shapes)] + [pick.uniform(-15, 15, size=(50, 6))])
    return x, np.concatenate([np.full(n, i) for i, (n, _) in enumerate(shapes)] + [np.full(50, -1)])


def test_density_topics_equal_brute_force_on_planted_clusters(spark, monkeypatch):
    x, truth = planted()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    seen = {}
    original = density.condensed

    def watched(points, forest, *rest):
        seen["cuts"] = density.level_cuts(forest, density.LEVELS)
        return original(points, forest, *rest)

    monkeypatch.setattr(density, "condensed", watched)
    rows = density.fit_density_topics(df, "v", 10, neighbours=len(x)).orderBy("i").collect()
    got = np.array([r.topic for r in rows])
    assert same_partition(got, brute_topics(x, 10, sorted(set(seen["cuts"]))))
    for c in range(4):  # each planted cluster is one topic, largest first, and noise is left out
        values, counts = np.unique(got[truth == c], return_counts=True)
        assert counts.max() >= 0.9 * counts.sum() and values[counts.argmax()] == c
    assert (got[truth == -1] == -1).mean() > 0.8


def test_nearest_by_projections(spark):
    pick = np.random.default_rng(1)
    centres = pick.normal(size=(40, 24)) * 3
    x = np.concatenate([c + pick.normal(size=(50, 24)) for c in centres])
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "pid long, vec array<double>, weight long")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, axis=1)[:, :10]
    for leaf, least in ((4096, 1.0), (256, 0.9)):
        got = density.nearest(points, 10, leaf=leaf).collect()
        found = {(r.a, r.b) for r in got}
        assert sum((a, b) in found for a in range(len(x)) for b in true[a].tolist()) / true.size >= least
        assert all(abs(r.d - np.sqrt(d[r.a, r.b])) < 1e-6 for r in got[:500])


def test_density_topics_of_odd_tables(spark):
    same = [(i, [1.0, 2.0]) for i in range(30)] + [(i, [9.0 + i, -i * 3.0]) for i in range(30, 40)] + [(99, None)]
    df = spark.createDataFrame(same, "i long, v array<double>")
    rows = density.fit_density_topics(df, "v", 10).collect()
    assert len(rows) == 41 and {r.topic for r in rows if r.i == 99} == {-1}
    assert density.fit_density_topics(df.limit(0), "v", 10).collect() == []
    assert {r.topic for r in density.fit_density_topics(df.where("i = 31"), "v", 10).collect()} == {-1}
