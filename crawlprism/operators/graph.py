"""Connected components and spanning trees as joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crawlprism.session import written


def components(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, node, root) of every node of the edges (*by, a, b); the root is the smallest node of its
    component. With `by`, every value of those columns is a graph of its own.

    Large-star and small-star steps alternate until nothing changes: a map-side minimum per node and a
    join, never a gathered neighbourhood. Each step is written to the shared folder.
    """
    keys = [*by, "u"]

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first())

    now = written(edges.select(*by, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(now)
    while before[0]:
        both = now.union(now.select(*by, "v", "u"))
        least = written(both.groupBy(*keys).agg(F.min("v").alias("m")).select(*keys, F.least("m", "u").alias("m")), "least")
        large = both.join(least, keys).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large_star")
        least = written(large.groupBy(*keys).agg(F.min("v").alias("m")), "least")
        moved = large.join(least, keys).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.union(least.select(*keys, F.col("m").alias("v"))).distinct(), "small_star")
        after = mark(now)
        if after == before:
            break
        before = after
    nodes = now.select(*by, F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(now.select(*by, F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of edges (a, b, w), a < b, ties by (a, b), by Borůvka steps: every component
    takes its lightest edge out, components that an edge joins become one, and of parallel edges
    between two components the lightest stays. At most log2 of the nodes steps."""
    ends = F.least("a", "b"), F.greatest("a", "b")
    live = edges.where("a <> b").select(
        ends[0].alias("ca"), ends[1].alias("cb"), F.struct("w", ends[0].alias("a"), ends[1].alias("b")).alias("e")
    )
    live = written(live.groupBy("ca", "cb").agg(F.min("e").alias("e")), "forest")
    taken: list[DataFrame] = []
    while not live.isEmpty():
        sides = live.select(F.col("ca").alias("c"), "e", "ca", "cb").union(live.select(F.col("cb").alias("c"), "e", "ca", "cb"))
        best = sides.groupBy("c").agg(F.min(F.struct("e", "ca", "cb")).alias("x")).select("x.*").distinct()
        best = written(best, "lightest")
        taken.append(best.select("e.a", "e.b", "e.w"))
        roots = written(components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "roots")
        moved = live
        for side in ("ca", "cb"):
            of = roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
            moved = moved.join(of, side)
        apart = moved.where("ca_root <> cb_root").select(
            F.least("ca_root", "cb_root").alias("ca"), F.greatest("ca_root", "cb_root").alias("cb"), "e"
        )
        live = written(apart.groupBy("ca", "cb").agg(F.min("e").alias("e")), "forest")
    if not taken:
        return edges.select("a", "b", "w").limit(0)
    return reduce(DataFrame.union, taken)
