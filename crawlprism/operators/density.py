"""Topics by density: clusters of vectors at every scale, the lasting ones kept, the rest outliers.

1. Equal vectors are one point with a weight. Points fall into buckets by the signs of random
   projections around the mean, in several tables; inside a bucket all distances are computed, and
   each point keeps its nearest ones over all tables. Buckets have a bounded size: larger ones are cut
   by further signs, then by hash.
2. A point's core distance reaches a weight of `min_topic_size`; the length of an edge is the largest of
   its distance and the core distances of its ends (mutual reachability), so sparse points are far
   from everything. The minimum spanning forest holds all that matters of these edges.
3. Thresholds at quantiles of the forest's lengths and below their largest gaps give components at every level, in one run for all
   levels. Components of at least `min_topic_size` form a tree (smaller ones are dust that falls off):
   a chain of levels over which a component only gains or loses dust is one cluster, until it meets
   another. Its stability sums its size over the density (one over length) it lasts through.
4. From the leaves up, a cluster that is at least as stable as the best of what it splits into is chosen;
   the whole table never is one. Points in no chosen cluster are outliers, topic -1. Topics are
   numbered by size, ties by their smallest point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from crawlprism.operators.graph import components, spanning_forest
from crawlprism.session import written

LEAF = 1024
TABLES = 8
LEVELS = 24
_EXTRA = 8
_FINE = 1000


def _points(df: DataFrame, vector: str) -> DataFrame:
    """(pid, vec, weight) of distinct vectors."""
    vec = F.transform(F.col(vector), lambda x: x.cast("double"))
    return df.where(F.col(vector).isNotNull()).select(vec.alias("vec")).groupBy("vec").agg(F.count("*").alias("weight")).select(
        F.xxhash64("vec").alias("pid"), "vec", "weight"
    )


def nearest(points: DataFrame, k: int, *, leaf: int = LEAF, tables: int = TABLES, seed: int = 42) -> DataFrame:
    """(a, b, d): the k nearest points b of each point a that share a bucket with it in any table.

    While there are at most `leaf` points there is one bucket and the result is exact.
    """
    shape = points.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not shape.n:
        return points.select(F.col("pid").alias("a"), F.col("pid").alias("b"), F.lit(0.0).alias("d")).limit(0)
    mean = [r.m for r in points.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()]
    bits = max(0, int(np.ceil(np.log2(shape.n / leaf))))
    tables = tables if bits else 1
    planes = np.random.default_rng(seed).normal(size=(tables * (bits + _EXTRA), shape.dim))
    centre = np.array(mean)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), np.float64)
            signs = ((x - centre) @ planes.T > 0).reshape(len(x), tables, bits + _EXTRA)
            fold = lambda s: s.astype(np.int64) @ (1 << np.arange(s.shape[-1], dtype=np.int64))
            names = (fold(signs[..., :bits]), fold(signs[..., bits:]))
            rows = np.repeat(np.arange(len(x)), tables)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                 pa.array(np.tile(np.arange(tables), len(x)).astype(np.int64)), *(pa.array(n.ravel()) for n in names)],
                ["pid", "vec", "t", "key", "more"],
            )

    placed = points.select("pid", "vec").mapInArrow(keyed, "pid long, vec array<double>, t long, key long, more long")
    most = 4 * leaf
    sizes = placed.groupBy("t", "key", "more").agg(F.count("*").alias("n_fine"))
    whole = sizes.withColumn("n", F.sum("n_fine").over(W.partitionBy("t", "key")))
    cut = placed.join(whole, ["t", "key", "more"]).select(
        "pid", "vec", "t", "key",
        F.when(F.col("n") > most, F.col("more")).otherwise(-1).alias("fine"),
        F.when((F.col("n") > most) & (F.col("n_fine") > most), F.pmod(F.xxhash64("pid"), F.ceil(F.col("n_fine") / most))).otherwise(0).alias("chunk"),
    )

    def meet(group: pa.Table) -> pa.Table:
        ids = group["pid"].to_numpy()
        x = np.array(group["vec"].to_pylist(), np.float64)
        n = min(k, len(ids) - 1)
        near, far = [], []
        for first in range(0, len(ids) if n > 0 else 0, 512):
            part = x[first : first + 512]
            d = np.maximum((part**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * part @ x.T, 0)
            d[np.arange(len(part)), np.arange(first, first + len(part))] = np.inf
            best = np.argpartition(d, n - 1, axis=1)[:, :n]
            near.append(ids[best])
            far.append(np.sqrt(np.take_along_axis(d, best, axis=1)))
        b, d = (np.concatenate(y).ravel() if y else np.empty(0, t) for y, t in ((near, np.int64), (far, np.float64)))
        return pa.table({"a": pa.array(np.repeat(ids, n) if n > 0 else b), "b": pa.array(b), "d": pa.array(d)})

    found = cut.groupBy("t", "key", "fine", "chunk").applyInArrow(meet, "a long, b long, d double")
    once = found.groupBy("a", "b").agg(F.min("d").alias("d"))
    ranked = once.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("d", "b")))
    return ranked.where(F.col("r") <= k).select("a", "b", "d")


def reachability(points: DataFrame, near: DataFrame, min_weight: int) -> DataFrame:
    """(a, b, w): edges by mutual reachability. A point whose neighbours do not reach `min_weight` has none."""
    weight = points.select(F.col("pid").alias("b"), F.col("weight").alias("weight_b"))
    own = points.select(F.col("pid").alias("a"), "weight")
    reached = F.sum("weight_b").over(W.partitionBy("a").orderBy("d", "b")) + F.col("weight")
    around = near.join(weight, "b").join(own, "a").withColumn("reached", reached)
    core = around.groupBy("a").agg(
        F.when(F.max("weight") >= min_weight, 0.0).otherwise(F.min(F.when(F.col("reached") >= min_weight, F.col("d")))).alias("core")
    ).where("core IS NOT NULL")
    core = written(core, "core")
    of = lambda c: core.select(F.col("a").alias(c), F.col("core").alias(f"core_{c}"))
    edges = near.join(of("a"), "a").join(of("b"), "b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("d", "core_a", "core_b").alias("w")
    )
    return edges.groupBy("a", "b").agg(F.min("w").alias("w"))


def level_cuts(forest: DataFrame, levels: int) -> list[float]:
    """At most `levels` lengths to cut the forest at: half at even quantiles, half where the next longer
    one is many times as long, out of `_FINE` quantiles."""
    fine = forest.agg(F.percentile_approx("w", [(i + 1) / _FINE for i in range(_FINE)], 10 * _FINE).alias("c")).first().c
    if not fine:
        return []
    half = max(1, levels // 2)
    even = {fine[(i + 1) * _FINE // half - 1] for i in range(half)}
    rise = sorted(range(_FINE - 1), key=lambda i: (-fine[i + 1] / max(fine[i], 1e-9), i))
    return sorted(even | {fine[i] for i in rise[: levels - half]})


def condensed(points: DataFrame, forest: DataFrame, min_weight: int, levels: int = LEVELS) -> DataFrame:
    """(pid, cluster): the chosen cluster of every point that is in one."""
    forest = written(forest, "tree")
    cuts = level_cuts(forest, levels)
    if not cuts:
        return points.select("pid", F.lit(0).cast("long").alias("cluster")).limit(0)
    top = len(cuts)  # the level of the whole table
    density = [1 / max(c, 1e-9) for c in cuts] + [0.0]
    gain = F.element_at(F.array(*[F.lit(density[i] - density[i + 1]) for i in range(top)]), F.col("level") + 1)
    bounds = F.array(*[F.lit(c) for c in cuts])
    within = F.explode(F.filter(F.sequence(F.lit(0), F.lit(top - 1)), lambda i: F.element_at(bounds, i + 1) >= F.col("w"))).alias("level")
    member = written(components(forest.select("a", "b", within), by=["level"]), "members")
    member = member.select("level", F.col("node").alias("pid"), F.col("root").alias("c"))
    sizes = member.join(points.select("pid", "weight"), "pid").groupBy("level", "c").agg(F.sum("weight").alias("size"))
    big = written(sizes.where(F.col("size") >= min_weight), "big")
    # The parent of a component is where its smallest point is one level up; above all is the whole table.
    up = member.select((F.col("level") - 1).alias("level"), F.col("pid").alias("c"), F.col("c").alias("parent"))
    linked = big.join(up, ["level", "c"], "left").withColumn("parent", F.when(F.col("level") == top - 1, F.lit(None)).otherwise(F.col("parent")))
    linked = written(linked, "linked")
    children = linked.groupBy((F.col("level") + 1).alias("level"), F.col("parent").alias("c")).agg(F.count("*").alias("n_children"))
    # A cluster begins where no child, or more than one, is below; it ends before it meets another.
    node = written(linked.join(children, ["level", "c"], "left").fillna({"n_children": 0}), "nodes")
    crowd = node.where(F.col("level") == top - 1).count()
    births = node.where("n_children <> 1").select(F.col("level").alias("born"), F.col("c").alias("cluster"))
    path = member.join(births, member["pid"] == births["cluster"]).where(F.col("level") >= F.col("born"))
    path = path.join(node.select("level", "c", "size", "n_children"), ["level", "c"])
    meets = F.min(F.when((F.col("level") > F.col("born")) & (F.col("n_children") > 1), F.col("level"))).over(W.partitionBy("born", "cluster"))
    chain = path.withColumn("ends", F.coalesce(meets, F.lit(top))).where(F.col("level") < F.col("ends"))
    met = path.select(F.col("level").alias("ends"), "born", "cluster", F.col("c").alias("parent"))
    clusters = (
        chain.groupBy("born", "cluster", "ends")
        .agg(F.sum(F.col("size") * gain).alias("stability"), F.max_by("c", "level").alias("last"))
        .join(met, ["born", "cluster", "ends"], "left")
    )
    clusters = written(clusters, "clusters")
    # Of the whole table's only child nothing is left to choose it over.
    alive = clusters if crowd > 1 else clusters.where(F.col("ends") < top)
    best = written(alive.select("born", "cluster", "ends", "parent", "stability", F.col("stability").alias("best"), F.lit(True).alias("wins")), "best")
    while True:
        below = best.where("parent IS NOT NULL").groupBy(F.col("ends").alias("born"), F.col("parent").alias("cluster")).agg(F.sum("best").alias("below"))
        new = best.join(below, ["born", "cluster"], "left").select(
            "born", "cluster", "ends", "parent", "stability", F.greatest("stability", F.coalesce("below", F.lit(0.0))).alias("best"),
            (F.col("stability") >= F.coalesce("below", F.lit(0.0))).alias("wins"), (F.greatest("stability", F.coalesce("below", F.lit(0.0))) != F.col("best")).alias("moved"),
        )
        new = written(new, "best")
        best = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    chosen = best.where("wins").join(clusters.select("born", "cluster", "last"), ["born", "cluster"]).select(
        (F.col("ends") - 1).alias("level"), F.col("last").alias("c"), "cluster"
    )
    held = member.join(chosen, ["level", "c"])
    return held.groupBy("pid").agg(F.max_by("cluster", "level").alias("cluster"))


def fit_density_topics(
    df: DataFrame, vector: str, min_topic_size: int = 10, *, neighbours: int | None = None, levels: int = LEVELS,
    leaf: int = LEAF, tables: int = TABLES, seed: int = 42,
) -> DataFrame:
    """The rows with a topic number, largest topic first, outliers -1. Null vectors are outliers."""
    points = written(_points(df, vector), "points")
    k = neighbours or max(min_topic_size, 5)
    near = written(nearest(points, k, leaf=leaf, tables=tables, seed=seed), "near")
    edges = written(reachability(points, near, min_topic_size), "reach")
    found = written(condensed(points, spanning_forest(edges), min_topic_size, levels), "found")
    sizes = found.join(points.select("pid", "weight"), "pid").groupBy("cluster").agg(F.sum("weight").alias("n"), F.min("pid").alias("least"))
    rank = W.orderBy(F.col("n").desc(), "least")  # one row per topic
    numbered = sizes.select("cluster", (F.row_number().over(rank) - 1).alias("topic"))
    topics = found.join(numbered, "cluster").select(F.col("pid").alias("_pid"), "topic")
    keyed = df.withColumn("_pid", F.xxhash64(F.transform(F.col(vector), lambda x: x.cast("double"))))
    return keyed.join(topics, "_pid", "left").withColumn("topic", F.coalesce("topic", F.lit(-1))).drop("_pid")
