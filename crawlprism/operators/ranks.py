"""Exact ranks and percentiles without a global sort of rows.

Rows collapse to (group, value, count) on the map side, so a value shared by a third of all rows is
one row. The remaining distinct values are cut at approximate quantiles into many ranges; running
counts inside a range plus the totals of the ranges before it give each value its exact rank. The
cut points only decide how evenly the work is spread, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Ranges per shuffle partition: enough for partitions to fill evenly.
RANGES_PER_PARTITION = 4


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def with_running_count(
    counts: DataFrame, value: str, by: Sequence[str] = (), n: str = "n", name: str = "n_before", keep_range: bool = False
) -> DataFrame:
    """Add the number of rows of the group with a smaller value. `counts` has one row per
    (group, value). `keep_range` leaves the range's number in `_range`."""
    by = list(by)
    ranges = RANGES_PER_PARTITION * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = counts.agg(
        F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("cuts")
    )
    ranged = _with_range(counts.withColumn("_cuts", cuts.scalar()), value, ranges).drop("_cuts")
    inside = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    # One row per range and group.
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = (
        ranged.groupBy(*by, "_range")
        .agg(F.sum(n).alias("_total_n"))
        .withColumn("_offset", F.coalesce(F.sum("_total_n").over(before), zero))
        .drop("_total_n")
    )
    counted = (
        ranged.withColumn("_inside", F.coalesce(F.sum(n).over(inside), zero))
        .join(offsets, [*by, "_range"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_offset", "_inside")
    )
    return counted if keep_range else counted.drop("_range")


def with_minimum_from_right(ranged: DataFrame, value: str, measure: str, by: Sequence[str], name: str) -> DataFrame:
    """Add the minimum of `measure` over the group's rows of this or a larger value. `ranged` has one
    row per (group, value) and its `_range`."""
    by = list(by)
    inside = W.partitionBy(*by, "_range").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    later = W.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)
    beyond = (
        ranged.groupBy(*by, "_range")
        .agg(F.min(measure).alias("_least"))
        .withColumn("_beyond", F.min("_least").over(later))
        .drop("_least")
    )
    return (
        ranged.withColumn("_inside", F.min(measure).over(inside))
        .join(beyond, [*by, "_range"])
        .withColumn(name, F.least("_inside", "_beyond"))
        .drop("_inside", "_beyond")
    )


def _with_range(df: DataFrame, value: str, most: int) -> DataFrame:
    """Add `_range`: how many of the sorted `_cuts` lie below the value, by binary search."""
    df = df.withColumn("_range", F.lit(0))
    step = 1 << most.bit_length()
    while step:
        here = F.col("_range")
        ahead = F.get("_cuts", here + F.lit(step - 1)) < F.col(value)
        df = df.withColumn("_range", F.when(ahead, here + F.lit(step)).otherwise(here))
        step >>= 1
    return df


def mid_rank(n_before: str = "n_before", n: str = "n") -> Column:
    """Average rank of a tie group."""
    return F.col(n_before) + (F.col(n) + 1) / F.lit(2.0)


def exact_percentiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated percentiles per group, as named columns."""
    by = list(by)
    counts = value_counts(df, value, by)
    ranked = with_running_count(counts, value, by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    rows = ranked.join(totals, by) if by else ranked.withColumn("_total", totals.scalar())

    def at(index: Column) -> Column:
        inside = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    aggs = []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("_total") - 1)
        aggs += [
            at(low).alias(f"_{name}_lo"),
            at(high).alias(f"_{name}_hi"),
            F.max(position - low).alias(f"_{name}_f"),
        ]
    grouped = rows.groupBy(*by).agg(*aggs)
    return grouped.select(
        *by,
        *[
            (
                F.col(f"_{q}_lo") + (F.col(f"_{q}_hi") - F.col(f"_{q}_lo")) * F.col(f"_{q}_f")
            ).alias(q)
            for q in quantiles
        ],
    )


def describe(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per group."""
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    quartiles = exact_percentiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, by)
    return basic.join(quartiles, list(by))
