"""Plan shapes shared by the operators.

Frames derived from data are joined without a broadcast hint: adaptive execution broadcasts them
when their measured size is small and otherwise keeps a sort-merge join whose skewed partitions it
splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlprism.config import Study
from crawlprism.functions.columns import percent, round_to


def active(df: DataFrame):
    return df.sparkSession


def profile_spine(df: DataFrame, study: Study, name: str = "profile") -> DataFrame:
    """One row per configured profile, in canonical order."""
    rows = [(i, p) for i, p in enumerate(study.profiles)]
    return active(df).createDataFrame(rows, f"ord int, {name} string")


def in_canonical_order(df: DataFrame, study: Study, fill: float = 0) -> DataFrame:
    """Every configured profile once, in order, with `fill` where the frame has no row."""
    measures = [c for c in df.columns if c != "profile"]
    joined = profile_spine(df, study).join(df, "profile", "left")
    return joined.select(
        "ord", "profile", *[F.coalesce(F.col(c), F.lit(fill)).alias(c) for c in measures]
    ).orderBy("ord")


def visit_totals(visits: DataFrame, visit: str = "visit_id", name: str = "total_visits") -> DataFrame:
    return visits.groupBy("profile").agg(F.count_distinct(visit).alias(name))


def top_keys(df: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The n keys with the largest summed measure; ties go to the smaller key."""
    return (
        df.groupBy(key)
        .agg(F.sum(measure).alias("_total"))
        .orderBy(F.col("_total").desc(), F.col(key))
        .limit(n)
    )


def keep_top(df: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """Rows of the global top-n keys, so every profile shows the same set."""
    top = top_keys(df, key, measure, n).select(key)
    return df.join(top, key, "left_semi")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group. `row_number() <= n` is pruned per task before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def with_group_total(df: DataFrame, group: Sequence[str], measure: str, name: str) -> DataFrame:
    """Attach the group's sum to its rows through a join: no group has to fit in one task."""
    totals = df.groupBy(*group).agg(F.sum(measure).alias(name))
    return df.join(totals, list(group))


def with_share(
    df: DataFrame,
    group: Sequence[str],
    measure: str,
    name: str,
    digits: int | None = None,
) -> DataFrame:
    """Percent of the group's sum."""
    out = with_group_total(df, group, measure, "_total")
    share = percent(measure, "_total")
    return out.withColumn(name, share if digits is None else round_to(share, digits)).drop("_total")


def presence(
    df: DataFrame, entity: str, visit: str = "visit_id", name: str = "entity"
) -> DataFrame:
    """One row per (profile, visit, entity), however often the visit met the entity."""
    return df.select("profile", visit, F.col(entity).alias(name)).distinct()


def frequency_table(
    df: DataFrame,
    visits: DataFrame,
    entity: str,
    top_n: int,
    visit: str = "visit_id",
    name: str = "entity",
) -> DataFrame:
    """Visits per (profile, entity) and their percent of the profile's visits, for the entities in
    the global top-n."""
    counts = (
        presence(df, entity, visit, name)
        .groupBy("profile", name)
        .agg(F.count("*").alias("n_visits_seen"))
    )
    return (
        keep_top(counts, name, "n_visits_seen", top_n)
        .join(visit_totals(visits, visit), "profile")
        .select(
            "profile",
            name,
            "n_visits_seen",
            round_to(percent("n_visits_seen", "total_visits"), 2).alias("pct_of_visits"),
        )
        .orderBy(name, "profile")
    )


def pivot_profiles(
    df: DataFrame, key: str, value: str, study: Study, fill: float = 0.0
) -> DataFrame:
    """One row per key, one column per configured profile."""
    return (
        df.groupBy(key)
        .pivot("profile", list(study.profiles))
        .agg(F.first(value))
        .na.fill(fill, subset=list(study.profiles))
    )
