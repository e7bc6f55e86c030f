"""Cookie volume, lifespan, listed networks and shared identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crawlprism.config import (
    ENTITY_LEVELS,
    EXTERNAL,
    FIRST_PARTY,
    INTER_FAMILY,
    RETARGETING_PARENTS,
    Study,
    check_choice,
)
from crawlprism.functions.columns import (
    count_if,
    id_like,
    lifespan_bucket,
    lifespan_days,
    member_or,
    ratio,
    round_to,
    third_party,
)
from crawlprism.operators.common import frequency_table, profile_spine


def cookie_counts(cookies: DataFrame) -> DataFrame:
    """Cookies per tier and profile, distinct owners, and third-party percents."""
    tier = F.col("relationship_tier")
    by_owner = cookies.groupBy("profile", "parent_entity").agg(
        F.count("*").alias("n"),
        count_if(tier == FIRST_PARTY).alias("first"),
        count_if(tier == INTER_FAMILY).alias("family"),
        count_if(tier == EXTERNAL).alias("external"),
    )
    return (
        by_owner.groupBy("profile")
        .agg(
            F.sum("n").alias("n_total"),
            F.sum("first").alias("n_first_party"),
            F.sum("family").alias("n_inter_family_third_party"),
            F.sum("external").alias("n_external_third_party"),
            F.count("parent_entity").alias("n_unique_parent_entities"),
        )
        .withColumn(
            "pct_third_party",
            round_to(
                100.0
                * ratio(
                    F.col("n_inter_family_third_party") + F.col("n_external_third_party"), "n_total"
                ),
                2,
            ),
        )
        .withColumn(
            "pct_external_third_party",
            round_to(100.0 * ratio("n_external_third_party", "n_total"), 2),
        )
        .orderBy("profile")
    )


def lifespan_distribution(cookies: DataFrame, third_party_only: bool = True) -> DataFrame:
    """Cookies per (profile, lifespan bucket), buckets in their natural order."""
    rows = cookies.where(third_party()) if third_party_only else cookies
    label, order = lifespan_bucket("_days")
    return (
        rows.withColumn("_days", lifespan_days("expiry", "time_stamp", "is_session"))
        .groupBy("profile", label.alias("lifespan_bucket"), order.alias("bucket_order"))
        .agg(F.count("*").alias("n_cookies"))
        .orderBy("profile", "bucket_order")
    )


def listed_network_presence(
    cookies: DataFrame, listed: Sequence[str] = RETARGETING_PARENTS
) -> DataFrame:
    """Cookie events and distinct visits per (profile, listed owner)."""
    label = member_or("parent_entity", listed)
    per_visit = (
        cookies.where(third_party())
        .withColumn("retargeter", label)
        .where(F.col("retargeter") != "other")
        .groupBy("profile", "retargeter", "visit_id")
        .agg(F.count("*").alias("n"))
    )
    return (
        per_visit.groupBy("profile", "retargeter")
        .agg(F.sum("n").alias("n_cookie_events"), F.count("visit_id").alias("n_visits_affected"))
        .orderBy("profile", F.col("n_cookie_events").desc(), "retargeter")
    )


def detect_cookie_syncs(cookies: DataFrame, min_id_length: int = 10) -> DataFrame:
    """Identifier-like values that one visit stores for two or more owners.

    Rows are first reduced to distinct owners per value on the map side, so a value repeated by a
    third of all cookies costs one row per (visit, owner); only then is a value's owner list built.
    """
    owners = (
        cookies.where(id_like("value", min_id_length) & third_party())
        .select("profile", "visit_id", F.col("value").alias("shared_value"), "parent_entity")
        .distinct()
    )
    return (
        owners.groupBy("profile", "visit_id", "shared_value")
        .agg(
            F.count("parent_entity").alias("n_parents"),
            F.array_join(F.array_sort(F.collect_list("parent_entity")), ", ").alias("parents"),
        )
        .where(F.col("n_parents") >= 2)
    )


def cookie_sync_summary(syncs: DataFrame, *, study: Study) -> DataFrame:
    """Sync events per profile. Profiles without one appear with zeros only if no profile has any."""
    per_visit = syncs.groupBy("profile", "visit_id").agg(
        F.count("shared_value").alias("n"), F.sum("n_parents").alias("parents")
    )
    found = per_visit.groupBy("profile").agg(
        F.sum("n").alias("n_sync_events"),
        F.count("visit_id").alias("n_visits_with_syncs"),
        F.sum("parents").alias("_parents"),
    )
    found = found.select(
        "profile",
        "n_sync_events",
        "n_visits_with_syncs",
        round_to(ratio("_parents", "n_sync_events"), 2).alias("avg_parents_per_sync"),
    )
    empty = (
        profile_spine(syncs, study)
        .where(~found.exists())
        .select(
            "profile",
            F.lit(0).cast("long").alias("n_sync_events"),
            F.lit(0).cast("long").alias("n_visits_with_syncs"),
            F.lit(0.0).alias("avg_parents_per_sync"),
        )
    )
    return found.unionByName(empty)


def cookie_prevalence(
    cookies: DataFrame, visits: DataFrame, granularity: str = "parent_entity", top_n: int = 50
) -> DataFrame:
    check_choice("granularity", granularity, ENTITY_LEVELS)
    return frequency_table(cookies.where(third_party()), visits, granularity, top_n)


__all__ = [
    "cookie_counts",
    "cookie_prevalence",
    "cookie_sync_summary",
    "detect_cookie_syncs",
    "lifespan_distribution",
    "listed_network_presence",
]
