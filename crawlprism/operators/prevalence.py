"""Which entities reach which profiles: prevalence, frequency, similarity, lift, exclusivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crawlprism.config import (
    ENTITY_LEVELS,
    EXTERNAL,
    GROUP_LEVELS,
    INTER_FAMILY,
    Study,
    check_choice,
)
from crawlprism.functions.columns import (
    count_if,
    not_first_party,
    ratio,
    round_to,
    smoothed_lift,
)
from crawlprism.functions.urls import has_http_scheme
from crawlprism.operators.common import frequency_table, presence


def tracker_requests(enriched: DataFrame, http_only: bool = True) -> DataFrame:
    keep = not_first_party()
    if http_only:
        keep = keep & has_http_scheme("url")
    return enriched.where(keep)


def prevalence_by_profile(
    enriched: DataFrame, trackers: Sequence[str] | None = None, list_column: str = "parent_entity"
) -> DataFrame:
    """Distinct visits, domains and owners met per profile, with per-visit ratios.

    The visit count and the entity counts are two narrow branches. The entity branch collapses on
    the map side to one row per (profile, owner triple, tier), so the multi-column distinct count
    runs on that small frame and never on requests.
    """
    rows = tracker_requests(enriched)
    if trackers is not None:
        rows = rows.where(F.col(list_column).isin(*trackers))
    visits = rows.groupBy("profile").agg(F.count_distinct("visit_id").alias("n_visits"))
    owners = rows.select("profile", *ENTITY_LEVELS, "relationship_tier").distinct()
    tier, parent = F.col("relationship_tier"), F.col("parent_entity")
    counts = owners.groupBy("profile").agg(
        F.count_distinct("domain").alias("n_unique_domains"),
        F.count_distinct("subsidiary_entity").alias("n_unique_subsidiaries"),
        F.count_distinct("parent_entity").alias("n_unique_parents"),
        F.count_distinct(F.when(tier == EXTERNAL, parent)).alias("n_external_third_party"),
        F.count_distinct(F.when(tier == INTER_FAMILY, parent)).alias("n_inter_family_third_party"),
    )
    out = visits.join(counts, "profile")
    for name, measure in (
        ("domains_per_visit", "n_unique_domains"),
        ("subsidiaries_per_visit", "n_unique_subsidiaries"),
        ("parents_per_visit", "n_unique_parents"),
    ):
        out = out.withColumn(name, round_to(ratio(measure, "n_visits"), 2))
    return out.orderBy("profile")


def tracker_frequency(
    enriched: DataFrame, visits: DataFrame, top_n: int = 50, granularity: str = "parent_entity"
) -> DataFrame:
    check_choice("granularity", granularity, ENTITY_LEVELS)
    return frequency_table(
        tracker_requests(enriched), visits, granularity, top_n, name=granularity
    )


def differential_entities(
    enriched: DataFrame,
    profile_a: str,
    profile_b: str | None = None,
    *,
    study: Study,
    granularity: str = "parent_entity",
    min_visits: int = 3,
    levels: Sequence[str] = GROUP_LEVELS,
) -> DataFrame:
    """Visits meeting each entity in A and in B, their difference and smoothed lift."""
    check_choice("granularity", granularity, levels)
    profile_b = study.resolve_baseline(profile_b)
    study.check(profile_a, profile_b)
    rows = tracker_requests(enriched).where(F.col("profile").isin(profile_a, profile_b))
    p = F.col("profile")
    return (
        presence(rows, granularity, name=granularity)
        .groupBy(granularity)
        .agg(
            count_if(p == profile_a).alias("visits_a"),
            count_if(p == profile_b).alias("visits_b"),
        )
        .where(F.col("visits_a") >= min_visits)
        .select(
            granularity,
            "visits_a",
            "visits_b",
            (F.col("visits_a") - F.col("visits_b")).alias("delta"),
            round_to(smoothed_lift("visits_a", "visits_b"), 3).alias("lift"),
        )
        .orderBy(F.col("lift").desc(), F.col("delta").desc(), granularity)
    )


def exclusive_entities(
    enriched: DataFrame,
    profile: str,
    *,
    study: Study,
    granularity: str = "parent_entity",
    levels: Sequence[str] = GROUP_LEVELS,
) -> DataFrame:
    """Entities of one profile that no other configured profile meets, with their visits.

    Membership looks at http requests only; the visit count takes every third-party request. One
    scan and one shuffle of visit-level rows answer both, instead of a set difference joined back.
    """
    check_choice("granularity", granularity, levels)
    others = study.others(profile)
    rows = tracker_requests(enriched, http_only=False).where(
        F.col("profile").isin(profile, *others) & F.col(granularity).isNotNull()
    )
    http = F.coalesce(has_http_scheme("url"), F.lit(False))
    mine = F.col("profile") == profile
    per_visit = rows.groupBy(granularity, "profile", "visit_id").agg(F.max(http).alias("_http"))
    return (
        per_visit.groupBy(granularity)
        .agg(
            F.max(mine & F.col("_http")).alias("_here"),
            F.max(~mine & F.col("_http")).alias("_elsewhere"),
            count_if(mine).alias("n_visits_seen"),
        )
        .where(F.col("_here") & ~F.col("_elsewhere"))
        .select(granularity, "n_visits_seen")
        .orderBy(F.col("n_visits_seen").desc(), granularity)
    )


def entity_sets(enriched: DataFrame, granularity: str) -> DataFrame:
    """Distinct (profile, entity) pairs of third-party http requests."""
    return (
        tracker_requests(enriched)
        .select("profile", F.col(granularity).alias("entity"))
        .distinct()
    )


def jaccard_similarity(
    enriched: DataFrame, *, study: Study, granularity: str = "subsidiary_entity"
) -> DataFrame:
    """Long (profile_a, profile_b, n_a, n_b, n_both, jaccard) over the configured profiles.

    Membership becomes one flag per profile on each entity row, and every cell is a counted
    conjunction of two flags in a single aggregation: no pairs of rows are formed.
    """
    check_choice("granularity", granularity, ENTITY_LEVELS)
    profiles = study.profiles
    flags = entity_sets(enriched, granularity).groupBy("entity").agg(
        *[F.max(F.col("profile") == p).alias(f"_p{i}") for i, p in enumerate(profiles)]
    )
    cells = [(i, j) for i in range(len(profiles)) for j in range(i, len(profiles))]
    totals = flags.agg(
        *[count_if(F.col(f"_p{i}") & F.col(f"_p{j}")).alias(f"_c{i}_{j}") for i, j in cells]
    )
    entries = []
    for i, a in enumerate(profiles):
        for j, b in enumerate(profiles):
            lo, hi = min(i, j), max(i, j)
            entries.append(
                F.struct(
                    F.lit(a).alias("profile_a"),
                    F.lit(b).alias("profile_b"),
                    F.col(f"_c{i}_{i}").alias("n_a"),
                    F.col(f"_c{j}_{j}").alias("n_b"),
                    F.col(f"_c{lo}_{hi}").alias("n_both"),
                )
            )
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    # A profile that met nothing has no row or column.
    return (
        totals.select(F.explode(F.array(*entries)).alias("c"))
        .select("c.*")
        .where((F.col("n_a") > 0) & (F.col("n_b") > 0))
        .withColumn("jaccard", F.coalesce(ratio("n_both", union), F.lit(0.0)))
    )


def jaccard_matrix(long: DataFrame, *, study: Study) -> DataFrame:
    """Square grid: one row per profile, one column per profile."""
    return (
        long.groupBy("profile_a")
        .pivot("profile_b", list(study.profiles))
        .agg(F.first("jaccard"))
        .orderBy("profile_a")
    )


def visit_overview(visits: DataFrame) -> DataFrame:
    """Visits, distinct sites and the id range per profile."""
    return visits.groupBy("profile").agg(
        F.count("*").alias("n_visits"),
        F.count_distinct("site_url").alias("n_unique_sites"),
        F.min("visit_id").alias("min_visit_id"),
        F.max("visit_id").alias("max_visit_id"),
    )
