"""Advertising pixels: hits, per-site presence, and what they say about the ads shown."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlprism.config import (
    DEFAULT_TARGET_PIXELS,
    INTENSITY_BUCKETS,
    PERSONA_AFFINITY,
    PIXEL_SIGNATURES,
    PLATFORM_FLAGS,
)
from crawlprism.functions.columns import (
    count_if,
    intensity_bucket,
    is_not_true,
    is_true,
    percent,
    ratio,
    round_to,
)
from crawlprism.functions.labels import with_pixel
from crawlprism.functions.suffixes import SuffixTrie
from crawlprism.functions.urls import full_host, host_suffixes, registered_domain
from crawlprism.operators.common import with_share
from crawlprism.session import written

SITE_KEYS = ("profile", "top_level_parent_entity")


def check_targets(
    targets: Sequence[str] | None, signatures=PIXEL_SIGNATURES
) -> Sequence[str] | None:
    if targets is None:
        return None
    known = {s[0] for s in signatures}
    unknown = [t for t in targets if t not in known]
    if unknown:
        raise ValueError(f"unknown pixel type(s) {unknown}; known: {sorted(known)}")
    return targets


def match_rule_domains(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """Rows whose host is a rule's domain or below it, once per rule. Hosts open into their dot
    suffixes and meet the rule table."""
    opened = df.withColumn("_suffix", F.explode(host_suffixes(full_host(url))))
    return opened.join(
        rules, F.col("_suffix") == F.col("rule_domain")
    ).drop("_suffix")


def page_owners(enriched: DataFrame, by: Sequence[str] = (), rules: SuffixTrie | None = None) -> DataFrame:
    """One owner per page URL: that of a request to the page's own domain, else the smallest. Requests
    of unknown owner (an empty name) have no say."""
    keys, page = [*by, "top_level_url"], F.col("top_level_url")
    # A page's own domain is part of its URL (or of what is left of a label that ends in "!"), so its rules are
    # walked once for each such domain of a page and not for every request.
    near = F.lower(page).contains(F.col("domain")) | page.contains("!.")
    least = (
        enriched.where(page.isNotNull() & (F.col("parent_entity") != ""))
        .groupBy(*keys, F.when(near, F.col("domain")).alias("_near"))
        .agg(F.min("parent_entity").alias("_least"))
    )
    own = F.coalesce(F.col("_near") == registered_domain("top_level_url", rules=rules), F.lit(False))
    return least.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(own, F.col("_least"))), F.min("_least")).alias("page_parent_entity")
    )


def pixel_hits(
    enriched: DataFrame,
    *,
    by: Sequence[str] = ("profile",),
    signatures=PIXEL_SIGNATURES,
    allow_domain_only: bool = False,
    rules: SuffixTrie | None = None,
) -> DataFrame:
    """One row per request that fires an advertising pixel, with the owners on both sides.

    Requests are classified in the scan stage and the few hits are written, then shuffled.
    """
    hits = (
        with_pixel(enriched, "url", "_hit", signatures, allow_domain_only, rules)
        .where(F.col("_hit").isNotNull())
        .select(
            *by,
            "visit_id",
            "top_level_url",
            F.col("url").alias("request_url"),
            F.col("_hit.pixel_type").alias("pixel_type"),
            F.col("_hit.matched_domain").alias("matched_domain"),
            F.col("_hit.pattern").isNotNull().alias("path_confirmed"),
            F.col("parent_entity").alias("request_parent_entity"),
            F.col("subsidiary_entity").alias("request_subsidiary_entity"),
            "relationship_tier",
            "is_technical_3p",
        )
    )
    # Requests are classified once. Each task brings its requests down to pages before a shuffle, which is less
    # than to send the requests to the pages that have hits.
    hits = written(hits, "pixel_hits")
    owners = page_owners(enriched, by, rules).withColumnRenamed("page_parent_entity", "top_level_parent_entity")
    return hits.join(owners, [*by, "top_level_url"], "left")


def site_pixels(
    hits: DataFrame,
    *,
    by: Sequence[str] = SITE_KEYS,
    targets: Sequence[str] | None = None,
    require_path: bool = False,
    only_third_party: bool = False,
    exclude_technical: bool = False,
    tiers: Sequence[str] | None = None,
    flags_from: str = "all",
) -> DataFrame:
    """One row per site with counted pixels; platform flags come from all hits of the site.

    Hits collapse to (site, pixel type, owner) first, with the number that pass the filters. That
    small frame gives the filtered counts and the unfiltered flags together: one scan, no join back,
    and a site with a third of all hits stays a handful of rows.
    """
    check_targets(targets)
    passes: Column = F.lit(True)
    if targets:
        passes = passes & F.col("pixel_type").isin(*targets)
    if require_path:
        passes = passes & is_true("path_confirmed")
    if only_third_party:
        passes = passes & F.coalesce(
            F.col("top_level_parent_entity") != F.col("request_parent_entity"), F.lit(False)
        )
    if exclude_technical:
        passes = passes & (F.coalesce("is_technical_3p", F.lit(0.0)) < 0.5)
    if tiers:
        passes = passes & F.coalesce(F.col("relationship_tier").isin(*tiers), F.lit(False))
    keys = list(by)
    known = hits
    for k in keys:
        named = F.col(k) != "" if dict(hits.dtypes)[k] == "string" else F.col(k).isNotNull()
        known = known.where(named)
    small = known.groupBy(*keys, "pixel_type", "request_parent_entity").agg(
        count_if(passes).alias("_n")
    )
    kept = F.col("_n") > 0
    flag_rows = F.lit(True) if flags_from == "all" else kept
    return (
        small.groupBy(*keys)
        .agg(
            F.sum("_n").alias("n_pixel_hits"),
            F.collect_set(F.when(kept, F.col("pixel_type"))).alias("_types"),
            F.count_distinct(F.when(kept, F.col("request_parent_entity"))).alias(
                "distinct_tracker_entities"
            ),
            *[
                F.max(flag_rows & (F.col("pixel_type") == label)).alias(flag)
                for flag, (label, _) in PLATFORM_FLAGS.items()
            ],
        )
        .where(F.col("n_pixel_hits") > 0)
        .select(
            *keys,
            F.lit(True).alias("has_pixel"),
            "n_pixel_hits",
            F.size("_types").cast("long").alias("n_distinct_pixel_types"),
            F.array_join(F.array_sort("_types"), ", ").alias("pixel_types"),
            "distinct_tracker_entities",
            *PLATFORM_FLAGS,
        )
    )


def measured_site_pixels(
    enriched: DataFrame,
    targets: Sequence[str] | None = DEFAULT_TARGET_PIXELS,
    require_path: bool = True,
    only_third_party: bool = True,
    exclude_technical: bool = False,
    tiers: Sequence[str] | None = None,
) -> DataFrame:
    """Measured crawl to site table. `exclude_technical` is off by default: every third-party tier
    carries the technical flag, so turning it on leaves nothing."""
    return site_pixels(
        pixel_hits(enriched),
        targets=targets,
        require_path=require_path,
        only_third_party=only_third_party,
        exclude_technical=exclude_technical,
        tiers=tiers,
    )


def seeded_site_pixels(
    hits: DataFrame,
    targets: Sequence[str] | None = DEFAULT_TARGET_PIXELS,
    require_path: bool = True,
) -> DataFrame:
    """Seeding crawl to site table per persona. Without hits the frame is empty, with the schema."""
    return site_pixels(
        hits,
        by=("persona", "top_level_parent_entity"),
        targets=targets,
        require_path=require_path,
    )


def named_site_pixels(hits: DataFrame, crawl: str) -> DataFrame:
    """Site table of one crawl, tagged with the crawl's name."""
    out = site_pixels(hits, by=("top_level_parent_entity",))
    return out.select(F.lit(crawl).alias("crawl_name"), *out.columns)


def pixel_coverage(sites: DataFrame, all_sites: DataFrame) -> DataFrame:
    """Share of a crawl's sites with a pixel, and whether it lies outside 5-95 percent."""
    n_with = sites.agg(F.count("*").alias("n_with_pixel"))
    n_all = all_sites.agg(F.count("*").alias("n_sites"))
    pct = F.coalesce(percent("n_with_pixel", "n_sites"), F.lit(0.0))
    return (
        n_with.withColumn("n_sites", n_all.scalar())
        .withColumn("pct", pct)
        .withColumn("suspicious", (F.col("pct") < 5) | (F.col("pct") > 95))
    )


# --- ads in pixel context --------------------------------------------------------------------

AD_CONTEXT_COLUMNS = (
    "profile", "visit_id", "page_url", "page_parent_entity", "ad_hash", "advertiser_network",
    "capture_network", "networks_agree", "confidence", "category", "product", "brand",
    "vlm_confidence", "same_company",
)


def ads_with_pixel_context(
    ads: DataFrame,
    owners: DataFrame,
    sites: DataFrame,
    seeded: DataFrame,
    require_networks_agree: bool = False,
) -> DataFrame:
    """Valid ads with the pixels of the page's owner, measured and seeded; absent means false or 0.

    Owner and pixels are looked up once for each page of a profile; the ads are shuffled once to meet them.
    """
    keep = is_true("is_valid_ad") & F.col("category").isNotNull() & is_not_true("same_company")
    if require_networks_agree:
        keep = keep & is_true("networks_agree")
    kept = ads.where(keep)
    pages = kept.select("profile", "page_url").distinct()
    pages = pages.join(owners, F.col("page_url") == F.col("top_level_url")).select("profile", "page_url", "page_parent_entity")
    measured = sites.select(
        "profile",
        F.col("top_level_parent_entity").alias("page_parent_entity"),
        F.col("has_pixel").alias("_has"),
        F.col("n_pixel_hits").alias("_hits"),
        F.col("n_distinct_pixel_types").alias("_types"),
        F.col("distinct_tracker_entities").alias("_entities"),
        F.col("pixel_types").alias("site_pixel_types"),
        *[F.col(f).alias(f"_{f}") for f in PLATFORM_FLAGS],
    )
    before = seeded.select(
        F.col("persona").alias("profile"),
        F.col("top_level_parent_entity").alias("page_parent_entity"),
        F.col("has_pixel").alias("_seeded"),
        F.col("pixel_types").alias("seeded_pixel_types"),
    )
    on = ["profile", "page_parent_entity"]
    pages = pages.join(measured, on, "left").join(before, on, "left")
    pages = pages.withColumnRenamed("profile", "_profile").withColumnRenamed("page_url", "_page_url")
    of_page = F.col("profile").eqNullSafe(F.col("_profile")) & (F.col("page_url") == F.col("_page_url"))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return (
        kept.join(pages, of_page, "left")
        .select(
            *AD_CONTEXT_COLUMNS,
            F.coalesce("_has", no).alias("site_has_pixel"),
            F.coalesce("_hits", zero).alias("site_pixel_hits"),
            F.coalesce("_types", zero).alias("site_distinct_pixels"),
            F.coalesce("_entities", zero).alias("site_tracker_entities"),
            "site_pixel_types",
            *[F.coalesce(f"_{f}", no).alias(f"site_{f}") for f in PLATFORM_FLAGS],
            F.coalesce("_seeded", no).alias("site_was_seeded_with_pixel"),
            "seeded_pixel_types",
        )
    )


def persona_affinity(df: DataFrame, affinity: Mapping[str, Iterable[str]]) -> DataFrame:
    pairs = [(p, c) for p, cats in affinity.items() for c in cats]
    return df.sparkSession.createDataFrame(pairs, "profile string, on_target_category string")


def score_ads(ads: DataFrame, affinity: Mapping[str, Iterable[str]] = PERSONA_AFFINITY) -> DataFrame:
    """Flag ads whose category the persona is expected to attract. The pairs are given in Python: they go to
    the ads."""
    pairs = [(p, c) for p, cats in affinity.items() for c in dict.fromkeys(cats)]
    wanted = persona_affinity(ads, {p: list(dict.fromkeys(c)) for p, c in affinity.items()})
    wanted = wanted.select(
        "profile", F.col("on_target_category").alias("category"), F.lit(True).alias("_hit")
    )
    return (
        ads.join(F.broadcast(wanted), ["profile", "category"], "left")
        .withColumn("is_on_target", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def _on_target() -> list[Column]:
    return [
        F.count("*").alias("n_ads"),
        count_if(F.col("is_on_target")).alias("n_on_target"),
    ]


def with_target_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("pct_on_target", 100.0 * ratio("n_on_target", "n_ads"))


def category_by_pixel(
    context: DataFrame, profile: str | None = None, normalize: bool = True
) -> DataFrame:
    rows = context if profile is None else context.where(F.col("profile") == profile)
    counts = rows.groupBy("profile", "category", "site_has_pixel").agg(F.count("*").alias("n_ads"))
    if normalize:
        out = with_share(counts, ["profile", "site_has_pixel"], "n_ads", "pct_within_group")
    else:
        out = counts.withColumn("pct_within_group", F.lit(None).cast("double"))
    return out.orderBy("profile", "category", "site_has_pixel")


def by_platform(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form of the platform flags: the given columns once per platform."""
    flags = [
        F.struct(F.lit(name).alias("platform"), F.col(f"site_{flag}").alias("present"))
        for flag, (_, name) in PLATFORM_FLAGS.items()
    ]
    return df.select(*columns, F.explode(F.array(*flags)).alias("_p")).select(
        *columns, "_p.platform", "_p.present"
    )


def _flag_groups(df: DataFrame, ids: Sequence[str], with_target: bool) -> DataFrame:
    """Counts per id and flag combination: the five-fold unpivot then runs on this small frame."""
    aggs = [F.count("*").alias("_n")]
    if with_target:
        aggs.append(count_if(F.col("is_on_target")).alias("_hits"))
    return df.groupBy(*ids, *[f"site_{f}" for f in PLATFORM_FLAGS]).agg(*aggs)


def category_by_platform(context: DataFrame, profile: str | None = None) -> DataFrame:
    """Ads of each category shown with and without each platform on the page."""
    rows = context if profile is None else context.where(F.col("profile") == profile)
    ids = ["profile", "category"]
    long = by_platform(_flag_groups(rows, ids, False), [*ids, "_n"])
    n = F.col("_n")
    zero = F.lit(0).cast("long")
    return (
        long.groupBy("profile", "platform", "category")
        .agg(
            F.sum(F.when(F.col("present"), n).otherwise(zero)).alias("n_ads_with_platform"),
            F.sum(F.when(~F.col("present"), n).otherwise(zero)).alias("n_ads_without_platform"),
        )
        .orderBy("profile", "platform", "category")
    )


def targeting_accuracy(scored: DataFrame) -> DataFrame:
    """On-target rate with and without a pixel, and their ratio per profile."""
    rates = with_target_rate(scored.groupBy("profile", "site_has_pixel").agg(*_on_target()))
    p = F.col("site_has_pixel")
    lift = rates.groupBy("profile").agg(
        F.max(F.when(p, F.col("pct_on_target"))).alias("_with"),
        F.max(F.when(~p, F.col("pct_on_target"))).alias("_without"),
    )
    lift = lift.select("profile", ratio("_with", "_without").alias("targeting_lift"))
    return rates.join(lift, "profile", "left").orderBy("profile", "site_has_pixel")


def targeting_by_platform(scored: DataFrame) -> DataFrame:
    long = by_platform(_flag_groups(scored, ["profile"], True), ["profile", "_n", "_hits"])
    out = long.groupBy("profile", "platform", "present").agg(
        F.sum("_n").alias("n_ads"), F.sum("_hits").alias("n_on_target")
    )
    return with_target_rate(out).drop("n_on_target").orderBy("profile", "platform", "present")


def seeded_impact(scored: DataFrame) -> DataFrame:
    out = scored.groupBy("profile", "site_was_seeded_with_pixel", "site_has_pixel").agg(*_on_target())
    return with_target_rate(out).orderBy(
        "profile",
        F.col("site_was_seeded_with_pixel").desc(),
        F.col("site_has_pixel").desc(),
    )


def intensity_response(scored: DataFrame, table=INTENSITY_BUCKETS) -> DataFrame:
    """On-target rate by how many tracking owners the page's owner carries."""
    label, order = intensity_bucket("site_tracker_entities", table)
    out = scored.groupBy(
        "profile", label.alias("intensity_bucket"), order.alias("bucket_order")
    ).agg(*_on_target())
    return with_target_rate(out).orderBy("profile", "bucket_order")


# --- diagnostics -----------------------------------------------------------------------------


def pixel_funnel(hits: DataFrame) -> DataFrame:
    """How many hits survive each condition, in one pass."""
    top, req = F.col("top_level_parent_entity"), F.col("request_parent_entity")
    both = top.isNotNull() & req.isNotNull()
    return hits.agg(
        F.count("*").alias("n_hits"),
        count_if(is_true("path_confirmed")).alias("n_path_confirmed"),
        count_if(both).alias("n_both_owners"),
        count_if(both & (top != req)).alias("n_cross_owner"),
        count_if(F.coalesce("is_technical_3p", F.lit(0.0)) < 0.5).alias("n_not_technical"),
    )


def pixel_types(hits: DataFrame) -> DataFrame:
    """Hits, confirmed hits and technical flags per pixel type."""
    technical = F.coalesce("is_technical_3p", F.lit(0.0)) >= 0.5
    return (
        hits.groupBy("pixel_type")
        .agg(
            F.count("*").alias("total_hits"),
            count_if(is_true("path_confirmed")).alias("n_path_confirmed"),
            count_if(technical).alias("flagged_technical"),
        )
        .withColumn(
            "pct_technical", round_to(100.0 * ratio("flagged_technical", "total_hits"), 1)
        )
    )


def site_pixel_summary(sites: DataFrame) -> DataFrame:
    return (
        sites.groupBy("profile")
        .agg(
            F.count("*").alias("n_entities"),
            count_if(F.col("has_pixel")).alias("n_with_pixel"),
            F.sum("n_pixel_hits").alias("total_hits_aggregated"),
        )
        .withColumn("pct_with_pixel", round_to(100.0 * ratio("n_with_pixel", "n_entities"), 1))
    )


def top_pixel_sites(sites: DataFrame, n: int = 10) -> DataFrame:
    return (
        sites.select(
            "profile", "top_level_parent_entity", "n_pixel_hits", "n_distinct_pixel_types", "pixel_types"
        )
        .orderBy(F.col("n_pixel_hits").desc(), "profile", "top_level_parent_entity")
        .limit(n)
    )


def first_party_domains(enriched: DataFrame, n: int = 20) -> DataFrame:
    """Busiest (domain, owner) pairs that carry no technical flag."""
    return (
        enriched.where(F.col("is_technical_3p") < 0.5)
        .groupBy("domain", "parent_entity")
        .agg(F.count("*").alias("n_reqs"))
        .orderBy(F.col("n_reqs").desc(), "domain", "parent_entity")
        .limit(n)
    )
