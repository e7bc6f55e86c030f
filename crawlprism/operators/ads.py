"""Ad volume, networks, content, placement, and their relation to tracking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from crawlprism.config import (
    CATEGORY_KEYWORDS,
    CONFIDENCE_LEVELS,
    FOLD_Y,
    KEYWORD_CATEGORIES,
    Study,
    check_choice,
)
from crawlprism.functions.columns import (
    above_fold,
    ad_size,
    count_if,
    is_not_true,
    is_true,
    optional_confidence,
    percent,
    ratio,
    round_to,
    smoothed_lift,
    third_party,
    usable_label,
    valid_ad,
)
from crawlprism.functions.text import contains_any, first_category
from crawlprism.functions.urls import has_http_scheme, hostname
from crawlprism.operators.common import (
    keep_top,
    pivot_profiles,
    top_per_group,
    with_share,
)

VISIT_KEYS = ("profile", "visit_id")


def _named_network(column: str = "advertiser_network"):
    return F.col(column).isNotNull() & (F.col(column) != "unknown")


def _content(ads: DataFrame, min_confidence: str, confidence: str) -> DataFrame:
    """Valid ads with a usable category that do not advertise the page's own company."""
    return ads.where(
        valid_ad(min_confidence, confidence) & usable_label("category") & is_not_true("same_company")
    )


# --- coverage and volume ---------------------------------------------------------------------


def label_coverage(ads: DataFrame, confidence: str = "confidence") -> DataFrame:
    """How many ads are unlabelled, rejected, or valid per confidence level."""
    valid, level = is_true("is_valid_ad"), F.col(confidence)
    return (
        ads.groupBy("profile")
        .agg(
            F.count("*").alias("total_ads"),
            count_if(F.col("is_valid_ad").isNull()).alias("unprocessed"),
            count_if(~F.col("is_valid_ad")).alias("invalid_ads"),
            *[count_if(valid & (level == x)).alias(f"{x}_conf") for x in ("high", "medium", "low")],
        )
        .withColumn("pct_high_conf", round_to(percent("high_conf", "total_ads"), 1))
        .orderBy("profile")
    )


def coverage_imbalance(coverage: DataFrame, limit: float = 0.10) -> DataFrame:
    """Sample deviation over profiles of the high-confidence rate, and whether it exceeds `limit`."""
    return coverage.agg(
        F.stddev_samp(ratio("high_conf", "total_ads")).alias("rate_stddev")
    ).withColumn("uneven", F.coalesce(F.col("rate_stddev") > limit, F.lit(False)))


def valid_ad_counts(ads: DataFrame, min_confidence: str = "high", confidence: str = "confidence") -> DataFrame:
    return (
        ads.where(valid_ad(min_confidence, confidence))
        .groupBy("profile")
        .agg(F.count("*").alias("n_ads"))
        .orderBy(F.col("n_ads").desc(), "profile")
    )


def ad_volume(ads: DataFrame, visits: DataFrame, min_confidence: str | None = None) -> DataFrame:
    """Ads, visits with ads and their density per profile; profiles without ads keep zeros."""
    per_visit = (
        ads.where(optional_confidence(min_confidence))
        .groupBy(*VISIT_KEYS)
        .agg(F.count("*").alias("n"))
    )
    found = per_visit.groupBy("profile").agg(
        F.sum("n").alias("n_ads"), F.count("visit_id").alias("n_visits_with_ads")
    )
    totals = visits.groupBy("profile").agg(F.count("*").alias("n_total_visits"))
    zero = F.lit(0).cast("long")
    return (
        totals.join(found, "profile", "left")
        .select(
            "profile",
            F.coalesce("n_ads", zero).alias("n_ads"),
            F.coalesce("n_visits_with_ads", zero).alias("n_visits_with_ads"),
            "n_total_visits",
        )
        .withColumn("ads_per_visit", round_to(ratio("n_ads", "n_total_visits"), 2))
        .withColumn("pct_visits_with_ads", round_to(percent("n_visits_with_ads", "n_total_visits"), 1))
        .orderBy("profile")
    )


def ads_per_visit_rate(counts: DataFrame, visits: DataFrame) -> DataFrame:
    """Counted ads over all visits of the profile; profiles without ads drop out."""
    totals = visits.groupBy("profile").agg(F.count("*").alias("n_visits"))
    return counts.join(totals, "profile").withColumn("ads_per_visit", ratio("n_ads", "n_visits"))


# --- networks --------------------------------------------------------------------------------


def network_distribution(
    ads: DataFrame, min_confidence: str = "high", confidence: str = "confidence"
) -> DataFrame:
    """Share of each named network in a profile's valid ads."""
    counts = (
        ads.where(valid_ad(min_confidence, confidence) & _named_network())
        .groupBy("profile", "advertiser_network")
        .agg(F.count("*").alias("n_ads"))
    )
    return with_share(counts, ["profile"], "n_ads", "pct", 2).orderBy(
        "profile", F.col("n_ads").desc(), "advertiser_network"
    )


def raw_network_distribution(ads: DataFrame, high_only: bool = True) -> DataFrame:
    """Share of every network label, before ads are labelled."""
    rows = ads.where(F.col("confidence") == "high") if high_only else ads
    counts = rows.groupBy("profile", "advertiser_network").agg(F.count("*").alias("n_ads"))
    return with_share(counts, ["profile"], "n_ads", "pct", 2).orderBy(
        "profile", F.col("n_ads").desc(), "advertiser_network"
    )


def share_matrix(
    long: DataFrame, key: str, value: str, *, study: Study, top_n: int, measure: str = "n_ads"
) -> DataFrame:
    """Wide grid of the top-n keys by total volume, largest first; missing cells are 0."""
    kept = keep_top(long, key, measure, top_n)
    totals = kept.groupBy(key).agg(F.sum(measure).alias("_total"))
    return (
        pivot_profiles(kept, key, value, study)
        .join(totals, key)
        .orderBy(F.col("_total").desc(), key)
        .drop("_total")
    )


# --- content ---------------------------------------------------------------------------------


def category_distribution(
    ads: DataFrame,
    min_confidence: str = "high",
    top_n: int | None = 20,
    confidence: str = "confidence",
) -> DataFrame:
    """Share of each category in a profile's valid ads; at most `top_n` categories per profile."""
    counts = (
        _content(ads, min_confidence, confidence)
        .groupBy("profile", F.trim("category").alias("category"))
        .agg(F.count("*").alias("n_ads"))
    )
    out = with_share(counts, ["profile"], "n_ads", "pct_of_profile", 2)
    order = [F.col("n_ads").desc(), F.col("category")]
    if top_n is not None:
        out = top_per_group(out, ["profile"], order, top_n)
    return out.orderBy("profile", *order)


def top_brands(
    ads: DataFrame,
    min_confidence: str = "high",
    top_n: int | None = None,
    confidence: str = "confidence",
    min_ads: int = 2,
) -> DataFrame:
    """Brands with their ads, networks and most frequent confidence (ties: the smaller text).

    The confidence floor leaves at most three levels, so the mode is read off three counters; one
    row per (brand, network) feeds both the counters and the distinct networks.
    """
    levels = sorted(CONFIDENCE_LEVELS.get(min_confidence, CONFIDENCE_LEVELS["high"]))
    counters = [f"_{x}" for x in levels]
    by_network = (
        _content(ads, min_confidence, confidence)
        .where(F.col("brand").isNotNull() & (F.trim("brand") != ""))
        .groupBy("profile", F.trim("brand").alias("brand"), "advertiser_network")
        .agg(*[count_if(F.col(confidence) == x).alias(f"_{x}") for x in levels])
    )
    ranked = F.array_min(
        F.array(*[F.struct((-F.col(f"_{x}")).alias("n"), F.lit(x).alias("level")) for x in levels])
    )
    out = (
        by_network.groupBy("profile", "brand")
        .agg(
            F.count("advertiser_network").alias("n_networks"),
            *[F.sum(c).alias(c) for c in counters],
        )
        .withColumn("n_ads", sum((F.col(c) for c in counters), F.lit(0).cast("long")))
        .where(F.col("n_ads") >= min_ads)
        .select("profile", "brand", "n_ads", "n_networks", ranked["level"].alias("modal_confidence"))
    )
    order = [F.col("n_ads").desc(), F.col("brand")]
    if top_n is not None:
        out = top_per_group(out, ["profile"], order, top_n)
    return out.orderBy("profile", *order)


def top_products(
    ads: DataFrame,
    min_confidence: str = "high",
    top_n: int | None = None,
    confidence: str = "confidence",
    min_ads: int = 2,
) -> DataFrame:
    out = (
        _content(ads, min_confidence, confidence)
        .where(F.col("product").isNotNull() & (F.trim("product") != ""))
        .groupBy("profile", F.trim("product").alias("product"))
        .agg(F.count("*").alias("n_ads"))
        .where(F.col("n_ads") >= min_ads)
    )
    order = [F.col("n_ads").desc(), F.col("product")]
    if top_n is not None:
        out = top_per_group(out, ["profile"], order, top_n)
    return out.orderBy("profile", *order)


def targeting_delta(
    distribution: DataFrame,
    *,
    study: Study,
    top_n: int = 15,
    profile_a: str | None = None,
    profile_b: str | None = None,
) -> DataFrame:
    """Percentage-point difference per category between two profiles, largest first.

    Works on the long form; the profiles are columns of the result instead of its header.
    """
    a, b = study.resolve_pair(profile_a, profile_b)
    kept = keep_top(distribution, "category", "n_ads", top_n)
    p = F.col("profile")

    def share(name: str):
        return F.coalesce(F.max(F.when(p == name, F.col("pct_of_profile"))), F.lit(0.0))

    return (
        kept.groupBy("category")
        .agg((share(a) - share(b)).alias("delta_pct"))
        .select("category", F.lit(a).alias("profile_a"), F.lit(b).alias("profile_b"), "delta_pct")
        .orderBy(F.col("delta_pct").desc(), "category")
    )


# --- placement -------------------------------------------------------------------------------


def placement_stats(
    ads: DataFrame,
    min_confidence: str = "high",
    confidence: str = "confidence",
    fold: float = FOLD_Y,
) -> DataFrame:
    """Mean position, size and area, and the share of ads above the fold."""
    area = F.col("ad_width") * F.col("ad_height")
    return (
        ads.where(valid_ad(min_confidence, confidence))
        .groupBy("profile")
        .agg(
            F.count("*").alias("n_ads"),
            round_to(F.avg("ad_x"), 1).alias("avg_x"),
            round_to(F.avg("ad_y"), 1).alias("avg_y"),
            round_to(F.avg("ad_width"), 1).alias("avg_width"),
            round_to(F.avg("ad_height"), 1).alias("avg_height"),
            round_to(F.avg(area), 1).alias("avg_area"),
            count_if(above_fold("ad_y", fold)).alias("above_fold_count"),
        )
        .withColumn("pct_above_fold", round_to(percent("above_fold_count", "n_ads"), 2))
        .orderBy("profile")
    )


def size_distribution(
    ads: DataFrame,
    min_confidence: str = "high",
    confidence: str = "confidence",
    labelled: bool = True,
    name: str = "iab_size",
) -> DataFrame:
    """Ads per standard size. `labelled` takes valid ads with a positive size; otherwise all
    high-confidence captures count."""
    if labelled:
        rows = ads.where(
            valid_ad(min_confidence, confidence) & (F.col("ad_width") > 0) & (F.col("ad_height") > 0)
        )
    else:
        rows = ads.where(F.col(confidence) == "high")
    return (
        rows.groupBy("profile", ad_size("ad_width", "ad_height").alias(name))
        .agg(F.count("*").alias("n_ads"))
        .orderBy("profile", F.col("n_ads").desc(), name)
    )


# --- tracking on the ad's page ---------------------------------------------------------------


def trackers_per_visit(
    enriched: DataFrame, keys: Sequence[str] = VISIT_KEYS, measure: str = "url"
) -> DataFrame:
    """Distinct third-party URLs (or hosts) per visit."""
    check_choice("measure", measure, ("url", "host"))
    value = F.col("url") if measure == "url" else hostname("url")
    return (
        enriched.where(third_party())
        .select(*keys, value.alias("_tracker"))
        .distinct()
        .groupBy(*keys)
        .agg(F.count("_tracker").alias("n_trackers"))
    )


def _ads_with_trackers(ads: DataFrame, enriched: DataFrame, keys, measure) -> DataFrame:
    return ads.join(trackers_per_visit(enriched, keys, measure), list(keys), "left")


def tracking_by_category(
    ads: DataFrame,
    enriched: DataFrame,
    min_confidence: str = "high",
    keys: Sequence[str] = VISIT_KEYS,
    measure: str = "url",
    confidence: str = "confidence",
    min_ads: int = 3,
) -> DataFrame:
    """Trackers on the pages that show each category. `keys=("visit_id",)` joins across profiles."""
    rows = ads.where(valid_ad(min_confidence, confidence) & F.col("category").isNotNull())
    return (
        _ads_with_trackers(rows, enriched, keys, measure)
        .groupBy("profile", F.trim("category").alias("category"))
        .agg(
            F.count_distinct("ad_hash").alias("n_ads"),
            round_to(F.avg("n_trackers"), 1).alias("avg_trackers_on_page"),
            round_to(F.stddev_samp("n_trackers"), 1).alias("stddev_trackers"),
        )
        .where(F.col("n_ads") >= min_ads)
        .orderBy(F.col("avg_trackers_on_page").desc_nulls_last(), "profile", "category")
    )


def tracking_by_network_category(
    ads: DataFrame,
    enriched: DataFrame,
    min_confidence: str = "high",
    keys: Sequence[str] = VISIT_KEYS,
    measure: str = "url",
    confidence: str = "confidence",
    min_ads: int = 2,
) -> DataFrame:
    rows = ads.where(
        valid_ad(min_confidence, confidence)
        & F.col("advertiser_network").isNotNull()
        & F.col("category").isNotNull()
    )
    return (
        _ads_with_trackers(rows, enriched, keys, measure)
        .groupBy("profile", "advertiser_network", F.trim("category").alias("category"))
        .agg(
            F.count_distinct("ad_hash").alias("n_ads"),
            round_to(F.avg("n_trackers"), 1).alias("avg_trackers"),
        )
        .where(F.col("n_ads") >= min_ads)
        .orderBy(F.col("avg_trackers").desc_nulls_last(), "profile", "advertiser_network", "category")
    )


def network_tracker_cooccurrence(
    ads: DataFrame,
    enriched: DataFrame,
    min_confidence: str = "high",
    top_n: int | None = 20,
    keys: Sequence[str] = VISIT_KEYS,
    confidence: str = "confidence",
    min_shared: int = 5,
) -> DataFrame:
    """Distinct ads of a network that share a visit with a tracker host, and distinct profiles.

    The ad-by-request product is never formed. An ad seen in one visit adds to that visit's count
    of its network, and such counts meet the visit's distinct hosts, which also gives the profiles. Only
    ads that recur in several visits are followed one by one, so that each counts once per (network, host).
    """
    keys = list(keys)
    where = [*keys, *([] if "profile" in keys else ["profile"])]
    by_ad, by_pair = ["advertiser_network", "ad_hash"], ["advertiser_network", "tracker_domain"]
    hosts = (
        enriched.where(third_party())
        .groupBy(*keys)
        .agg(F.collect_set(hostname("url")).alias("_hosts"))
    )
    shown = ads.where(valid_ad(min_confidence, confidence) & _named_network()).select(*by_ad, *where)
    place = F.struct(*where)
    spread = shown.groupBy(*by_ad).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    alone = F.col("_first").eqNullSafe(F.col("_last"))
    once = spread.where(alone).select(*by_ad, "_first.*")
    recurring = spread.where(~alone).select(*by_ad)
    again = shown.join(recurring, by_ad, "left_semi").distinct()
    counts = (
        once.withColumn("_once", F.col("ad_hash").isNotNull())
        .unionByName(again.withColumn("_once", F.lit(False)))
        .groupBy("advertiser_network", *where)
        .agg(count_if(F.col("_once")).alias("_ads"))
    )
    single = (
        counts.join(hosts, keys)
        .select("advertiser_network", "profile", "_ads", F.explode("_hosts").alias("tracker_domain"))
        .groupBy(*by_pair, "profile")
        .agg(F.sum("_ads").alias("_shared"))
        .groupBy(*by_pair)
        .agg(F.sum("_shared").alias("_shared"), F.count("profile").alias("n_profiles"))
    )
    several = (
        again.where(F.col("ad_hash").isNotNull())
        .join(hosts, keys)
        .select(*by_ad, F.explode("_hosts").alias("tracker_domain"))
        .distinct()
        .groupBy(*by_pair)
        .agg(F.count("*").alias("_several"))
    )
    out = (
        single.join(several, by_pair, "left")
        .select(*by_pair, (F.col("_shared") + F.coalesce("_several", F.lit(0))).alias("shared_ads"), "n_profiles")
        .where(F.col("shared_ads") >= min_shared)
        .orderBy(F.col("shared_ads").desc(), *by_pair)
    )
    return out if top_n is None else out.limit(top_n)


def visit_measures(
    visits: DataFrame, requests: DataFrame, ads: DataFrame, cookies: DataFrame
) -> DataFrame:
    """Distinct hosts, high-confidence ads and cookies per visit, zeros included.

    All branches are aggregated on the visit keys, so the joins reuse that partitioning.
    """
    keys = list(VISIT_KEYS)
    hosts = (
        requests.where(has_http_scheme("url"))
        .groupBy(*keys)
        .agg(F.count_distinct(hostname("url")).alias("n_trackers"))
    )
    shown = ads.where(F.col("confidence") == "high").groupBy(*keys).agg(F.count("*").alias("n_ads"))
    stored = cookies.groupBy(*keys).agg(F.count("*").alias("n_cookies"))
    zero = F.lit(0).cast("long")
    return (
        visits.select(*keys)
        .join(hosts, keys, "left")
        .join(shown, keys, "left")
        .join(stored, keys, "left")
        .select(*keys, *[F.coalesce(c, zero).alias(c) for c in ("n_trackers", "n_ads", "n_cookies")])
    )


# --- text ------------------------------------------------------------------------------------


def text_stats(ads: DataFrame, chars: str = "ocr_char_count") -> DataFrame:
    return (
        ads.where(F.col("confidence") == "high")
        .groupBy("profile")
        .agg(
            F.count("*").alias("n_ads_total"),
            count_if(F.col(chars) > 0).alias("n_ads_with_text"),
            round_to(F.avg(chars), 1).alias("avg_ocr_chars"),
            round_to(F.stddev_samp(chars), 1).alias("stddev_ocr_chars"),
            F.max(chars).alias("max_ocr_chars"),
        )
        .withColumn("pct_with_text", round_to(percent("n_ads_with_text", "n_ads_total"), 1))
        .orderBy("profile")
    )


def keyword_category_counts(
    ads: DataFrame,
    lexicon: Mapping[str, Sequence[str]] = KEYWORD_CATEGORIES,
    text: str = "ocr_text",
    chars: str = "ocr_char_count",
    wildcards: bool = False,
) -> DataFrame:
    """Ads whose text holds any keyword of a category; an ad may match several categories."""
    wide = (
        ads.where((F.col("confidence") == "high") & (F.col(chars) > 0))
        .groupBy("profile")
        .agg(
            F.count("*").alias("n_ads_with_text"),
            *[
                count_if(contains_any(text, words, wildcards)).alias(f"n_{name}")
                for name, words in lexicon.items()
            ],
        )
    )
    long = wide.unpivot(
        ["profile", "n_ads_with_text"], [f"n_{n}" for n in lexicon], "category", "n_matching_ads"
    )
    return long.select(
        "profile",
        F.regexp_replace("category", "^n_", "").alias("category"),
        "n_matching_ads",
        round_to(percent("n_matching_ads", "n_ads_with_text"), 2).alias("pct_of_ads"),
    )


def differential_keyword_categories(
    counts: DataFrame, profile_a: str, profile_b: str | None = None, *, study: Study
) -> DataFrame:
    b = study.resolve_baseline(profile_b)
    study.check(profile_a)
    p = F.col("profile")

    def share(name: str):
        return F.coalesce(F.max(F.when(p == name, F.col("pct_of_ads"))), F.lit(0.0))

    return (
        counts.groupBy("category")
        .agg(share(profile_a).alias("pct_a"), share(b).alias("pct_b"))
        .withColumn("pct_delta", F.col("pct_a") - F.col("pct_b"))
        .withColumn("pct_lift", smoothed_lift("pct_a", "pct_b", 0.1))
        .orderBy(F.col("pct_lift").desc(), "category")
    )


def categorize_by_keywords(
    ads: DataFrame,
    min_chars: int = 10,
    min_confidence: str = "high",
    lexicon: Mapping[str, Sequence[str]] = CATEGORY_KEYWORDS,
) -> DataFrame:
    """Each named-network ad with its first keyword category; short or unmatched text is Unknown."""
    label = F.when(F.col("ocr_char_count") < min_chars, "Unknown").otherwise(
        first_category("ocr_text", lexicon)
    )
    return ads.where((F.col("confidence") == min_confidence) & _named_network()).select(
        "profile", "advertiser_network", "page_url", "ocr_text", "ocr_char_count", label.alias("ad_category")
    )


def network_category_cells(
    categorized: DataFrame, profile: str, networks: Sequence[str], normalize: str | None = "row"
) -> DataFrame:
    """Long (network, category, value) of one profile over all listed networks and all categories
    met there: percent of the row, percent of the column, or counts; zero cells are kept."""
    if normalize is not None:
        check_choice("normalize", normalize, ("row", "col"))
    rows = categorized.where(
        (F.col("profile") == profile)
        & F.col("advertiser_network").isin(*networks)
        & (F.col("ad_category") != "Unknown")
    )
    return cross_cells(rows, networks, normalize)


def cross_cells(rows: DataFrame, networks: Sequence[str], normalize: str | None) -> DataFrame:
    counts = rows.groupBy("ad_category", "advertiser_network").agg(F.count("*").alias("n"))
    # One map per category, at most one entry per listed network, opened over the whole list.
    per_category = counts.groupBy("ad_category").agg(
        F.map_from_entries(F.collect_list(F.struct("advertiser_network", "n"))).alias("_by")
    )
    cells = per_category.select(
        "ad_category", "_by", F.explode(F.array(*[F.lit(x) for x in networks])).alias("advertiser_network")
    ).select(
        "advertiser_network",
        "ad_category",
        F.coalesce(F.col("_by")[F.col("advertiser_network")], F.lit(0).cast("long")).alias("n"),
    )
    if normalize is None:
        return cells.select("advertiser_network", "ad_category", F.col("n").cast("double").alias("value"))
    key = "advertiser_network" if normalize == "row" else "ad_category"
    return with_share(cells, [key], "n", "value").select(
        "advertiser_network", "ad_category", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def network_category_differential(
    categorized: DataFrame,
    networks: Sequence[str],
    *,
    study: Study,
    profile_a: str | None = None,
    profile_b: str | None = None,
) -> DataFrame:
    """Row-share of A minus row-share of B per (network, category), over the categories of either."""
    a, b = study.resolve_pair(profile_a, profile_b)
    left = network_category_cells(categorized, a, networks, "row")
    right = network_category_cells(categorized, b, networks, "row")
    signed = left.withColumn("_sign", F.lit(1.0)).unionByName(right.withColumn("_sign", F.lit(-1.0)))
    return signed.groupBy("advertiser_network", "ad_category").agg(
        F.sum(F.col("value") * F.col("_sign")).alias("diff_pct")
    )


# --- small reports ---------------------------------------------------------------------------


def ingestion_check(ads: DataFrame) -> DataFrame:
    """Ads, networks, mean text length and screenshots per profile."""
    return ads.groupBy("profile").agg(
        F.count("*").alias("n_ads"),
        F.count_distinct("advertiser_network").alias("n_networks"),
        F.avg("ocr_char_count").alias("avg_ocr_chars"),
        count_if(is_true("has_screenshot")).alias("n_with_screenshot"),
    )


def exploration_summary(ads: DataFrame) -> DataFrame:
    return ads.groupBy("profile").agg(
        F.count("*").alias("n_ads"),
        F.count_distinct("visit_id").alias("n_visits"),
        F.count_distinct("page_url").alias("n_pages"),
        count_if(F.col("ocr_char_count") > 0).alias("n_ads_with_text"),
    )


def confidence_network_crosstab(ads: DataFrame, levels: Sequence[str] = ("high", "medium", "low")) -> DataFrame:
    """Networks by capture confidence, zero filled."""
    return (
        ads.groupBy("advertiser_network")
        .pivot("confidence", list(levels))
        .agg(F.count(F.lit(1)))
        .na.fill(0, subset=list(levels))
    )


def verification_breakdown(ads: DataFrame) -> DataFrame:
    return ads.groupBy("verification_source").agg(
        F.count("*").alias("n_ads"), count_if(is_true("networks_agree")).alias("n_agree")
    )


def agreement_rate(ads: DataFrame) -> DataFrame:
    return ads.agg(
        F.count("*").alias("n_ads"), count_if(is_true("networks_agree")).alias("n_agree")
    ).withColumn("pct_agree", F.coalesce(percent("n_agree", "n_ads"), F.lit(0.0)))


