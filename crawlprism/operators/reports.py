"""The data behind each figure. Drawing is left to the caller; these frames are small."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crawlprism.config import Study
from crawlprism.functions.columns import (
    condition_label,
    percent,
    ratio,
    sig_marker,
)
from crawlprism.operators.common import pivot_profiles, profile_spine, with_share
from crawlprism.operators.ranks import exact_percentiles


def heatmap(long: DataFrame, key: str, value: str, *, study: Study, top_n: int = 25) -> DataFrame:
    """Key x profile grid, zero filled, the top-n keys by summed value first."""
    wide = pivot_profiles(long.where(F.col("profile").isin(*study.profiles)), key, value, study)
    total = sum((F.col(f"`{p}`") for p in study.profiles[1:]), F.col(f"`{study.profiles[0]}`"))
    return wide.withColumn("_t", total).orderBy(F.col("_t").desc(), key).limit(top_n).drop("_t")


def by_peak(long: DataFrame, key: str, value: str, *, study: Study) -> DataFrame:
    """Key x profile grid ordered by the largest cell of each row."""
    wide = pivot_profiles(long, key, value, study)
    peak = F.greatest(*[F.col(f"`{p}`") for p in study.profiles])
    return wide.withColumn("peak", peak).orderBy(F.col("peak").desc(), key)


def shared_histogram(
    df: DataFrame, value: str, by: str = "profile", edges: int = 50, quantile: float = 0.99
) -> DataFrame:
    """Counts per group over bins shared by all groups: `edges` equal edges from 0 to the quantile.

    Values above the last edge and values that are not numbers are left out; the last bin includes
    its upper edge.
    """
    bins = edges - 1
    numeric = df.select(by, F.col(value).try_cast("double").alias("v")).where(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    top = exact_percentiles(numeric, "v", {"top": quantile})
    return (
        numeric.withColumn("_top", top.scalar())
        .where((F.col("v") >= 0) & (F.col("v") <= F.col("_top")))
        .withColumn(
            "bin",
            F.least(
                F.width_bucket("v", F.lit(0.0), F.col("_top"), F.lit(bins)), F.lit(bins)
            ).cast("long"),
        )
        .groupBy(by, "bin", "_top")
        .agg(F.count("*").alias("n"))
        .select(
            by,
            "bin",
            ((F.col("bin") - 1) * F.col("_top") / bins).alias("bin_from"),
            (F.col("bin") * F.col("_top") / bins).alias("bin_to"),
            "n",
        )
    )


def bucket_shares(
    long: DataFrame, bucket: str, measure: str, normalize: bool = True
) -> DataFrame:
    """Percent of the profile per bucket, or the counts."""
    if not normalize:
        return long.select("profile", bucket, F.col(measure).cast("double").alias("value"))
    return with_share(long, ["profile"], measure, "value").select("profile", bucket, "value")


def topic_grid(
    distribution: DataFrame, *, study: Study, top_n: int = 20, outlier: int = -1
) -> DataFrame:
    """Topic x profile grid without outliers, labelled `#id: keywords`."""
    rows = distribution.where(F.col("topic") != outlier)
    labels = rows.groupBy("topic").agg(F.min("keywords").alias("keywords"))
    text = F.concat(
        F.lit("#"),
        F.col("topic").cast("string"),
        F.lit(": "),
        F.substring(F.coalesce("keywords", F.lit("")), 1, 50),
    )
    return (
        heatmap(rows, "topic", "pct_of_profile", study=study, top_n=top_n)
        .join(labels, "topic", "left")
        .withColumn("label", text)
        .drop("keywords")
    )


def category_by_pixel_grid(distribution: DataFrame, top_n: int = 12) -> DataFrame:
    """Within-group shares of the top-n categories, labelled by pixel presence."""
    top = (
        distribution.groupBy("category")
        .agg(F.sum("n_ads").alias("_t"))
        .orderBy(F.col("_t").desc(), "category")
        .limit(top_n)
    )
    return distribution.join(top, "category", "left_semi").withColumn(
        "pixel_label", F.when(F.col("site_has_pixel"), "Pixel present").otherwise("Pixel absent")
    )


def platform_column_shares(by_platform: DataFrame) -> DataFrame:
    """Percent of each platform's ads per category; an empty platform column counts as 1."""
    totals = by_platform.groupBy("profile", "platform").agg(
        F.sum("n_ads_with_platform").alias("_t")
    )
    total = F.when(F.col("_t") == 0, 1).otherwise(F.col("_t"))
    return by_platform.join(totals, ["profile", "platform"]).select(
        "profile",
        "platform",
        "category",
        percent("n_ads_with_platform", total).alias("pct_of_platform"),
    )


def category_shares(categorized: DataFrame, by: Sequence[str] = ("profile",)) -> DataFrame:
    """Percent of a row's categorised ads per category; Unknown is left out."""
    counts = (
        categorized.where(F.col("ad_category") != "Unknown")
        .groupBy(*by, "ad_category")
        .agg(F.count("*").alias("n"))
    )
    return with_share(counts, list(by), "n", "pct")


def network_specialization(
    categorized: DataFrame, networks: Sequence[str], *, study: Study, profile: str | None = None
) -> DataFrame:
    profile = study.resolve_baseline(profile)
    rows = categorized.where(
        (F.col("profile") == profile) & F.col("advertiser_network").isin(*networks)
    )
    return category_shares(rows, ("advertiser_network",))


def size_shares(sizes: DataFrame, name: str = "iab_size") -> DataFrame:
    return with_share(sizes, ["profile"], "n_ads", "pct").select("profile", name, "pct")


def mean_tracker_load(tracking: DataFrame, top_n: int = 10) -> DataFrame:
    """Mean over profiles of a category's tracker load, the heaviest first."""
    return (
        tracking.groupBy("category")
        .agg(F.avg("avg_trackers_on_page").alias("avg_trackers"))
        .orderBy(F.col("avg_trackers").desc_nulls_last(), "category")
        .limit(top_n)
    )


def intensity_series(response: DataFrame) -> DataFrame:
    """Dose-response points in bucket order, with the profile's number of ads."""
    totals = response.groupBy("profile").agg(F.sum("n_ads").alias("n_profile"))
    return response.join(totals, "profile").select(
        "profile", "bucket_order", "intensity_bucket", "pct_on_target", "n_profile"
    )


def profile_bars(df: DataFrame, measures: Sequence[str], *, study: Study) -> DataFrame:
    """The given measures for every configured profile, in canonical order (null where absent)."""
    return profile_spine(df, study).join(df.select("profile", *measures), "profile", "left").orderBy("ord")


def presence_grid(
    presence: DataFrame, metric: str = "n_cookie_events", *, study: Study, key: str = "retargeter"
) -> DataFrame:
    """Network x profile grid of a metric, smallest total first."""
    wide = pivot_profiles(presence, key, metric, study, fill=0)
    total = sum((F.col(f"`{p}`") for p in study.profiles[1:]), F.col(f"`{study.profiles[0]}`"))
    return wide.withColumn("total", total).orderBy("total", key)


def annotated_grid(matrix: DataFrame, pvalues: DataFrame, *, study: Study, key: str = "category") -> DataFrame:
    """Cells of a share grid as text with the marker of significant differences."""
    cells = matrix.unpivot([key], list(study.profiles), "profile", "value")
    mark = F.when(F.col("sig").isNull() | (F.col("sig") == "ns"), "").otherwise(F.col("sig"))
    # format_number rounds the binary value, half to even, as printf does.
    text = F.replace(F.format_number("value", 1), F.lit(","), F.lit(""))
    return (
        cells.join(pvalues.select("profile", key, "sig"), ["profile", key], "left")
        .select(key, "profile", F.concat(text, mark).alias("cell"))
    )


def annotated_delta(delta: DataFrame, pvalues: DataFrame, persona: str, key: str = "category") -> DataFrame:
    """A delta table with the persona's markers, smallest first."""
    marks = pvalues.where(F.col("profile") == persona).select(key, "sig")
    mark = F.when(F.col("sig").isNull() | (F.col("sig") == "ns"), "").otherwise(F.col("sig"))
    return (
        delta.join(marks, key, "left")
        .select(key, "delta_pct", mark.alias("marker"))
        .orderBy("delta_pct", key)
    )


def symmetric_bound(df: DataFrame, value: str) -> DataFrame:
    """The largest absolute cell: the colour scale's bound."""
    return df.agg(F.max(F.abs(value)).alias("bound"))


def platform_status(by_platform: DataFrame) -> DataFrame:
    return by_platform.withColumn(
        "status", F.when(F.col("present"), "Platform present").otherwise("Platform absent")
    )


def seeded_conditions(impact: DataFrame) -> DataFrame:
    return impact.withColumn(
        "condition", condition_label("site_was_seeded_with_pixel", "site_has_pixel")
    )


def label_mix(labels: DataFrame) -> DataFrame:
    """Percent of each label in a profile's usable classifications."""
    counts = labels.groupBy("profile", "clip_top_label").agg(F.count("*").alias("n"))
    return with_share(counts, ["profile"], "n", "pct")


def total_variation(mix: DataFrame, *, study: Study) -> DataFrame:
    """Half the summed absolute difference of two profiles' label shares, for every pair.

    Shares become one column per profile on each label row, so no pairs of rows are formed.
    """
    wide = pivot_profiles(mix, "clip_top_label", "pct", study)
    names = study.profiles
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = wide.agg(
        *[
            (F.sum(F.abs(F.col(f"`{a}`") - F.col(f"`{b}`"))) / 2).alias(f"_{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    entries = [
        F.struct(
            F.lit(a).alias("profile_a"), F.lit(b).alias("profile_b"), F.col(f"_{i}").alias("tvd")
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return sums.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def marked(pvalues: DataFrame, p: str = "p_adj") -> DataFrame:
    return pvalues.withColumn("sig", sig_marker(p))


def rate(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, ratio(a, b))
