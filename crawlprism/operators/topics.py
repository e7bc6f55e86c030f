"""Embedding labels and text topics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from crawlprism.config import LABEL_SETS, NOISE_LABELS, OUTLIER_KEYWORDS, SMOOTHING_PCT, Study, check_choice
from crawlprism.functions.columns import count_if, percent, smoothed_lift
from crawlprism.functions.text import clean_text, tokens
from crawlprism.operators.common import top_per_group, with_share

SCORE_SCHEMA = (
    "top_label string, top_confidence double, second_label string, second_confidence double"
)


def label_set(name: str, sets: Mapping[str, Sequence[str]] = LABEL_SETS) -> tuple[str, ...]:
    """The label texts of a persona; an unknown name is an error, not an empty set."""
    return tuple(sets[check_choice("label set", name, tuple(sets))])


def score_labels(
    df: DataFrame,
    vector: str,
    labels: Sequence[tuple[str, Sequence[float]]] | DataFrame,
    threshold: float = 0.5,
    noise: Sequence[str] = NOISE_LABELS,
    scale: float = 100.0,
) -> DataFrame:
    """Zero-shot labels: cosine against each label vector, softmax, best and second best.

    A label matrix given in Python is a small parameter sent with the task; rows go through it in
    Arrow batches as one matrix product, without a shuffle. Labels given as a frame (label, vector)
    become one row of vectors that every task reads as a constant; any number of them counts.
    """
    if isinstance(labels, DataFrame):
        return _finished(df, vector, _scores_by_frame(df, vector, labels, scale), threshold, noise)
    if not labels:
        raise ValueError("at least one label is needed")
    names = [n for n, _ in labels]
    matrix = np.asarray([v for _, v in labels], dtype="float64")
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)

    @F.pandas_udf(SCORE_SCHEMA)
    def score(vectors: pd.Series) -> pd.DataFrame:
        rows = np.stack([np.asarray(v, dtype="float64") for v in vectors])
        rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        logits = scale * rows @ matrix.T
        weights = np.exp(logits - logits.max(axis=1, keepdims=True))
        share = weights / weights.sum(axis=1, keepdims=True)
        order = np.argsort(-share, axis=1, kind="stable")
        take = np.arange(len(rows))
        out = pd.DataFrame(
            {"top_label": [names[i] for i in order[:, 0]], "top_confidence": share[take, order[:, 0]]}
        )
        if len(names) > 1:
            out["second_label"] = [names[i] for i in order[:, 1]]
            out["second_confidence"] = share[take, order[:, 1]]
        else:
            out["second_label"], out["second_confidence"] = None, None
        return out

    scored = df.where(F.col(vector).isNotNull()).withColumn("_s", score(vector))
    return _finished(df, vector, scored, threshold, noise)


def _scores_by_frame(df: DataFrame, vector: str, labels: DataFrame, scale: float) -> DataFrame:
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)

    own = F.col("vector").cast("array<double>")
    unit = F.transform(own, lambda x: x / F.sqrt(dot(own, own)))
    packed = labels.select("label", own.alias("vector")).select("label", unit.alias("v")).agg(
        F.array_sort(F.collect_list(F.struct("label", "v"))).alias("_labels")
    )
    work = df.where(F.col(vector).isNotNull()).withColumn("_x", F.col(vector).cast("array<double>"))
    work = work.withColumn("_norm", F.sqrt(dot(F.col("_x"), F.col("_x")))).withColumn("_labels", packed.scalar())
    logits = F.transform(
        "_labels",
        lambda e: F.struct((-F.lit(scale) * dot(F.col("_x"), e["v"]) / F.col("_norm")).alias("minus"), e["label"].alias("label")),
    )
    work = work.withColumn("_all", F.array_sort(logits)).withColumn("_top", F.try_element_at("_all", F.lit(1))["minus"])
    weights = F.transform("_all", lambda e: F.exp(F.col("_top") - e["minus"]))
    work = work.withColumn("_total", F.aggregate(weights, F.lit(0.0), lambda x, y: x + y))
    picked = []
    for i, name in ((1, "top"), (2, "second")):
        e = F.try_element_at("_all", F.lit(i))
        picked += [
            e["label"].alias(f"{name}_label"),
            (F.exp(F.col("_top") - e["minus"]) / F.col("_total")).alias(f"{name}_confidence"),
        ]
    return work.withColumn("_s", F.struct(*picked)).drop("_x", "_norm", "_labels", "_all", "_top", "_total")


def _finished(df: DataFrame, vector: str, scored: DataFrame, threshold: float, noise: Sequence[str]) -> DataFrame:
    return scored.select(
        *[c for c in df.columns if c != vector],
        "_s.*",
        F.col("_s.top_label").isin(*noise).alias("is_noise"),
        (F.col("_s.top_confidence") < threshold).alias("is_low_confidence"),
    )


def label_vectors(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label, added up on the map side."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.where(F.col(vector).isNotNull()).groupBy(label).agg(vector_to_array(mean).alias("vector"))


def label_pipeline(
    ads: DataFrame,
    images: DataFrame,
    scores: DataFrame,
    *,
    path: str = "png_path",
    keys: Sequence[str] = ("profile", "visit_id", "ad_hash"),
) -> DataFrame:
    """Label status of every ad: image_not_found, unreadable (an image without scores) or ok."""
    listed = images.select(F.col("path").alias(path), F.lit(True).alias("_found"))
    narrow = scores.select(path, *[c for c in SCORED])
    joined = ads.select(*keys, path).join(listed, path, "left").join(narrow, path, "left")
    found = F.col("_found").isNotNull()
    ok = found & F.col("top_label").isNotNull()
    return joined.select(
        *keys,
        F.when(ok, F.col("top_label")).alias("clip_top_label"),
        F.when(ok, F.col("top_confidence")).when(found, 0.0).alias("clip_top_confidence"),
        F.when(ok, F.col("second_label")).alias("clip_second_label"),
        F.when(ok, F.col("second_confidence")).alias("clip_second_confidence"),
        F.when(ok, F.col("is_noise")).when(found, True).alias("clip_is_noise"),
        F.when(ok, F.col("is_low_confidence")).when(found, True).alias("clip_is_low_confidence"),
        F.when(ok, "ok").when(found, "unreadable").otherwise("image_not_found").alias("clip_status"),
    )


SCORED = (
    "top_label", "top_confidence", "second_label", "second_confidence", "is_noise",
    "is_low_confidence",
)


def usable_labels(labels: DataFrame) -> DataFrame:
    """Classifications that are neither noise nor low confidence; missing flags do not pass."""
    yes = F.lit(True)
    return labels.where(
        ~F.coalesce("clip_is_noise", yes) & ~F.coalesce("clip_is_low_confidence", yes)
    )


def label_summary(labels: DataFrame) -> DataFrame:
    """Noise, low-confidence and usable counts."""
    no, yes = F.lit(False), F.lit(True)
    usable = ~F.coalesce("clip_is_noise", yes) & ~F.coalesce("clip_is_low_confidence", yes)
    return (
        labels.agg(
            F.count("*").alias("n_total"),
            count_if(F.coalesce("clip_is_noise", no)).alias("n_noise"),
            count_if(F.coalesce("clip_is_low_confidence", no)).alias("n_low_confidence"),
            count_if(usable).alias("n_usable"),
        )
        .withColumn("pct_noise", percent("n_noise", "n_total"))
        .withColumn("pct_low_confidence", percent("n_low_confidence", "n_total"))
    )


def top_labels(labels: DataFrame, n: int = 5) -> DataFrame:
    counts = usable_labels(labels).groupBy("profile", "clip_top_label").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["profile"], [F.col("n").desc(), F.col("clip_top_label")], n)


def with_labels(ads: DataFrame, labels: DataFrame, how: str = "left") -> DataFrame:
    """Labels back to ads on the full ad key."""
    return ads.join(labels, ["profile", "visit_id", "ad_hash"], how)


# --- topics ----------------------------------------------------------------------------------


def ad_corpus(
    ads: DataFrame, min_chars: int = 20, min_confidence: str | None = "high"
) -> DataFrame:
    """Ads with enough cleaned text to be about something."""
    rows = ads.where(F.col("ocr_char_count") > 0)
    if min_confidence:
        rows = rows.where(F.col("confidence") == min_confidence)
    return (
        rows.select(
            "profile", "ad_hash", "page_url", "advertiser_network", F.col("ocr_text").alias("ocr_text_raw")
        )
        .withColumn("ocr_text", clean_text("ocr_text_raw"))
        .withColumn("n_chars_clean", F.length("ocr_text"))
        .where(F.col("n_chars_clean") >= min_chars)
    )


def fit_topics(
    df: DataFrame,
    vector: str,
    k: int = 10,
    min_topic_size: int = 10,
    seed: int = 42,
    save_path: str | None = None,
) -> DataFrame:
    """Cluster vectors and add a topic number, largest topic first; clusters smaller than
    `min_topic_size` become the outlier topic -1."""
    work = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    fitted = work.select("features").persist()  # every iteration reads it
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_cluster").fit(fitted)
    fitted.unpersist()
    if save_path:
        model.write().overwrite().save(save_path)
    assigned = model.transform(work).drop("features")
    # At most k rows.
    sizes = assigned.groupBy("_cluster").agg(F.count("*").alias("_n"))
    ranked = sizes.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "_cluster"))).alias("o")
    )
    numbered = ranked.select(F.posexplode("o").alias("_pos", "e")).select(
        F.col("e._cluster").alias("_cluster"),
        F.when(-F.col("e.n") >= min_topic_size, F.col("_pos")).otherwise(-1).alias("topic"),
    )
    return assigned.join(numbered, "_cluster").drop("_cluster")


def topic_keywords(
    corpus: DataFrame, text: str = "ocr_text", topic: str = "topic", top_words: int = 8
) -> DataFrame:
    """Size and top words per topic by class-based TF-IDF: tf * ln(1 + A / f), with A the mean
    number of words per topic (whole part) and f the term's count over all topics."""
    words = (
        corpus.select(topic, F.explode(tokens(text)).alias("term"))
        .groupBy(topic, "term")
        .agg(F.count("*").alias("tf"))
    )
    terms = words.groupBy("term").agg(F.sum("tf").alias("f"))
    per_topic = words.groupBy(topic).agg(F.sum("tf").alias("_words"))
    mean = per_topic.agg(F.floor(F.avg("_words")).cast("double").alias("A"))
    scored = (
        words.join(terms, "term")
        .join(per_topic, topic)
        .withColumn(
            "score",
            F.col("tf") / F.col("_words") * F.log1p(mean.scalar() / F.col("f")),
        )
    )
    best = top_per_group(
        scored.select(topic, "term", "tf", "f", "score"),
        [topic],
        [F.round("score", 12).desc(), F.col("term")],
        top_words,
    )
    listed = best.groupBy(topic).agg(
        F.sort_array(
            F.collect_list(F.struct((-F.round("score", 12)).alias("s"), "term"))
        ).alias("w")
    )
    sizes = corpus.groupBy(topic).agg(F.count("*").alias("size"))
    keywords = F.array_join(F.transform("w", lambda e: e["term"]), ", ")
    return (
        sizes.join(listed, topic, "left")
        .select(
            F.col(topic).alias("topic_id"),
            "size",
            F.when(F.col(topic) == -1, OUTLIER_KEYWORDS)
            .otherwise(F.coalesce(keywords, F.lit("")))
            .alias("keywords"),
        )
        .orderBy(F.col("size").desc(), "topic_id")
    )


def topic_distribution(corpus: DataFrame, keywords: DataFrame, topic: str = "topic") -> DataFrame:
    """Ads and percent of the profile per topic, with the topic's keywords."""
    counts = corpus.groupBy("profile", topic).agg(F.count("*").alias("n_ads"))
    shares = with_share(counts, ["profile"], "n_ads", "pct_of_profile", 2)
    return (
        shares.join(keywords.select(F.col("topic_id").alias(topic), "keywords"), topic, "left")
        .select("profile", topic, "keywords", "n_ads", "pct_of_profile")
        .orderBy("profile", F.col("pct_of_profile").desc(), topic)
    )


def differential_topics(
    distribution: DataFrame, profile_a: str, profile_b: str | None = None, *, study: Study
) -> DataFrame:
    b = study.resolve_baseline(profile_b)
    study.check(profile_a)
    p = F.col("profile")

    def share(name: str):
        return F.coalesce(F.max(F.when(p == name, F.col("pct_of_profile"))), F.lit(0.0))

    return (
        distribution.groupBy(F.col("topic").alias("topic_id"))
        .agg(
            F.min("keywords").alias("keywords"), share(profile_a).alias("pct_a"), share(b).alias("pct_b")
        )
        .withColumn("delta", F.col("pct_a") - F.col("pct_b"))
        .withColumn("lift", smoothed_lift("pct_a", "pct_b", SMOOTHING_PCT))
        .orderBy(F.col("lift").desc(), "topic_id")
    )


def save_corpus(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_corpus(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


