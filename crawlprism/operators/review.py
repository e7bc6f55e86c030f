"""Human review of label records: edits, progress, merging of reviewers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from crawlprism.functions.columns import count_if, text_or, to_bool

FLAG_DEFAULTS = {"viewed": False, "modified": False, "same_company": False}
TEXT_DEFAULTS = {"old_category": "", "old_description": "", "notes": ""}


def with_review_columns(df: DataFrame) -> DataFrame:
    """Add the review columns that are missing, with their defaults."""
    missing = {
        k: F.lit(v)
        for k, v in {**FLAG_DEFAULTS, **TEXT_DEFAULTS}.items()
        if k not in df.columns
    }
    return df.withColumns(missing) if missing else df


def coerce_review_columns(df: DataFrame) -> DataFrame:
    """Flags that were saved as text become booleans; null texts become ''."""
    return df.withColumns(
        {
            **{c: to_bool(c) for c in ("viewed", "modified") if c in df.columns},
            **{c: text_or(c) for c in TEXT_DEFAULTS if c in df.columns},
        }
    )


def apply_edits(desc: DataFrame, edits: DataFrame, key: str = "index", seq: str = "seq") -> DataFrame:
    """Apply a log of edits (key, seq, category, description, same_company, notes, mark_modified).

    The last edit of a row gives its values. Saving a row that is not modified yet records the
    values ahead of that save, so the old values are those ahead of the first marking edit (of the
    last edit, if none marks). The log is reduced to one row per key before it meets the table.
    """
    marking = F.col("mark_modified")
    recorded = edits.groupBy(key).agg(
        F.coalesce(F.min(F.when(marking, F.col(seq))), F.max(seq)).alias("_recorded")
    )
    values = F.struct("category", "description")
    log = (
        edits.join(recorded, key)
        .groupBy(key)
        .agg(
            F.max_by(F.struct("category", "description", "same_company", "notes"), seq).alias("_last"),
            F.max_by(values, F.when(F.col(seq) < F.col("_recorded"), F.col(seq))).alias("_prior"),
            F.max(marking).alias("_marked"),
        )
    )
    joined = desc.join(log, key, "left")
    edited = F.col("_last").isNotNull()
    was_modified = F.coalesce("modified", F.lit(False))
    fresh = edited & ~was_modified
    ahead = F.coalesce(F.col("_prior"), values)
    new = {
        c: F.when(edited, F.col(f"_last.{c}")).otherwise(F.col(c))
        for c in ("category", "description", "same_company", "notes")
    }
    new["modified"] = was_modified | F.coalesce("_marked", F.lit(False))
    new["old_category"] = F.when(fresh, ahead["category"]).otherwise(F.col("old_category"))
    new["old_description"] = F.when(fresh, ahead["description"]).otherwise(F.col("old_description"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in desc.columns])


def mark_viewed(desc: DataFrame, viewed: DataFrame, key: str = "index") -> DataFrame:
    """Set viewed on the listed keys."""
    seen = viewed.select(key).distinct().withColumn("_seen", F.lit(True))
    joined = desc.join(seen, key, "left")
    flag = F.coalesce("viewed", F.lit(False)) | F.coalesce("_seen", F.lit(False))
    return joined.select(*[flag.alias(c) if c == "viewed" else F.col(c) for c in desc.columns])


def next_unviewed(desc: DataFrame, current: int, key: str = "index") -> DataFrame:
    """The next unviewed key after `current`, else the first one before it, else null."""
    open_ = ~F.coalesce("viewed", F.lit(False))
    return desc.agg(
        F.coalesce(
            F.min(F.when(open_ & (F.col(key) > current), F.col(key))),
            F.min(F.when(open_ & (F.col(key) < current), F.col(key))),
        ).alias("next_index")
    )


def merge_reviews(sources: Sequence[DataFrame], key: str = "index") -> DataFrame:
    """Viewed rows of all reviewers, one per key: a modified row wins, then the earlier reviewer.

    One aggregation with map-side combine picks the row; a key repeated very often stays cheap.
    """
    tagged = []
    for i, df in enumerate(sources):
        rows = df.withColumn("viewed", to_bool("viewed")).where("viewed")
        if "modified" in rows.columns:
            rows = rows.withColumn("modified", to_bool("modified"))
        else:
            rows = rows.withColumn("modified", F.lit(False))
        tagged.append(rows.withColumn("_source", F.lit(i)))
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    rest = [c for c in union.columns if c not in (key, "_source")]
    order = F.struct((~F.col("modified")).alias("m"), F.col("_source").alias("s"))
    return (
        union.groupBy(key)
        .agg(
            F.min(F.struct(order.alias("o"), F.struct(*rest).alias("r"))).alias("_w"),
            F.count("*").alias("_n"),
        )
        .select(key, "_w.r.*", (F.col("_n") - 1).alias("n_overlaps"))
    )


def review_summary(desc: DataFrame) -> DataFrame:
    """Rows, viewed, modified and the percent modified."""
    return desc.agg(
        F.count("*").alias("n_rows"),
        count_if(F.coalesce("viewed", F.lit(False))).alias("n_viewed"),
        count_if(F.coalesce("modified", F.lit(False))).alias("n_modified"),
    ).withColumn(
        "pct_modified", F.try_divide(F.col("n_modified") * 100.0, F.col("n_rows").cast("double"))
    )


def review_categories(desc: DataFrame) -> DataFrame:
    return desc.groupBy("category").agg(F.count("*").alias("n_rows"))
