"""Incremental arrival: resumable labelling and enrichment of a file stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlprism.functions.suffixes import SuffixTrie, from_table
from crawlprism.functions.urls import with_registered_domain
from crawlprism.operators.enrich import EnrichmentTarget, enrich, tier_counts, with_tiers
from crawlprism.sources.tagged import path_exists


def pending(
    ads: DataFrame,
    done: DataFrame | None = None,
    assigned: DataFrame | None = None,
    key: str = "index",
    only: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Ads that still need a label: not processed, not assigned elsewhere, optionally a given list
    of ads or the first `limit` by key."""
    todo = ads
    for other in (done, assigned):
        if other is not None:
            todo = todo.join(other.select(key), key, "left_anti")
    if only is not None:
        todo = todo.where(F.col("ad_hash").isin(*only))
    if limit is not None:
        todo = todo.orderBy(key).limit(limit)
    return todo


def resume_labels(
    spark: SparkSession,
    ads: DataFrame,
    label: Callable[[DataFrame], DataFrame],
    output: str,
    assigned: DataFrame | None = None,
    key: str = "index",
) -> None:
    """Label what the output does not hold yet and append it. Safe to run again after a failure, also
    one that left a folder without a committed file: the output is read with the labels' own schema."""
    done = None
    if path_exists(spark, output):
        done = spark.read.schema(label(ads).schema).parquet(output)
    label(pending(ads, done, assigned, key)).write.mode("append").option(
        "compression", "zstd"
    ).parquet(output)


def label_stream(
    arrivals: DataFrame,
    label: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
    key: Sequence[str] = ("index",),
    assigned: DataFrame | None = None,
    *,
    time_column: str | None = None,
    forget_after: str = "30 days",
) -> StreamingQuery:
    """Label new files as they arrive, each key once; keys assigned elsewhere are left out.

    Which keys have come is keyed state, kept in the state store under the checkpoint, so the work of a
    micro-batch does not depend on what earlier ones labelled. With `time_column` the state forgets a
    key once the watermark is `forget_after` past it; a repeat that comes later than that counts as new.
    Each micro-batch goes to its own folder, written by overwrite: a batch that is replayed after a
    failure starts from the state it started from before and replaces itself.
    """
    keys = list(key)
    if time_column is None:
        fresh = arrivals.dropDuplicates(keys)
    else:
        fresh = arrivals.withWatermark(time_column, forget_after).dropDuplicatesWithinWatermark(keys)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        todo = batch if assigned is None else batch.join(assigned.select(*keys), keys, "left_anti")
        label(todo).write.mode("overwrite").option("compression", "zstd").parquet(f"{output}/batch={batch_id}")

    return (
        fresh.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _appended(rows: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .option("path", output)
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def enrich_stream(
    arrivals: DataFrame,
    index: DataFrame,
    visits: DataFrame,
    target: EnrichmentTarget,
    output: str,
    checkpoint: str,
    suffix_rules: DataFrame | SuffixTrie | None = None,
) -> StreamingQuery:
    """Stream-static join of arriving rows with the owner and visit tables, appended as Parquet. All
    visits must be known; for visits that arrive later see `enrich_late_stream`."""
    rows = enrich(
        arrivals,
        index,
        visits,
        domain_column=target.domain_column,
        context_column=target.context_column,
        suffix_rules=suffix_rules,
    )
    return _appended(rows, output, checkpoint)


def enrich_late_stream(
    arrivals: DataFrame,
    index: DataFrame,
    visits: DataFrame,
    target: EnrichmentTarget,
    output: str,
    checkpoint: str,
    *,
    row_time: str,
    visit_time: str,
    within: str = "1 hour",
    lateness: str = "10 minutes",
    visit_keys: tuple[str, ...] = ("profile", "visit_id"),
    suffix_rules: DataFrame | SuffixTrie | None = None,
) -> StreamingQuery:
    """Enrich arriving rows with visits that arrive on a stream of their own, before or after them.

    Rows that name their page go straight through. The others wait in state for a visit whose time is
    at most `within` from theirs; both streams carry a watermark of `lateness`, and a row leaves with
    unknown tier once the watermark says that no such visit can come any more. State is thus bounded
    by the rows of that span. Repeated visits count once.
    """
    if isinstance(suffix_rules, DataFrame):
        suffix_rules = from_table(suffix_rules) or suffix_rules
    if isinstance(suffix_rules, DataFrame):
        raise ValueError("these suffix rules are too large for a stream")
    base = with_registered_domain(arrivals, target.domain_column, "_domain", rules=suffix_rules)
    context = target.context_column
    if context is not None and context in arrivals.columns:
        base = with_registered_domain(base, context, "_context", rules=suffix_rules)
    else:
        base = base.withColumn("_context", F.lit(None).cast("string"))
    keys = list(visit_keys)
    named = with_registered_domain(visits, "site_url", "visit_domain", rules=suffix_rules)
    site = (
        named.select(*[F.col(k).alias(f"_v_{k}") for k in keys], F.col(visit_time).alias("_v_time"), "visit_domain")
        .withWatermark("_v_time", lateness)
        .dropDuplicatesWithinWatermark([f"_v_{k}" for k in keys])
    )
    waits = base.where(F.col("_context").isNull()).withWatermark(row_time, lateness)
    same = [F.col(k) == F.col(f"_v_{k}") for k in keys]
    span = F.expr(f"_v_time BETWEEN {row_time} - INTERVAL {within} AND {row_time} + INTERVAL {within}")
    met = waits.join(site, reduce(and_, same) & span, "left_outer").withColumn("_top", F.col("visit_domain"))
    own = base.where(F.col("_context").isNotNull()).withColumn("_top", F.col("_context"))
    columns = [*arrivals.columns, "_domain", "_top"]
    rows = with_tiers(own.select(*columns).union(met.select(*columns)), arrivals.columns, index)
    return _appended(rows, output, checkpoint)


def tier_count_stream(enriched: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Running rows per tier, kept as state (a handful of keys). Each batch writes a table of its own
    beside the last one, so a reader by `read_tier_counts` always finds a whole table; older ones are left
    to the owner of the folder."""
    return (
        tier_counts(enriched)
        .writeStream.foreachBatch(lambda counts, n: counts.coalesce(1).write.mode("overwrite").parquet(f"{output}/batch={n:012d}"))
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def read_tier_counts(spark: SparkSession, output: str) -> DataFrame:
    """The tier counts of the last batch that was written; its one file appears when it is whole."""
    every = spark.read.parquet(output)
    return every.where(F.col("batch") == every.agg(F.max("batch").alias("last")).scalar()).drop("batch")
