"""Views over a study's tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlprism.config import CRAWL_TABLES, ENRICHED_TABLES, Study
from crawlprism.sources.tagged import path_exists

DESCRIPTION_COLUMNS = (
    "is_valid_ad", "category", "product", "brand", "description",
    ("content", "vlm_text"), ("confidence", "vlm_confidence"),
    "status", "reason", "viewed", "modified", "same_company",
    "old_category", "old_description", "notes",
)


def ads_enriched(ads: DataFrame, descriptions: DataFrame, keys: Sequence[str] = ("visit_id", "ad_hash")) -> DataFrame:
    """Every ad with its description record; the record's own content and confidence are renamed."""
    picked = []
    for c in DESCRIPTION_COLUMNS:
        source, name = c if isinstance(c, tuple) else (c, c)
        picked.append(F.col(source).alias(name))
    return ads.join(descriptions.select(*keys, *picked), list(keys), "left").select(
        *ads.columns, *[c[1] if isinstance(c, tuple) else c for c in DESCRIPTION_COLUMNS]
    )


def register_views(
    spark: SparkSession,
    root: str,
    tables: Sequence[str] = (*CRAWL_TABLES, *ENRICHED_TABLES, "ads", "ads_desc", "ads_clip"),
) -> list[str]:
    """Views over the tables found below `root`, enriched ones included; absent tables are skipped.
    Registers `ads_enriched` when both of its inputs are there. Returns the names registered."""
    done = []
    for table in tables:
        path = f"{root}/{table}"
        if path_exists(spark, path):
            spark.read.parquet(path).createOrReplaceTempView(table)
            done.append(table)
    if "ads" in done and "ads_desc" in done:
        ads_enriched(spark.table("ads"), spark.table("ads_desc")).createOrReplaceTempView("ads_enriched")
        done.append("ads_enriched")
    return done


def missing_views(spark: SparkSession, expected: Sequence[str] = (*CRAWL_TABLES, *ENRICHED_TABLES)) -> list[str]:
    return [t for t in expected if not spark.catalog.tableExists(t)]


def row_counts(tables: Mapping[str, DataFrame | None], *, study: Study, spark: SparkSession) -> DataFrame:
    """(table, profile, n_rows) for every table and configured profile; 0 where there are none."""
    counts = [
        df.groupBy("profile").agg(F.count("*").alias("n_rows")).withColumn("table", F.lit(t))
        for t, df in tables.items()
        if df is not None
    ]
    names = spark.createDataFrame([(t,) for t in tables], "table string")
    some = counts[0] if counts else spark.createDataFrame([], "profile string, n_rows long, table string")
    found = reduce(DataFrame.unionByName, counts[1:], some)
    # Table and profile names are configuration: both lists are hung on the row as literals.
    spine = names.select(
        "table", F.explode(F.array(*[F.lit(p) for p in study.profiles])).alias("profile")
    )
    return spine.join(found, ["table", "profile"], "left").select(
        "table", "profile", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows")
    )


