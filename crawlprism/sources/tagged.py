"""One table out of several crawls: common columns, tagged with the crawl's profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def columns_of(df: DataFrame) -> list[str]:
    """Column names in ordinal order."""
    return [f.name for f in df.schema.fields]


def common_columns(sources: Mapping[str, DataFrame]) -> list[str]:
    """Names present in every source, sorted."""
    return sorted(set.intersection(*[set(columns_of(df)) for df in sources.values()]))


def drift_report(spark: SparkSession, sources: Mapping[str, DataFrame]) -> DataFrame:
    """(profile, column) of every column that some other source lacks and the union drops."""
    keep = set(common_columns(sources))
    rows = [(p, c) for p, df in sources.items() for c in columns_of(df) if c not in keep]
    return spark.createDataFrame(rows, "profile string, dropped_column string")


def tagged_union(sources: Mapping[str, DataFrame], tag: str = "profile") -> DataFrame:
    """Bag union of the common columns, in sorted order, each row tagged with its source."""
    if not sources:
        raise ValueError("no sources")
    keep = [c for c in common_columns(sources) if c != tag]
    parts = [df.select(*keep).withColumn(tag, F.lit(p)) for p, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on any file system Spark is configured for."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    location = jvm.org.apache.hadoop.fs.Path(path)
    found = location.getFileSystem(conf).globStatus(location)
    return found is not None and len(found) > 0


def require_sources(spark: SparkSession, paths: Mapping[str, str]) -> Mapping[str, str]:
    """Fail before any work, naming every missing input."""
    missing = [f"{p}: {path}" for p, path in paths.items() if not path_exists(spark, path)]
    if missing:
        raise FileNotFoundError("missing sources: " + "; ".join(missing))
    return paths


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("profile",), *, rebalance: bool = True
) -> int:
    """ZSTD Parquet with bounded row groups; returns the number of rows written, from one pass.

    Rows are rebalanced to even files first: adaptive execution splits a partition value that holds
    a large part of the rows and merges small ones. Without `rebalance` every task writes the rows it
    has, which spares a shuffle of the whole table.
    """
    keys = [c for c in partition_by if c in df.columns]
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    writer = (
        (counted.hint("rebalance", *keys) if rebalance else counted)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", 64 * 1024 * 1024)
    )
    if keys:
        writer = writer.partitionBy(*keys)
    writer.parquet(path)
    return seen.get["n"]


def convert_crawls(
    spark: SparkSession,
    roots: Mapping[str, str],
    tables: Sequence[str],
    target: str,
    fmt: str = "parquet",
) -> dict[str, int]:
    """Union each table over all crawls and write it. A table that one crawl lacks is skipped.

    `roots` maps a profile to the folder holding its tables, in any format Spark reads.
    """
    require_sources(spark, roots)
    rows: dict[str, int] = {}
    for table in tables:
        paths = {p: f"{root}/{table}" for p, root in roots.items()}
        if not all(path_exists(spark, path) for path in paths.values()):
            continue
        sources = {p: spark.read.format(fmt).load(path) for p, path in paths.items()}
        rows[table] = write_table(tagged_union(sources), f"{target}/{table}")
    return rows


def seeding_requests(df: DataFrame, persona: str) -> DataFrame:
    """The three columns the pixel extraction needs from a seeding crawl, tagged with its persona."""
    return df.select(F.lit(persona).alias("persona"), "visit_id", "url", "top_level_url")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: str, booleans: Sequence[str] = ()) -> DataFrame:
    """A report CSV back as a frame; booleans saved as text are coerced."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumns({c: F.col(c).cast("string").try_cast("boolean") for c in booleans})


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of differing schemas, columns united by name."""
    return spark.read.option("mergeSchema", True).parquet(path)
