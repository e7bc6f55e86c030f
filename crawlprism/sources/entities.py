"""The entity tree file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crawlprism.operators.enrich import entity_index

TREE_SCHEMA = (
    "path string, subsidiary_entity string, parent_entity string, source string, priority int"
)


def read_tree(spark: SparkSession, path: str, schema: str = TREE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Leaf domains with their owners."""
    return entity_index(read_tree(spark, path))
