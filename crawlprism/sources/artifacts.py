"""Captured ad records: JSON files to one flat table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crawlprism.functions.columns import is_true
from crawlprism.functions.labels import json_shape, kind_of, with_network

SCHEMA_VERSION = "3.1"
RECT_FIELDS = {"ad_width": "$.w", "ad_height": "$.h", "ad_x": "$.x", "ad_y": "$.y"}


def scan_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """All `<profile>/ads/**/*.json` below `root` as (profile, path, value)."""
    path = F.col("_metadata.file_path")
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("wholetext", True)
        .text(root)
        .select(
            F.regexp_extract(path, r"([^/]+)/ads/", 1).alias("profile"),
            path.alias("path"),
            "value",
        )
        .where(F.col("profile") != "")
    )


def without_sidecars(files: DataFrame, path: str = "path") -> DataFrame:
    """Drop files whose name starts with an underscore (Spark's own file listing hides them too)."""
    return files.where(~F.element_at(F.split(path, "/"), -1).startswith("_"))


def _truthy(text: Column, value: Column) -> Column:
    """A JSON value that is neither absent, null, false, zero nor empty, by its text. The value itself
    is looked at for the few texts only that a string may have as well."""
    # Only these texts can be falsy, and the non-empty ones only when they are not strings.
    plain = ~text.isin("", "0", "0.0", "false", "{}", "[]")
    return text.isNotNull() & (plain | ((text != "") & (kind_of(value) == "STRING")))


def _get(record: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(record, path, kind)


def records(files: DataFrame) -> DataFrame:
    """One row per file with its parsed records.

    A string that holds JSON is decoded once more. An object is one record, an array gives its
    object elements, anything else none; `malformed` marks files that are not JSON at all.
    """
    staged = (
        files.withColumn("_outer", F.try_parse_json("value"))
        .withColumn(
            "_text",
            F.when(json_shape("value") == "STRING", _get(F.col("_outer"), "$", "string")).otherwise(F.col("value")),
        )
        .withColumn(
            "_v",
            F.when(json_shape("value") == "STRING", F.try_parse_json("_text")).otherwise(F.col("_outer")),
        )
    )
    kind = json_shape("_text")
    elements = F.filter(
        _get(F.col("_v"), "$", "array<variant>"), lambda e: kind_of(e) == "OBJECT"
    )
    none = F.array().cast("array<variant>")
    known = F.col("_v").isNotNull()
    return staged.select(
        *files.columns,
        (~known).alias("malformed"),
        F.when(known & (kind == "OBJECT"), F.array(F.col("_v")))
        .when(known & (kind == "ARRAY"), F.coalesce(elements, none))
        .otherwise(none)
        .alias("records"),
    )


def ingestion_counts(parsed: DataFrame) -> DataFrame:
    """Files, malformed files, and files without a usable record, per profile."""
    return parsed.groupBy("profile").agg(
        F.count("*").alias("n_files"),
        F.count(F.when(F.col("malformed"), 1)).alias("n_malformed"),
        F.count(F.when(F.size("records") == 0, 1)).alias("n_without_records"),
        F.sum(F.size("records")).cast("long").alias("n_records"),
    )


def flat_ads(
    files: DataFrame, text: DataFrame | None = None, images: DataFrame | None = None
) -> DataFrame:
    """The flat ad table: one row per ad record of every file that is no sidecar.

    `text` (path, ocr_text) gives text already extracted from screenshots, `images` (path) lists the
    screenshots that exist; both are keyed by the JSON path without its extension.
    """
    rec, read = F.col("rec"), F.col("_read")
    inner = ("src", "tag", "id", "network", "confidence", "matched_selector", "outerHTML", "outer_html")
    outer = ("src", "ad_id", "id", "network", "outerHTML", "outer_html")
    # Every candidate is read in one pass over the record, as text; a field of another type, and all of
    # a record's metadata that is no object, comes out as null.
    meta_type = "struct<" + ",".join(f"{k}:string" for k in inner) + ",rect:variant>"
    plain_fields = "visit_id:bigint,page_url:string,timestamp:double,record_type:string,"
    rec_type = f"struct<{plain_fields}" + ",".join(f"{k}:string" for k in outer) + f",rect:variant,ad_metadata:{meta_type}>"
    # Opened with the empty lists and then cut: else Spark pushes a test of the lists below their parsing
    # and parses twice.
    opened = (
        records(without_sidecars(files))
        .withColumn("_count", F.size("records"))
        .select("profile", "path", "_count", F.posexplode_outer("records").alias("pos", "rec"))
        .where(rec.isNotNull())
        .withColumn("_read", _get(rec, "$", rec_type))
        .where(F.coalesce(read["record_type"], F.lit("ad")) == "ad")
    )
    looked_up = opened.select(
        "profile",
        "path",
        "pos",
        "_count",
        rec,
        F.coalesce(read["visit_id"], F.lit(-1).cast("long")).alias("visit_id"),
        F.coalesce(read["page_url"], F.lit("")).alias("page_url"),
        F.coalesce(read["timestamp"], F.lit(0.0)).alias("timestamp"),
        *[read["ad_metadata"][k].alias(f"m_{k}") for k in (*inner, "rect")],
        *[read[k].alias(f"r_{k}") for k in (*outer, "rect")],
    )
    # A value counts in a fallback chain only when it is truthy; the others become null here.
    plain = ("m_tag", "m_confidence", "m_matched_selector")
    source = {f"m_{k}": f"$.ad_metadata.{k}" for k in inner} | {f"r_{k}": f"$.{k}" for k in outer}
    chosen = looked_up.withColumns(
        {c: F.when(_truthy(F.col(c), _get(rec, path)), F.col(c)) for c, path in source.items() if c not in plain}
    )
    truthy_rect = [F.when(_truthy(F.col(c).cast("string"), F.col(c)), F.col(c)) for c in ("m_rect", "r_rect")]
    rect_type = "struct<" + ",".join(f"{path[2:]}:double" for path in RECT_FIELDS.values()) + ">"
    # Of a rectangle that is no object nothing is read.
    measured = chosen.withColumn("rect", _get(F.coalesce(*truthy_rect), "$", rect_type)).withColumns(
        {name: F.coalesce(F.col("rect")[path[2:]], F.lit(0.0)) for name, path in RECT_FIELDS.items()}
    )

    def first(*choices: str) -> Column:
        return F.coalesce(*[F.col(c) for c in choices])

    base = measured.select(
        "profile",
        "path",
        "pos",
        "visit_id",
        "page_url",
        "_count",
        "timestamp",
        *RECT_FIELDS,
        _stem(F.col("path")).alias("_stem"),
        first("m_src", "r_src").alias("ad_src"),
        first("m_outerHTML", "m_outer_html", "r_outerHTML", "r_outer_html").alias("outer_html"),
        first("m_tag").alias("ad_tag"),
        first("m_id", "r_ad_id", "r_id").alias("ad_id"),
        F.coalesce(first("m_network", "r_network"), F.lit("unknown")).alias("capture_network"),
        F.coalesce(first("m_confidence"), F.lit("unknown")).alias("confidence"),
        F.coalesce(first("m_matched_selector"), F.lit("")).alias("matched_selector"),
    )
    base = with_network(base, "ad_src", "outer_html", "capture_network", "_net")
    base = base.withColumn("_key", F.regexp_replace("path", r"\.json$", ""))
    if text is not None:
        base = base.join(text.select(F.col("path").alias("_key"), "ocr_text"), "_key", "left")
    else:
        base = base.withColumn("ocr_text", F.lit(None).cast("string"))
    if images is not None:
        listed = images.select(
            F.regexp_replace("path", r"\.png$", "").alias("_key"), F.col("path").alias("_png")
        )
        base = base.join(listed, "_key", "left")
    else:
        base = base.withColumn("_png", F.lit(None).cast("string"))
    return base.select(
        F.xxhash64("path", "pos").alias("index"),
        "profile",
        "visit_id",
        "page_url",
        F.when(F.col("_count") > 1, F.concat_ws("_", "_stem", F.col("pos").cast("string")))
        .otherwise(F.col("_stem"))
        .alias("ad_hash"),
        "ad_src",
        "ad_tag",
        "ad_id",
        "ad_width",
        "ad_height",
        "ad_x",
        "ad_y",
        F.col("_net.network").alias("advertiser_network"),
        "capture_network",
        F.col("_net.source").alias("verification_source"),
        F.col("_net.agrees").alias("networks_agree"),
        "confidence",
        "matched_selector",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.coalesce("ocr_text", F.lit("")).alias("ocr_text"),
        F.length(F.coalesce("ocr_text", F.lit(""))).cast("long").alias("ocr_char_count"),
        F.col("_png").isNotNull().alias("has_screenshot"),
        "timestamp",
        F.coalesce("_png", F.lit("")).alias("png_path"),
        "outer_html",
    )


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.json$", "")


def disagreements(ads: DataFrame) -> DataFrame:
    """The audit trail: ads whose captured label and matched network belong to different families."""
    return ads.where(~is_true("networks_agree")).select(
        "profile",
        "visit_id",
        "page_url",
        "ad_hash",
        "capture_network",
        F.col("advertiser_network").alias("regex_network"),
        "verification_source",
        "matched_selector",
        F.col("ad_src").alias("src"),
        "outer_html",
    )


def write_disagreements(ads: DataFrame, path: str) -> None:
    disagreements(ads).write.mode("overwrite").json(path)


def list_images(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Paths of the image files below `root`; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path")
    )


def resolve_images(ads: DataFrame, images: DataFrame, root: str, path: str = "png_path") -> DataFrame:
    """Add the full image path, null when the ad names none or the file does not exist."""
    full = F.when(F.coalesce(F.col(path), F.lit("")) != "", F.concat(F.lit(root.rstrip("/") + "/"), F.col(path)))
    listed = images.select(F.col("path").alias("image_path"))
    return ads.withColumn("_want", full).join(
        listed, F.col("_want") == F.col("image_path"), "left"
    ).drop("_want")


def file_index(files: DataFrame, path: str = "path") -> DataFrame:
    """A stable key per file, the same on every run and without ordering all files. Records of a file
    are told apart by their position as well: see `flat_ads`."""
    return files.withColumn("index", F.xxhash64(path))
