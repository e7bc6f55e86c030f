"""Readers, writers, views and streams."""

import json

import pytest
from pyspark.sql import functions as F

from crawlprism.config import Study
from crawlprism.operators import enrich
from crawlprism.sources import artifacts, catalog, tagged
from crawlprism.streaming import incremental

STUDY = Study(profiles=("a", "b"))


def test_union_drops_and_reports_drift(spark):
    one = spark.createDataFrame([(1, "x", 9)], "visit_id long, url string, only int")
    two = spark.createDataFrame([("y", 2)], "url string, visit_id long")
    out = tagged.tagged_union({"a": one, "b": two})
    assert out.columns == ["url", "visit_id", "profile"]
    assert sorted(map(tuple, out.collect())) == [("x", 1, "a"), ("y", 2, "b")]
    assert [tuple(r) for r in tagged.drift_report(spark, {"a": one, "b": two}).collect()] == [("a", "only")]
    with pytest.raises(ValueError):
        tagged.tagged_union({})


def test_convert_names_every_missing_source(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a" / "t"))
    with pytest.raises(FileNotFoundError, match="b: .*c: "):
        tagged.require_sources(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "c": str(tmp_path / "c")})
    spark.range(2).write.parquet(str(tmp_path / "b" / "t"))
    spark.range(1).write.parquet(str(tmp_path / "b" / "u"))
    rows = tagged.convert_crawls(spark, {p: str(tmp_path / p) for p in "ab"}, ("t", "u"), str(tmp_path / "out"))
    assert rows == {"t": 5}
    assert spark.read.parquet(str(tmp_path / "out" / "t")).groupBy("profile").count().count() == 2


def test_artifact_scan(spark, tmp_path):
    meta = {"src": "https://x.doubleclick.net/", "network": "google_adsense", "rect": {"x": 1, "w": 300, "h": None}, "confidence": "high"}
    files = {
        "a/ads/v1/one.json": json.dumps({"visit_id": 4, "page_url": "p", "ad_metadata": meta, "timestamp": "12.5"}),
        "a/ads/v1/_visit_summary.json": "{}",
        "a/ads/v2/many.json": json.dumps([{"visit_id": 5, "src": "s", "ad_metadata": "no dict"}, 3, {"visit_id": 6, "rect": {"y": 2}}]),
        "a/ads/v2/twice.json": json.dumps(json.dumps({"visit_id": 7})),
        "b/ads/bad.json": "{",
        "b/ads/note.json": json.dumps({"record_type": "note"}),
        "b/ads/number.json": "3",
        "b/other/skipped.json": "{}",
        "b/ads/one.txt": "{}",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    scanned = artifacts.scan_artifacts(spark, str(tmp_path))
    # The reader itself leaves out files whose name starts with an underscore.
    assert scanned.count() == 6
    counts = {r.profile: r for r in artifacts.ingestion_counts(artifacts.records(artifacts.without_sidecars(scanned))).collect()}
    assert (counts["a"].n_files, counts["a"].n_records, counts["b"].n_malformed, counts["b"].n_without_records) == (3, 4, 1, 2)
    rows = {r.ad_hash: r for r in artifacts.flat_ads(scanned).collect()}
    assert set(rows) == {"one", "many_0", "many_1", "twice"}
    one = rows["one"]
    assert (one.visit_id, one.ad_width, one.ad_height, one.ad_x, one.timestamp) == (4, 300.0, 0.0, 1.0, 12.5)
    assert (one.advertiser_network, one.capture_network, one.verification_source, one.networks_agree) == ("google_doubleclick", "google_adsense", "src_regex", True)
    assert rows["many_0"].ad_src == "s" and rows["many_0"].capture_network == "unknown"
    assert rows["many_1"].ad_y == 2.0 and rows["twice"].visit_id == 7
    assert {r.ad_hash for r in artifacts.disagreements(artifacts.flat_ads(scanned)).collect()} == {"many_0", "many_1", "twice"}


def test_images(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(b"x")
    images = artifacts.list_images(spark, str(tmp_path))
    root = images.first().path.rsplit("/a/", 1)[0]
    ads = spark.createDataFrame([(1, "a/x.png"), (2, "a/y.png"), (3, ""), (4, None)], "i int, png_path string")
    got = {r.i: r.image_path is not None for r in artifacts.resolve_images(ads, images, root).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_views_and_counts(spark, tmp_path):
    visits = spark.createDataFrame([("a", 1), ("a", 2)], "profile string, visit_id long")
    tagged.write_table(visits, str(tmp_path / "site_visits"))
    assert catalog.register_views(spark, str(tmp_path)) == ["site_visits"]
    assert "http_requests_enriched" in catalog.missing_views(spark)
    got = {(r.table, r.profile): r.n_rows for r in catalog.row_counts({"site_visits": visits, "callstacks": None}, study=STUDY, spark=spark).collect()}
    assert got == {("site_visits", "a"): 2, ("site_visits", "b"): 0, ("callstacks", "a"): 0, ("callstacks", "b"): 0}


def test_write_enriched_reports_tiers(spark, tmp_path):
    df = spark.createDataFrame([("a", "first-party"), ("b", "unknown"), ("a", "unknown")], "profile string, relationship_tier string")
    got = enrich.write_enriched(df, str(tmp_path / "e"))
    assert got["unknown"] == 2 and got["first-party"] == 1 and got["external third-party"] == 0
    assert spark.read.parquet(str(tmp_path / "e")).count() == 3


def test_label_stream_resumes_from_its_checkpoint(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = lambda a, b: spark.range(a, b).withColumnRenamed("id", "index")
    label = lambda df: df.withColumn("label", F.col("index") * 2)

    def run():
        stream = spark.readStream.schema("index long").parquet(source)
        incremental.label_stream(stream, label, out, check).awaitTermination()
        return sorted(r["index"] for r in spark.read.parquet(out).collect())

    rows(0, 5).write.parquet(source)
    assert run() == list(range(5))
    rows(5, 8).write.mode("append").parquet(source)
    assert run() == list(range(8))
    assert run() == list(range(8))


def test_stream_labels_each_key_once(spark, tmp_path):
    """The same keys in two files, in two runs, and keys that are assigned elsewhere."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = spark.range(5).withColumnRenamed("id", "index").coalesce(1)
    assigned = spark.createDataFrame([(3,)], "index long")

    def run():
        stream = spark.readStream.schema("index long").option("maxFilesPerTrigger", 1).parquet(source)
        label = lambda df: df.withColumn("label", F.lit("x"))
        incremental.label_stream(stream, label, out, check, assigned=assigned).awaitTermination()
        return sorted(r["index"] for r in spark.read.parquet(out).collect())

    for _ in range(2):
        rows.write.mode("append").parquet(source)
    assert run() == [0, 1, 2, 4]
    rows.write.mode("append").parquet(source)
    assert run() == [0, 1, 2, 4]


def test_resume_after_a_first_run_that_left_no_file(spark, tmp_path):
    out = tmp_path / "labels"
    (out / "_temporary" / "0").mkdir(parents=True)
    ads = spark.range(3).withColumnRenamed("id", "index")
    for _ in range(2):
        incremental.resume_labels(spark, ads, lambda df: df.withColumn("label", F.lit("x")), str(out))
    assert sorted(r["index"] for r in spark.read.parquet(str(out)).collect()) == [0, 1, 2]


def test_records_of_one_file_have_keys_of_their_own(spark):
    rec = '{"visit_id":1,"src":"https://x.com/"}'
    files = spark.createDataFrame([("a", "/d/a/ads/m.json", f"[{rec},{rec}]"), ("a", "/d/a/ads/n.json", rec)], "profile string, path string, value string")
    got = artifacts.flat_ads(files).select("index", "ad_hash").collect()
    assert len({r["index"] for r in got}) == 3 and {r.ad_hash for r in got} == {"m_0", "m_1", "n"}


def test_pending(spark):
    ads = spark.createDataFrame([(i, f"h{i}") for i in range(6)], "index long, ad_hash string")
    done = spark.createDataFrame([(0,), (2,)], "index long")
    assert [r["index"] for r in incremental.pending(ads, done, limit=2).collect()] == [1, 3]
    assert [r["index"] for r in incremental.pending(ads, done, only=["h2", "h5"]).collect()] == [5]
