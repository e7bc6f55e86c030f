"""What keeps the work in step with the tables: bounded broadcasts, tables written without a second
shuffle, metrics grouped once."""

from pathlib import Path

from pyspark.sql import functions as F

from crawlprism.config import Study
from crawlprism.operators import enrich, stats
from crawlprism.session import RUNTIME_CONF
from crawlprism.sources import artifacts
from crawlprism.sources.tagged import write_table


def test_a_file_of_some_megabytes_is_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "visits")
    spark.range(600_000).select("id", F.xxhash64("id").alias("v")).coalesce(1).write.parquet(path)
    size = sum(p.stat().st_size for p in Path(path).glob("*.parquet"))
    assert 2 << 20 < size < 64 << 20
    visits = spark.read.parquet(path)
    joined = spark.range(100).withColumnRenamed("id", "k").join(visits, F.col("k") == F.col("id"), "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_files_that_hide_their_rows_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "part")
    few = F.pmod(F.xxhash64("id"), F.lit(4000))
    spark.range(300_000).select(few.alias("p"), F.concat(F.lit("a name of some length, number "), few).alias("name")).coalesce(1).write.parquet(path)
    assert sum(p.stat().st_size for p in Path(path).glob("*.parquet")) < 2 << 20  # 20 MB of rows
    joined = spark.range(2_000_000).join(spark.read.parquet(path), F.col("id") == F.col("p")).agg(F.count("name"))
    assert joined.first()[0] == 300_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_measured_sides_have_a_bound_of_their_own():
    assert int(RUNTIME_CONF["spark.sql.adaptive.autoBroadcastJoinThreshold"]) <= 16 << 20


def test_tasks_write_their_own_rows_without_rebalance(spark, tmp_path):
    rows = spark.range(0, 900, 1, 3).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), (F.col("id") % 3).cast("string"))).alias("profile"), "id"
    )
    even, own = str(tmp_path / "even"), str(tmp_path / "own")
    assert write_table(rows, even) == write_table(rows, own, rebalance=False) == 900
    files = lambda path: len(list(Path(path).rglob("*.parquet")))
    assert files(own) == 9 and files(even) < 9
    got = spark.read.parquet(own)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.read.parquet(even).collect()))


def test_a_battery_groups_its_metric_once(spark, monkeypatch):
    calls, table = [], stats._value_table
    monkeypatch.setattr(stats, "_value_table", lambda *a: calls.append(a) or table(*a))
    metrics = spark.createDataFrame([(p, v) for p in ("a", "b", "c") for v in range(12)], "profile string, metric_value long")
    study = Study(profiles=("a", "b", "c"))
    got = stats.pairwise_battery(metrics, "m", study=study).collect()
    assert len(calls) == 1 and len(got) == 3
    alone = stats.kruskal_wallis(metrics, study.profiles, "m").first()
    assert (got[0].statistic, got[0].n_observations) == (alone.statistic, 36)


def test_records_are_parsed_once(spark):
    texts = [
        '{"visit_id":1,"src":"a","ad_metadata":7,"rect":"x"}',
        '{"visit_id":"2","src":0,"ad_id":"0","ad_metadata":{"src":false,"network":["n"],"rect":{"w":3,"h":"4","x":null}},"rect":{"w":9}}',
        '[1,{"visit_id":4,"ad_metadata":{"rect":{}},"rect":{"w":6}},{"record_type":"note"}]',
        '{"record_type":null,"page_url":8,"timestamp":"x"}', '"{\\"visit_id\\":5}"', '{"x":', "[]", "7",
    ]
    files = spark.createDataFrame([("p", f"/d/p/ads/f{i}.json", x) for i, x in enumerate(texts)], "profile string, path string, value string")
    flat = artifacts.flat_ads(files.repartition(2))
    # A file's text, and once more the text in a string: Spark used to repeat both below the explode.
    assert flat._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 2
    got = {r[0]: tuple(r[1:]) for r in flat.select("ad_hash", "visit_id", "page_url", "ad_src", "ad_id", "capture_network", "ad_width", "ad_height").collect()}
    assert got == {
        "f0": (1, "", "a", None, "unknown", 0.0, 0.0), "f1": (2, "", None, "0", '["n"]', 3.0, 4.0),
        "f2_0": (4, "", None, None, "unknown", 6.0, 0.0), "f3": (-1, "8", None, None, "unknown", 0.0, 0.0),
        "f4": (5, "", None, None, "unknown", 0.0, 0.0),
    }


def test_hosts_are_searched_once_a_row(spark):
    requests = spark.createDataFrame(
        [("a", 1, "https://x.one.com/p", "https://www.one.com/"), ("a", 1, "https://y.two.com/p", None), ("a", 2, "https://z.two.com/", "not a page"),
         ("a", 2, "https://two.com/", "https://10.0.0.1/"), ("b", 1, "https://q.one.com/", None), ("a", 1, "https://x.one.com/p", "https://www.one.com/"),
         (None, 1, "https://x.one.com/p", ""), ("b", 9, None, "https://one.com/")],
        "profile string, visit_id int, url string, top_level_url string",
    )
    visits = spark.createDataFrame([("a", 1, "https://two.com/"), ("a", 2, "https://one.com/"), ("b", 1, None)], "profile string, visit_id int, site_url string")
    index = spark.createDataFrame([("one.com", "One", "Group"), ("two.com", "Two", "Group")], "entity_domain string, subsidiary_entity string, parent_entity string")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, made = spark.conf.get(key), []
    try:
        for bound in ("-1", before):
            spark.conf.set(key, bound)
            made.append(enrich.enrich(requests, index, visits, domain_column="url", context_column="top_level_url", keep_context=True))
            if bound == "-1":
                plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
                # Once for the pages in each of two branches, for the visits, and for the rows in each branch.
                assert "Union" in plan and plan.count("regexp_extract(") <= 5
            made[-1] = sorted(map(str, made[-1].collect()))
    finally:
        spark.conf.set(key, before)
    assert made[0] == made[1] and len(made[0]) == 8
