"""What is sent between tasks: wide rows once, lookups in narrow tables, and the same rows as before."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from crawlprism.functions.labels import with_pixel
from crawlprism.operators import ads, enrich, pixels
from crawlprism.plans.roles import Roles

EXT = "external third-party"


@contextmanager
def unbroadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exchanges(df):
    """The columns that each shuffle of the first plan sends."""
    found = []

    def walk(node):
        if node.nodeName() == "Exchange":
            found.append({a.split("#")[0] for a in node.output().mkString("|").split("|")})
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(df._jdf.queryExecution().executedPlan().initialPlan())
    return found


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def crawl(spark):
    rng = random.Random(3)
    pages = [None, "", "not a page", "com", "https://10.0.0.1/", "https://www.one.com/", "https://one.com/x", "http://a.b.co.uk/", "https://y.7", "https://[::1]/"]
    hosts = ["https://x.one.com/p", "https://two.com/", "wss://cdn.co.uk/", "https://10.1.1.1/", None, "", "https://q.three.org/"]
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(hosts), rng.choice(pages), i) for i in range(400)]
    requests = spark.createDataFrame(rows, "profile string, visit_id long, url string, top_level_url string, part long")
    sites = [("a", 1, "https://two.com/"), ("a", 2, None), ("b", 1, "https://www.one.com/"), ("b", 1, "https://two.com/"), ("b", 3, "https://10.0.0.9/"), (None, 1, "https://one.com/")]
    visits = spark.createDataFrame(sites, "profile string, visit_id long, site_url string")
    index = spark.createDataFrame([("one.com", "One", "Group"), ("two.com", "Two", "Group"), ("b.co.uk", "B", "Uk")], "entity_domain string, subsidiary_entity string, parent_entity string")
    return requests, visits, index


def enriched(crawl, context="top_level_url"):
    requests, visits, index = crawl
    return enrich.enrich(requests, index, visits, domain_column="url", context_column=context, keep_context=True)


@pytest.mark.parametrize("context", ["top_level_url", None])
def test_requests_meet_owners_in_one_shuffle(spark, crawl, context):
    want = sorted(map(str, enriched(crawl, context).collect()))
    with unbroadcast(spark):
        out = enriched(crawl, context)
        sent = exchanges(out)
        assert sum("part" in columns for columns in sent) <= (2 if context else 1)  # the two branches read one shuffle
        assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.collect())) == want and len(want) == 400


def test_a_hot_visit_is_spread(spark, crawl, monkeypatch):
    want = sorted(map(str, enriched(crawl).collect()))
    monkeypatch.setattr(enrich, "HOT_SLICE_ROWS", 20)
    requests = crawl[0]
    hot = requests.unionByName(requests.where("profile = 'a' AND visit_id = 1").crossJoin(spark.range(9)).drop("id"))
    with unbroadcast(spark):
        assert enrich._spread(hot, ["profile", "visit_id"], "url", 8)
        twice = enrich.enrich(hot, crawl[2], crawl[1], domain_column="url", context_column="top_level_url", keep_context=True)
        assert sorted({str(r) for r in twice.collect()}) == sorted(set(want)) and twice.count() == hot.count()


def test_page_owners_walk_the_rules_once_a_page(spark):
    rows = [
        ("https://www.one.com/", "one.com", "Z"), ("https://www.one.com/", "one.com", "Y"), ("https://www.one.com/", "ad.com", "A"),
        ("https://WWW.One.com/b", "one.com", "Q"), ("https://WWW.One.com/b", "ad.com", "A"), ("https://x.a!.com/", "acom", "N"), ("https://x.a!.com/", "b.com", "B"),
        ("https://10.0.0.1/", "10.0.0.1", "I"), ("https://10.0.0.1/", None, "C"), ("https://e.com/?one.com", "one.com", "O"), ("https://e.com/?one.com", "z.com", "M"),
        ("https://n.com/", "n.com", ""), (None, "one.com", "T"), ("https://f.com/", "", "K"),
    ]
    df = spark.createDataFrame(rows, "top_level_url string, domain string, parent_entity string")
    out = pixels.page_owners(df)
    own = {r[0]: r[1] for r in df.select("top_level_url", pixels.registered_domain("top_level_url").alias("d")).collect()}
    want = {}
    for page in {r[0] for r in rows if r[0] and r[2]}:
        seen = [r for r in rows if r[0] == page and r[2]]
        mine = [r[2] for r in seen if r[1] is not None and r[1] == own[page]]
        want[page] = min(mine or [r[2] for r in seen])
    assert dict(map(tuple, out.collect())) == want
    first = plan_of(out).rsplit("Aggregate", 1)[1]  # before rows are brought down to pages
    assert "regexp_extract" not in first and "crc32" not in first.lower()


def test_pixels_search_the_host_once(spark, tmp_path):
    spark.createDataFrame([("https://a.facebook.com/tr?id=1",), ("https://facebook.com.x.org/tr?",), (None,)], "url string").write.parquet(str(tmp_path / "r"))
    hits = with_pixel(spark.read.parquet(str(tmp_path / "r")), "url", "hit").where(F.col("hit").isNotNull()).select("url", "hit.pixel_type")
    assert plan_of(hits).count("regexp_extract(") <= 3  # once for the host, and twice for the few that fit
    assert [tuple(r) for r in hits.collect()] == [("https://a.facebook.com/tr?id=1", "Meta Pixel")]


def test_ads_are_sent_once_to_their_pages(spark):
    names = [c for c in pixels.AD_CONTEXT_COLUMNS if c != "page_parent_entity"]
    kinds = {"visit_id": "long", "networks_agree": "boolean", "same_company": "boolean"}
    shown = [("a", "p1"), ("a", "p2"), ("b", "p1"), ("b", None), (None, "p1"), ("a", "p9"), ("a", "p1")]
    values = [tuple({"profile": p, "page_url": u, "visit_id": i, "networks_agree": True, "same_company": None}.get(c, f"{c}{i}") for c in names) + (True,) for i, (p, u) in enumerate(shown)]
    frame = spark.createDataFrame(values, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names) + ", is_valid_ad boolean")
    owners = spark.createDataFrame([("p1", "O"), ("p2", "Q")], "top_level_url string, page_parent_entity string")
    hits = spark.createDataFrame(
        [("a", "O", "Criteo", "x"), ("a", "O", "Meta Pixel", "y"), ("b", "Q", "Criteo", "x")],
        "profile string, top_level_parent_entity string, pixel_type string, request_parent_entity string",
    ).withColumn("path_confirmed", F.lit(True))
    seeded = pixels.seeded_site_pixels(hits.withColumnRenamed("profile", "persona"), targets=("Criteo",))
    with unbroadcast(spark):
        out = pixels.ads_with_pixel_context(frame, owners, pixels.site_pixels(hits), seeded)
        assert sum("ad_hash" in columns for columns in exchanges(out)) == 1
        scored = pixels.score_ads(out, {"a": ("category0",)})
        assert sum("ad_hash" in columns for columns in exchanges(scored)) == 1
        got = {r.visit_id: (r.page_parent_entity, r.site_pixel_hits, r.site_has_meta, r.site_was_seeded_with_pixel, r.is_on_target) for r in scored.collect()}
    none = (0, False, False, False)
    assert got == {
        0: ("O", 2, True, True, True), 1: ("Q", *none), 2: ("O", *none), 3: (None, *none), 4: ("O", *none), 5: (None, *none), 6: ("O", 2, True, True, False),
    }


@pytest.mark.parametrize("keys", [("profile", "visit_id"), ("visit_id",)])
def test_cooccurrence_sends_hosts_once(spark, keys):
    rng = random.Random(8)
    shown = [(rng.choice(["a", "b", None]), rng.choice([1, 1, 2, 3, None]), rng.choice([None, *(f"ad{i}" for i in range(40))]), rng.choice(["n1", "n2", None])) for _ in range(120)]
    seen = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 4, None]), f"https://t{rng.randrange(6)}.com/x", EXT) for _ in range(90)]
    ad_frame = spark.createDataFrame([(*s, True, "high") for s in shown], "profile string, visit_id long, ad_hash string, advertiser_network string, is_valid_ad boolean, confidence string")
    requests = spark.createDataFrame(seen, "profile string, visit_id long, url string, relationship_tier string")
    want = {}
    for p, v, h, n in shown:
        for q, w, u, _ in seen:
            if n is not None and v is not None and v == w and (keys == ("visit_id",) or (p is not None and p == q)):
                cell = want.setdefault((n, u.split("/")[2]), (set(), set()))
                cell[0].add(h)
                cell[1].add(p)
    with unbroadcast(spark):
        out = ads.network_tracker_cooccurrence(ad_frame, requests, top_n=None, keys=keys, min_shared=0)
        sent = exchanges(out)
        # In each of the two branches hosts travel once, as a set a visit.
        assert sum(not columns & {"advertiser_network"} for columns in sent if columns & {"_hosts", "buf", "url", "tracker_domain"}) <= 2
        got = {(r.advertiser_network, r.tracker_domain): (r.shared_ads, r.n_profiles) for r in out.collect()}
    assert got == {k: (len(a - {None}), len(b - {None})) for k, (a, b) in want.items()}


def test_flags_travel_as_one_number(spark, sf, monkeypatch):
    roles = Roles(spark, sf)
    with unbroadcast(spark):
        sent = [columns for build in (roles._requests, roles._ads) for columns in exchanges(build())]
    assert not any(columns & {"l_tax", "l_returnflag", "l_linestatus", "o_orderpriority"} for columns in sent if "l_orderkey" in columns and "l_partkey" in columns)
