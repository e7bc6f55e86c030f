"""Sources, sinks, views, incremental arrival and review."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crawlprism.operators import ads, enrich, review, stats, topics
from crawlprism.plans.registry import register
from crawlprism.plans.roles import STUDY, Roles, profile_of, with_ctes
from crawlprism.session import shared_dir
from crawlprism.sources import artifacts, catalog, entities, tagged
from crawlprism.streaming import incremental


def scratch(t: Roles, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# --- tagged union ----------------------------------------------------------------------------


def _crawls(t: Roles):
    """One raw request table per profile; the first has a column the others lack."""
    out = {}
    for p in STUDY.profiles:
        rows = t.requests.where(F.col("profile") == p).drop("profile", "part", "qty")
        out[p] = rows.withColumn("only_here", F.lit(1)) if p == STUDY.profiles[0] else rows
    return out


register(
    "a1_a2_g1_tagged_union",
    lambda t: tagged.tagged_union(_crawls(t)),
    with_ctes("SELECT profile, top_level_url, url, visit_id FROM enriched", "enriched"),
)


def _converted(t: Roles):
    """Raw crawls written per profile, converted, and read back as views."""
    root, target = scratch(t, "raw"), scratch(t, "converted")
    for p, df in _crawls(t).items():
        tagged.write_table(df, f"{root}/{p}/http_requests")
    roots = {p: f"{root}/{p}" for p in STUDY.profiles}
    tagged.convert_crawls(t.spark, roots, ("http_requests", "callstacks"), target)
    return t.spark.read.parquet(f"{target}/http_requests").groupBy("profile").agg(
        F.count("*").alias("n_rows"), F.count_distinct("visit_id").alias("n_visits"), F.count("top_level_url").alias("n_context")
    )


register(
    "a5_a6_convert_crawls",
    _converted,
    with_ctes(
        "SELECT profile, count(*) AS n_rows, count(DISTINCT visit_id) AS n_visits, count(top_level_url) AS n_context FROM enriched GROUP BY 1",
        "enriched",
    ),
)


def _csv(t: Roles):
    path = scratch(t, "csv")
    rows = t.ads.where(F.col("advertiser_network").isNotNull()).select("profile", "ad_hash", "advertiser_network", "has_screenshot")
    tagged.write_csv(rows, path)
    return tagged.read_report_csv(
        t.spark, path, "profile string, ad_hash string, advertiser_network string, has_screenshot string", ("has_screenshot",)
    )


register(
    "a7_a8_csv_round_trip",
    _csv,
    with_ctes("SELECT profile, ad_hash, advertiser_network, has_screenshot FROM ads WHERE advertiser_network IS NOT NULL", "ads"),
)


def _merged(t: Roles):
    path = scratch(t, "merged")
    visits = t.visits
    visits.select("profile", "visit_id").where(F.col("site_url").isNull()).write.parquet(f"{path}/part=0")
    visits.where(F.col("site_url").isNotNull()).write.parquet(f"{path}/part=1")
    return tagged.read_merged(t.spark, path).select("profile", "visit_id", "site_url")


register("a19_merged_schema_read", _merged, with_ctes("SELECT * FROM visits", "visits"))
register(
    "a23_seeding_requests",
    lambda t: tagged.seeding_requests(t.requests.where(F.col("profile") == "building"), "building"),
    with_ctes("SELECT profile AS persona, visit_id, url, top_level_url FROM enriched WHERE profile = 'building'", "enriched"),
)


def _saved_corpus(t: Roles):
    path = scratch(t, "corpus")
    topics.save_corpus(topics.ad_corpus(t.doc_ads, 200), path)
    return topics.load_corpus(t.spark, path).groupBy("profile").agg(
        F.count("*").alias("n_docs"), F.sum("n_chars_clean").alias("n_chars")
    )


_CLEAN = r"""array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(ocr_text, 'https?://\S+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g'), '[^a-zA-Z]+', ' ', 'g')), ' '), lambda x: length(x) >= 3), ' ')"""
register(
    "a24_corpus_save_and_load",
    _saved_corpus,
    with_ctes(
        f"SELECT profile, count(*) AS n_docs, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM (SELECT *, {_CLEAN} AS c FROM doc_ads WHERE ocr_char_count > 0 AND confidence = 'high') WHERE length(c) >= 200 GROUP BY 1",
        "doc_ads",
    ),
)

# --- ad records ------------------------------------------------------------------------------

# One JSON text per line item, in the shapes captures have.
_META = """'"ad_metadata":{"src":' || CASE WHEN l_tax < 0.03 THEN '"https://ads.doubleclick.net/x"' WHEN l_tax < 0.05 THEN '""' ELSE 'null' END
  || ',"tag":"iframe","network":"' || CASE WHEN l_suppkey % 3 = 0 THEN 'google_adsense' WHEN l_suppkey % 3 = 1 THEN 'criteo' ELSE 'unknown' END
  || '","confidence":"high","rect":{"x":' || l_linenumber || ',"y":2.5,"w":' || l_linenumber * 100 || ',"h":' || CAST(l_quantity AS INT) || '}}'"""
_REC = f"""'{{"visit_id":' || l_orderkey || ',"page_url":"https://p/' || l_partkey || '","timestamp":' || l_suppkey || ',"src":"https://static.criteo.net/b",' || {_META} || '}}'"""
_JSON = """CASE l_linenumber WHEN 1 THEN rec WHEN 2 THEN '[' || rec || ',7,' || rec || ']' WHEN 3 THEN '{"visit_id": '
  WHEN 4 THEN '"' || replace(rec, '"', concat(chr(92), '"')) || '"' WHEN 5 THEN '{"record_type":"note","visit_id":1}' WHEN 6 THEN '42'
  ELSE '{"visit_id":' || l_orderkey || ',"outer_html":"<a href=//taboola.com>","network":"taboola","ad_id":"x' || l_partkey || '"}' END"""
_PATH = "concat('/data/', profile, '/ads/', CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN '_visit' ELSE '' END, 'a', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, '.json')"


def _files(t: Roles):
    def build():
        rows = t.lines.withColumn("rec", F.expr(_REC))
        return rows.select("profile", F.expr(_PATH).alias("path"), F.expr(_JSON).alias("value"))

    return t.stored("ad_files", build)


_FILES_SQL = f"files AS (SELECT profile, {_PATH} AS path, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax FROM base WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O'))"
register(
    "a11_sidecar_filter",
    lambda t: artifacts.without_sidecars(_files(t)).select("profile", "path"),
    with_ctes("SELECT profile, path FROM files", "base", extra=_FILES_SQL),
)
register(
    "a12_record_counts",
    lambda t: artifacts.ingestion_counts(artifacts.records(artifacts.without_sidecars(_files(t)))),
    with_ctes(
        """SELECT profile, count(*) AS n_files, count(*) FILTER (l_linenumber = 3) AS n_malformed, count(*) FILTER (l_linenumber IN (3, 6)) AS n_without_records,
      CAST(sum(CASE l_linenumber WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 6 THEN 0 ELSE 1 END) AS BIGINT) AS n_records FROM files GROUP BY 1""",
        "base",
        extra=_FILES_SQL,
    ),
)
_FLAT_SQL = """SELECT profile, CAST(l_orderkey AS BIGINT) AS visit_id, CASE WHEN l_linenumber = 7 THEN '' ELSE 'https://p/'||l_partkey END AS page_url,
      'a'||l_orderkey||'_'||l_linenumber||'_'||l_partkey||'_'||l_suppkey||CASE WHEN l_linenumber = 2 THEN '_'||i ELSE '' END AS ad_hash,
      CASE WHEN l_linenumber = 7 THEN NULL WHEN l_tax < 0.03 THEN 'https://ads.doubleclick.net/x' ELSE 'https://static.criteo.net/b' END AS ad_src,
      CASE WHEN l_linenumber <> 7 THEN 'iframe' END AS ad_tag, CASE WHEN l_linenumber = 7 THEN 'x'||l_partkey END AS ad_id,
      CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber * 100 END::DOUBLE AS ad_width, CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS INT) END::DOUBLE AS ad_height,
      CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END::DOUBLE AS ad_x, CASE WHEN l_linenumber = 7 THEN 0 ELSE 2.5 END::DOUBLE AS ad_y,
      CASE WHEN l_linenumber = 7 THEN 'taboola' WHEN l_tax < 0.03 THEN 'google_doubleclick' ELSE 'criteo' END AS advertiser_network,
      CASE WHEN l_linenumber = 7 THEN 'taboola' ELSE cap END AS capture_network, CASE WHEN l_linenumber = 7 THEN 'outerhtml_regex' ELSE 'src_regex' END AS verification_source,
      l_linenumber = 7 OR (l_tax < 0.03 AND cap = 'google_adsense') OR (l_tax >= 0.03 AND cap = 'criteo') AS networks_agree,
      CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE 'high' END AS confidence, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_suppkey END::DOUBLE AS timestamp
    FROM (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN 'google_adsense' WHEN 1 THEN 'criteo' ELSE 'unknown' END AS cap FROM files WHERE l_linenumber IN (1, 2, 4, 7))
    JOIN (VALUES (0), (1)) k(i) ON i = 0 OR l_linenumber = 2"""
_FLAT = (
    "profile", "visit_id", "page_url", "ad_hash", "ad_src", "ad_tag", "ad_id", "ad_width", "ad_height", "ad_x", "ad_y",
    "advertiser_network", "capture_network", "verification_source", "networks_agree", "confidence", "timestamp",
)
register(
    "a13_a14_flat_ads",
    lambda t: artifacts.flat_ads(_files(t)).select(*_FLAT),
    with_ctes(_FLAT_SQL, "base", extra=_FILES_SQL),
)


def _with_files(t: Roles):
    """Flat ads with extracted text and screenshots: every second file has either. Keys are unique."""
    files = _files(t).select("path", F.regexp_replace("path", r"\.json$", "").alias("key"))
    half = F.regexp_extract("key", "_([0-9]+)$", 1).cast("long") % 2
    text = files.where(half == 0).select(F.col("key").alias("path"), F.lit("seen").alias("ocr_text")).distinct()
    images = files.where(half == 1).select(F.concat("key", F.lit(".png")).alias("path")).distinct()
    made = artifacts.flat_ads(_files(t), text, images)
    return made.groupBy("profile", "has_screenshot", "ocr_text").agg(
        F.count("*").alias("n_ads"), F.count_distinct("index").alias("n_keys"), F.count_distinct("png_path").alias("n_images")
    )


register(
    "a14_ads_with_files",
    _with_files,
    with_ctes(
        """SELECT profile, odd = 1 AS has_screenshot, CASE odd WHEN 1 THEN '' ELSE 'seen' END AS ocr_text, count(*) AS n_ads, count(DISTINCT path||'#'||i) AS n_keys,
      CASE odd WHEN 1 THEN count(DISTINCT path) ELSE 1 END AS n_images
    FROM (SELECT *, l_suppkey % 2 AS odd FROM files WHERE l_linenumber IN (1, 2, 4, 7)) JOIN (VALUES (0), (1)) k(i) ON i = 0 OR l_linenumber = 2 GROUP BY profile, odd""",
        "base",
        extra=_FILES_SQL,
    ),
)
_SOURCE_COUNTS = f"SELECT verification_source, count(*) AS n_ads, count(*) FILTER (networks_agree) AS n_agree FROM ({_FLAT_SQL}) GROUP BY 1"
register(
    "d54_verification_sources",
    lambda t: ads.verification_breakdown(t.stored("flat_ads", lambda: artifacts.flat_ads(_files(t)))),
    with_ctes(_SOURCE_COUNTS, "base", extra=_FILES_SQL),
)


def _scanned(t: Roles):
    """Nations as captured records, one JSON file each below their region's folder, scanned back."""
    root = scratch(t, "scanned")
    nations = t.table("nation").join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for region in STUDY.profiles:
        own = nations.where(F.col("n_regionkey") == STUDY.profiles.index(region))
        own.select(F.col("n_nationkey").alias("visit_id"), F.col("n_name").alias("page_url")).coalesce(1).write.option(
            "maxRecordsPerFile", 1
        ).json(f"{root}/{region}/ads/day")
    found = artifacts.flat_ads(artifacts.scan_artifacts(t.spark, root))
    return found.select("profile", "visit_id", "page_url", (F.col("index").isNotNull() & F.col("ad_hash").startswith("part")).alias("keyed"))


register(
    "a10_scanned_artifacts",
    _scanned,
    f"SELECT list_extract({list(STUDY.profiles)}, CAST(n_regionkey + 1 AS INT)) AS profile, CAST(n_nationkey AS BIGINT) AS visit_id, n_name AS page_url, true AS keyed FROM nation",
)


def _tree_file(t: Roles):
    """Suppliers below their nation as a CSV tree, read back into an owner index."""
    path = scratch(t, "tree")
    nation, supplier = t.table("nation"), t.table("supplier")
    top = nation.select(F.concat(F.lit("/"), "n_name").alias("path"), F.col("n_name").alias("subsidiary_entity"), F.col("n_name").alias("parent_entity"))
    leaf = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("/"), "n_name", F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".net")).alias("path"),
        F.col("s_name").alias("subsidiary_entity"), F.col("n_name").alias("parent_entity"),
    )
    more = {"source": F.lit("fixture"), "priority": F.lit(1)}
    top.unionByName(leaf).withColumns(more).write.option("header", True).csv(path)
    return entities.load_index(t.spark, path).select("entity_domain", "subsidiary_entity", "parent_entity")


register(
    "a20_entity_tree_file",
    _tree_file,
    """SELECT 's'||s_suppkey||'.net' AS entity_domain, s_name AS subsidiary_entity, n_name AS parent_entity FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_name, n_name, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""",
)


def _own_metric(t: Roles):
    """A metric as SQL over a view, with a pattern whose braces stay."""
    t.enriched.createOrReplaceTempView("own_metric_rows")
    return stats.metric_from_sql(
        t.spark,
        "SELECT profile, visit_id, count(*) AS metric_value FROM own_metric_rows WHERE profile IN {profiles} AND url RLIKE '[a-z]{3}' GROUP BY 1, 2",
        STUDY.profiles[:2],
    )


register(
    "i8_own_sql_metric",
    _own_metric,
    with_ctes(
        f"SELECT profile, visit_id, count(*) AS metric_value FROM enriched WHERE profile IN {STUDY.profiles[:2]} AND regexp_matches(url, '[a-z]{{3}}') GROUP BY 1, 2",
        "enriched",
    ),
)


def _audit(t: Roles):
    path = scratch(t, "audit")
    ads = t.stored("flat_ads", lambda: artifacts.flat_ads(_files(t)))
    artifacts.write_disagreements(ads, path)
    return t.spark.read.schema(
        "profile string, visit_id long, ad_hash string, capture_network string, regex_network string, verification_source string"
    ).json(path)


register(
    "a9_disagreement_audit",
    _audit,
    with_ctes(
        f"SELECT profile, visit_id, ad_hash, capture_network, advertiser_network AS regex_network, verification_source FROM ({_FLAT_SQL}) WHERE NOT networks_agree",
        "base",
        extra=_FILES_SQL,
    ),
)
register(
    "e6_stable_file_index",
    lambda t: artifacts.file_index(t.lines.select(F.expr(_PATH).alias("path")).distinct()).agg(
        F.count("*").alias("n_files"), F.count_distinct("index").alias("n_keys")
    ),
    with_ctes(f"SELECT count(DISTINCT {_PATH}) AS n_files, count(DISTINCT {_PATH}) AS n_keys FROM base", "base"),
)


def _resolved(t: Roles):
    named = t.ads.select(
        "profile", "ad_hash", "visit_id", F.when(F.col("ad_y") > 200, F.concat("profile", F.lit("/"), "ad_hash", F.lit(".png"))).alias("png_path")
    )
    images = t.ads.where("has_screenshot").select(F.concat(F.lit("/shots/"), "profile", F.lit("/"), "ad_hash", F.lit(".png")).alias("path")).distinct()
    return artifacts.resolve_images(named, images, "/shots").groupBy("profile", F.col("image_path").isNotNull().alias("found")).agg(F.count("*").alias("n"))


register(
    "a25_resolve_images",
    _resolved,
    with_ctes(
        """SELECT profile, ad_y > 200 AND (profile, ad_hash) IN (SELECT (profile, ad_hash) FROM ads WHERE has_screenshot) AS found, count(*) AS n FROM ads GROUP BY 1, 2""",
        "ads",
    ),
)

# --- views -----------------------------------------------------------------------------------


def _descriptions(t: Roles):
    """One label record per (visit, ad) of two thirds of the line items."""
    part = t.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    return (
        t.lines.join(part, "l_partkey")
        .where(F.col("l_returnflag") != "N")
        .groupBy(F.col("l_orderkey").alias("visit_id"), F.concat(F.lit("ad"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("ad_hash"))
        .agg(F.min("p_type").alias("category"), F.min("p_brand").alias("brand"), F.max("l_linestatus").alias("content"))
        .select(
            "visit_id", "ad_hash", (F.col("content") == "O").alias("is_valid_ad"), "category", "brand",
            *[F.lit("x").alias(c) for c in ("product", "description", "status", "reason")],
            "content", F.lit("high").alias("confidence"),
            *[F.lit(False).alias(c) for c in ("viewed", "modified", "same_company")],
            *[F.lit("").alias(c) for c in ("old_category", "old_description", "notes")],
        )
    )


def _plain_ads(t: Roles):
    return t.ads.select("profile", "visit_id", "ad_hash", "advertiser_network", "ad_x")


register(
    "a17_c1_ads_enriched_view",
    lambda t: catalog.ads_enriched(_plain_ads(t), _descriptions(t)).select(
        "profile", "visit_id", "ad_hash", "advertiser_network", "is_valid_ad", "category", "brand", "vlm_text", "vlm_confidence"
    ),
    with_ctes(
        """SELECT a.profile, a.visit_id, a.ad_hash, a.advertiser_network, d.content = 'O' AS is_valid_ad, d.category, d.brand, d.content AS vlm_text, CASE WHEN d.content IS NOT NULL THEN 'high' END AS vlm_confidence
    FROM ads a LEFT JOIN (SELECT l_orderkey AS visit_id, 'ad'||l_orderkey||'_'||l_linenumber AS ad_hash, min(p_type) AS category, min(p_brand) AS brand, max(l_linestatus) AS content
      FROM base JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N' GROUP BY 1, 2) d USING (visit_id, ad_hash)""",
        "ads",
    ),
)
register(
    "a18_row_counts",
    lambda t: catalog.row_counts(
        {"site_visits": t.visits, "http_requests": t.requests, "javascript": t.script_calls, "callstacks": None}, study=STUDY, spark=t.spark
    ),
    with_ctes(
        """SELECT tab AS "table", profiles.profile, coalesce(n, 0) AS n_rows FROM (SELECT unnest(['site_visits','http_requests','javascript','callstacks']) AS tab) CROSS JOIN profiles LEFT JOIN (
      SELECT 'site_visits' AS tab, profile, count(*) AS n FROM visits GROUP BY ALL UNION ALL SELECT 'http_requests', profile, count(*) FROM enriched GROUP BY ALL
      UNION ALL SELECT 'javascript', profile, count(*) FROM script_calls GROUP BY ALL) x USING (tab, profile)""",
        "profiles", "visits", "enriched", "script_calls",
    ),
)


def _views(t: Roles):
    root = scratch(t, "study")
    tagged.write_table(t.visits, f"{root}/site_visits")
    tagged.write_table(_plain_ads(t), f"{root}/ads")
    tagged.write_table(_descriptions(t), f"{root}/ads_desc")
    catalog.register_views(t.spark, root)
    return t.spark.sql(
        "SELECT profile, count(DISTINCT v.visit_id) AS n_visits, count(a.ad_hash) AS n_ads, count(a.category) AS n_labelled "
        "FROM site_visits v LEFT JOIN ads_enriched a USING (profile, visit_id) GROUP BY profile"
    )


register(
    "a15_registered_views",
    _views,
    with_ctes(
        """SELECT v.profile, count(DISTINCT v.visit_id) AS n_visits, count(a.ad_hash) AS n_ads, count(d.visit_id) AS n_labelled FROM visits v LEFT JOIN ads a USING (profile, visit_id)
    LEFT JOIN (SELECT DISTINCT l_orderkey AS visit_id, 'ad'||l_orderkey||'_'||l_linenumber AS ad_hash FROM base WHERE l_returnflag <> 'N') d ON d.visit_id = a.visit_id AND d.ad_hash = a.ad_hash GROUP BY 1""",
        "visits", "ads",
    ),
)

# --- incremental arrival ---------------------------------------------------------------------


def _pending(t: Roles):
    docs = t.table("documents").select(F.col("doc_id").alias("index"), F.concat(F.lit("doc"), "doc_id").alias("ad_hash"), "lang")
    done = t.table("labels").select(F.col("doc_id").alias("index"))
    elsewhere = t.table("embeddings").where(F.col("label") == 3).select(F.col("vec_id").alias("index"))
    return incremental.pending(docs, done, elsewhere)


_PENDING = "SELECT doc_id AS \"index\", 'doc'||doc_id AS ad_hash, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)"
register("c5_l1_pending_labels", _pending, _PENDING)
register(
    "f4_first_pending",
    lambda t: incremental.pending(_pending(t), limit=25),
    _PENDING + " ORDER BY doc_id LIMIT 25",
)


def _resumed(t: Roles):
    """Label in two runs; the second takes only what the first left."""
    path = scratch(t, "labels")
    docs = t.table("documents").select(F.col("doc_id").alias("index"), "n_chars", "lang")
    label = lambda df: df.select("index", (F.col("n_chars") > 500).alias("is_long"))
    incremental.resume_labels(t.spark, docs.where(F.col("lang") == "en"), label, path)
    incremental.resume_labels(t.spark, docs, label, path)
    return t.spark.read.parquet(path)


register(
    "l1_resumed_labels",
    _resumed,
    "SELECT doc_id AS \"index\", n_chars > 500 AS is_long FROM documents",
)


def _event_files(t: Roles, name: str):
    """The script calls as files that arrive one by one, and a stream over them."""
    path = scratch(t, name)
    t.script_calls.write.parquet(path)
    return (
        t.spark.readStream.schema(t.script_calls.schema)
        .option("maxFilesPerTrigger", 2)
        .parquet(path)
    )


_SCRIPT_TARGET = enrich.EnrichmentTarget("javascript", "script_url", "top_level_url")


def _streamed(t: Roles):
    out, checkpoint = scratch(t, "stream-out"), scratch(t, "stream-checkpoint")
    query = incremental.enrich_stream(
        _event_files(t, "arrivals"), t.index, t.script_visits, _SCRIPT_TARGET, out, checkpoint
    )
    query.awaitTermination()
    return t.spark.read.parquet(out).groupBy("profile", "relationship_tier", "parent_entity").agg(F.count("*").alias("n_rows"))


register(
    "l2_streamed_enrichment",
    _streamed,
    with_ctes("SELECT profile, relationship_tier, parent_entity, count(*) AS n_rows FROM scripts GROUP BY 1, 2, 3", "scripts"),
)


def _late_visits(t: Roles):
    """Cookies whose visits come in later files than they, in earlier ones, or never; a row and a visit
    at the end of time let the watermark pass all others."""
    rows, visits, out, checkpoint = (scratch(t, n) for n in ("late-rows", "late-visits", "late-out", "late-checkpoint"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("c_custkey") * 60)
    profile = F.lower("c_mktsegment").alias("profile")
    host = F.concat(F.lit("a.site"), F.col("c_custkey"), F.lit(".gob.mx"))
    calls = t.table("customer").select(profile, F.col("c_custkey").alias("visit_id"), host.alias("host"), at.alias("at"))
    site = F.concat(F.lit("https://www.site"), F.col("c_custkey") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0), F.lit(".gob.mx/"))
    seen = t.table("customer").where("c_custkey % 5 <> 0").select(
        profile, F.col("c_custkey").alias("visit_id"), site.alias("site_url"),
        (at + F.when(F.col("c_custkey") % 2 == 0, F.expr("INTERVAL 20 MINUTES")).otherwise(F.expr("INTERVAL -20 MINUTES"))).alias("seen_at"),
    )
    end = F.timestamp_seconds(F.lit(1_900_000_000))
    for df, path, last in (
        (calls, rows, [F.lit("end"), F.lit(-1).cast("long"), F.lit("x.com"), end]),
        (seen, visits, [F.lit("end"), F.lit(-2).cast("long"), F.lit("https://x.com/"), end]),
    ):
        for part in range(3):
            df.where(F.col("visit_id") % 3 == part).coalesce(1).write.mode("append").parquet(path)
        t.spark.range(1).select(*[c.alias(n) for c, n in zip(last, df.columns)]).write.mode("append").parquet(path)
    streams = [t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(p) for df, p, n in ((calls, rows, 4), (seen, visits, 4))]
    incremental.enrich_late_stream(
        streams[0], t.index, streams[1], enrich.EnrichmentTarget("cookies", "host", None), out, checkpoint, row_time="at", visit_time="seen_at"
    ).awaitTermination()
    return t.spark.read.schema("profile string, visit_id long, domain string, relationship_tier string").parquet(out).where("visit_id >= 0").select(
        "visit_id", "domain", "relationship_tier"
    )


register(
    "l2_late_visits",
    _late_visits,
    """SELECT c_custkey AS visit_id, 'site' || c_custkey || '.gob.mx' AS domain, CASE WHEN c_custkey % 5 = 0 THEN 'unknown'
      WHEN c_custkey % 3 = 0 THEN 'external third-party' ELSE 'first-party' END AS relationship_tier FROM customer""",
)


def _stream_labels(t: Roles):
    """Documents that arrive twice, in different files, without those assigned elsewhere."""
    path, out, checkpoint = (scratch(t, n) for n in ("label-arrivals", "label-out", "label-checkpoint"))
    docs = t.table("documents").select(F.col("doc_id").alias("index"), "n_chars", "lang")
    for _ in range(2):
        docs.repartition(2, "index").write.mode("append").parquet(path)
    arrivals = t.spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = incremental.label_stream(
        arrivals,
        lambda df: df.select("index", (F.col("n_chars") > 500).alias("is_long")),
        out,
        checkpoint,
        assigned=t.table("labels").where("toxic = 1").select(F.col("doc_id").alias("index")),
    )
    query.awaitTermination()
    return t.spark.read.parquet(out).groupBy("index").agg(F.count("*").alias("n_labels"), F.max("is_long").alias("is_long"))


register(
    "l1_streamed_labels",
    _stream_labels,
    """SELECT doc_id AS "index", 1 AS n_labels, n_chars > 500 AS is_long FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)


def _tier_stream(t: Roles):
    """The tiers of enriched rows that arrive file by file, counted as they come."""
    path, out, checkpoint = (scratch(t, n) for n in ("tier-arrivals", "tier-out", "tier-checkpoint"))
    t.scripts.write.parquet(path)
    arrivals = t.spark.readStream.schema(t.scripts.schema).option("maxFilesPerTrigger", 2).parquet(path)
    incremental.tier_count_stream(arrivals, out, checkpoint).awaitTermination()
    return incremental.read_tier_counts(t.spark, out)


register(
    "l2_tier_counts",
    _tier_stream,
    with_ctes("SELECT relationship_tier, count(*) AS n_rows FROM scripts GROUP BY 1", "scripts"),
)

# --- sampling --------------------------------------------------------------------------------

register(
    "f5_seeded_sample",
    lambda t: t.ads.select("profile", "visit_id", "ad_hash").distinct().orderBy(
        F.md5(F.concat_ws("|", "profile", "visit_id", "ad_hash", F.lit("42")).cast("binary"))
    ).limit(20),
    with_ctes(
        "SELECT profile, visit_id, ad_hash FROM (SELECT DISTINCT profile, visit_id, ad_hash FROM ads) ORDER BY md5(concat_ws('|', profile, visit_id, ad_hash, '42')) LIMIT 20",
        "ads",
    ),
)

# --- review ----------------------------------------------------------------------------------


def _desc(t: Roles):
    """Documents as label records under review."""
    return t.table("documents").select(
        F.col("doc_id").alias("index"), profile_of("doc_id").alias("profile"), F.col("source").alias("category"), F.col("lang").alias("description")
    )


register(
    "m1_review_columns",
    lambda t: review.with_review_columns(_desc(t)).groupBy(
        "category", "viewed", "modified", "same_company", "old_category", "old_description", "notes"
    ).agg(F.count("*").alias("n")),
    "SELECT source AS category, false AS viewed, false AS modified, false AS same_company, '' AS old_category, '' AS old_description, '' AS notes, count(*) AS n FROM documents GROUP BY 1",
)


def _edits(t: Roles):
    """Conversation turns as edits: user turns mark the record, others only save it."""
    return t.table("conversations").select(
        F.col("conv_id").alias("index"),
        F.col("turn").alias("seq"),
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("category"),
        F.concat(F.lit("d"), F.length("text").cast("string")).alias("description"),
        (F.length("text") > 300).alias("same_company"),
        F.col("role").alias("notes"),
        ((F.col("role") == "user") & (F.col("turn") > 0)).alias("mark_modified"),
    )


register(
    "m2_apply_edits",
    lambda t: review.apply_edits(review.with_review_columns(_desc(t)), _edits(t)).drop("viewed"),
    """WITH e AS (SELECT conv_id AS i, turn AS seq, 'c'||turn AS category, 'd'||length(text) AS description, length(text) > 300 AS same_company, role AS notes, role = 'user' AND turn > 0 AS mark FROM conversations),
    rec AS (SELECT i, coalesce(min(seq) FILTER (mark), max(seq)) AS rec, max(seq) AS last, bool_or(mark) AS marked FROM e GROUP BY 1),
    prior AS (SELECT e.i, max(seq) AS seq FROM e JOIN rec USING (i) WHERE seq < rec GROUP BY 1)
    SELECT d.doc_id AS "index", list_extract(['automobile','building','furniture','household','machinery'], CAST(d.doc_id % 5 + 1 AS INTEGER)) AS profile,
      coalesce(l.category, d.source) AS category, coalesce(l.description, d.lang) AS description, coalesce(l.same_company, false) AS same_company, coalesce(l.notes, '') AS notes,
      coalesce(rec.marked, false) AS modified, CASE WHEN rec.i IS NULL THEN '' ELSE coalesce(p.category, d.source) END AS old_category, CASE WHEN rec.i IS NULL THEN '' ELSE coalesce(p.description, d.lang) END AS old_description
    FROM documents d LEFT JOIN rec ON rec.i = d.doc_id LEFT JOIN e l ON l.i = rec.i AND l.seq = rec.last LEFT JOIN prior ON prior.i = rec.i LEFT JOIN e p ON p.i = prior.i AND p.seq = prior.seq""",
)


def _viewed(t: Roles):
    return review.mark_viewed(
        review.with_review_columns(_desc(t)), t.table("labels").select(F.col("doc_id").alias("index"))
    )


register(
    "m3_next_unviewed",
    lambda t: review.next_unviewed(_viewed(t), 100),
    """SELECT coalesce(min(doc_id) FILTER (doc_id > 100), min(doc_id) FILTER (doc_id < 100)) AS next_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
register(
    "m3_mark_viewed",
    lambda t: _viewed(t).select("index", "viewed"),
    'SELECT doc_id AS "index", doc_id IN (SELECT doc_id FROM labels) AS viewed FROM documents',
)


def _reviewers(t: Roles):
    """Two reviewers: one saw the labelled documents, one the documents that have a vector."""
    base = _desc(t)
    labels = t.table("labels").select(F.col("doc_id").alias("index"), F.lit("True").alias("viewed"), (F.col("toxic") == 1).alias("modified"))
    vectors = t.table("embeddings").select(F.col("vec_id").alias("index"), F.lit(True).alias("viewed"), (F.col("label") > 6).alias("modified"))
    return [
        base.join(labels, "index", "left").withColumn("notes", F.lit("a")),
        base.join(vectors, "index", "left").withColumn("notes", F.lit("b")),
    ]


_MERGED = """SELECT "index", profile, category, description, true AS viewed, modified, notes, n_overlaps FROM (
      SELECT *, row_number() OVER (PARTITION BY "index" ORDER BY modified DESC, notes) AS r, count(*) OVER (PARTITION BY "index") - 1 AS n_overlaps FROM (
        SELECT d.doc_id AS "index", list_extract(['automobile','building','furniture','household','machinery'], CAST(d.doc_id % 5 + 1 AS INTEGER)) AS profile, source AS category, lang AS description, coalesce(toxic = 1, false) AS modified, 'a' AS notes FROM documents d JOIN labels l ON l.doc_id = d.doc_id
        UNION ALL SELECT d.doc_id, list_extract(['automobile','building','furniture','household','machinery'], CAST(d.doc_id % 5 + 1 AS INTEGER)), source, lang, label > 6, 'b' FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id)) WHERE r = 1"""
register("m4_e2_merged_reviews", lambda t: review.merge_reviews(_reviewers(t)), _MERGED)
register(
    "d58_review_summary",
    lambda t: review.review_summary(review.merge_reviews(_reviewers(t))),
    f"SELECT count(*) AS n_rows, count(*) FILTER (viewed) AS n_viewed, count(*) FILTER (modified) AS n_modified, 100.0 * count(*) FILTER (modified) / count(*) AS pct_modified FROM ({_MERGED})",
)
register(
    "d58_review_categories",
    lambda t: review.review_categories(review.merge_reviews(_reviewers(t))),
    f"SELECT category, count(*) AS n_rows FROM ({_MERGED}) GROUP BY 1",
)
