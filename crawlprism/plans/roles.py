"""The study's tables as projections of the fixture tables, for Spark and as SQL text.

A role (visits, requests, cookies, scripts, ads, …) is built twice: here from URLs and raw fields,
so that the operators do the domain, owner and tier work themselves, and in SQL straight from the
keys, so that the two sides agree only if that work is right.

As in a real study, the crawl tables and their enriched forms are written once (per application and
source folder, in the shared folder) and the analysis reads those Parquet tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crawlprism.config import CANVAS_READ_SYMBOLS, CANVAS_WRITE_SYMBOLS, PLATFORM_FLAGS, Study
from crawlprism.operators import enrich as E
from crawlprism.operators.fingerprint import PROBE_SYMBOLS
from crawlprism.operators.pixels import AD_CONTEXT_COLUMNS
from crawlprism.session import shared_dir, ship_package, tune
from crawlprism.sources.tagged import write_table

STUDY = Study(profiles=("automobile", "building", "furniture", "household", "machinery"))

UNRESOLVED_NATION = 24  # customers without a site URL: unknown tier
UNMAPPED_SUPPLIER_NATION = 23  # not in the entity tree: the domain is its own owner
UNMAPPED_CUSTOMER_NATIONS = (20, 21, 22)

# Request paths that fire a pixel, by l_partkey % 200.
PIXEL_URLS = (
    "https://www.facebook.com/tr/?id=1",
    "https://stats.g.doubleclick.net/activity;src=1",
    "https://www.googleadservices.com/pagead/conversion/1",
    "https://static.criteo.net/load/x",
    "https://analytics.tiktok.com/api/v2/pixel",
    "https://www.facebook.com/about",
    "https://bat.bing.com/bat.js",
)
AFFINITY = {
    "building": ("ECONOMY", "LARGE"),
    "furniture": ("SMALL",),
    "household": ("PROMO", "STANDARD", "MEDIUM"),
    "machinery": ("LARGE", "PROMO"),
    "automobile": (),
}
NOISE_TOPICS = ("topic 3",)


def padded(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 9, "0")


def page_host(c: str) -> Column:
    return F.concat(F.lit("www.customer"), padded(c), F.lit(".net"))


def profile_of(c: str) -> Column:
    names = F.array(*[F.lit(p) for p in STUDY.profiles])
    return F.element_at(names, (F.col(c) % len(STUDY.profiles) + 1).cast("int"))


_written: set[str] = set()


class Roles:
    """Lazily built role frames over one folder of fixture tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        ship_package(spark)
        self.folder = folder
        self.study = STUDY

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table of the study, written by the first query that needs it."""
        source = hashlib.sha1(self.folder.encode()).hexdigest()[:12]
        app = self.spark.sparkContext.applicationId
        path = f"{shared_dir(self.spark).rstrip('/')}/study-{app}-{source}/{name}"
        if path not in _written:
            write_table(build(), path, rebalance=False)
            _written.add(path)
        return self.spark.read.parquet(path)

    # --- visits and requests -----------------------------------------------------------------

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with their customer's profile: the visits, one column richer."""
        customer = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("profile"), "c_nationkey"
        )
        return self.table("orders").join(customer, "o_custkey")

    @cached_property
    def visits(self) -> DataFrame:
        return self.stored("site_visits", self._visits)

    def _visits(self) -> DataFrame:
        site = F.concat(F.lit("https://"), page_host("o_custkey"), F.lit("/"))
        return self.orders.select(
            "profile",
            F.col("o_orderkey").alias("visit_id"),
            F.when(F.col("c_nationkey") != UNRESOLVED_NATION, site).alias("site_url"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self._with_orders(self.table("lineitem"))

    def _with_orders(self, lines: DataFrame) -> DataFrame:
        orders = self.orders.select(
            F.col("o_orderkey").alias("l_orderkey"),
            "o_custkey",
            "o_orderdate",
            "o_orderpriority",
            "profile",
            "c_nationkey",
        )
        return lines.join(orders, "l_orderkey")

    @cached_property
    def requests(self) -> DataFrame:
        return self.stored("http_requests", self._requests)

    def _requests(self) -> DataFrame:
        # Line number and flag travel to the orders as one small number.
        n = F.col("l_linenumber")
        kind = F.when(n.isin(1, 3), n).when((n == 7) & (F.col("l_returnflag") == "N"), 7).when(n.isNotNull(), 0)
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", kind.cast("int").alias("kind")
        )
        scheme = F.when(F.col("kind") == 7, "wss://").otherwise("https://")
        host = F.when(F.col("kind") == 3, page_host("o_custkey")).otherwise(
            F.concat(F.lit("cdn.supplier"), padded("l_suppkey"), F.lit(".com"))
        )
        page = F.concat(F.lit("https://"), page_host("o_custkey"), F.lit("/"))
        no_context = (F.col("c_nationkey") == UNRESOLVED_NATION) | (F.col("kind") == 1)
        return self._with_orders(lines).select(
            "profile",
            F.col("l_orderkey").alias("visit_id"),
            F.concat(scheme, host, F.lit("/r/"), F.col("l_partkey").cast("string")).alias("url"),
            F.when(~no_context, page).alias("top_level_url"),
            F.col("l_partkey").alias("part"),
            F.col("l_quantity").alias("qty"),
        )

    @cached_property
    def tree(self) -> DataFrame:
        """The entity tree as path rows: inner nodes, then supplier and customer leaves."""
        region = self.table("region")
        nation = self.table("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        sub, par = F.col("n_name"), F.col("r_name")
        top = F.concat(F.lit("world/"), par)
        inner = nation.select(top.alias("path")).distinct().unionByName(
            nation.select(F.concat(top, F.lit("/"), sub).alias("path"))
        )
        supplier = (
            self.table("supplier")
            .where(F.col("s_nationkey") != UNMAPPED_SUPPLIER_NATION)
            .select(
                F.concat(F.lit("supplier"), padded("s_suppkey"), F.lit(".com")).alias("leaf"),
                F.col("s_nationkey").alias("n_nationkey"),
            )
        )
        customer = (
            self.table("customer")
            .where(~F.col("c_nationkey").isin(*UNMAPPED_CUSTOMER_NATIONS))
            .select(
                F.concat(F.lit("customer"), padded("c_custkey"), F.lit(".net")).alias("leaf"),
                F.col("c_nationkey").alias("n_nationkey"),
            )
        )
        leaves = (
            supplier.unionByName(customer)
            .join(nation, "n_nationkey")
            .select(
                F.concat(top, F.lit("/"), sub, F.lit("/"), F.col("leaf")).alias("path"),
                sub.alias("subsidiary_entity"),
                par.alias("parent_entity"),
            )
        )
        return leaves.unionByName(inner, allowMissingColumns=True)

    @cached_property
    def index(self) -> DataFrame:
        return self.stored("entity_index", self._index)

    def _index(self) -> DataFrame:
        return E.entity_index(self.tree)

    @cached_property
    def enriched(self) -> DataFrame:
        return self.stored("http_requests_enriched", self._enriched)

    def _enriched(self) -> DataFrame:
        return E.enrich(
            self.requests, self.index, self.visits, domain_column="url", context_column="top_level_url"
        )

    # --- cookies -----------------------------------------------------------------------------

    @cached_property
    def cookies(self) -> DataFrame:
        return self.stored("javascript_cookies", self._cookies)

    def _cookies(self) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
        host = F.when(F.col("l_linenumber") == 3, page_host("o_custkey")).otherwise(
            F.concat(F.lit(".supplier"), padded("l_suppkey"), F.lit(".com"))
        )
        value = F.when(F.col("l_linenumber") == 2, F.col("p_name")).otherwise(
            F.concat(F.lit("sync_id_"), F.col("p_type"))
        )
        return self.lines.join(part, "l_partkey").select(
            "profile",
            F.col("l_orderkey").alias("visit_id"),
            host.alias("host"),
            value.alias("value"),
            F.when(F.col("l_linenumber") != 7, F.col("l_shipdate")).alias("expiry"),
            F.col("o_orderdate").alias("time_stamp"),
            F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), 1)
            .otherwise(0)
            .alias("is_session"),
        )

    @cached_property
    def cookies_enriched(self) -> DataFrame:
        return self.stored("javascript_cookies_enriched", self._cookies_enriched)

    def _cookies_enriched(self) -> DataFrame:
        return E.enrich(self.cookies, self.index, self.visits, domain_column="host")

    # --- script calls ------------------------------------------------------------------------

    @cached_property
    def script_calls(self) -> DataFrame:
        return self.stored("javascript", self._script_calls)

    def _script_calls(self) -> DataFrame:
        probes = F.array(*[F.lit(s) for s in PROBE_SYMBOLS])
        kind, even = F.col("event_type"), F.col("event_id") % 2 == 0
        symbol = (
            F.when(kind == "click", CANVAS_WRITE_SYMBOLS[0])
            .when(kind == "view", CANVAS_READ_SYMBOLS[0])
            .when((kind == "purchase") & even, "AudioContext.createOscillator")
            .when(kind == "purchase", "AudioBuffer.getChannelData")
            .otherwise(F.element_at(probes, (F.col("event_id") % len(PROBE_SYMBOLS) + 1).cast("int")))
        )
        return self.table("events").select(
            profile_of("user_id").alias("profile"),
            (F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)).alias("visit_id"),
            F.concat(
                F.lit("https://js.supplier"),
                F.lpad((F.col("user_id") % 100).cast("string"), 9, "0"),
                F.lit(".com/s.js"),
            ).alias("script_url"),
            F.concat(F.lit("https://"), page_host("user_id"), F.lit("/")).alias("top_level_url"),
            symbol.alias("symbol"),
        )

    @cached_property
    def script_visits(self) -> DataFrame:
        return self.stored("script_site_visits", self._script_visits)

    def _script_visits(self) -> DataFrame:
        return self.script_calls.select(
            "profile", "visit_id", F.col("top_level_url").alias("site_url")
        ).distinct()

    @cached_property
    def scripts(self) -> DataFrame:
        return self.stored("javascript_enriched", self._scripts)

    def _scripts(self) -> DataFrame:
        return E.enrich(
            self.script_calls,
            self.index,
            self.script_visits,
            domain_column="script_url",
            context_column="top_level_url",
        )

    # --- ads ---------------------------------------------------------------------------------

    @cached_property
    def ads(self) -> DataFrame:
        return self.stored("ads_enriched", self._ads)

    def _ads(self) -> DataFrame:
        """Ads with their label record already attached."""
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand", "p_size"
        )
        n, q = F.col("l_linenumber"), F.col("l_quantity")
        # What flags, tax and priority say travels as one small number: to the orders, then to the parts.
        flag, status, tax = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_tax")
        valid = F.when((flag == "N") & (status == "F"), 0).when((flag == "A") & (status == "O"), 1).otherwise(2)
        same = F.when(tax < 0.005, 2).when(tax < 0.015, 1).otherwise(0)
        state = valid + 3 * same + 9 * F.when(status == "O", 1).otherwise(0)
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", state.alias("state")
        )
        priority = F.substring("o_orderpriority", 1, 1)
        level = F.when(priority.isin("1", "2"), 2).when(priority == "3", 1).otherwise(0)
        lines = self._with_orders(lines).select(
            "profile", "o_custkey", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
            (F.col("state") + 18 * level).alias("state"),
        )
        said = lambda base, size: F.floor(F.col("state") / base) % size
        sizes = {1: (728, 90), 2: (300, 250), 3: (160, 600), 4: (50, 50), 5: (600, 500)}
        width, height = F.when(n == 0, 0.0), F.when(n == 0, 0.0)
        for k, (w, h) in sizes.items():
            width, height = width.when(n == k, float(w)), height.when(n == k, float(h))
        ten = F.col("l_suppkey") % 10
        return lines.join(part, "l_partkey").select(
            "profile",
            F.col("l_orderkey").alias("visit_id"),
            F.concat(F.lit("https://"), page_host("o_custkey"), F.lit("/")).alias("page_url"),
            F.when(n == 5, F.concat(F.lit("ad_p"), F.col("l_partkey").cast("string")))
            .otherwise(F.concat(F.lit("ad"), F.col("l_orderkey").cast("string"), F.lit("_"), n.cast("string")))
            .alias("ad_hash"),
            F.when(ten == 8, "unknown")
            .when(ten < 8, F.concat(F.lit("net_"), ten.cast("string")))
            .alias("advertiser_network"),
            F.concat(F.lit("net_"), (F.col("l_suppkey") % 7).cast("string")).alias("capture_network"),
            (ten == F.col("l_suppkey") % 7).alias("networks_agree"),
            F.when(said(18, 3) == 2, "high").when(said(18, 3) == 1, "medium").otherwise("low").alias("confidence"),
            F.when(q < 3, None).when(q < 5, " None ").otherwise(F.concat(F.lit(" "), F.col("p_type"))).alias("category"),
            F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("brand"),
            F.when(F.col("p_size") <= 45, F.col("p_name")).alias("product"),
            width.otherwise(F.col("p_size") * 10.0).alias("ad_width"),
            height.otherwise(q * 10.0).alias("ad_height"),
            F.round(F.col("l_discount") * 1000).alias("ad_x"),
            (n * 200.0).alias("ad_y"),
            F.when(said(1, 3) == 0, None).otherwise(said(1, 3) == 2).alias("is_valid_ad"),
            F.when(said(3, 3) > 0, said(3, 3) == 2).alias("same_company"),
            F.when(said(9, 2) == 1, "high").otherwise("medium").alias("vlm_confidence"),
            (n <= 5).alias("has_screenshot"),
            F.length("p_name").cast("long").alias("ocr_char_count"),
            F.col("p_name").alias("ocr_text"),
        )

    @cached_property
    def doc_ads(self) -> DataFrame:
        return self.stored("ads", self._doc_ads)

    def _doc_ads(self) -> DataFrame:
        """Documents as ads with text."""
        return self.table("documents").select(
            profile_of("doc_id").alias("profile"),
            F.col("doc_id").alias("visit_id"),
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("ad_hash"),
            F.col("source").alias("page_url"),
            F.col("lang").alias("advertiser_network"),
            F.when(F.col("lang") == "de", "medium").otherwise("high").alias("confidence"),
            F.col("text").alias("ocr_text"),
            F.col("n_chars").alias("ocr_char_count"),
        )

    @cached_property
    def labelled_docs(self) -> DataFrame:
        """Documents with review labels: no label, invalid (quality 0) or valid."""
        labels = self.table("labels")
        return self.table("documents").join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("index"),
            profile_of("doc_id").alias("profile"),
            (F.col("quality") == 1).alias("is_valid_ad"),
            (F.col("toxic") == 1).alias("same_company"),
            F.when(F.col("lang") == "de", "medium").otherwise("high").alias("confidence"),
            F.col("source").alias("category"),
        )

    # --- pixels ------------------------------------------------------------------------------

    @cached_property
    def pixel_requests(self) -> DataFrame:
        slot = F.col("part") % 200
        url = F.when(slot == 0, PIXEL_URLS[0])
        for i, u in enumerate(PIXEL_URLS[1:], 1):
            url = url.when(slot == i, u)
        return self.enriched.withColumn("url", url.otherwise(F.col("url")))

    @cached_property
    def hits(self) -> DataFrame:
        return self.stored("pixel_hits", self._hits)

    def _hits(self) -> DataFrame:
        from crawlprism.operators.pixels import pixel_hits

        return pixel_hits(self.pixel_requests)

    @cached_property
    def sites(self) -> DataFrame:
        from crawlprism.config import DEFAULT_TARGET_PIXELS
        from crawlprism.operators.pixels import site_pixels

        return site_pixels(
            self.hits, targets=DEFAULT_TARGET_PIXELS, require_path=True, only_third_party=True
        )

    @cached_property
    def seeded(self) -> DataFrame:
        """Hits with a Criteo or Microsoft pixel stand for the seeding crawl."""
        from crawlprism.operators.pixels import seeded_site_pixels

        return seeded_site_pixels(
            self.hits.withColumnRenamed("profile", "persona"), targets=("Criteo", "Microsoft UET")
        )

    @cached_property
    def context(self) -> DataFrame:
        return self.stored("ads_with_context", self._context)

    def _context(self) -> DataFrame:
        from crawlprism.operators.pixels import ads_with_pixel_context, page_owners

        ads = self.ads.withColumn("category", F.trim("category"))
        return ads_with_pixel_context(ads, page_owners(self.enriched), self.sites, self.seeded)

    @cached_property
    def scored(self) -> DataFrame:
        from crawlprism.operators.pixels import score_ads

        return score_ads(self.context, AFFINITY)


# --- the same roles as SQL -----------------------------------------------------------------------

_HOSTED = "'https://www.customer'||lpad(CAST({} AS VARCHAR),9,'0')||'.net/'"
_PROFILES = ", ".join(f"'{p}'" for p in STUDY.profiles)
_PROBES = ", ".join(f"'{s}'" for s in PROBE_SYMBOLS)
_PIXEL_CASE = " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(PIXEL_URLS))
_PIXEL_LABELS = {
    0: "Meta Pixel", 1: "DoubleClick", 2: "Google Ads Conversion", 3: "Criteo", 4: "TikTok Pixel",
    6: "Microsoft UET",
}
_PIXEL_DOMAINS = {
    0: "facebook.com", 1: "stats.g.doubleclick.net", 2: "googleadservices.com",
    3: "static.criteo.net", 4: "analytics.tiktok.com", 6: "bat.bing.com",
}


def case_of(expr: str, table: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + " END"


# name -> (SQL, names it reads)
def _context_sql() -> str:
    """The operator's output columns, one by one: those of the ad, then the site's with their defaults."""
    of_site = {"site_has_pixel": "has_pixel", "site_pixel_hits": "n_pixel_hits", "site_distinct_pixels": "n_distinct_pixel_types",
               "site_tracker_entities": "distinct_tracker_entities", "site_pixel_types": "pixel_types"}
    of_site |= {f"site_{flag}": flag for flag in PLATFORM_FLAGS}
    missing = {"has_pixel": "false", "pixel_types": "NULL"} | {c: "0" for c in of_site.values() if c.startswith(("n_", "distinct_"))}
    columns = [
        "trim(category) AS category" if c == "category" else c for c in AD_CONTEXT_COLUMNS
    ]
    columns += [f"coalesce(s.{c}, {missing.get(c, 'false')}) AS {name}" for name, c in of_site.items()]
    columns += ["z.has_pixel IS NOT NULL AS site_was_seeded_with_pixel", "z.pixel_types AS seeded_pixel_types"]
    owned = "(SELECT * EXCLUDE (top_level_url) FROM ads LEFT JOIN page_owner ON top_level_url = page_url WHERE is_valid_ad AND category IS NOT NULL AND coalesce(NOT same_company, true)) a"
    site = "ON (a.profile, page_parent_entity) = ({0}.{1}, {0}.top_level_parent_entity)"
    return (
        f"SELECT {', '.join(f'a.{c}' if c in ('profile',) else c for c in columns)} FROM {owned} "
        f"LEFT JOIN sites s {site.format('s', 'profile')} LEFT JOIN seeded z {site.format('z', 'persona')}"
    )


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "profiles": (
        "SELECT unnest([" + _PROFILES + f"]) AS profile, unnest(range({len(STUDY.profiles)})) AS ord",
        (),
    ),
    "visits": (
        f"""SELECT lower(c_mktsegment) AS profile, o_orderkey AS visit_id,
      CASE WHEN c_nationkey <> {UNRESOLVED_NATION} THEN {_HOSTED.format('o_custkey')} END AS site_url
    FROM orders JOIN customer ON o_custkey = c_custkey""",
        (),
    ),
    "base": (
        f"""SELECT l.*, o_custkey, o_orderdate, o_orderpriority, lower(c_mktsegment) AS profile, c_nationkey,
      'customer'||lpad(CAST(o_custkey AS VARCHAR),9,'0')||'.net' AS page_domain,
      'supplier'||lpad(CAST(l_suppkey AS VARCHAR),9,'0')||'.com' AS supp_domain,
      CASE WHEN c_nationkey IN {UNMAPPED_CUSTOMER_NATIONS} THEN 'customer'||lpad(CAST(o_custkey AS VARCHAR),9,'0')||'.net' ELSE cn.n_name END AS page_sub,
      CASE WHEN c_nationkey IN {UNMAPPED_CUSTOMER_NATIONS} THEN 'customer'||lpad(CAST(o_custkey AS VARCHAR),9,'0')||'.net' ELSE cr.r_name END AS page_par,
      CASE WHEN s_nationkey = {UNMAPPED_SUPPLIER_NATION} THEN 'supplier'||lpad(CAST(l_suppkey AS VARCHAR),9,'0')||'.com' ELSE sn.n_name END AS supp_sub,
      CASE WHEN s_nationkey = {UNMAPPED_SUPPLIER_NATION} THEN 'supplier'||lpad(CAST(l_suppkey AS VARCHAR),9,'0')||'.com' ELSE sr.r_name END AS supp_par
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region cr ON cr.r_regionkey = cn.n_regionkey
    JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN region sr ON sr.r_regionkey = sn.n_regionkey""",
        (),
    ),
    "tiered": (
        f"""SELECT *, CASE WHEN c_nationkey = {UNRESOLVED_NATION} THEN 'unknown'
        WHEN dom = page_domain OR sub = page_sub THEN 'first-party'
        WHEN par = page_par THEN 'inter-family third-party' ELSE 'external third-party' END AS tier,
      CASE WHEN c_nationkey = {UNRESOLVED_NATION} THEN NULL WHEN dom = page_domain THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS tech
    FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN page_domain ELSE supp_domain END AS dom,
        CASE WHEN l_linenumber = 3 THEN page_sub ELSE supp_sub END AS sub,
        CASE WHEN l_linenumber = 3 THEN page_par ELSE supp_par END AS par FROM base)""",
        ("base",),
    ),
    "enriched": (
        f"""SELECT profile, l_orderkey AS visit_id,
      CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN 'wss://' ELSE 'https://' END
        || CASE WHEN l_linenumber = 3 THEN 'www.' ELSE 'cdn.' END || dom || '/r/' || l_partkey AS url,
      CASE WHEN c_nationkey <> {UNRESOLVED_NATION} AND l_linenumber <> 1 THEN 'https://www.'||page_domain||'/' END AS top_level_url,
      l_partkey AS part, l_quantity AS qty, dom AS domain,
      CASE WHEN tier = 'unknown' THEN '' ELSE sub END AS subsidiary_entity,
      CASE WHEN tier = 'unknown' THEN '' ELSE par END AS parent_entity,
      tier AS relationship_tier, tech AS is_technical_3p FROM tiered""",
        ("tiered",),
    ),
    "trackers": (
        "SELECT * FROM enriched WHERE url LIKE 'http%' AND relationship_tier NOT IN ('first-party','unknown')",
        ("enriched",),
    ),
    "tp": (
        "SELECT * FROM enriched WHERE relationship_tier IN ('inter-family third-party','external third-party')",
        ("enriched",),
    ),
    "cookies": (
        """SELECT profile, l_orderkey AS visit_id,
      CASE WHEN l_linenumber = 3 THEN 'www.'||page_domain ELSE '.'||supp_domain END AS host,
      CASE WHEN l_linenumber = 2 THEN p_name ELSE 'sync_id_'||p_type END AS value,
      CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS expiry, o_orderdate AS time_stamp,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END AS is_session,
      dom AS domain, CASE WHEN tier = 'unknown' THEN '' ELSE sub END AS subsidiary_entity,
      CASE WHEN tier = 'unknown' THEN '' ELSE par END AS parent_entity, tier AS relationship_tier
    FROM tiered JOIN part ON p_partkey = l_partkey""",
        ("tiered",),
    ),
    "tp_cookies": (
        "SELECT * FROM cookies WHERE relationship_tier IN ('inter-family third-party','external third-party')",
        ("cookies",),
    ),
    "script_calls": (
        f"""SELECT list_extract([{_PROFILES}], CAST(user_id % {len(STUDY.profiles)} + 1 AS INTEGER)) AS profile,
      user_id * 10 + (day(ts) - 1) // 7 AS visit_id,
      'https://js.supplier'||lpad(CAST(user_id % 100 AS VARCHAR),9,'0')||'.com/s.js' AS script_url,
      {_HOSTED.format('user_id')} AS top_level_url,
      CASE WHEN event_type = 'click' THEN '{CANVAS_WRITE_SYMBOLS[0]}'
        WHEN event_type = 'view' THEN '{CANVAS_READ_SYMBOLS[0]}'
        WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'AudioContext.createOscillator'
        WHEN event_type = 'purchase' THEN 'AudioBuffer.getChannelData'
        ELSE list_extract([{_PROBES}], CAST(event_id % {len(PROBE_SYMBOLS)} + 1 AS INTEGER)) END AS symbol,
      user_id, user_id % 100 AS suppkey FROM events""",
        (),
    ),
    "scripts": (
        f"""SELECT *, CASE WHEN sub = page_sub THEN 'first-party'
        WHEN par = page_par THEN 'inter-family third-party' ELSE 'external third-party' END AS relationship_tier,
        sub AS subsidiary_entity, par AS parent_entity FROM (
      SELECT e.*, 'supplier'||lpad(CAST(suppkey AS VARCHAR),9,'0')||'.com' AS domain,
        CASE WHEN s_suppkey IS NULL OR s_nationkey = {UNMAPPED_SUPPLIER_NATION} THEN 'supplier'||lpad(CAST(suppkey AS VARCHAR),9,'0')||'.com' ELSE sn.n_name END AS sub,
        CASE WHEN s_suppkey IS NULL OR s_nationkey = {UNMAPPED_SUPPLIER_NATION} THEN 'supplier'||lpad(CAST(suppkey AS VARCHAR),9,'0')||'.com' ELSE sr.r_name END AS par,
        CASE WHEN c_custkey IS NULL OR c_nationkey IN {UNMAPPED_CUSTOMER_NATIONS} THEN 'customer'||lpad(CAST(user_id AS VARCHAR),9,'0')||'.net' ELSE cn.n_name END AS page_sub,
        CASE WHEN c_custkey IS NULL OR c_nationkey IN {UNMAPPED_CUSTOMER_NATIONS} THEN 'customer'||lpad(CAST(user_id AS VARCHAR),9,'0')||'.net' ELSE cr.r_name END AS page_par
      FROM script_calls e LEFT JOIN supplier ON s_suppkey = suppkey
      LEFT JOIN nation sn ON sn.n_nationkey = s_nationkey LEFT JOIN region sr ON sr.r_regionkey = sn.n_regionkey
      LEFT JOIN customer ON c_custkey = user_id
      LEFT JOIN nation cn ON cn.n_nationkey = c_nationkey LEFT JOIN region cr ON cr.r_regionkey = cn.n_regionkey)""",
        ("script_calls",),
    ),
    "tp_scripts": (
        "SELECT * FROM scripts WHERE relationship_tier IN ('inter-family third-party','external third-party')",
        ("scripts",),
    ),
    "ads": (
        """SELECT profile, l_orderkey AS visit_id, 'https://www.'||page_domain||'/' AS page_url,
      CASE WHEN l_linenumber = 5 THEN 'ad_p'||l_partkey ELSE 'ad'||l_orderkey||'_'||l_linenumber END AS ad_hash,
      CASE WHEN l_suppkey % 10 = 8 THEN 'unknown' WHEN l_suppkey % 10 < 8 THEN 'net_'||(l_suppkey % 10) END AS advertiser_network,
      'net_'||(l_suppkey % 7) AS capture_network, l_suppkey % 10 = l_suppkey % 7 AS networks_agree,
      CASE WHEN o_orderpriority[1] IN ('1','2') THEN 'high' WHEN o_orderpriority[1] = '3' THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 5 THEN ' None ' ELSE ' '||p_type END AS category,
      CASE WHEN p_size <= 45 THEN p_brand END AS brand, CASE WHEN p_size <= 45 THEN p_name END AS product,
      CAST(CASE l_linenumber WHEN 1 THEN 728 WHEN 2 THEN 300 WHEN 3 THEN 160 WHEN 4 THEN 50 WHEN 5 THEN 600 ELSE p_size * 10 END AS DOUBLE) AS ad_width,
      CAST(CASE l_linenumber WHEN 1 THEN 90 WHEN 2 THEN 250 WHEN 3 THEN 600 WHEN 4 THEN 50 WHEN 5 THEN 500 ELSE l_quantity * 10 END AS DOUBLE) AS ad_height,
      round(l_discount * 1000) AS ad_x, l_linenumber * 200.0::DOUBLE AS ad_y,
      CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN NULL WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN false ELSE true END AS is_valid_ad,
      CASE WHEN l_tax < 0.005 THEN true WHEN l_tax < 0.015 THEN false END AS same_company,
      CASE WHEN l_linestatus = 'O' THEN 'high' ELSE 'medium' END AS vlm_confidence,
      l_linenumber <= 5 AS has_screenshot, length(p_name) AS ocr_char_count, p_name AS ocr_text
    FROM base JOIN part ON p_partkey = l_partkey""",
        ("base",),
    ),
    "valid_ads": (
        "SELECT * FROM ads WHERE is_valid_ad = true AND confidence IN ('high')",
        ("ads",),
    ),
    "content_ads": (
        """SELECT * FROM valid_ads WHERE category IS NOT NULL AND same_company IS NOT TRUE
      AND TRIM(category) <> '' AND TRIM(category) <> 'None'""",
        ("valid_ads",),
    ),
    "doc_ads": (
        f"""SELECT list_extract([{_PROFILES}], CAST(doc_id % {len(STUDY.profiles)} + 1 AS INTEGER)) AS profile,
      doc_id AS visit_id, 'doc'||doc_id AS ad_hash, source AS page_url, lang AS advertiser_network,
      CASE WHEN lang = 'de' THEN 'medium' ELSE 'high' END AS confidence, text AS ocr_text, n_chars AS ocr_char_count
    FROM documents""",
        (),
    ),
    "labelled_docs": (
        f"""SELECT d.doc_id AS "index", list_extract([{_PROFILES}], CAST(d.doc_id % {len(STUDY.profiles)} + 1 AS INTEGER)) AS profile,
      quality = 1 AS is_valid_ad, toxic = 1 AS same_company,
      CASE WHEN lang = 'de' THEN 'medium' ELSE 'high' END AS confidence, source AS category
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
        (),
    ),
    "hits": (
        f"""SELECT e.profile, visit_id, e.top_level_url,
      CASE part % 200 {_PIXEL_CASE} END AS request_url, {case_of('part % 200', _PIXEL_LABELS)} AS pixel_type,
      {case_of('part % 200', _PIXEL_DOMAINS)} AS matched_domain, true AS path_confirmed,
      parent_entity AS request_parent_entity, subsidiary_entity AS request_subsidiary_entity,
      relationship_tier, is_technical_3p, owner AS top_level_parent_entity
    FROM enriched e LEFT JOIN (
      SELECT profile, top_level_url, coalesce(min(CASE WHEN domain = replace(replace(top_level_url,'https://www.',''),'/','') THEN parent_entity END), min(parent_entity)) AS owner
      FROM enriched WHERE top_level_url IS NOT NULL AND parent_entity <> '' GROUP BY profile, top_level_url) p
      ON p.profile = e.profile AND p.top_level_url = e.top_level_url
    WHERE part % 200 IN (0,1,2,3,4,6)""",
        ("enriched",),
    ),
    "sites": (
        """SELECT profile, top_level_parent_entity, true AS has_pixel, count(*) AS n_pixel_hits,
      count(DISTINCT pixel_type) AS n_distinct_pixel_types,
      string_agg(DISTINCT pixel_type, ', ' ORDER BY pixel_type) AS pixel_types,
      count(DISTINCT request_parent_entity) AS distinct_tracker_entities,
      bool_or(u.has_meta) AS has_meta, bool_or(u.has_tiktok) AS has_tiktok, bool_or(u.has_doubleclick) AS has_doubleclick,
      bool_or(u.has_google_ads) AS has_google_ads, bool_or(u.has_criteo) AS has_criteo
    FROM hits JOIN (SELECT profile, top_level_parent_entity, bool_or(pixel_type = 'Meta Pixel') AS has_meta,
      bool_or(pixel_type = 'TikTok Pixel') AS has_tiktok, bool_or(pixel_type = 'DoubleClick') AS has_doubleclick,
      bool_or(pixel_type = 'Google Ads Conversion') AS has_google_ads, bool_or(pixel_type = 'Criteo') AS has_criteo
      FROM hits GROUP BY profile, top_level_parent_entity) u USING (profile, top_level_parent_entity)
    WHERE top_level_parent_entity IS NOT NULL AND request_parent_entity IS NOT NULL
      AND top_level_parent_entity <> request_parent_entity GROUP BY profile, top_level_parent_entity""",
        ("hits",),
    ),
    "seeded": (
        """SELECT profile AS persona, top_level_parent_entity, true AS has_pixel, count(*) AS n_pixel_hits,
      count(DISTINCT pixel_type) AS n_distinct_pixel_types,
      string_agg(DISTINCT pixel_type, ', ' ORDER BY pixel_type) AS pixel_types,
      count(DISTINCT request_parent_entity) AS distinct_tracker_entities
    FROM hits WHERE pixel_type IN ('Criteo','Microsoft UET') AND top_level_parent_entity IS NOT NULL
    GROUP BY profile, top_level_parent_entity""",
        ("hits",),
    ),
    "page_owner": (
        """SELECT top_level_url, coalesce(min(CASE WHEN domain = replace(replace(top_level_url,'https://www.',''),'/','') THEN parent_entity END), min(parent_entity)) AS page_parent_entity
    FROM enriched WHERE top_level_url IS NOT NULL AND parent_entity <> '' GROUP BY top_level_url""",
        ("enriched",),
    ),
    "context": (_context_sql(), ("ads", "page_owner", "sites", "seeded")),
    "affinity": (
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{p}','{c}')" for p, cats in AFFINITY.items() for c in cats)
        + ") t(profile, on_target_category)",
        (),
    ),
    "scored": (
        """SELECT c.*, a.on_target_category IS NOT NULL AS is_on_target FROM context c
    LEFT JOIN affinity a ON a.profile = c.profile AND a.on_target_category = c.category""",
        ("context", "affinity"),
    ),
}


def with_ctes(body: str, *names: str, extra: str = "") -> str:
    """A query over the named roles, with everything they read defined first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][1]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][0]})" for n in ordered]
    if extra:
        parts.append(extra)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
