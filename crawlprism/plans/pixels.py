"""Advertising pixels and what they say about the ads shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlprism.config import INTENSITY_BUCKETS
from crawlprism.functions.columns import intensity_bucket
from crawlprism.functions.labels import with_pixel
from crawlprism.operators import pixels, reports, stats
from crawlprism.plans.registry import register
from crawlprism.plans.roles import with_ctes

_SITE_COLUMNS = (
    "profile, top_level_parent_entity, has_pixel, n_pixel_hits, n_distinct_pixel_types, pixel_types, "
    "distinct_tracker_entities, has_meta, has_tiktok, has_doubleclick, has_google_ads, has_criteo"
)
_RULES = (("example.com", 1), ("example.net", 2), ("example.org", 3))

register(
    "d35_c7_pixel_hits",
    lambda t: t._hits(),
    with_ctes("SELECT * FROM hits", "hits"),
)
register(
    "b17_classify_pixel",
    lambda t: with_pixel(t.pixel_requests, "url", "p")
    .where(F.col("p").isNotNull())
    .groupBy("p.pixel_type", "p.matched_domain", "p.pattern")
    .agg(F.count("*").alias("n_hits")),
    with_ctes(
        r"""SELECT pixel_type, matched_domain, CASE pixel_type WHEN 'Meta Pixel' THEN '/tr/?(\?|$)' WHEN 'DoubleClick' THEN '/activity'
      WHEN 'Google Ads Conversion' THEN '/pagead/conversion' WHEN 'Criteo' THEN '/load/' WHEN 'TikTok Pixel' THEN '/api/v2/pixel' ELSE '/bat\.js' END AS pattern, count(*) AS n_hits
    FROM hits GROUP BY 1, 2, 3""",
        "hits",
    ),
)
_PAGE_RULES = (
    ("Paged", ("example.com", "example.net"), (r"[?&]page=\d+",)),
    ("Campaign", ("example.com", "example.org"), (r"utm_source=",)),
    ("English", ("example.org",), (r"/en/",)),
)
register(
    "b17_classify_pages",
    lambda t: with_pixel(t.table("pages").select("page_id", "url"), "url", "p", _PAGE_RULES).select(
        "page_id", F.col("p.pixel_type").alias("label")
    ),
    r"""SELECT page_id, CASE WHEN regexp_matches(h, 'example\.(com|net)$') AND regexp_matches(url, '[?&]page=\d+') THEN 'Paged'
      WHEN regexp_matches(h, 'example\.(com|org)$') AND contains(url, 'utm_source=') THEN 'Campaign'
      WHEN regexp_matches(h, 'example\.org$') AND contains(url, '/en/') THEN 'English' END AS label
    FROM (SELECT *, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS h FROM pages)""",
)
register(
    "c19_host_suffix_match",
    lambda t: pixels.match_rule_domains(
        t.table("pages").select("page_id", "url"),
        "url",
        t.spark.createDataFrame(list(_RULES), "rule_domain string, rule_id int"),
    ),
    """SELECT page_id, url, rule_domain, rule_id FROM pages JOIN (VALUES ('example.com',1),('example.net',2),('example.org',3)) r(rule_domain, rule_id)
      ON ends_with('.'||lower(regexp_extract(url, '://([^/?#:]+)', 1)), '.'||rule_domain)""",
)
register("d36_d38_site_pixels", lambda t: t.sites, with_ctes(f"SELECT {_SITE_COLUMNS} FROM sites", "sites"))
register(
    "d36_site_pixels_unfiltered",
    lambda t: pixels.site_pixels(t.hits).select("profile", "top_level_parent_entity", "n_pixel_hits", "pixel_types"),
    with_ctes(
        "SELECT profile, top_level_parent_entity, count(*) AS n_pixel_hits, string_agg(DISTINCT pixel_type, ', ' ORDER BY pixel_type) AS pixel_types FROM hits WHERE top_level_parent_entity IS NOT NULL GROUP BY 1, 2",
        "hits",
    ),
)
register(
    "d36_site_pixels_by_tier",
    lambda t: pixels.site_pixels(t.hits, tiers=("inter-family third-party",), targets=("Meta Pixel", "Criteo")).select(
        "profile", "top_level_parent_entity", "n_pixel_hits", "has_tiktok"
    ),
    with_ctes(
        """SELECT profile, top_level_parent_entity, count(*) FILTER (relationship_tier = 'inter-family third-party' AND pixel_type IN ('Meta Pixel','Criteo')) AS n_pixel_hits,
      bool_or(pixel_type = 'TikTok Pixel') AS has_tiktok FROM hits WHERE top_level_parent_entity IS NOT NULL GROUP BY 1, 2 HAVING n_pixel_hits > 0""",
        "hits",
    ),
)
register(
    "d37_named_site_pixels",
    lambda t: pixels.named_site_pixels(t.hits, "measured").select(
        "crawl_name", "top_level_parent_entity", "n_pixel_hits", "n_distinct_pixel_types", "distinct_tracker_entities"
    ),
    with_ctes(
        "SELECT 'measured' AS crawl_name, top_level_parent_entity, count(*) AS n_pixel_hits, count(DISTINCT pixel_type) AS n_distinct_pixel_types, count(DISTINCT request_parent_entity) AS distinct_tracker_entities FROM hits WHERE top_level_parent_entity IS NOT NULL GROUP BY 2",
        "hits",
    ),
)
register(
    "d38_pixel_coverage",
    lambda t: pixels.pixel_coverage(
        t.sites,
        t.enriched.where(F.col("top_level_url").isNotNull())
        .join(pixels.page_owners(t.enriched), "top_level_url")
        .select("profile", "page_parent_entity")
        .distinct(),
    ),
    with_ctes(
        """SELECT n_with_pixel, n_sites, 100.0 * n_with_pixel / n_sites AS pct, 100.0 * n_with_pixel / n_sites < 5 OR 100.0 * n_with_pixel / n_sites > 95 AS suspicious
    FROM (SELECT count(*) AS n_with_pixel FROM sites), (SELECT count(*) AS n_sites FROM (SELECT DISTINCT profile, page_parent_entity FROM enriched JOIN page_owner USING (top_level_url)))""",
        "sites",
        "page_owner",
    ),
)
register(
    "d39_seeded_pixels",
    lambda t: t.seeded.select(
        "persona", "top_level_parent_entity", "has_pixel", "n_pixel_hits", "n_distinct_pixel_types", "pixel_types", "distinct_tracker_entities"
    ),
    with_ctes("SELECT * FROM seeded", "seeded"),
)
register("d40_c8_ads_with_pixel_context", lambda t: t.context, with_ctes("SELECT * FROM context", "context"))
register("d41_c9_ads_scored", lambda t: t.scored.select("profile", "visit_id", "ad_hash", "category", "is_on_target"), with_ctes("SELECT profile, visit_id, ad_hash, category, is_on_target FROM scored", "scored"))
_BY_PIXEL = """SELECT profile, category, site_has_pixel, n_ads, 100.0 * n_ads / sum(n_ads) OVER (PARTITION BY profile, site_has_pixel) AS pct_within_group
    FROM (SELECT profile, category, site_has_pixel, count(*) AS n_ads FROM context GROUP BY 1, 2, 3)"""
register("d42_category_by_pixel", lambda t: pixels.category_by_pixel(t.context), with_ctes(_BY_PIXEL, "context"))
_UNPIVOT = """u AS (SELECT *, platform, present FROM {0}, LATERAL (VALUES ('Meta', site_has_meta), ('DoubleClick', site_has_doubleclick),
      ('Google Ads', site_has_google_ads), ('Criteo', site_has_criteo), ('TikTok', site_has_tiktok)) v(platform, present))"""
_BY_PLATFORM = """SELECT profile, platform, category, count(*) FILTER (present) AS n_ads_with_platform, count(*) FILTER (NOT present) AS n_ads_without_platform FROM u GROUP BY 1, 2, 3"""
register(
    "d43_category_by_platform",
    lambda t: pixels.category_by_platform(t.context),
    with_ctes(_BY_PLATFORM, "context", extra=_UNPIVOT.format("context")),
)
register(
    "h2_unpivot_platforms",
    lambda t: pixels.by_platform(t.context, ["profile", "ad_hash"]).groupBy("profile", "platform", "present").agg(F.count("*").alias("n")),
    with_ctes("SELECT profile, platform, present, count(*) AS n FROM u GROUP BY 1, 2, 3", "context", extra=_UNPIVOT.format("context")),
)
_ACCURACY = """SELECT profile, site_has_pixel, count(*) AS n_ads, count(*) FILTER (is_on_target) AS n_on_target, 100.0 * (count(*) FILTER (is_on_target) / count(*)) AS pct_on_target FROM scored GROUP BY 1, 2"""
register(
    "d44_targeting_accuracy",
    lambda t: pixels.targeting_accuracy(t.scored).withColumn("targeting_lift", F.round("targeting_lift", 9)),
    with_ctes(
        f"""SELECT a.*, round(w.pct_on_target / nullif(n.pct_on_target, 0), 9) AS targeting_lift FROM ({_ACCURACY}) a
    LEFT JOIN ({_ACCURACY}) w ON w.profile = a.profile AND w.site_has_pixel LEFT JOIN ({_ACCURACY}) n ON n.profile = a.profile AND NOT n.site_has_pixel""",
        "scored",
    ),
)
_PLATFORM_RATE = "SELECT profile, platform, present, count(*) AS n_ads, 100.0 * (count(*) FILTER (is_on_target) / count(*)) AS pct_on_target FROM u GROUP BY 1, 2, 3"
register(
    "d45_targeting_by_platform",
    lambda t: pixels.targeting_by_platform(t.scored),
    with_ctes(_PLATFORM_RATE, "scored", extra=_UNPIVOT.format("scored")),
)
_SEEDED = "SELECT profile, site_was_seeded_with_pixel, site_has_pixel, count(*) AS n_ads, count(*) FILTER (is_on_target) AS n_on_target, 100.0 * (count(*) FILTER (is_on_target) / count(*)) AS pct_on_target FROM scored GROUP BY 1, 2, 3"
register("d46_seeded_impact", lambda t: pixels.seeded_impact(t.scored), with_ctes(_SEEDED, "scored"))
_ORDER = "CASE " + " ".join(
    f"WHEN site_tracker_entities <= {top} THEN {i}" if top is not None else f"ELSE {i}" for i, (top, _) in enumerate(INTENSITY_BUCKETS)
) + " END"
_INTENSITY = f"""SELECT profile, list_extract({[label for _, label in INTENSITY_BUCKETS]}, bucket_order + 1) AS intensity_bucket, bucket_order,
      count(*) AS n_ads, count(*) FILTER (is_on_target) AS n_on_target, 100.0 * (count(*) FILTER (is_on_target) / count(*)) AS pct_on_target
    FROM (SELECT *, {_ORDER} AS bucket_order FROM scored) GROUP BY ALL"""
register("d47_intensity_response", lambda t: pixels.intensity_response(t.scored), with_ctes(_INTENSITY, "scored"))
register(
    "b28_intensity_bucket",
    lambda t: t.sites.groupBy(intensity_bucket("n_pixel_hits")[0].alias("bucket")).agg(F.count("*").alias("n_sites")),
    with_ctes(
        "SELECT CASE WHEN n_pixel_hits <= 1 THEN '1 (Low)' WHEN n_pixel_hits <= 5 THEN '2-5 (Med)' WHEN n_pixel_hits <= 10 THEN '6-10 (High)' ELSE '11+ (Extreme)' END AS bucket, count(*) AS n_sites FROM sites GROUP BY 1",
        "sites",
    ),
)
register(
    "d48_pixel_funnel",
    lambda t: pixels.pixel_funnel(t.hits),
    with_ctes(
        """SELECT count(*) AS n_hits, count(*) FILTER (path_confirmed) AS n_path_confirmed,
      count(*) FILTER (top_level_parent_entity IS NOT NULL AND request_parent_entity IS NOT NULL) AS n_both_owners,
      count(*) FILTER (top_level_parent_entity <> request_parent_entity) AS n_cross_owner,
      count(*) FILTER (coalesce(is_technical_3p, 0) < 0.5) AS n_not_technical FROM hits""",
        "hits",
    ),
)
register(
    "d48_pixel_types",
    lambda t: pixels.pixel_types(t.hits),
    with_ctes(
        """SELECT pixel_type, count(*) AS total_hits, count(*) FILTER (path_confirmed) AS n_path_confirmed, count(*) FILTER (coalesce(is_technical_3p, 0) >= 0.5) AS flagged_technical,
      round(100.0 * (count(*) FILTER (coalesce(is_technical_3p, 0) >= 0.5) / count(*)), 1) AS pct_technical FROM hits GROUP BY 1""",
        "hits",
    ),
)
register(
    "d48_site_pixel_summary",
    lambda t: pixels.site_pixel_summary(t.sites),
    with_ctes(
        "SELECT profile, count(*) AS n_entities, count(*) FILTER (has_pixel) AS n_with_pixel, CAST(sum(n_pixel_hits) AS BIGINT) AS total_hits_aggregated, round(100.0 * (count(*) FILTER (has_pixel) / count(*)), 1) AS pct_with_pixel FROM sites GROUP BY 1",
        "sites",
    ),
)
register(
    "d48_top_pixel_sites",
    lambda t: pixels.top_pixel_sites(t.sites),
    with_ctes(
        "SELECT profile, top_level_parent_entity, n_pixel_hits, n_distinct_pixel_types, pixel_types FROM sites ORDER BY n_pixel_hits DESC, 1, 2 LIMIT 10",
        "sites",
    ),
)
register(
    "d48_first_party_domains",
    lambda t: pixels.first_party_domains(t.enriched),
    with_ctes(
        "SELECT domain, parent_entity, count(*) AS n_reqs FROM enriched WHERE is_technical_3p < 0.5 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20",
        "enriched",
    ),
)
register(
    "e3_first_owner_per_page",
    lambda t: pixels.page_owners(t.enriched),
    with_ctes("SELECT * FROM page_owner", "page_owner"),
)
register(
    "k6_category_by_pixel_grid",
    lambda t: reports.category_by_pixel_grid(pixels.category_by_pixel(t.context), 3),
    with_ctes(
        f"""SELECT *, CASE WHEN site_has_pixel THEN 'Pixel present' ELSE 'Pixel absent' END AS pixel_label FROM ({_BY_PIXEL})
    WHERE category IN (SELECT category FROM context GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)""",
        "context",
    ),
)
register(
    "k7_platform_column_shares",
    lambda t: reports.platform_column_shares(pixels.category_by_platform(t.context)),
    with_ctes(
        f"""SELECT profile, platform, category, 100.0 * n_ads_with_platform / CASE WHEN s = 0 THEN 1 ELSE s END AS pct_of_platform
    FROM (SELECT *, sum(n_ads_with_platform) OVER (PARTITION BY profile, platform) AS s FROM ({_BY_PLATFORM}))""",
        "context",
        extra=_UNPIVOT.format("context"),
    ),
)
register(
    "k11_intensity_series",
    lambda t: reports.intensity_series(pixels.intensity_response(t.scored)),
    with_ctes(
        f"SELECT profile, bucket_order, intensity_bucket, pct_on_target, CAST(sum(n_ads) OVER (PARTITION BY profile) AS BIGINT) AS n_profile FROM ({_INTENSITY})",
        "scored",
    ),
)
register(
    "k19_platform_status",
    lambda t: reports.platform_status(pixels.targeting_by_platform(t.scored)),
    with_ctes(
        f"SELECT *, CASE WHEN present THEN 'Platform present' ELSE 'Platform absent' END AS status FROM ({_PLATFORM_RATE})",
        "scored",
        extra=_UNPIVOT.format("scored"),
    ),
)
register(
    "k19_b40_seeded_conditions",
    lambda t: reports.seeded_conditions(pixels.seeded_impact(t.scored)),
    with_ctes(
        f"""SELECT *, CASE WHEN site_was_seeded_with_pixel THEN 'Seeded+Pixel' ELSE 'Not seeded' END || chr(10) || '(' || CASE WHEN site_has_pixel THEN 'meas. pixel' ELSE 'no meas. pixel' END || ')' AS condition FROM ({_SEEDED})""",
        "scored",
    ),
)
_TABLE = f"""w AS (SELECT profile, max(n_on_target) FILTER (site_has_pixel) AS k1, max(n_ads) FILTER (site_has_pixel) AS m1,
      max(n_on_target) FILTER (NOT site_has_pixel) AS k2, max(n_ads) FILTER (NOT site_has_pixel) AS m2 FROM ({_ACCURACY}) GROUP BY 1)"""
ERFC = """(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 300), lambda n: exp(n * ln(2) + (2 * n + 1) * ln(greatest({x}, 1e-150)) - {x} * {x} - (lgamma(2.0 * n + 2) - n * ln(2) - lgamma(n + 1.0))))))"""
CHI2 = """CASE WHEN ({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}) = 0 THEN NULL ELSE
      pow(abs({a} - ({a} + {b}) * 1.0::DOUBLE * ({a} + {c}) / ({a} + {b} + {c} + {d})) - least(0.5::DOUBLE, abs({a} - ({a} + {b}) * 1.0::DOUBLE * ({a} + {c}) / ({a} + {b} + {c} + {d}))), 2)
      * pow({a} + {b} + {c} + {d}, 3) / (({a} + {b})::DOUBLE * ({c} + {d}) * ({a} + {c}) * ({b} + {d})) END"""
register(
    "i13_targeting_tests",
    lambda t: stats.targeting_tests(pixels.targeting_accuracy(t.scored)).select(
        "profile", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"), "sig"
    ),
    with_ctes(
        f"""SELECT profile, round(x, 6) AS chi2, round(p, 6) AS p_value,
      CASE WHEN p IS NULL THEN 'n/a' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS sig
    FROM (SELECT *, {ERFC.format(x='sqrt(x / 2)')} AS p FROM (SELECT profile, {CHI2.format(a='k1', b='(m1 - k1)', c='k2', d='(m2 - k2)')} AS x FROM w))""",
        "scored",
        extra=_TABLE,
    ),
)
register(
    "i14_targeting_lift",
    lambda t: stats.targeting_lift(pixels.targeting_accuracy(t.scored)).select(
        "profile", *[F.round(c, 9).alias(c) for c in ("lift", "ci_low", "ci_high")]
    ),
    with_ctes(
        """SELECT profile, round(lift, 9) AS lift, round(greatest(lift - 1.96::DOUBLE * se * lift, 0), 9) AS ci_low, round(lift + 1.96::DOUBLE * se * lift, 9) AS ci_high
    FROM (SELECT profile, (k1 / m1) / (k2 / m2) AS lift, sqrt((k1 / m1) * (1 - k1 / m1) / m1 + (k2 / m2) * (1 - k2 / m2) / m2) AS se FROM w WHERE k2 > 0 AND m1 > 0)""",
        "scored",
        extra=_TABLE,
    ),
)
