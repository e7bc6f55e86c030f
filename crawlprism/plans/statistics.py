"""Hypothesis tests, rank statistics and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlprism.functions.columns import sig_marker, smoothed_lift
from crawlprism.operators import ads, ranks, reports, stats
from crawlprism.plans.ads import _CATEGORIES, _matrix
from crawlprism.plans.pixels import CHI2, ERFC
from crawlprism.plans.registry import register
from crawlprism.plans.roles import STUDY, with_ctes

A, B = "building", "automobile"
PAIRS = [(p, STUDY.baseline) for p in STUDY.profiles if p != STUDY.baseline]
TRACKERS = (
    "supplier000000001.com", "supplier000000002.com", "supplier000000003.com", "supplier000000004.com",
    "customer000000042", "customer000000043", "wss://", "/r/77", "not-there.example",
)


def fisher(a: str, b: str, c: str, d: str) -> str:
    logp = (
        "(lgamma({a}+{c}+1.0) - lgamma({k}+1.0) - lgamma({a}+{c}-{k}+1.0) + lgamma({b}+{d}+1.0) - lgamma({a}+{b}-{k}+1.0)"
        " - lgamma({b}+{d}-({a}+{b}-{k})+1.0) - lgamma({a}+{b}+{c}+{d}+1.0) + lgamma({a}+{b}+1.0) + lgamma({c}+{d}+1.0))"
    )

    def at(k: str) -> str:
        return logp.format(a=a, b=b, c=c, d=d, k=k)

    span = f"range(greatest(0, {a}-{d}), least({a}+{b}, {a}+{c}) + 1)"
    return (
        f"least(1.0::DOUBLE, list_sum(list_transform(list_filter({span}, lambda k: {at('k')} <= {at(a)} + 1e-7), lambda k: exp({at('k')}))))"
    )


def odds(a: str, b: str, c: str, d: str) -> str:
    return f"CASE WHEN {b} * {c} > 0 THEN {a}::DOUBLE * {d} / ({b} * {c}) WHEN {a} * {d} > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END"


def expected_below_5(a: str, b: str, c: str, d: str) -> str:
    return f"least({a}+{b}, {c}+{d})::DOUBLE * least({a}+{c}, {b}+{d}) / ({a}+{b}+{c}+{d}) < 5"


# --- presence tests --------------------------------------------------------------------------

_LIST = ", ".join(f"('{t}')" for t in TRACKERS)
_TABLES = f"""SELECT tracker, count(DISTINCT visit_id) FILTER (profile = '{A}' AND hit) AS a,
      count(DISTINCT visit_id) FILTER (profile = '{A}') - count(DISTINCT visit_id) FILTER (profile = '{A}' AND hit) AS b,
      count(DISTINCT visit_id) FILTER (profile = '{B}' AND hit) AS c,
      count(DISTINCT visit_id) FILTER (profile = '{B}') - count(DISTINCT visit_id) FILTER (profile = '{B}' AND hit) AS d
    FROM (SELECT profile, visit_id, tracker, {{match}} AS hit FROM enriched, (VALUES {_LIST}) t(tracker) WHERE profile IN ('{A}','{B}')) GROUP BY 1"""
_CONTAINS = _TABLES.format(match="contains(url, tracker)")
register(
    "c14_i4_presence_tables",
    lambda t: stats.presence_tables(t.requests, A, B, TRACKERS),
    with_ctes(_CONTAINS, "enriched"),
)
register(
    "c14_presence_tables_like",
    lambda t: stats.presence_tables(t.requests, A, B, TRACKERS, match="like"),
    with_ctes(_TABLES.format(match="url LIKE '%'||tracker||'%'"), "enriched"),
)


# Ten thousand patterns: the hosts of suppliers that are there, of many that are not, and LIKE forms of them.
_MANY = tuple(f"supplier{n:09d}.com" for n in range(1, 10_001))
_MANY_CTES = f"""p AS (SELECT 'supplier' || lpad(n::VARCHAR, 9, '0') || '.com' AS host FROM range(1, 10001) r(n)),
    v AS (SELECT DISTINCT profile, visit_id, regexp_extract(url, 'supplier[0-9]{{9}}[.]com') AS host FROM enriched WHERE profile IN ('{A}','{B}')),
    n AS (SELECT count(DISTINCT visit_id) FILTER (profile = '{A}') AS na, count(DISTINCT visit_id) FILTER (profile = '{B}') AS nb FROM v)"""


def _many_sql(name: str) -> str:
    body = f"""SELECT {name} AS tracker, count(visit_id) FILTER (profile = '{A}') AS a, any_value(na) - a AS b, count(visit_id) FILTER (profile = '{B}') AS c,
      any_value(nb) - c AS d FROM n, p LEFT JOIN v USING (host) GROUP BY host"""
    return with_ctes(body, "enriched", extra=_MANY_CTES)


register("c14_presence_many_trackers", lambda t: stats.presence_tables(t.requests, A, B, _MANY), _many_sql("host"))
register(
    "c14_presence_many_like",
    lambda t: stats.presence_tables(t.requests, A, B, [x.replace("supplier", "s_pplier%") for x in _MANY], match="like"),
    _many_sql("replace(host, 'supplier', 's_pplier%')"),
)


def _tests(correction: str) -> str:
    corrected = (
        "least(p * count(*) OVER (), 1.0)"
        if correction == "bonferroni"
        else "least(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0)"
    )
    return f"""SELECT CASE WHEN exact THEN 'Fisher''s exact (2x2)' ELSE 'chi-square (2x2)' END AS test_name, '{A} vs {B}: '||tracker AS comparison,
      round(CASE WHEN exact THEN {odds('a', 'b', 'c', 'd')} ELSE x END, 6) AS statistic, round(p, 6) AS p_value, round({corrected}, 6) AS p_value_corrected,
      '{correction}' AS correction_method, round(CASE WHEN NOT exact THEN sqrt(x / (a + b + c + d)) END, 9) AS effect_size,
      CASE WHEN NOT exact THEN 'Cramer''s V' END AS effect_size_name, a + b + c + d AS n_observations, {corrected} < 0.05 AS reject_null, '' AS notes
    FROM (SELECT *, row_number() OVER (ORDER BY p, tracker) AS r, count(*) OVER () AS m FROM (
      SELECT *, CASE WHEN exact THEN {fisher('a', 'b', 'c', 'd')} ELSE {ERFC.format(x='sqrt(x / 2)')} END AS p FROM (
        SELECT *, {expected_below_5('a', 'b', 'c', 'd')} AS exact, {CHI2.format(a='a', b='b', c='c', d='d')} AS x FROM ({_CONTAINS}))))"""


def _rounded(df):
    for c, digits in (("statistic", 6), ("p_value", 6), ("p_value_corrected", 6), ("effect_size", 9)):
        if c in df.columns:
            df = df.withColumn(c, F.round(c, digits))
    return df


register(
    "i4_i5_presence_tests",
    lambda t: _rounded(stats.presence_tests(stats.presence_tables(t.requests, A, B, TRACKERS), A, B)),
    with_ctes(_tests("bonferroni"), "enriched"),
)
register(
    "i3_presence_tests_bh",
    lambda t: _rounded(
        stats.presence_tests(stats.presence_tables(t.requests, A, B, TRACKERS), A, B, "benjamini-hochberg")
    ),
    with_ctes(_tests("benjamini-hochberg"), "enriched"),
)

# --- metrics ---------------------------------------------------------------------------------

_METRICS = {
    "requests_per_visit": "SELECT profile, visit_id, count(*) AS metric_value FROM enriched GROUP BY 1, 2",
    "unique_hosts_per_visit": "SELECT profile, visit_id, count(DISTINCT regexp_extract(url, '://([^/]+)', 1)) AS metric_value FROM enriched WHERE url LIKE 'http%' GROUP BY 1, 2",
    "cookies_per_visit": "SELECT profile, visit_id, count(*) AS metric_value FROM cookies GROUP BY 1, 2",
    "third_party_cookies_per_visit": "SELECT profile, visit_id, count(*) AS metric_value FROM cookies JOIN visits USING (profile, visit_id) WHERE regexp_extract(site_url, '://([^/]+)', 1) <> host GROUP BY 1, 2",
    "tier_cookies_per_visit": "SELECT profile, visit_id, count(*) AS metric_value FROM tp_cookies GROUP BY 1, 2",
}
_READS = {
    "requests_per_visit": ("enriched",),
    "unique_hosts_per_visit": ("enriched",),
    "cookies_per_visit": ("cookies",),
    "third_party_cookies_per_visit": ("cookies", "visits"),
    "tier_cookies_per_visit": ("tp_cookies",),
}


def _metric(t, name: str):
    cookies = t.cookies_enriched if name == "tier_cookies_per_visit" else t.cookies
    return stats.metric(name, requests=t.requests, cookies=cookies, visits=t.visits)


for _name, _sql in _METRICS.items():
    _key = "c13_i8_" if _name == "third_party_cookies_per_visit" else "i8_"
    register(_key + _name, lambda t, n=_name: _metric(t, n), with_ctes(_sql, *_READS[_name]))


def _value_metric(t):
    """A continuous metric: order totals."""
    return t.orders.select("profile", F.col("o_orderkey").alias("visit_id"), F.col("o_totalprice").alias("metric_value"))


_ORDERS = "m AS (SELECT lower(c_mktsegment) AS profile, o_orderkey AS visit_id, o_totalprice AS metric_value FROM orders JOIN customer ON o_custkey = c_custkey)"


def _metric_cte(name: str) -> str:
    return f"m AS ({_METRICS[name]})"


# --- ranks -----------------------------------------------------------------------------------

_MID = """SELECT metric_value, count(*) AS n, CAST(min(r) - 1 AS BIGINT) AS n_before, min(r) - 1 + (count(*) + 1) / 2.0 AS mid_rank
    FROM (SELECT *, rank() OVER (ORDER BY metric_value) AS r FROM m) GROUP BY 1"""
register(
    "e5_mid_ranks",
    lambda t: ranks.with_running_count(
        ranks.value_counts(_metric(t, "unique_hosts_per_visit"), "metric_value"), "metric_value"
    ).withColumn("mid_rank", ranks.mid_rank()),
    with_ctes(_MID, "enriched", extra=_metric_cte("unique_hosts_per_visit")),
)
register(
    "e5_mid_ranks_continuous",
    lambda t: ranks.with_running_count(
        ranks.value_counts(_value_metric(t), "metric_value"), "metric_value"
    ).withColumn("mid_rank", ranks.mid_rank()),
    with_ctes(_MID, extra=_ORDERS),
)
_DESCRIBE = """SELECT profile, count(metric_value) AS count, round(avg(metric_value), 6) AS mean, round(stddev(metric_value), 6) AS std, CAST(min(metric_value) AS DOUBLE) AS min,
      CAST(max(metric_value) AS DOUBLE) AS max, round(quantile_cont(metric_value, 0.25), 6) AS p25, round(quantile_cont(metric_value, 0.5), 6) AS p50, round(quantile_cont(metric_value, 0.75), 6) AS p75 FROM m GROUP BY 1"""


def _describe(df):
    out = ranks.describe(df, "metric_value", ["profile"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


register(
    "d50_describe_requests",
    lambda t: _describe(_metric(t, "requests_per_visit")),
    with_ctes(_DESCRIBE, "enriched", extra=_metric_cte("requests_per_visit")),
)
register("d50_describe_totals", lambda t: _describe(_value_metric(t)), with_ctes(_DESCRIBE, extra=_ORDERS))


def _rank_sums(pairs) -> str:
    listed = ", ".join(f"('{a}','{b}')" for a, b in pairs)
    return f"""SELECT profile_a, profile_b, CAST(sum(in_a) AS BIGINT) AS n_a, CAST(sum(1 - in_a) AS BIGINT) AS n_b,
      sum(in_a * mid) AS rank_sum_a, sum(CAST(t AS DOUBLE) * t - 1) AS tie_term,
      sum(in_a * mid) - sum(in_a) * (sum(in_a) + 1) / 2 AS u_a FROM (
      SELECT *, rank() OVER (PARTITION BY profile_a, profile_b ORDER BY metric_value) + (count(*) OVER (PARTITION BY profile_a, profile_b, metric_value) - 1) / 2.0::DOUBLE AS mid,
        count(*) OVER (PARTITION BY profile_a, profile_b, metric_value) AS t FROM (
        SELECT profile_a, profile_b, metric_value, CASE WHEN profile = profile_a THEN 1 ELSE 0 END AS in_a
        FROM m JOIN (VALUES {listed}) p(profile_a, profile_b) ON profile IN (profile_a, profile_b))) GROUP BY 1, 2"""


register(
    "i6_rank_sums",
    lambda t: stats.rank_sums(_metric(t, "requests_per_visit"), PAIRS).drop("u_b"),
    with_ctes(_rank_sums(PAIRS), "enriched", extra=_metric_cte("requests_per_visit")),
)
register(
    "i6_rank_sums_continuous",
    lambda t: stats.rank_sums(_value_metric(t), PAIRS).drop("u_b"),
    with_ctes(_rank_sums(PAIRS), extra=_ORDERS),
)


def _mann_whitney(name: str) -> str:
    z = "(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))"
    return f"""SELECT 'Mann-Whitney U' AS test_name, profile_a||' vs '||profile_b||': {name}' AS comparison, u AS statistic,
      round(least(1.0, {ERFC.format(x='(greatest(z, 0) / sqrt(2))')} + CASE WHEN z < 0 THEN 1 ELSE 0 END), 6) AS p_value, round(1 - 2 * u / (n1 * n2), 9) AS effect_size,
      'rank-biserial r' AS effect_size_name, CAST(n1 + n2 AS BIGINT) AS n_observations, '' AS notes, profile_a FROM (
      SELECT *, {z} AS z FROM (SELECT profile_a, profile_b, n_a::DOUBLE AS n1, n_b::DOUBLE AS n2, u_a AS u, tie_term AS ties FROM ({_rank_sums(PAIRS)})))"""


register(
    "i6_mann_whitney",
    lambda t: _rounded(stats.mann_whitney(_metric(t, "unique_hosts_per_visit"), PAIRS, "unique_hosts_per_visit").drop("ord")),
    with_ctes(
        f"SELECT * EXCLUDE (profile_a) FROM ({_mann_whitney('unique_hosts_per_visit')})",
        "enriched",
        extra=_metric_cte("unique_hosts_per_visit"),
    ),
)
_KW = """SELECT 'Kruskal-Wallis H' AS test_name, k||' profiles: {name}' AS comparison, round(h, 6) AS statistic,
      round(CASE k WHEN 5 THEN exp(-h / 2) * (1 + h / 2) WHEN 3 THEN exp(-h / 2) END, 6) AS p_value,
      round(greatest(0, (h - k + 1) / (n - k)), 9) AS effect_size, 'epsilon²' AS effect_size_name, CAST(n AS BIGINT) AS n_observations, '' AS notes FROM (
      SELECT count(*) AS k, sum(c) AS n, (12.0::DOUBLE * sum(r * r / c) / (sum(c) * (sum(c) + 1)) - 3 * (sum(c) + 1)) / (1 - max(ties) / (pow(sum(c), 3) - sum(c))) AS h FROM (
        SELECT profile, count(*)::DOUBLE AS c, sum(mid) AS r, max(ties) AS ties FROM (
          SELECT *, sum(t * t - 1) OVER () AS ties FROM (
          SELECT profile, rank() OVER (ORDER BY metric_value) + (count(*) OVER (PARTITION BY metric_value) - 1) / 2.0::DOUBLE AS mid, (count(*) OVER (PARTITION BY metric_value))::DOUBLE AS t FROM m)) GROUP BY 1))"""
register(
    "i7_kruskal_wallis",
    lambda t: _rounded(stats.kruskal_wallis(_metric(t, "unique_hosts_per_visit"), STUDY.profiles, "unique_hosts_per_visit")),
    with_ctes(_KW.format(name="unique_hosts_per_visit"), "enriched", extra=_metric_cte("unique_hosts_per_visit")),
)
register(
    "i7_kruskal_wallis_continuous",
    lambda t: _rounded(stats.kruskal_wallis(_value_metric(t), STUDY.profiles, "order totals")),
    with_ctes(_KW.format(name="order totals"), extra=_ORDERS),
)


def _battery(name: str, correction: str) -> str:
    corrected = (
        "least(p_value * 4, 1.0)"
        if correction == "bonferroni"
        else "least(min(p_value * 4 / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0)"
    )
    return f"""SELECT *, round(p_value, 4) AS p_value_corrected, 'none' AS correction_method, p_value < 0.05 AS reject_null FROM ({_KW.format(name=name)})
    UNION ALL BY NAME SELECT * EXCLUDE (r, profile_a), round({corrected}, 4) AS p_value_corrected, '{correction}' AS correction_method, {corrected} < 0.05 AS reject_null
    FROM (SELECT *, row_number() OVER (ORDER BY p_value, profile_a) AS r FROM ({_mann_whitney(name)}))"""


def _battery_spark(t, name: str, correction: str):
    out = stats.pairwise_battery(_metric(t, name), name, study=STUDY, correction=correction)
    return _rounded(out.withColumn("p_value_corrected", F.round("p_value_corrected", 4)))


register(
    "i9_pairwise_battery",
    lambda t: _battery_spark(t, "requests_per_visit", "bonferroni"),
    with_ctes(_battery("requests_per_visit", "bonferroni"), "enriched", extra=_metric_cte("requests_per_visit")),
)
register(
    "i9_pairwise_battery_bh",
    lambda t: _battery_spark(t, "cookies_per_visit", "benjamini-hochberg"),
    with_ctes(_battery("cookies_per_visit", "benjamini-hochberg"), "cookies", extra=_metric_cte("cookies_per_visit")),
)

# --- corrections -----------------------------------------------------------------------------


def _pseudo_p(t):
    """One number in (0, 1] per supplier, used as a p-value."""
    return t.table("supplier").select("s_name", ((F.col("s_suppkey") * 7919) % 1000 / 1000.0 + 0.0005).alias("p_value"))


register(
    "i2_bonferroni",
    lambda t: stats.correct_pvalues(_pseudo_p(t), method="bonferroni"),
    "SELECT s_name, p_value, least(p_value * count(*) OVER (), 1.0) AS p_value_corrected FROM (SELECT s_name, (s_suppkey * 7919) % 1000 / 1000.0::DOUBLE + 0.0005::DOUBLE AS p_value FROM supplier)",
)
register(
    "i3_e4_benjamini_hochberg",
    lambda t: stats.correct_pvalues(_pseudo_p(t), method="benjamini-hochberg"),
    """SELECT s_name, p_value, least(min(p_value * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS p_value_corrected
    FROM (SELECT *, row_number() OVER (ORDER BY p_value, s_name) AS r, count(*) OVER () AS m
      FROM (SELECT s_name, (s_suppkey * 7919) % 1000 / 1000.0::DOUBLE + 0.0005::DOUBLE AS p_value FROM supplier))""",
)
register(
    "b39_significance_marker",
    lambda t: _pseudo_p(t).withColumn("sig", sig_marker("p_value")),
    """SELECT s_name, p_value, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS sig
    FROM (SELECT s_name, (s_suppkey * 7919) % 1000 / 1000.0::DOUBLE + 0.0005::DOUBLE AS p_value FROM supplier)""",
)
register(
    "b36_b37_smoothed_lift",
    lambda t: t.table("lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("a"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("b")
    ).select("l_suppkey", smoothed_lift("a", "b").alias("lift"), smoothed_lift("a", "b", 0.1).alias("pct_lift")),
    """SELECT l_suppkey, (a + 1.0) / (b + 1.0) AS lift, (a + 0.1::DOUBLE) / (b + 0.1::DOUBLE) AS pct_lift
    FROM (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)""",
)

# --- category tests --------------------------------------------------------------------------


def _counts(t):
    return ads.category_distribution(t.ads, top_n=None).select("profile", "category", "n_ads")


def _brand_counts(t):
    """Many small cells: brand and product together, so that exact tests occur."""
    return t.ads.where(F.col("is_valid_ad") & F.col("brand").isNotNull()).groupBy(
        "profile", F.concat_ws("/", "brand", F.trim("category")).alias("category")
    ).agg(F.count("*").alias("n_ads"))


def _pvalues(source: str, baseline: str) -> str:
    return f"""SELECT profile, category, a AS n_persona, c AS n_control, 100.0 * a / (a + b) AS pct_persona, 100.0 * c / (c + d) AS pct_control,
      round(p, 6) AS p_raw, CASE WHEN p IS NOT NULL THEN round(least(p * count(p) OVER (), 1.0), 4) END AS p_adj, test_used,
      CASE WHEN p IS NULL THEN '' WHEN least(p * count(p) OVER (), 1.0) < 0.001 THEN '***' WHEN least(p * count(p) OVER (), 1.0) < 0.01 THEN '**' WHEN least(p * count(p) OVER (), 1.0) < 0.05 THEN '*' ELSE 'ns' END AS sig FROM (
      SELECT *, CASE test_used WHEN 'skipped' THEN NULL WHEN 'fisher' THEN {fisher('a', 'b', 'c', 'd')} ELSE {ERFC.format(x='sqrt(x / 2)')} END AS p FROM (
        SELECT *, CASE WHEN a + c = 0 THEN 'skipped' WHEN {expected_below_5('a', 'b', 'c', 'd')} THEN 'fisher' ELSE 'chi2' END AS test_used, {CHI2.format(a='a', b='b', c='c', d='d')} AS x FROM (
          SELECT p.profile, k.category, coalesce(x.n_ads, 0) AS a, p.total - coalesce(x.n_ads, 0) AS b, coalesce(y.n_ads, 0) AS c, z.total - coalesce(y.n_ads, 0) AS d
          FROM (SELECT profile, CAST(sum(n_ads) AS BIGINT) AS total FROM ({source}) GROUP BY 1) p
          CROSS JOIN (SELECT DISTINCT category FROM ({source})) k
          CROSS JOIN (SELECT CAST(sum(n_ads) AS BIGINT) AS total FROM ({source}) WHERE profile = '{baseline}') z
          LEFT JOIN ({source}) x ON x.profile = p.profile AND x.category = k.category
          LEFT JOIN ({source}) y ON y.profile = '{baseline}' AND y.category = k.category WHERE p.profile <> '{baseline}')))"""


def _pv(df):
    return df.withColumn("p_raw", F.round("p_raw", 6)).withColumn("p_adj", F.round("p_adj", 4))


_BRANDS = "SELECT profile, concat_ws('/', brand, TRIM(category)) AS category, count(*) AS n_ads FROM ads WHERE is_valid_ad AND brand IS NOT NULL GROUP BY 1, 2"
_COUNTS = "SELECT profile, category, n_ads FROM (" + _CATEGORIES + ")"
register(
    "i10_category_pvalues",
    lambda t: _pv(stats.category_pvalues(_counts(t), B)),
    with_ctes(_pvalues(_COUNTS, B), "content_ads"),
)
register(
    "i10_category_pvalues_small_cells",
    lambda t: _pv(stats.category_pvalues(_brand_counts(t), B)),
    with_ctes(_pvalues("SELECT * FROM bc", B), "ads", extra=f"bc AS ({_BRANDS})"),
)
register(
    "i15_persona_baseline_pvalues",
    lambda t: _pv(stats.category_pvalues(_counts(t), "furniture")),
    with_ctes(_pvalues(_COUNTS, "furniture"), "content_ads"),
)
_CONTINGENCY = """SELECT category, profile, n_ads FROM (SELECT *, sum(n_ads) OVER (PARTITION BY category) AS s FROM (
      SELECT lower(trim(brand)) AS category, profile, count(*) AS n_ads FROM valid_ads WHERE brand IS NOT NULL GROUP BY 1, 2)) WHERE s >= 10"""


def _cells(t):
    rows = t.ads.where(ads.valid_ad("high") & F.col("brand").isNotNull())
    return stats.contingency(rows, category="brand")


register("h8_contingency", lambda t: _cells(t), with_ctes(_CONTINGENCY, "valid_ads"))
register(
    "i11_chi_square_omnibus",
    lambda t: stats.chi_square_omnibus(_cells(t)).withColumn("chi2", F.round("chi2", 6)).withColumn("p_value", F.round("p_value", 6)),
    with_ctes(
        f"""SELECT round(x, 6) AS chi2, dof, round(exp(-x / 2) * list_sum(list_transform(range(0, dof // 2), lambda k: exp(k * ln(x / 2) - lgamma(k + 1.0)))), 6) AS p_value, CAST(n AS BIGINT) AS n_observations FROM (
      SELECT sum(pow(o - e, 2) / e) AS x, (count(DISTINCT category) - 1) * (count(DISTINCT profile) - 1) AS dof, sum(o) AS n FROM (
        SELECT k.category, p.profile, coalesce(c.n_ads, 0)::DOUBLE AS o, k.s::DOUBLE * p.s / t.s AS e
        FROM (SELECT category, sum(n_ads) AS s FROM ct GROUP BY 1) k CROSS JOIN (SELECT profile, sum(n_ads) AS s FROM ct GROUP BY 1) p
        CROSS JOIN (SELECT sum(n_ads) AS s FROM ct) t LEFT JOIN ct c ON c.category = k.category AND c.profile = p.profile))""",
        "valid_ads",
        extra=f"ct AS ({_CONTINGENCY})",
    ),
)
register(
    "i12_category_fisher",
    lambda t: stats.category_fisher(_cells(t), A, B).withColumns(
        {"odds_ratio": F.round("odds_ratio", 9), "p_value": F.round("p_value", 6), "p_adj": F.round("p_adj", 4)}
    ),
    with_ctes(
        f"""SELECT category, a AS n_a, c AS n_b, round({odds('a', 'b', 'c', 'd')}, 9) AS odds_ratio, round(p, 6) AS p_value,
      round(least(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0), 4) AS p_adj,
      least(min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) < 0.05 AS significant FROM (
      SELECT *, row_number() OVER (ORDER BY p, category) AS r, count(*) OVER () AS m FROM (
        SELECT *, {fisher('a', 'b', 'c', 'd')} AS p FROM (
          SELECT category, coalesce(max(n_ads) FILTER (profile = '{A}'), 0) AS a, (SELECT CAST(sum(n_ads) AS BIGINT) FROM ct WHERE profile = '{A}') - coalesce(max(n_ads) FILTER (profile = '{A}'), 0) AS b,
            coalesce(max(n_ads) FILTER (profile = '{B}'), 0) AS c, (SELECT CAST(sum(n_ads) AS BIGINT) FROM ct WHERE profile = '{B}') - coalesce(max(n_ads) FILTER (profile = '{B}'), 0) AS d
          FROM ct WHERE profile IN ('{A}','{B}') GROUP BY 1)))""",
        "valid_ads",
        extra=f"ct AS ({_CONTINGENCY})",
    ),
)
_GRID = _matrix(_CATEGORIES, "category", "pct_of_profile", 15)
register(
    "k16_annotated_grid",
    lambda t: reports.annotated_grid(
        ads.share_matrix(ads.category_distribution(t.ads, top_n=None), "category", "pct_of_profile", study=STUDY, top_n=15),
        stats.category_pvalues(_counts(t), B),
        study=STUDY,
    ),
    with_ctes(
        f"""SELECT g.category, g.profile, printf('%.1f', g.value) || CASE WHEN v.sig IS NULL OR v.sig = 'ns' THEN '' ELSE v.sig END AS cell
    FROM (UNPIVOT ({_GRID}) ON {", ".join(STUDY.profiles)} INTO NAME profile VALUE value) g LEFT JOIN ({_pvalues(_COUNTS, B)}) v ON v.profile = g.profile AND v.category = g.category""",
        "content_ads",
    ),
)
register(
    "k17_annotated_delta",
    lambda t: reports.annotated_delta(
        ads.targeting_delta(ads.category_distribution(t.ads, top_n=None), study=STUDY, profile_a="machinery", profile_b="furniture"),
        stats.category_pvalues(_counts(t), "furniture"),
        "machinery",
    ),
    with_ctes(
        f"""SELECT d.category, machinery - furniture AS delta_pct, CASE WHEN v.sig IS NULL OR v.sig = 'ns' THEN '' ELSE v.sig END AS marker
    FROM ({_GRID}) d LEFT JOIN ({_pvalues(_COUNTS, 'furniture')}) v ON v.profile = 'machinery' AND v.category = d.category""",
        "content_ads",
    ),
)

# --- histograms ------------------------------------------------------------------------------

_HIST = """SELECT profile, CAST(least(floor(49.0::DOUBLE * v / q) + 1, 49) AS BIGINT) AS bin, round((least(floor(49.0::DOUBLE * v / q) + 1, 49) - 1) * q / 49, 6) AS bin_from,
      round(least(floor(49.0::DOUBLE * v / q) + 1, 49) * q / 49, 6) AS bin_to, count(*) AS n
    FROM (SELECT profile, metric_value::DOUBLE AS v, (SELECT quantile_cont(metric_value::DOUBLE, 0.99) FROM m) AS q FROM m) WHERE v >= 0 AND v <= q GROUP BY ALL"""


def _hist(df):
    return reports.shared_histogram(df, "metric_value").withColumns(
        {c: F.round(c, 6) for c in ("bin_from", "bin_to")}
    )


register(
    "k2_shared_histogram",
    lambda t: _hist(_metric(t, "requests_per_visit")),
    with_ctes(_HIST, "enriched", extra=_metric_cte("requests_per_visit")),
)
register("k2_shared_histogram_continuous", lambda t: _hist(_value_metric(t)), with_ctes(_HIST, extra=_ORDERS))
