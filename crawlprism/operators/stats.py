"""Hypothesis tests. Spark computes contingency counts, ranks and ties over the full data; each
test ends as one row, and only the closed-form p-value of that row runs in Python."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlprism.config import ALPHA, Study, check_choice
from crawlprism.functions.columns import (
    count_if,
    percent,
    ratio,
    sig_marker,
    third_party,
)
from crawlprism.functions.grams import with_matches
from crawlprism.functions.probability import (
    chi2_sf,
    fisher_p,
    mann_whitney_exact_p,
    normal_two_sided,
)
from crawlprism.functions.urls import has_http_scheme, hostname
from crawlprism.operators.common import with_group_total
from crawlprism.operators.ranks import mid_rank, with_minimum_from_right, with_running_count
from crawlprism.session import written

RESULT_COLUMNS = (
    "test_name", "comparison", "statistic", "p_value", "p_value_corrected", "correction_method",
    "effect_size", "effect_size_name", "n_observations", "reject_null", "notes",
)
CORRECTIONS = ("bonferroni", "benjamini-hochberg")


# --- multiple testing ------------------------------------------------------------------------


def correct_pvalues(
    df: DataFrame,
    p: str = "p_value",
    method: str = "bonferroni",
    *,
    family: Sequence[str] = (),
    name: str = "p_value_corrected",
    listed: bool = False,
) -> DataFrame:
    """Correct families of p-values, one row per test; null p-values stay null and are no tests.

    Families that grow with the data are handled by distinct p-values in ranges: counts, ranks and the
    minimum from the right come from range totals, so no family has to fit into one task. A family
    whose tests are a list given in Python (`listed`: profiles, trackers) is one small window.
    """
    check_choice("correction", method, CORRECTIONS)
    by = list(family)
    if listed:
        return _correct_listed(df, p, method, by, name)
    tests = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n"))
    totals = tests.groupBy(*by).agg(F.sum("_n").alias("_m"))

    def with_m(rows: DataFrame) -> DataFrame:
        return rows.join(totals, by, "left") if by else rows.withColumn("_m", totals.scalar())

    if method == "bonferroni":
        return with_m(df).withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("_m"), F.lit(1.0)))).drop("_m")
    ranked = with_m(with_running_count(tests, p, by, n="_n", name="_before", keep_range=True))
    # Of equal p-values the last rank gives the smallest value, and all of them take the minimum.
    scaled = ranked.withColumn("_scaled", F.col(p) * F.col("_m") / (F.col("_before") + F.col("_n")))
    adjusted = with_minimum_from_right(scaled, p, "_scaled", by, "_adjusted")
    return (
        df.join(adjusted.select(*by, p, "_adjusted"), [*by, p], "left")
        .withColumn(name, F.when(F.col("_adjusted").isNotNull(), F.least("_adjusted", F.lit(1.0))))
        .select(*df.columns, name)
    )


def _correct_listed(df: DataFrame, p: str, method: str, by: Sequence[str], name: str) -> DataFrame:
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    m = F.count(p).over(group)
    if method == "bonferroni":
        return df.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.col(p) * m, F.lit(1.0))))
    ranked = group.orderBy(F.col(p).asc_nulls_last())
    from_right = ranked.rowsBetween(0, W.unboundedFollowing)
    last_rank = F.max("_rank").over(W.partitionBy(*by, p))
    return (
        df.withColumn("_rank", F.row_number().over(ranked))
        .withColumn("_scaled", F.col(p) * m / last_rank)
        .withColumn(
            name,
            F.when(F.col(p).isNotNull(), F.least(F.min("_scaled").over(from_right), F.lit(1.0))),
        )
        .drop("_rank", "_scaled")
    )


# --- 2x2 tables ------------------------------------------------------------------------------


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def min_expected() -> Column:
    """Smallest expected cell of a table (a, b, c, d)."""
    n = _d("a") + _d("b") + _d("c") + _d("d")
    row = F.least(_d("a") + _d("b"), _d("c") + _d("d"))
    column = F.least(_d("a") + _d("c"), _d("b") + _d("d"))
    return F.try_divide(row * column, n)


def chi2_2x2(yates: bool = True) -> Column:
    """Chi-square statistic of (a, b, c, d), with continuity correction that never overshoots."""
    a, b, c, d = _d("a"), _d("b"), _d("c"), _d("d")
    n = a + b + c + d
    expected = F.try_divide((a + b) * (a + c), n)
    gap = F.abs(a - expected)
    if yates:
        gap = gap - F.least(F.lit(0.5), gap)
    weight = F.try_divide(n * n * n, (a + b) * (c + d) * (a + c) * (b + d))
    return gap * gap * weight


def odds_ratio() -> Column:
    """a*d / (b*c); infinity when only the denominator is 0, NaN when both are."""
    top, bottom = _d("a") * _d("d"), _d("b") * _d("c")
    return (
        F.when(bottom > 0, F.try_divide(top, bottom))
        .when(top > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )


def tested_2x2(tables: DataFrame, yates: bool = True) -> DataFrame:
    """Add test, statistic and p to rows with cells a, b, c, d.

    Chi-square, or Fisher's exact test as soon as an expected cell is below 5.
    """
    exact = F.coalesce(min_expected() < 5, F.lit(True))
    # Each tail is computed where it counts: other rows go in as empty tables or as 0.
    cell = lambda c: F.when(F.col("_exact"), F.col(c)).otherwise(F.lit(0))
    return (
        tables.withColumn("_exact", exact)
        .withColumn("_chi2", F.when(F.col("_exact"), F.lit(0.0)).otherwise(chi2_2x2(yates)))
        .withColumns({f"_{c}": cell(c) for c in "abcd"})
        .withColumn("statistic", F.when(F.col("_exact"), odds_ratio()).otherwise(F.col("_chi2")))
        .withColumn("_one", F.lit(1.0))
        .withColumn("_p_chi", chi2_sf(F.col("_chi2"), F.col("_one")))
        .withColumn("_p_exact", fisher_p("_a", "_b", "_c", "_d"))
        .withColumn("p_value", F.when(F.col("_exact"), F.col("_p_exact")).otherwise(F.col("_p_chi")))
        .withColumn("test", F.when(F.col("_exact"), "fisher").otherwise("chi2"))
        .drop("_exact", "_chi2", "_one", "_p_chi", "_p_exact", "_a", "_b", "_c", "_d")
    )


#: Lists of substrings up to this length are cheaper to walk than to index.
WALKED = 32


def presence_tables(
    requests: DataFrame,
    profile_a: str,
    profile_b: str,
    trackers: Sequence[str],
    *,
    column: str = "url",
    match: str = "contains",
) -> DataFrame:
    """2x2 visit counts for every tracker from one scan of the requests.

    Each request yields only the trackers it matches. `match` is a literal substring, a LIKE
    substring in which `%` and `_` keep their meaning, or equality (for owner columns). Up to
    `WALKED` substrings are tested one after the other; more are found by an index of their rarest
    q-grams, with the same rows.
    """
    check_choice("match", match, ("contains", "like", "equals"))
    text, trackers = F.col(column), list(dict.fromkeys(trackers))
    rows = requests.where(F.col("profile").isin(profile_a, profile_b))
    table = requests.sparkSession.createDataFrame([(t,) for t in trackers], "tracker string")
    used = rows.select("profile", "visit_id", text.alias("_text"))
    if match == "equals":
        met = used.join(table, F.col("_text") == F.col("tracker"))
    elif len(trackers) <= WALKED:
        listed = F.array(*[F.lit(t) for t in trackers])
        hit = {
            "contains": lambda t: F.col("_text").contains(t),
            "like": lambda t: F.like(F.col("_text"), F.concat(F.lit("%"), t, F.lit("%"))),
        }[match]
        met = used.select("profile", "visit_id", F.explode(F.filter(listed, hit)).alias("tracker"))
    else:
        met = with_matches(used, "_text", trackers, "tracker", like=match == "like")
    found = (
        met.select("profile", "visit_id", "tracker")
        .distinct()
        .groupBy("tracker")
        .agg(
            count_if(F.col("profile") == profile_a).alias("a"),
            count_if(F.col("profile") == profile_b).alias("c"),
        )
    )
    totals = (
        rows.select("profile", "visit_id")
        .distinct()
        .agg(
            count_if(F.col("profile") == profile_a).alias("_na"),
            count_if(F.col("profile") == profile_b).alias("_nb"),
        )
    )
    zero = F.lit(0).cast("long")
    sizes = totals.select(F.struct("_na", "_nb").alias("s"))
    return (
        table.join(found, "tracker", "left")
        .withColumn("_s", sizes.scalar())
        .select(
            "tracker",
            F.coalesce("a", zero).alias("a"),
            (F.col("_s._na") - F.coalesce("a", zero)).alias("b"),
            F.coalesce("c", zero).alias("c"),
            (F.col("_s._nb") - F.coalesce("c", zero)).alias("d"),
        )
    )


def presence_tests(
    tables: DataFrame,
    profile_a: str,
    profile_b: str,
    correction: str | None = "bonferroni",
    alpha: float = ALPHA,
) -> DataFrame:
    """One result record per tracker, corrected as a family."""
    tested = tested_2x2(tables)
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    missing = (F.col("a") + F.col("b") == 0) | (F.col("c") + F.col("d") == 0)
    chi = (F.col("test") == "chi2") & ~missing
    rows = tested.select(
        F.when(chi | missing, "chi-square (2x2)").otherwise("Fisher's exact (2x2)").alias("test_name"),
        F.concat(F.lit(f"{profile_a} vs {profile_b}: "), F.col("tracker")).alias("comparison"),
        F.when(missing, float("nan")).otherwise(F.col("statistic")).alias("statistic"),
        F.when(missing, 1.0).otherwise(F.col("p_value")).alias("p_value"),
        F.when(chi, F.sqrt(F.col("statistic") / n)).alias("effect_size"),
        F.when(chi, "Cramer's V").alias("effect_size_name"),
        F.when(missing, 0).otherwise(n).cast("long").alias("n_observations"),
        F.when(missing, "Insufficient data — one or both profiles missing").otherwise("").alias("notes"),
    )
    if correction is None:
        rows = rows.withColumn("p_value_corrected", F.col("p_value"))
    else:
        rows = correct_pvalues(rows, method=correction, listed=True)
    return (
        rows.withColumn("correction_method", F.lit(correction or "none"))
        .withColumn("reject_null", F.col("p_value_corrected") < alpha)
        .select(*RESULT_COLUMNS)
        .orderBy("p_value_corrected", "comparison")
    )


# --- metrics ---------------------------------------------------------------------------------


def requests_per_visit(requests: DataFrame, **_) -> DataFrame:
    return requests.groupBy("profile", "visit_id").agg(F.count("*").alias("metric_value"))


def unique_hosts_per_visit(requests: DataFrame, **_) -> DataFrame:
    return (
        requests.where(has_http_scheme("url"))
        .groupBy("profile", "visit_id")
        .agg(F.count_distinct(hostname("url")).alias("metric_value"))
    )


def cookies_per_visit(cookies: DataFrame, **_) -> DataFrame:
    return cookies.groupBy("profile", "visit_id").agg(F.count("*").alias("metric_value"))


def third_party_cookies_per_visit(cookies: DataFrame, visits: DataFrame, **_) -> DataFrame:
    """Cookies whose host text differs from the site's host; a leading dot counts as different."""
    sites = visits.select("profile", "visit_id", hostname("site_url").alias("_site"))
    return (
        cookies.join(sites, ["profile", "visit_id"])
        .where(F.col("_site") != F.col("host"))
        .groupBy("profile", "visit_id")
        .agg(F.count("*").alias("metric_value"))
    )


def tier_cookies_per_visit(cookies: DataFrame, **_) -> DataFrame:
    """Cookies in a third-party tier."""
    return (
        cookies.where(third_party())
        .groupBy("profile", "visit_id")
        .agg(F.count("*").alias("metric_value"))
    )


METRICS: Mapping[str, Callable[..., DataFrame]] = {
    "requests_per_visit": requests_per_visit,
    "unique_hosts_per_visit": unique_hosts_per_visit,
    "cookies_per_visit": cookies_per_visit,
    "third_party_cookies_per_visit": third_party_cookies_per_visit,
    "tier_cookies_per_visit": tier_cookies_per_visit,
}


def metric(name: str, **tables: DataFrame) -> DataFrame:
    check_choice("metric", name, tuple(METRICS))
    return METRICS[name](**tables)


def metric_from_sql(spark, template: str, profiles: Sequence[str]) -> DataFrame:
    """A caller's own metric: SQL over registered views with a `{profiles}` placeholder, giving
    (profile, visit_id, metric_value). Other braces, as in patterns, stay as they are."""
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in profiles)
    return spark.sql(template.replace("{profiles}", f"({listed})"))


# --- rank tests ------------------------------------------------------------------------------


def _value_table(metrics: DataFrame, profiles: Sequence[str], value: str) -> DataFrame:
    """One row per distinct value with a count per profile."""
    p = F.col("profile")
    return (
        metrics.where(p.isin(*profiles) & F.col(value).isNotNull())
        .groupBy(F.col(value).alias("v"))
        .agg(*[count_if(p == x).alias(f"_n{i}") for i, x in enumerate(profiles)])
    )


def _stored_value_table(metrics: DataFrame, profiles: Sequence[str], value: str) -> DataFrame:
    """The same, written once: ranks read it several times, and the metric below it groups whole crawls."""
    return written(_value_table(metrics, profiles, value), "value_counts")


def kruskal_wallis(
    metrics: DataFrame, profiles: Sequence[str], name: str, value: str = "metric_value"
) -> DataFrame:
    """H with tie correction over all profiles that have data, and epsilon squared."""
    return _kruskal_wallis(_stored_value_table(metrics, profiles, value), profiles, name)


def _kruskal_wallis(table: DataFrame, profiles: Sequence[str], name: str) -> DataFrame:
    k_all = range(len(profiles))
    table = table.withColumn("n", sum((F.col(f"_n{i}") for i in k_all), F.lit(0)))
    ranked = with_running_count(table, "v")
    t = _d("n")
    sums = ranked.agg(
        F.sum("n").alias("n"),
        F.sum(t * t * t - t).alias("ties"),
        *[F.sum(f"_n{i}").alias(f"_n{i}") for i in k_all],
        *[F.sum(mid_rank() * F.col(f"_n{i}")).alias(f"_r{i}") for i in k_all],
    )
    n = _d("n")
    groups = sum((F.when(F.col(f"_n{i}") > 0, 1).otherwise(0) for i in k_all), F.lit(0))
    spread = sum(
        (F.coalesce(F.try_divide(_d(f"_r{i}") * _d(f"_r{i}"), _d(f"_n{i}")), F.lit(0.0)) for i in k_all),
        F.lit(0.0),
    )
    raw = F.try_divide(F.lit(12.0) * spread, n * (n + 1)) - 3 * (n + 1)
    correction = 1 - F.try_divide(F.col("ties"), n * n * n - n)
    out = (
        sums.withColumn("k", groups)
        .withColumn("h", F.try_divide(raw, correction))
        .withColumn("_dof", (F.col("k") - 1).cast("double"))
        .withColumn("_p", chi2_sf(F.col("h"), F.col("_dof")))
    )
    few = F.col("k") < 2
    return out.select(
        F.lit("Kruskal-Wallis H").alias("test_name"),
        F.when(few, f"all profiles: {name}")
        .otherwise(F.concat(F.col("k").cast("string"), F.lit(f" profiles: {name}")))
        .alias("comparison"),
        F.when(few, float("nan")).otherwise(F.col("h")).alias("statistic"),
        F.when(few, 1.0).otherwise(F.col("_p")).alias("p_value"),
        F.when(
            ~few & (n > F.col("k")),
            F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (n - F.col("k"))),
        ).alias("effect_size"),
        F.when(~few & (n > F.col("k")), "epsilon²").alias("effect_size_name"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_observations"),
        F.when(few, "Need at least 2 non-empty groups").otherwise("").alias("notes"),
    )


def rank_sums(
    metrics: DataFrame,
    pairs: Sequence[tuple[str, str]],
    value: str = "metric_value",
) -> DataFrame:
    """Per pair: sizes, rank sum of the first profile, U of both, and the tie term.

    All pairs come from one table of distinct values; ranks are per pair.
    """
    profiles = list(dict.fromkeys(x for pair in pairs for x in pair))
    return _rank_sums(_stored_value_table(metrics, profiles, value), profiles, pairs)


def _rank_sums(table: DataFrame, profiles: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    at = {p: i for i, p in enumerate(profiles)}
    entries = [
        F.struct(
            F.lit(a).alias("profile_a"),
            F.lit(b).alias("profile_b"),
            F.col(f"_n{at[a]}").alias("n_a"),
            F.col(f"_n{at[b]}").alias("n_b"),
        )
        for a, b in pairs
    ]
    by = ["profile_a", "profile_b"]
    long = (
        table.select("v", F.explode(F.array(*entries)).alias("e"))
        .select("v", "e.*")
        .withColumn("n", F.col("n_a") + F.col("n_b"))
        .where(F.col("n") > 0)
    )
    t = _d("n")
    return (
        with_running_count(long, "v", by)
        .groupBy(*by)
        .agg(
            F.sum("n_a").alias("n_a"),
            F.sum("n_b").alias("n_b"),
            F.sum(mid_rank() * F.col("n_a")).alias("rank_sum_a"),
            F.sum(t * t * t - t).alias("tie_term"),
        )
        .withColumn("u_a", F.col("rank_sum_a") - _d("n_a") * (_d("n_a") + 1) / 2)
        .withColumn("u_b", _d("n_a") * _d("n_b") - F.col("u_a"))
    )


def mann_whitney(
    metrics: DataFrame,
    pairs: Sequence[tuple[str, str]],
    name: str,
    value: str = "metric_value",
) -> DataFrame:
    """Two-sided U test for every pair. Exact where a sample has at most 8 rows and nothing is tied,
    else the normal approximation with continuity correction."""
    return _mann_whitney(rank_sums(metrics, pairs, value), pairs, name)


def _mann_whitney(sums: DataFrame, pairs: Sequence[tuple[str, str]], name: str) -> DataFrame:
    n1, n2 = _d("n_a"), _d("n_b")
    n = n1 + n2
    usable = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    variance = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1)))
    z = F.try_divide(F.greatest("u_a", "u_b") - n1 * n2 / 2 - 0.5, F.sqrt(variance))
    small = usable & (F.least("n_a", "n_b") <= 8) & (F.col("tie_term") == 0)
    keep = F.when(small, F.col("u_a")).otherwise(0.0)
    tested = (
        sums.withColumn("_z", F.coalesce(z, F.lit(0.0)))
        .withColumn("_p_normal", normal_two_sided("_z"))
        .withColumn("_u", keep)
        .withColumn("_k1", F.when(small, F.col("n_a")).otherwise(0))
        .withColumn("_k2", F.when(small, F.col("n_b")).otherwise(0))
        .withColumn("_p_exact", mann_whitney_exact_p("_u", "_k1", "_k2"))
        .withColumn("_small", small)
    )
    frame = sums.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "ord int, profile_a string, profile_b string"
    )
    ok = F.coalesce(usable, F.lit(False))
    return (
        frame.join(tested, ["profile_a", "profile_b"], "left")
        .select(
            "ord",
            F.lit("Mann-Whitney U").alias("test_name"),
            F.concat("profile_a", F.lit(" vs "), "profile_b", F.lit(f": {name}")).alias("comparison"),
            F.when(ok, F.col("u_a")).otherwise(float("nan")).alias("statistic"),
            F.when(~ok, 1.0)
            .when(F.col("_small"), F.col("_p_exact"))
            .otherwise(F.col("_p_normal"))
            .alias("p_value"),
            F.when(ok, 1 - 2 * F.col("u_a") / (n1 * n2)).alias("effect_size"),
            F.when(ok, "rank-biserial r").alias("effect_size_name"),
            (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).cast("long").alias("n_observations"),
            F.when(ok, "").otherwise("Insufficient data in one or both profiles").alias("notes"),
        )
    )


def pairwise_battery(
    metrics: DataFrame,
    name: str,
    *,
    study: Study,
    correction: str = "bonferroni",
    baseline: str | None = None,
    value: str = "metric_value",
) -> DataFrame:
    """Omnibus test plus every profile against the baseline; the correction covers the pairs."""
    baseline = study.resolve_baseline(baseline)
    pairs = [(p, baseline) for p in study.profiles if p != baseline]
    table = _stored_value_table(metrics, study.profiles, value)
    omnibus = (
        _kruskal_wallis(table, study.profiles, name)
        .withColumn("p_value_corrected", F.col("p_value"))
        .withColumn("correction_method", F.lit("none"))
        .withColumn("ord", F.lit(-1))
    )
    tests = correct_pvalues(
        _mann_whitney(_rank_sums(table, study.profiles, pairs), pairs, name), method=correction, listed=True
    ).withColumn("correction_method", F.lit(correction))
    return (
        omnibus.unionByName(tests)
        .withColumn("reject_null", F.col("p_value_corrected") < study.alpha)
        .orderBy("ord")
        .select(*RESULT_COLUMNS)
    )


# --- category tests --------------------------------------------------------------------------


def category_tables(
    counts: DataFrame, baseline: str, category: str = "category", n: str = "n_ads"
) -> DataFrame:
    """2x2 cells per (profile, category) against the baseline, over all categories met anywhere."""
    p = F.col("profile")
    base = counts.groupBy("profile", category).agg(F.sum(n).alias("n"))
    totals = base.groupBy("profile").agg(F.sum("n").alias("_total"))
    base_total = totals.where(p == baseline).select(F.col("_total"))
    base_n = base.groupBy(category).agg(
        F.sum(F.when(p == baseline, F.col("n")).otherwise(0)).alias("c")
    )
    # Every profile meets every category: the profile list hangs on each category row.
    others = totals.where(p != baseline).agg(
        F.array_sort(F.collect_list(F.struct("profile", "_total"))).alias("o")
    )
    spine = (
        base_n.withColumn("_o", others.scalar())
        .select(category, "c", F.explode("_o").alias("_o"))
        .select(category, "c", "_o.profile", "_o._total")
    )
    zero = F.lit(0).cast("long")
    return (
        spine.join(base.withColumnRenamed("n", "a"), ["profile", category], "left")
        .withColumn("a", F.coalesce("a", zero))
        .withColumn("_base", base_total.scalar())
        .select(
            "profile",
            category,
            "a",
            (F.col("_total") - F.col("a")).alias("b"),
            "c",
            (F.col("_base") - F.col("c")).alias("d"),
        )
    )


def category_pvalues(
    counts: DataFrame,
    baseline: str,
    category: str = "category",
    n: str = "n_ads",
    bonferroni: bool = True,
) -> DataFrame:
    """Does a profile's share of a category differ from the baseline's? Cells without any ad of the
    category on either side are skipped and do not count as tests."""
    tables = category_tables(counts, baseline, category, n)
    skipped = (F.col("a") + F.col("c") == 0) | (
        F.col("a") + F.col("b") + F.col("c") + F.col("d") == 0
    )
    degenerate = (
        (F.col("a") + F.col("b") == 0)
        | (F.col("c") + F.col("d") == 0)
        | (F.col("b") + F.col("d") == 0)
    )
    zero = F.lit(0.0)
    rows = tested_2x2(tables).select(
        "profile",
        category,
        F.col("a").alias("n_persona"),
        F.col("c").alias("n_control"),
        F.coalesce(percent("a", F.col("a") + F.col("b")), zero).alias("pct_persona"),
        F.coalesce(percent("c", F.col("c") + F.col("d")), zero).alias("pct_control"),
        F.when(~skipped & ~degenerate, F.col("p_value")).alias("p_raw"),
        F.when(skipped, "skipped").when(degenerate, "error").otherwise(F.col("test")).alias("test_used"),
    )
    if bonferroni:
        rows = correct_pvalues(rows, "p_raw", name="p_adj")
    else:
        rows = rows.withColumn("p_adj", F.col("p_raw"))
    return rows.withColumn("sig", sig_marker("p_adj")).orderBy("profile", category)


def contingency(
    ads: DataFrame, min_row_total: int = 10, category: str = "category"
) -> DataFrame:
    """Ads per (normalised category, profile), categories with at least `min_row_total` ads."""
    counts = ads.groupBy(F.lower(F.trim(category)).alias("category"), "profile").agg(
        F.count("*").alias("n_ads")
    )
    return (
        with_group_total(counts, ["category"], "n_ads", "_row")
        .where(F.col("_row") >= min_row_total)
        .drop("_row")
    )


def chi_square_omnibus(
    cells: DataFrame, row: str = "category", column: str = "profile", n: str = "n_ads"
) -> DataFrame:
    """r x c chi-square over the full grid.

    Summed over all cells, (o-e)^2/e equals N * (sum o^2 / (row*col) - 1); cells without rows add
    nothing to that sum, so empty cells need not exist as rows.
    """
    rows = with_group_total(cells, [row], n, "_row")
    both = with_group_total(rows, [column], n, "_col")
    o = _d(n)
    out = both.agg(
        F.sum(o).alias("_n"),
        F.sum(F.try_divide(o * o, _d("_row") * _d("_col"))).alias("_s"),
        F.count_distinct(row).alias("_r"),
        F.count_distinct(column).alias("_c"),
    )
    return (
        out.withColumn("chi2", F.col("_n") * (F.col("_s") - 1))
        .withColumn("dof", (F.col("_r") - 1) * (F.col("_c") - 1))
        .withColumn("_dof", F.col("dof").cast("double"))
        .withColumn("p_value", chi2_sf("chi2", "_dof"))
        .select("chi2", "dof", "p_value", F.col("_n").cast("long").alias("n_observations"))
    )


def category_fisher(
    cells: DataFrame,
    profile_a: str,
    profile_b: str,
    correction: str = "benjamini-hochberg",
    alpha: float = ALPHA,
) -> DataFrame:
    """Fisher's exact test per category between two profiles, with odds ratio and correction."""
    tables = category_tables(
        cells.where(F.col("profile").isin(profile_a, profile_b)), profile_b
    ).where(F.col("profile") == profile_a)
    tested = tables.withColumn("p_value", fisher_p("a", "b", "c", "d")).withColumn(
        "odds_ratio", odds_ratio()
    )
    return (
        correct_pvalues(tested, method=correction, name="p_adj")
        .select(
            "category",
            F.col("a").alias("n_a"),
            F.col("c").alias("n_b"),
            "odds_ratio",
            "p_value",
            "p_adj",
            (F.col("p_adj") < alpha).alias("significant"),
        )
        .orderBy("p_adj", "category")
    )


# --- targeting -------------------------------------------------------------------------------


def _with_without(accuracy: DataFrame) -> DataFrame:
    """One row per profile: ads and on-target ads with and without a pixel."""
    p = F.col("site_has_pixel")
    return accuracy.groupBy("profile").agg(
        F.max(F.when(p, F.col("n_on_target"))).alias("_k1"),
        F.max(F.when(p, F.col("n_ads"))).alias("_m1"),
        F.max(F.when(~p, F.col("n_on_target"))).alias("_k2"),
        F.max(F.when(~p, F.col("n_ads"))).alias("_m2"),
    )


def targeting_tests(accuracy: DataFrame) -> DataFrame:
    """Chi-square (continuity corrected) of on-target against pixel presence, per profile, with its
    marker; 'n/a' where one side is missing or a margin is empty."""
    cells = _with_without(accuracy).select(
        "profile",
        F.col("_k1").alias("a"),
        (F.col("_m1") - F.col("_k1")).alias("b"),
        F.col("_k2").alias("c"),
        (F.col("_m2") - F.col("_k2")).alias("d"),
    )
    return (
        cells.withColumn("chi2", chi2_2x2())
        .withColumn("_x", F.coalesce("chi2", F.lit(float("nan"))))
        .withColumn("_one", F.lit(1.0))
        .withColumn("_p", chi2_sf("_x", "_one"))
        .withColumn("p_value", F.when(F.col("chi2").isNotNull(), F.col("_p")))
        .select("profile", "chi2", "p_value", sig_marker("p_value", none="n/a").alias("sig"))
    )


def targeting_lift(accuracy: DataFrame, z: float = 1.96) -> DataFrame:
    """Ratio of on-target rates with a symmetric band; the lower end stops at 0."""
    p1 = ratio("_k1", "_m1")
    p2 = ratio("_k2", "_m2")
    m1, m2 = _d("_m1"), _d("_m2")
    se = F.sqrt(F.try_divide(p1 * (1 - p1), m1) + F.try_divide(p2 * (1 - p2), m2))
    lift = F.try_divide(p1, p2)
    return (
        _with_without(accuracy)
        .withColumn("lift", lift)
        .withColumn("_half", z * se * F.col("lift"))
        .where(F.col("lift").isNotNull())
        .select(
            "profile",
            "lift",
            F.greatest(F.col("lift") - F.col("_half"), F.lit(0.0)).alias("ci_low"),
            (F.col("lift") + F.col("_half")).alias("ci_high"),
        )
    )
