"""Ranks, percentiles and tests against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlprism.config import Study
from crawlprism.functions import grams
from crawlprism.operators import ranks, reports, stats

STUDY = Study(profiles=("a", "b", "c"))


def frame(spark, groups):
    rows = [(p, i, float(v)) for p, values in groups.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "profile string, visit_id long, metric_value double")


def skewed(seed=1, n=3000):
    """A third of all rows share one value."""
    rng = random.Random(seed)
    return {
        p: [7.0 if rng.random() < 1 / 3 else round(rng.lognormvariate(1, 1), 1) for _ in range(n // (i + 1))]
        for i, p in enumerate(STUDY.profiles)
    }


def mid_ranks(values):
    order = sorted(values)
    first = {}
    for i, v in enumerate(order):
        first.setdefault(v, i)
    return {v: first[v] + (order.count(v) + 1) / 2 for v in first}


def test_ranks_and_percentiles(spark):
    groups = skewed()
    df = frame(spark, groups)
    counts = ranks.value_counts(df, "metric_value", ["profile"])
    ranked = ranks.with_running_count(counts, "metric_value", ["profile"]).collect()
    for p, values in groups.items():
        ordered = np.sort(values)
        for r in (x for x in ranked if x.profile == p):
            assert r.n_before == np.searchsorted(ordered, r.metric_value, side="left")
    out = ranks.exact_percentiles(df, "metric_value", {"p25": 0.25, "p99": 0.99}, ["profile"])
    for r in out.collect():
        assert r.p25 == pytest.approx(np.percentile(groups[r.profile], 25))
        assert r.p99 == pytest.approx(np.percentile(groups[r.profile], 99))
    whole = ranks.exact_percentiles(df, "metric_value", {"p50": 0.5}).first()
    assert whole.p50 == pytest.approx(np.percentile(sum(groups.values(), []), 50))


def test_mann_whitney_and_kruskal(spark):
    groups = skewed(n=900)
    df = frame(spark, groups)
    sums = {(r.profile_a, r.profile_b): r for r in stats.rank_sums(df, [("b", "a"), ("c", "a")]).collect()}
    for (x, y), r in sums.items():
        rank = mid_ranks(groups[x] + groups[y])
        u = sum(rank[v] for v in groups[x]) - len(groups[x]) * (len(groups[x]) + 1) / 2
        assert r.u_a == pytest.approx(u)
        assert r.u_a + r.u_b == pytest.approx(len(groups[x]) * len(groups[y]))
    h = stats.kruskal_wallis(df, STUDY.profiles, "m").first()
    grown = df.withColumn("metric_value", F.exp("metric_value") + 3)
    assert stats.kruskal_wallis(grown, STUDY.profiles, "m").first().statistic == pytest.approx(h.statistic)
    assert h.comparison == "3 profiles: m" and 0 <= h.p_value <= 1


def test_small_and_missing_samples(spark):
    df = frame(spark, {"a": [1, 2, 3], "b": [4, 5, 6]})
    rows = stats.mann_whitney(df, [("b", "a"), ("c", "a")], "m").orderBy("ord").collect()
    assert rows[0].p_value == pytest.approx(0.1) and rows[0].statistic == 9 and rows[0].effect_size == -1
    assert rows[1].p_value == 1.0 and rows[1].notes and rows[1].n_observations == 3
    alone = stats.kruskal_wallis(frame(spark, {"a": [1, 2]}), STUDY.profiles, "m").first()
    assert alone.p_value == 1.0 and alone.notes == "Need at least 2 non-empty groups"


def test_battery(spark):
    out = stats.pairwise_battery(frame(spark, skewed(n=300)), "m", study=STUDY).collect()
    assert [r.test_name for r in out] == ["Kruskal-Wallis H", "Mann-Whitney U", "Mann-Whitney U"]
    assert out[0].correction_method == "none" and out[1].p_value_corrected >= out[1].p_value
    with pytest.raises(ValueError):
        stats.pairwise_battery(frame(spark, {}), "m", study=STUDY, baseline="nobody")


def test_corrections(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, None, 0.03]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p_value double")
    bon = {r.i: r.p_value_corrected for r in stats.correct_pvalues(df).collect()}
    bh = {r.i: r.p_value_corrected for r in stats.correct_pvalues(df, method="benjamini-hochberg").collect()}
    for method, got in (("bonferroni", bon), ("benjamini-hochberg", bh)):
        listed = {r.i: r.p_value_corrected for r in stats.correct_pvalues(df, method=method, listed=True).collect()}
        assert listed == pytest.approx(got)
    known = [i for i, p in enumerate(ps) if p is not None]
    assert bon[5] is None and bh[5] is None
    for i in known:
        assert bon[i] == pytest.approx(min(1, ps[i] * 6))
        assert ps[i] <= bh[i] <= bon[i] + 1e-12
    ordered = sorted(known, key=lambda i: ps[i])
    assert all(bh[x] <= bh[y] + 1e-12 for x, y in zip(ordered, ordered[1:]))
    assert bh[3] == pytest.approx(0.03) and bh[0] == pytest.approx(0.03)
    with pytest.raises(ValueError):
        stats.correct_pvalues(df, method="sidak")


def test_presence(spark):
    rows = [("a", v, f"https://x.com/{v % 2}") for v in range(40)] + [("a", 0, "https://x.com/0")] * 50
    rows += [("b", v, "https://y.com/1") for v in range(30)] + [("b", 3, "https://z%z.com/")]
    df = spark.createDataFrame(rows, "profile string, visit_id long, url string")
    tables = {r.tracker: (r.a, r.b, r.c, r.d) for r in stats.presence_tables(df, "a", "b", ["x.com/0", "y.com", "z%z", "none"]).collect()}
    assert tables == {"x.com/0": (20, 20, 0, 30), "y.com": (0, 40, 30, 0), "z%z": (0, 40, 1, 29), "none": (0, 40, 0, 30)}
    out = {r.comparison.split(": ")[1]: r for r in stats.presence_tests(stats.presence_tables(df, "a", "b", list(tables)), "a", "b").collect()}
    assert out["x.com/0"].test_name == "chi-square (2x2)" and out["x.com/0"].effect_size_name == "Cramer's V"
    assert out["z%z"].test_name == "Fisher's exact (2x2)" and out["z%z"].effect_size is None
    lonely = stats.presence_tests(stats.presence_tables(df, "a", "nobody", ["x.com"]), "a", "nobody").first()
    assert lonely.p_value == 1.0 and lonely.n_observations == 0 and not lonely.reject_null


@pytest.mark.parametrize("match", ["contains", "like", "equals"])
def test_presence_by_index_equals_the_walk(spark, monkeypatch, match):
    """Short, shared, overlapping and empty patterns, wildcards and escapes, null and short texts."""
    pick = random.Random(11)
    letters = "ab.%_\\c"
    word = lambda n: "".join(pick.choice(letters) for _ in range(pick.randrange(n)))
    texts = [word(14) for _ in range(200)] + [None, "", "a"]
    rows = [(pick.choice("ab"), v % 60, t) for v, t in enumerate(texts)]
    patterns = sorted({word(7) for _ in range(80)} | {"", "a", "aaaa", "%", "a_c"})
    if match == "like":  # a lone backslash at the end is no valid pattern
        patterns = [p for p in patterns if re.fullmatch(r"(?s)(?:\\[%_\\]|[^\\])*", p)]
    df = spark.createDataFrame(rows, "profile string, visit_id long, url string")
    found = []
    for walked in (10_000, 0):
        monkeypatch.setattr(stats, "WALKED", walked)
        found.append(sorted(map(tuple, stats.presence_tables(df, "a", "b", patterns, match=match).collect())))
    assert found[0] == found[1] and len(found[0]) == len(patterns)
    if match == "contains":
        for p, a, *_ in found[0]:
            assert a == len({v for who, v, t in rows if who == "a" and t is not None and p in t})


def test_anchors_are_the_rarest_grams():
    got = grams.anchors(["ads.com", "clic.com", "cli", "%", "x%", "a\\%b_"], like=True)
    assert got["%"] == "" and got["x%"] == "x" and got["a\\%b_"] == "a%b" and ".com" not in got.values()


def test_category_pvalues(spark):
    rows = [("a", "x", 50), ("a", "y", 50), ("b", "x", 90), ("b", "y", 10), ("c", "z", 5)]
    df = spark.createDataFrame(rows, "profile string, category string, n_ads long")
    out = {(r.profile, r.category): r for r in stats.category_pvalues(df, "a").collect()}
    assert len(out) == 6
    assert out["b", "z"].test_used == "skipped" and out["b", "z"].p_raw is None and out["b", "z"].sig == ""
    assert out["b", "x"].test_used == "chi2" and out["b", "x"].sig == "***"
    assert out["c", "z"].test_used == "fisher"
    assert out["b", "x"].p_adj == pytest.approx(min(1, out["b", "x"].p_raw * 5))


def test_histogram_keeps_upper_edge(spark):
    df = frame(spark, {"a": [0, 10, 10, 10], "b": [5, 1000]})
    edge = ranks.exact_percentiles(df, "metric_value", {"q": 1.0}).first().q
    assert edge == 1000
    out = reports.shared_histogram(df, "metric_value", quantile=1.0).collect()
    assert sum(r.n for r in out) == 6 and {r.bin for r in out} == {1, 49}
