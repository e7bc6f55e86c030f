"""Scalar functions on the awkward values."""

import math
import random
from itertools import combinations
from math import comb

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from crawlprism.functions import columns as C
from crawlprism.functions.labels import with_label_record, with_network, with_pixel
from crawlprism.functions.probability import (
    chi2_tail,
    fisher_two_sided,
    mann_whitney_exact,
)
from crawlprism.functions.text import clean_text, contains_any, first_category, squeeze
from crawlprism.functions import suffixes
from crawlprism.functions.urls import (
    full_host,
    host_suffixes,
    hostname,
    last_two_labels,
    read_suffix_rules,
    registered_domain,
    with_registered_domain,
)

URLS = {
    "https://www.a.example.co.uk:80/x?y": ("example.co.uk", "example.co.uk"),
    ".tracker.com": ("tracker.com", "tracker.com"),
    "HTTP://u:p@B.Com./": ("b.com", "b.com"),
    "com": ("com", None),
    "google": ("google", None),
    "blog.google": ("blog.google", "blog.google"),
    "1.2.3.4": (None, None),
    "http://1.2.3.4:8080/a": (None, None),
    "http://[::1]:80/": (None, None),
    "": (None, None),
    "localhost": (None, None),
    "a.shop.photography": ("shop.photography", "shop.photography"),
    "news.email": ("news.email", "news.email"),
    "https://x.y.xn--p1ai/": ("y.xn--p1ai", "y.xn--p1ai"),
    "10.0.0.1": (None, None),
    "data:image/png;base64,aa": ("data", None),  # a top-level name of its own
    "http://a.b.gob.mx/": ("b.gob.mx", "b.gob.mx"),
    "x.com.co": ("x.com.co", "x.com.co"),
    "https://a.b.c.kawasaki.jp/": ("b.c.kawasaki.jp", "b.c.kawasaki.jp"),
    "a.city.kawasaki.jp": ("city.kawasaki.jp", "city.kawasaki.jp"),
    "kawasaki.jp": ("kawasaki.jp", "kawasaki.jp"),
    "www.ck": ("www.ck", "www.ck"),
    "a.b.ck": ("a.b.ck", "a.b.ck"),
    "b.ck": ("b.ck", None),
    "ck": ("ck", None),
    "nhs.uk": ("nhs.uk", None),
    "a.nhs.uk": ("a.nhs.uk", "a.nhs.uk"),
    "a.b.github.io": ("github.io", "github.io"),  # private suffixes do not count
    "x.pvt.k12.ma.us": ("x.pvt.k12.ma.us", "x.pvt.k12.ma.us"),
    "a.b.unlisted": ("b.unlisted", "b.unlisted"),
    "co.uk": ("co.uk", None),
    "http://x.y.z.de/?u=http://other.com": ("z.de", "z.de"),
    "//cdn.foo.net/a": ("foo.net", "foo.net"),
}


def test_registered_domain(spark):
    df = spark.createDataFrame([(u,) for u in URLS] + [(None,)], "u string")
    got = {
        r.u: (r.d, r.s)
        for r in df.select(
            "u", registered_domain("u").alias("d"), registered_domain("u", brand_tld=False).alias("s")
        ).collect()
    }
    assert got.pop(None) == (None, None)
    assert got == URLS


def test_registered_domain_by_rule_file(spark, tmp_path, monkeypatch):
    rules = tmp_path / "rules.txt"
    rules.write_text("// comment\n\ncom\nuk\nco.uk\n*.ck\n!www.ck\nck\na.b.c.d.e.uk\n")
    table = read_suffix_rules(spark, str(rules))
    cases = {
        "https://a.b.co.uk/": "b.co.uk",
        "https://b.uk": "b.uk",
        "https://x.y.foo.ck": "y.foo.ck",
        "https://a.www.ck": "www.ck",
        "https://foo.ck": "foo.ck",
        "https://n.unlisted": "n.unlisted",
        "https://p.a.b.c.d.e.uk": "p.a.b.c.d.e.uk",
        "https://x.p.a.b.c.d.e.uk": "p.a.b.c.d.e.uk",
        "https://10.0.0.1/": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    for most in (suffixes.TRIE_BYTES, 0):  # as a trie, and joined
        monkeypatch.setattr(suffixes, "TRIE_BYTES", most)
        got = {r.u: r.domain for r in with_registered_domain(df, "u", rules=table).collect()}
        assert got == cases
        strict = {r.u: r.domain for r in with_registered_domain(df, "u", rules=table, brand_tld=False).collect()}
        assert strict == cases | {"https://foo.ck": None}
    plan = with_registered_domain(df, "u", rules=suffixes.from_table(table) or suffixes.from_list(rules.read_text().splitlines()))
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def longest_rule(host: str, rules: list[str]) -> str | None:
    """The registered domain by the public suffix algorithm, rule by rule."""
    labels = host.split(".")
    best, exception = int(len(labels) > 1 or f"*.{host}" in rules), 0
    for rule in rules:
        parts = rule.removeprefix("!").split(".")
        if len(parts) <= len(labels) and all(p in ("*", x) for p, x in zip(reversed(parts), reversed(labels))):
            if rule.startswith("!"):
                exception = max(exception, len(parts) - 1)
            else:
                best = max(best, len(parts))
    n = exception or best
    return None if not n else ".".join(labels[-n - 1 :])


def test_trie_equals_the_suffix_algorithm(spark):
    pick = random.Random(4)
    names = ["a", "b", "c", "d"]
    for _ in range(12):
        some = {".".join(pick.choice(names) for _ in range(pick.randrange(1, 5))) for _ in range(12)}
        rules = [pick.choice(["", "", "*."]) + r for r in some]
        rules += ["!" + pick.choice(names) + "." + r[2:] for r in rules if r.startswith("*.") and pick.random() < 0.5]
        trie = suffixes.SuffixTrie.of(rules)
        hosts = sorted({".".join(pick.choice(names) for _ in range(pick.randrange(1, 8))) for _ in range(120)})
        df = spark.createDataFrame([(h,) for h in hosts], "h string")
        got = [r.d for r in df.select(registered_domain("h", rules=trie).alias("d")).collect()]
        assert got == [longest_rule(h, rules) for h in hosts], rules


def test_a_walk_names_each_rule_once(spark):
    trie = suffixes.SuffixTrie.of(["com", "co.uk", "x.co.uk", *(f"r{i}.b.uk" for i in range(50))])
    assert trie.depth == 3
    df = spark.createDataFrame([("https://a.r7.b.uk/",), ("https://a.r77.b.uk/",), ("b.uk",)], "u string")
    got = with_registered_domain(df.repartition(1), "u", rules=trie)
    # The driver copies and prints the rules with the plan; they used to stand there once a step.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f",{name}:1") for name in ("com", "co.uk", "r7.b.uk")] == [1, 1, 1]
    assert sorted(r.domain for r in got.collect()) == ["a.r7.b.uk", "b.uk", "b.uk"]


def test_private_rules_are_left_out_unless_asked_for():
    lines = ["// ===BEGIN ICANN DOMAINS===", "com", "// ===END ICANN DOMAINS===", "// ===BEGIN PRIVATE DOMAINS===", "blog.com", "// ===END PRIVATE DOMAINS==="]
    assert suffixes.from_list(lines).depth == 1 and suffixes.from_list(lines, private=True).depth == 2


def exact_fisher(a: int, b: int, c: int, d: int) -> float:
    """In whole numbers, for tables whose first row is short."""
    row, column, n = a + b, a + c, a + b + c + d
    ways = [comb(column, x) * comb(n - column, row - x) for x in range(row + 1)]
    return sum(w for w in ways if w * 10**7 <= ways[a] * (10**7 + 1)) / comb(n, row)


def test_fisher_keeps_its_digits_at_large_counts():
    tables = [(3, 40, 10**9, 9 * 10**9), (12, 60, 10**9, 9 * 10**9 + 7), (0, 25, 10**10, 10**10), (9, 1, 10**10, 3 * 10**10), (30, 0, 10**8, 10**9),
              (1, 200, 10**10, 10**12), (120, 80, 5 * 10**9, 5 * 10**9), (400, 600, 3000, 7000), (16, 16, 17, 15), (0, 0, 3, 4), (5, 0, 0, 5)]
    for table in tables:
        assert fisher_two_sided(*table) == pytest.approx(exact_fisher(*table), rel=1e-9), table


def test_hosts(spark):
    row = spark.range(1).select(
        hostname(F.lit("https://A.b.com:8/x")).alias("h"),
        hostname(F.lit("no scheme")).alias("none"),
        full_host(F.lit("https://A.b.com:8/x")).alias("f"),
        last_two_labels(F.lit("a.b.c")).alias("two"),
        last_two_labels(F.lit("a")).alias("one"),
        host_suffixes(F.lit("a.b.c")).alias("s"),
    ).first()
    assert tuple(row) == ("A.b.com:8", "", "a.b.com", "b.c", "a", ["a.b.c", "b.c", "c"])


def test_text(spark):
    row = spark.range(1).select(
        clean_text(F.lit("Hello me@x.com http://a.b/c WORLD ab ça va é3four@ @x.y\ttab")).alias("c"),
        clean_text(F.lit(None).cast("string")).alias("n"),
        squeeze(F.lit("  a \n\t b ")).alias("q"),
        contains_any(F.lit("50% off"), ["% off"]).alias("lit"),
        contains_any(F.lit("50 x off"), ["% off"]).alias("no_wildcard"),
        contains_any(F.lit("50 x off"), ["% off"], wildcards=True).alias("wildcard"),
        first_category(F.lit("Bank SALE"), {"A": ("sale",), "B": ("bank",)}).alias("first"),
        first_category(F.lit("none"), {"A": ("sale",)}).alias("unknown"),
    ).first()
    assert tuple(row) == ("hello world four tab", "", "a b", True, False, True, "A", "Unknown")


def test_columns(spark):
    row = spark.range(1).select(
        C.round_to(F.lit(1.005), 2).alias("r"),
        C.round_to(F.lit(-2.5), 0).alias("neg"),
        C.percent(F.lit(1), F.lit(0)).alias("p"),
        C.lifespan_bucket(F.lit(-0.5))[0].alias("expired"),
        C.lifespan_bucket(F.lit(365.0))[0].alias("year"),
        C.intensity_bucket(F.lit(0))[0].alias("low"),
        C.intensity_bucket(F.lit(11))[0].alias("extreme"),
        C.sig_marker(F.lit(None).cast("double")).alias("none"),
        C.sig_marker(F.lit(0.05)).alias("ns"),
        C.to_bool(F.lit("True")).alias("t"),
        C.to_bool(F.lit("maybe")).alias("m"),
        C.ad_size(F.lit(728.0), F.lit(90.0)).alias("s"),
    ).first()
    assert tuple(row) == (
        1.0, -3.0, None, "session", "1y+", "1 (Low)", "11+ (Extreme)", "", "ns", True, False,
        "728x90 leaderboard",
    )


def test_network_resolution(spark):
    cases = [
        ("https://ad.doubleclick.net/x", None, "google_adsense", ("google_doubleclick", "src_regex", True)),
        (None, "<iframe src=//TABOOLA.com>", "unknown", ("taboola", "outerhtml_regex", False)),
        (None, None, "criteo", ("criteo", "capture_metadata", True)),
        (None, "", "none", ("unknown", "unknown", False)),
        ("https://criteo.net", "taboola.com", None, ("criteo", "src_regex", True)),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, s string, h string, n string")
    got = {r.i: tuple(r.o) for r in with_network(df, "s", "h", "n", "o").collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_pixels(spark):
    cases = {
        "https://www.facebook.com/tr?id=1": ("Meta Pixel", "facebook.com", r"/tr/?(\?|$)"),
        "https://connect.facebook.net/en_US/fbevents.js": ("Meta Pixel", "connect.facebook.net", r"/en_US/fbevents\.js"),
        "https://facebook.com/about": None,
        "https://notfacebook.com/tr?id=1": None,
        "https://x.stats.g.doubleclick.net/ACTIVITY;": ("DoubleClick", "stats.g.doubleclick.net", "/activity"),
        "https://t.co/i/adsct": ("X/Twitter Pixel", "t.co", "/i/adsct"),
        "": None,
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    got = {r.url: (tuple(r.pixel) if r.pixel else None) for r in with_pixel(df).collect()}
    assert got.pop(None) is None
    assert got == cases
    loose = with_pixel(df, allow_domain_only=True).where("url like '%about'").first().pixel
    assert tuple(loose) == ("Meta Pixel", "facebook.com", None)


def test_label_records(spark):
    cases = {
        '{"is_valid_ad": true, "category": "Retail"}': (True, "Retail", "None"),
        '[{"is_valid_ad": "yes", "reason": "r"}, {"reason": "s"}]': (True, "None", "r"),
        "[7]": (False, "None", "None"),
        "[]": (False, "None", "JSON output unreadable"),
        '"text"': (False, "None", "JSON output unreadable"),
        '{"category": 5}': (False, "None", "JSON output unreadable"),
        '{"is_valid_ad": "perhaps"}': (False, "None", "JSON output unreadable"),
        "{broken": (False, "None", "JSON output unreadable"),
        "": (False, "None", "Empty response message content"),
        "{}": (False, "None", "None"),
    }
    df = spark.createDataFrame([(c, 5) for c in cases], "c string, d int")
    out = with_label_record(df, "c", duration="d")
    got = {r.c: (r.label.is_valid_ad, r.label.category, r.label.reason) for r in out.collect()}
    assert got == cases
    silent = with_label_record(df.withColumn("d", F.lit(None).cast("int")), "c", duration="d")
    assert {r.label.reason for r in silent.collect()} == {"Empty response"}


def brute_fisher(a, b, c, d):
    r, k, n = a + b, a + c, a + b + c + d
    p = lambda x: comb(k, x) * comb(n - k, r - x) / comb(n, r)
    limit = p(a) * (1 + 1e-7)
    return sum(p(x) for x in range(max(0, r + k - n), min(r, k) + 1) if p(x) <= limit)


@settings(max_examples=300, deadline=None)
@given(st.tuples(*[st.integers(0, 15)] * 4))
def test_fisher_matches_enumeration(table):
    if sum(table):
        assert fisher_two_sided(*table) == pytest.approx(brute_fisher(*table), abs=1e-9)


def test_tails():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert chi2_tail(31.410432844230918, 20) == pytest.approx(0.05, abs=1e-9)
    assert chi2_tail(0.0, 3) == 1.0
    assert math.isnan(chi2_tail(float("nan"), 1))


@pytest.mark.parametrize("n1,n2", [(2, 3), (3, 3), (4, 5), (1, 6)])
def test_exact_u_distribution(n1, n2):
    counts: dict[int, int] = {}
    for chosen in combinations(range(1, n1 + n2 + 1), n1):
        u = sum(chosen) - n1 * (n1 + 1) // 2
        counts[u] = counts.get(u, 0) + 1
    total = sum(counts.values())
    for u in counts:
        high = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(v for k, v in counts.items() if k >= high) / total)
        assert mann_whitney_exact(u, n1, n2) == pytest.approx(want)
