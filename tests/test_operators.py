"""Operators on hand-made frames: guards, empty inputs, hot groups, review logic."""

import random

import pytest
from pyspark.sql import functions as F

from crawlprism.config import Study
from crawlprism.operators import ads, cookies, enrich, fingerprint, pixels, prevalence, review, topics

STUDY = Study(profiles=("a", "b", "c"))
ENRICHED = (
    "profile string, visit_id long, url string, top_level_url string, domain string, "
    "subsidiary_entity string, parent_entity string, relationship_tier string, is_technical_3p double"
)
EXT = "external third-party"


def requests(spark, rows):
    return spark.createDataFrame(
        [(p, v, f"https://{d}/", "https://page.com/", d, d, o, tier, 1.0) for p, v, d, o, tier in rows], ENRICHED
    )


def test_guards(spark):
    df = requests(spark, [])
    with pytest.raises(ValueError):
        prevalence.differential_entities(df, "nobody", study=STUDY)
    with pytest.raises(ValueError):
        prevalence.jaccard_similarity(df, study=STUDY, granularity="url")
    with pytest.raises(ValueError):
        fingerprint.detect_canvas(df, granularity="url")
    with pytest.raises(ValueError):
        pixels.check_targets(["Metta Pixel"])
    with pytest.raises(ValueError):
        STUDY.resolve_pair("a")
    assert STUDY.resolve_pair() == ("b", "a") and STUDY.others("b") == ("a", "c")


def test_unknown_owner_does_not_own_a_page(spark):
    df = requests(spark, [("a", 1, "x.com", "", "unknown"), ("a", 1, "y.com", "G", EXT)])
    assert [r.page_parent_entity for r in pixels.page_owners(df).collect()] == ["G"]
    only = requests(spark, [("a", 1, "x.com", "", "unknown")])
    assert pixels.page_owners(only).collect() == []


def test_any_number_of_labels(spark):
    n = 1001
    labels = spark.createDataFrame([(f"l{i:04d}", [float(i == k) for k in range(4)] + [float(i)]) for i in range(n)], "label string, vector array<double>")
    rows = spark.createDataFrame([(1, [0.0, 0.0, 0.0, 0.0, 1.0]), (2, [0.0, 1.0, 0.0, 0.0, 0.0]), (3, None)], "id int, x array<double>")
    got = {r.id: r for r in topics.score_labels(rows, "x", labels).collect()}
    listed = {r.id: r for r in topics.score_labels(rows, "x", [(r.label, r.vector) for r in labels.where("label <> 'l0000'").collect()]).collect()}
    assert got.keys() == {1, 2} and got[2].top_label == "l0001"
    assert (got[2].second_label, listed[2].second_label) == ("l0000", "l0002")  # ties go to the smaller name
    assert got[2].top_confidence == pytest.approx(listed[2].top_confidence)
    with pytest.raises(ValueError):
        topics.label_set("nobody")


def test_more_symbols_than_one_mask_holds(spark):
    names = [f"s{i}" for i in range(100)]
    rows = [("a", f"https://x.com/{k}", "o", 1, s, EXT, 1.0) for k, some in enumerate((names, names[60:63], names[:4])) for s in some]
    df = spark.createDataFrame(rows, "profile string, script_url string, parent_entity string, visit_id long, symbol string, relationship_tier string, is_technical_3p double")
    got = {r.script_url[-1]: r for r in fingerprint.detect_probers(df, 3, symbols=names).collect()}
    assert {k: r.n_attributes_read for k, r in got.items()} == {"0": 100, "1": 3, "2": 4}
    assert got["1"].attributes_list == "s60, s61, s62"


def test_empty_inputs_keep_their_schema(spark):
    df = requests(spark, [])
    assert prevalence.prevalence_by_profile(df).columns[:2] == ["profile", "n_visits"]
    assert prevalence.jaccard_similarity(df, study=STUDY).count() == 0
    assert pixels.measured_site_pixels(df).columns[-1] == "has_criteo"
    assert pixels.measured_site_pixels(df).count() == 0
    empty = cookies.detect_cookie_syncs(df.withColumn("value", F.lit("x")))
    rows = cookies.cookie_sync_summary(empty, study=STUDY).collect()
    assert sorted(r.profile for r in rows) == list(STUDY.profiles) and all(r.n_sync_events == 0 for r in rows)


def test_jaccard_properties(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(50), f"d{rng.randrange(12)}.com", "o", EXT) for _ in range(80)]
    sets = {p: {r[2] for r in rows if r[0] == p} for p in "abc"}
    for r in prevalence.jaccard_similarity(requests(spark, rows), study=STUDY).collect():
        x, y = sets[r.profile_a], sets[r.profile_b]
        assert r.jaccard == pytest.approx(len(x & y) / len(x | y))
        if r.profile_a == r.profile_b:
            assert r.jaccard == 1.0


def test_exclusive_counts_every_scheme_but_belongs_by_http(spark):
    df = requests(
        spark,
        [("a", 1, "only.com", "Only", EXT), ("a", 2, "only.com", "Only", EXT), ("b", 1, "both.com", "Both", EXT),
         ("a", 3, "both.com", "Both", EXT), ("b", 9, "only.com", "Only", EXT)],
    ).withColumn("url", F.when(F.col("visit_id").isin(2, 9), "wss://x/").otherwise(F.col("url")))
    rows = prevalence.exclusive_entities(df, "a", study=STUDY).collect()
    assert [(r.parent_entity, r.n_visits_seen) for r in rows] == [("Only", 2)]


def test_enrich_tiers(spark):
    tree = spark.createDataFrame(
        [("w", None, None), ("w/P", None, None), ("w/P/S", None, None), ("w/P/S/one.com", "S", "P"), ("w/P/S/two.com", "S", "P"),
         ("w/P/T", None, None), ("w/P/T/three.com", "T", "P")],
        "path string, subsidiary_entity string, parent_entity string",
    )
    visits = spark.createDataFrame([("a", 1, "https://www.one.com/"), ("a", 2, None)], "profile string, visit_id long, site_url string")
    rows = [(1, "https://x.one.com/", None), (1, "https://two.com/", "https://one.com/"), (1, "https://three.com", ""), (1, "https://un.org", None),
            (2, "https://one.com", None), (1, "not a url", None)]
    df = spark.createDataFrame([("a", *r) for r in rows], "profile string, visit_id long, url string, top_level_url string")
    index = enrich.entity_index(tree)
    got = {
        (r.url, r.visit_id): (r.domain, r.parent_entity, r.relationship_tier, r.is_technical_3p)
        for r in enrich.enrich(df, index, visits, domain_column="url", context_column="top_level_url").collect()
    }
    assert got == {
        ("https://x.one.com/", 1): ("one.com", "P", "first-party", 0.0),
        ("https://two.com/", 1): ("two.com", "P", "first-party", 1.0),
        ("https://three.com", 1): ("three.com", "P", "inter-family third-party", 1.0),
        ("https://un.org", 1): ("un.org", "un.org", "external third-party", 1.0),
        ("https://one.com", 2): ("one.com", "", "unknown", None),
        ("not a url", 1): ("", "", "unknown", None),
    }
    assert {r.node: r.n_children for r in enrich.entity_children(tree).collect()} == {"w": 1, "w/P": 2, "w/P/S": 2, "w/P/T": 1}


def test_hot_visit_cooccurrence(spark):
    """One visit holds a third of all requests and ads; results equal the full product."""
    rng = random.Random(5)
    shown = [("a" if rng.random() < 0.5 else "b", 1 if rng.random() < 0.4 else rng.randrange(2, 9), f"ad{rng.randrange(60)}", rng.choice(["n1", "n2", "unknown"])) for _ in range(300)]
    seen = [(rng.choice("ab"), 1 if rng.random() < 0.4 else rng.randrange(2, 9), f"t{rng.randrange(5)}.com", "o", EXT) for _ in range(300)]
    ad_frame = spark.createDataFrame(
        [(*s, True, "high") for s in shown], "profile string, visit_id long, ad_hash string, advertiser_network string, is_valid_ad boolean, confidence string"
    )
    for keys in (("profile", "visit_id"), ("visit_id",)):
        want: dict = {}
        for p, v, h, n in shown:
            for q, w, d, _, _ in seen:
                if n != "unknown" and v == w and (keys == ("visit_id",) or p == q):
                    cell = want.setdefault((n, d), (set(), set()))
                    cell[0].add(h)
                    cell[1].add(p)
        out = ads.network_tracker_cooccurrence(ad_frame, requests(spark, seen), top_n=None, keys=keys, min_shared=1)
        got = {(r.advertiser_network, r.tracker_domain): (r.shared_ads, r.n_profiles) for r in out.collect()}
        assert got == {k: (len(a), len(p)) for k, (a, p) in want.items()}


def test_hot_shared_value(spark):
    rows = [("a", 1, "same-identifier", f"o{i % 7}", EXT) for i in range(500)] + [("a", 2, "short", "o1", EXT), ("a", 2, "short", "o2", EXT)]
    df = spark.createDataFrame(rows, "profile string, visit_id long, value string, parent_entity string, relationship_tier string")
    out = cookies.detect_cookie_syncs(df).collect()
    assert len(out) == 1 and out[0].n_parents == 7 and out[0].parents == ", ".join(f"o{i}" for i in range(7))


def test_merge_prefers_modified_then_first(spark):
    schema = "index long, viewed string, modified boolean, category string"
    one = spark.createDataFrame([(1, "True", False, "a1"), (2, "True", True, "a2"), (3, "", False, "a3"), (4, "True", False, "a4")], schema)
    two = spark.createDataFrame([(1, "True", True, "b1"), (2, "True", True, "b2"), (3, "True", None, "b3"), (5, None, True, "b5")], schema)
    got = {r["index"]: (r.category, r.n_overlaps) for r in review.merge_reviews([one, two]).collect()}
    assert got == {1: ("b1", 1), 2: ("a2", 1), 3: ("b3", 0), 4: ("a4", 0)}


def test_edits_equal_a_step_by_step_replay(spark):
    rng = random.Random(11)
    desc = [(i, f"c{i}", f"d{i}", rng.random() < 0.3) for i in range(30)]
    edits = [(rng.randrange(30), s, f"C{s}", f"D{s}", rng.random() < 0.5, f"n{s}", rng.random() < 0.4) for s in range(90)]
    state = {i: dict(category=c, description=d, modified=m, same=False, notes="", oc="", od="") for i, c, d, m in desc}
    for i, _, c, d, same, notes, mark in edits:
        row = state[i]
        if not row["modified"]:
            row["oc"], row["od"] = row["category"], row["description"]
        row.update(category=c, description=d, same=same, notes=notes, modified=row["modified"] or mark)
    base = review.with_review_columns(spark.createDataFrame(desc, "index int, category string, description string, modified boolean"))
    log = spark.createDataFrame(
        edits, "index int, seq int, category string, description string, same_company boolean, notes string, mark_modified boolean"
    )
    for r in review.apply_edits(base, log).collect():
        w = state[r["index"]]
        assert (r.category, r.description, r.modified, r.same_company, r.notes, r.old_category, r.old_description) == (
            w["category"], w["description"], w["modified"], w["same"], w["notes"], w["oc"], w["od"],
        )


def test_next_unviewed_wraps(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, None), (4, True)], "index long, viewed boolean")
    assert review.next_unviewed(df, 1).first()[0] == 3
    assert review.next_unviewed(df, 3).first()[0] == 1
    assert review.next_unviewed(df.where("viewed"), 1).first()[0] is None


def test_network_cells_keep_zero_rows(spark):
    df = spark.createDataFrame([("a", "n1", "X"), ("a", "n1", "Y"), ("a", "n2", "X"), ("a", "n1", "Unknown"), ("b", "n3", "Z")], "profile string, advertiser_network string, ad_category string")
    got = {(r.advertiser_network, r.ad_category): r.value for r in ads.network_category_cells(df, "a", ["n1", "n2", "n9"], "row").collect()}
    assert got == {("n1", "X"): 50.0, ("n1", "Y"): 50.0, ("n2", "X"): 100.0, ("n2", "Y"): 0.0, ("n9", "X"): 0.0, ("n9", "Y"): 0.0}
