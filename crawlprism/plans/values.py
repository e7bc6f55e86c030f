"""Scalar functions, text, embedding labels and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlprism.config import AD_CATEGORIES
from crawlprism.functions import columns as C
from crawlprism.functions.labels import (
    compatible_labels,
    first_match,
    with_label_record,
    with_network,
)
from crawlprism.functions.text import clean_text, squeeze
from crawlprism.functions.urls import (
    full_host,
    has_http_scheme,
    hostname,
    last_two_labels,
    registered_domain,
    with_registered_domain,
)
from crawlprism.operators import density, reports, topics
from crawlprism.operators.common import top_per_group
from crawlprism.plans.registry import register
from crawlprism.plans.roles import STUDY, profile_of, with_ctes

# --- URLs ------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
register(
    "b1_registered_domain",
    lambda t: t.table("pages").select("page_id", registered_domain("url").alias("domain")),
    f"SELECT page_id, array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') AS domain FROM pages",
)
register(
    "b1_registered_domain_of_suffixes",
    lambda t: t.table("pages").select("page_id", registered_domain(F.substring_index(full_host("url"), ".", -1)).alias("brand")),
    f"SELECT page_id, list_extract(string_split({_HOST}, '.'), -1) AS brand FROM pages",
)
register(
    "b2_registered_domain_strict",
    lambda t: t.table("pages").select(
        "page_id",
        registered_domain("url", brand_tld=False).alias("domain"),
        registered_domain(F.substring_index(full_host("url"), ".", -1), brand_tld=False).alias("of_suffix"),
    ),
    f"SELECT page_id, array_to_string(list_slice(string_split({_HOST}, '.'), -2, -1), '.') AS domain, CAST(NULL AS VARCHAR) AS of_suffix FROM pages",
)
# Hosts below wildcard, exception, deep and unlisted names, by page.
_SUFFIX_RULES = (("com", 1, 1, 1), ("jp", 1, 1, 1), ("kawasaki.jp", 2, 3, 1), ("city.kawasaki.jp", 3, 2, 2), ("a.b.c.d.e.cn", 6, 6, 1), ("cn", 1, 1, 1))
_TAILS = ("x.y.kawasaki.jp", "x.city.kawasaki.jp", "x.a.b.c.d.e.cn", "x.y.unlisted", "x.e.cn")
_DOMAINS = ("x.y.kawasaki.jp", "city.kawasaki.jp", "x.a.b.c.d.e.cn", "y.unlisted", "e.cn")


def _by_rules(t):
    tails = F.array(*[F.lit(x) for x in _TAILS])
    tail = F.element_at(tails, (F.col("page_id") % len(_TAILS) + 1).cast("int"))
    pages = t.table("pages").select("page_id", F.concat(F.lit("https://"), full_host("url"), F.lit("."), tail, F.lit("/p")).alias("u"))
    rules = t.spark.createDataFrame(_SUFFIX_RULES, "rule string, labels int, suffix_labels int, rank int")
    return with_registered_domain(pages, "u", rules=rules).select("page_id", "domain")


register(
    "b1_registered_domain_by_rules",
    _by_rules,
    f"SELECT page_id, list_extract({list(_DOMAINS)}, CAST(page_id % {len(_DOMAINS)} + 1 AS INT)) AS domain FROM pages",
)
# Hosts below names of the public list: registries, wildcards, an exception, a name that is private there.
_PUBLIC_TAILS = ("x.gob.mx", "x.y.com.co", "a.b.kawasaki.jp", "a.city.kawasaki.jp", "n.nhs.uk", "b.github.io", "w.www.ck", "v.w.ck")
_PUBLIC_DOMAINS = ("x.gob.mx", "y.com.co", "a.b.kawasaki.jp", "city.kawasaki.jp", "n.nhs.uk", "github.io", "www.ck", "v.w.ck")


def _by_public_list(t):
    tail = F.element_at(F.array(*[F.lit(x) for x in _PUBLIC_TAILS]), (F.col("page_id") % len(_PUBLIC_TAILS) + 1).cast("int"))
    pages = t.table("pages").select("page_id", F.concat(F.lit("https://"), full_host("url"), F.lit("."), tail, F.lit("/p")).alias("u"))
    return with_registered_domain(pages, "u").select("page_id", "domain", registered_domain("u", brand_tld=False).alias("strict"))


register(
    "b1_b2_registered_domain_public_list",
    _by_public_list,
    f"SELECT page_id, list_extract({list(_PUBLIC_DOMAINS)}, CAST(page_id % {len(_PUBLIC_DOMAINS)} + 1 AS INT)) AS domain, domain AS strict FROM pages",
)
register(
    "b3_full_host",
    lambda t: t.table("pages").select("page_id", full_host("url").alias("host")),
    f"SELECT page_id, {_HOST} AS host FROM pages",
)
register(
    "b4_hostname_pages",
    lambda t: t.table("pages").select("page_id", hostname("url").alias("host"), hostname("html").alias("html_host")),
    "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(html, '://([^/]+)', 1) AS html_host FROM pages",
)
register(
    "b5_last_two_labels",
    lambda t: t.table("pages").select("page_id", last_two_labels(hostname("url")).alias("domain")),
    "SELECT page_id, array_to_string(list_slice(string_split(regexp_extract(url, '://([^/]+)', 1), '.'), -2, -1), '.') AS domain FROM pages",
)
register(
    "b6_http_scheme",
    lambda t: t.requests.where(has_http_scheme("url")).groupBy("profile").agg(F.count("*").alias("n_rows")),
    with_ctes("SELECT profile, count(*) AS n_rows FROM enriched WHERE url LIKE 'http%' GROUP BY 1", "enriched"),
)
register(
    "b12_b13_third_party_predicates",
    lambda t: t.enriched.groupBy(C.not_first_party().alias("not_first"), C.third_party().alias("third")).agg(F.count("*").alias("n_rows")),
    with_ctes(
        """SELECT relationship_tier NOT IN ('first-party','unknown') AS not_first, relationship_tier IN ('inter-family third-party','external third-party') AS third, count(*) AS n_rows FROM enriched GROUP BY ALL""",
        "enriched",
    ),
)

# --- labels ----------------------------------------------------------------------------------

_RULES = ((r"example\.com.*page=", "net_paged"), (r"example\.com", "net_com"), (r"example\.net", "net_net"))
_FAMILIES = {"net_paged": "com", "net_com": "com"}


def _first(column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{n}'" for p, n in _RULES) + " END"


register(
    "b14_first_matching_network",
    lambda t: t.table("pages").select("page_id", first_match("url", _RULES).alias("network"), first_match("html", _RULES).alias("html_network")),
    f"SELECT page_id, {_first('url')} AS network, {_first('html')} AS html_network FROM pages",
)
_CAPTURED = "CASE page_id % 5 WHEN 0 THEN 'net_com' WHEN 1 THEN 'unknown' WHEN 2 THEN NULL WHEN 3 THEN 'net_net' ELSE '' END"
register(
    "b15_resolve_network",
    lambda t: with_network(
        t.table("pages").withColumn("captured", F.expr(_CAPTURED)), "url", "html", "captured", "r", _RULES, _FAMILIES
    ).select("page_id", "r.*"),
    f"""SELECT page_id, coalesce(u, h, CASE WHEN k NOT IN ('unknown','none','') THEN k END, 'unknown') AS network,
      CASE WHEN u IS NOT NULL THEN 'src_regex' WHEN h IS NOT NULL THEN 'outerhtml_regex' WHEN k NOT IN ('unknown','none','') THEN 'capture_metadata' ELSE 'unknown' END AS source,
      CASE WHEN coalesce(u, h) IS NOT NULL THEN k IS NULL OR coalesce(u, h) = k OR (coalesce(u, h) IN ('net_paged','net_com') AND k IN ('net_paged','net_com'))
        ELSE coalesce(k NOT IN ('unknown','none',''), false) END AS agrees
    FROM (SELECT page_id, {_first('url')} AS u, {_first('html')} AS h, {_CAPTURED} AS k FROM pages)""",
)
register(
    "b16_compatible_labels",
    lambda t: t.ads.groupBy("advertiser_network", "capture_network").agg(F.count("*").alias("n_ads")).withColumn(
        "compatible",
        compatible_labels("advertiser_network", "capture_network", {"net_0": "a", "net_1": "a", "net_5": "b", "net_6": "b"}),
    ),
    with_ctes(
        """SELECT advertiser_network, capture_network, count(*) AS n_ads, coalesce(advertiser_network = capture_network OR (advertiser_network IN ('net_0','net_1') AND capture_network IN ('net_0','net_1'))
      OR (advertiser_network IN ('net_5','net_6') AND capture_network IN ('net_5','net_6')), false) AS compatible FROM ads GROUP BY 1, 2""",
        "ads",
    ),
)
register(
    "b42_closed_set",
    lambda t: t.ads.groupBy(C.closed_set(F.trim("category"), (*AD_CATEGORIES, "PROMO", "SMALL")).alias("category")).agg(F.count("*").alias("n_ads")),
    with_ctes(
        "SELECT CASE WHEN TRIM(category) IN ('PROMO','SMALL','None') THEN TRIM(category) ELSE 'Other' END AS category, count(*) AS n_ads FROM ads GROUP BY 1",
        "ads",
    ),
)
# A model's answer per event: a whole object, an array, a broken text, an empty one, or none.
_ANSWER = """CASE event_type WHEN 'click' THEN '{"is_valid_ad": true, "category": "' || props_key || '", "brand": "b' || event_id || '"}'
      WHEN 'view' THEN '[{"is_valid_ad": false, "reason": "r' || props_key || '"}, 1]' WHEN 'purchase' THEN '{"is_valid_ad": true, "category": '
      WHEN 'signup' THEN '' ELSE '{"category": 5}' END"""
register(
    "b41_parse_label",
    lambda t: with_label_record(
        t.table("events")
        .withColumn("props_key", F.get_json_object("props", "$.k"))
        .select("event_id", F.expr(_ANSWER).alias("answer")),
        "answer",
        "r",
    ).select("event_id", "r.*"),
    """SELECT event_id, event_type = 'click' AS is_valid_ad, CASE WHEN event_type = 'click' THEN k ELSE 'None' END AS category, 'None' AS product,
      CASE WHEN event_type = 'click' THEN 'b'||event_id ELSE 'None' END AS brand, 'None' AS description, 'None' AS content, 'None' AS confidence,
      CASE event_type WHEN 'click' THEN 'None' WHEN 'view' THEN 'r'||k WHEN 'signup' THEN 'Empty response message content' ELSE 'JSON output unreadable' END AS reason
    FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
)

# --- predicates and coercions ----------------------------------------------------------------

register(
    "b30_id_like_values",
    lambda t: t.cookies.groupBy("value", C.id_like("value").alias("id_like")).agg(F.count("*").alias("n_rows")),
    with_ctes(
        "SELECT value, length(value) >= 10 AND regexp_matches(value, '^[a-zA-Z0-9_.-]+$') AS id_like, count(*) AS n_rows FROM cookies GROUP BY 1, 2",
        "cookies",
    ),
)
_MIXED = "CASE o_orderpriority WHEN '1-URGENT' THEN 'True' WHEN '2-HIGH' THEN 'False' WHEN '3-MEDIUM' THEN '' WHEN '5-LOW' THEN NULL ELSE 'true' END"
register(
    "b31_b32_coercions",
    lambda t: t.table("orders")
    .withColumn("raw", F.expr(_MIXED))
    .groupBy(C.to_bool("raw").alias("flag"), C.text_or("raw").alias("text"))
    .agg(F.count("*").alias("n_rows")),
    f"SELECT coalesce(try_cast(nullif(raw, '') AS BOOLEAN), false) AS flag, coalesce(raw, '') AS text, count(*) AS n_rows FROM (SELECT {_MIXED} AS raw FROM orders) GROUP BY 1, 2",
)
register(
    "b38_percent_of_total",
    lambda t: t.table("lineitem").groupBy("l_suppkey").agg(
        F.count(F.when(F.col("l_quantity") > 49, 1)).alias("a"), F.count(F.when(F.col("l_tax") > 0.075, 1)).alias("b")
    ).select("l_suppkey", C.percent("a", "b").alias("pct")),
    """SELECT l_suppkey, 100.0 * count(*) FILTER (l_quantity > 49) / nullif(count(*) FILTER (l_tax > 0.075), 0) AS pct FROM lineitem GROUP BY 1""",
)

# --- text ------------------------------------------------------------------------------------

_CLEAN = r"""array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), '\S+@\S+\.\S+', ' ', 'g'), '[^a-zA-Z]+', ' ', 'g')), ' '), lambda x: length(x) >= 3), ' ')"""
register(
    "b20_clean_text",
    lambda t: t.table("documents").select("doc_id", clean_text("text").alias("clean")),
    f"SELECT doc_id, {_CLEAN} AS clean FROM documents",
)
register(
    "b21_b22_ad_corpus",
    lambda t: topics.ad_corpus(t.doc_ads, 200).select("profile", "ad_hash", "ocr_text", F.col("n_chars_clean").cast("long").alias("n_chars_clean")),
    with_ctes(
        f"""SELECT profile, ad_hash, clean AS ocr_text, length(clean) AS n_chars_clean FROM (SELECT *, {_CLEAN.replace('text,', 'ocr_text,', 1)} AS clean FROM doc_ads WHERE ocr_char_count > 0 AND confidence = 'high') WHERE length(clean) >= 200""",
        "doc_ads",
    ),
)
register(
    "b44_squeeze",
    lambda t: t.table("conversations").select("conv_id", "turn", squeeze("text").alias("text"), F.length(squeeze("text")).cast("long").alias("n_chars")),
    r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_chars FROM conversations",
)

# --- embedding labels ------------------------------------------------------------------------


def _labels(t):
    """Mean vector per label number: the label set, as a frame."""
    means = topics.label_vectors(t.table("embeddings"), "label", "embedding")
    return means.select(F.concat(F.lit("topic "), F.col("label").cast("string")).alias("label"), "vector")


_SCORES = """centre AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    cos AS (SELECT vec_id, c.label, 100 * list_cosine_similarity(e.embedding::DOUBLE[], c.v) AS s FROM embeddings e CROSS JOIN centre c),
    soft AS (SELECT vec_id, label, exp(s - max(s) OVER (PARTITION BY vec_id)) / sum(exp(s - m)) OVER (PARTITION BY vec_id) AS p
      FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM cos)),
    best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS r FROM soft),
    scored AS (SELECT a.vec_id, 'topic '||a.label AS top_label, round(a.p, 6) AS top_confidence, 'topic '||b.label AS second_label, round(b.p, 6) AS second_confidence,
      a.label = 3 AS is_noise, a.p < 0.5 AS is_low_confidence FROM best a JOIN best b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2)"""


def _score(t):
    df = t.table("embeddings").select("vec_id", "embedding")
    return topics.score_labels(df, "embedding", _labels(t), noise=("topic 3",)).withColumns(
        {c: F.round(c, 6) for c in ("top_confidence", "second_confidence")}
    )


register("j1_e8_zero_shot_labels", lambda t: _score(t), f"WITH {_SCORES} SELECT * FROM scored")


def _images(t):
    """Vectors as ad images: most documents have one, some images could not be scored."""
    ads = t.table("documents").select(
        profile_of("doc_id").alias("profile"),
        F.col("doc_id").alias("visit_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("ad_hash"),
        F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("png_path"),
    )
    vectors = t.table("embeddings")
    images = vectors.select(F.concat(F.lit("img/"), F.col("vec_id").cast("string")).alias("path"))
    scores = _score(t).join(vectors.where(F.col("label") != 7).select("vec_id"), "vec_id", "left_semi").withColumn(
        "png_path", F.concat(F.lit("img/"), F.col("vec_id").cast("string"))
    )
    return topics.label_pipeline(ads, images, scores)


_PIPELINE = (
    _SCORES
    + f""", labelled AS (SELECT list_extract([{", ".join(f"'{p}'" for p in STUDY.profiles)}], CAST(doc_id % 5 + 1 AS INTEGER)) AS profile, doc_id AS visit_id, 'doc'||doc_id AS ad_hash,
      s.top_label AS clip_top_label, CASE WHEN s.vec_id IS NOT NULL THEN s.top_confidence WHEN e.vec_id IS NOT NULL THEN 0.0::DOUBLE END AS clip_top_confidence,
      s.second_label AS clip_second_label, s.second_confidence AS clip_second_confidence,
      CASE WHEN s.vec_id IS NOT NULL THEN s.is_noise WHEN e.vec_id IS NOT NULL THEN true END AS clip_is_noise,
      CASE WHEN s.vec_id IS NOT NULL THEN s.is_low_confidence WHEN e.vec_id IS NOT NULL THEN true END AS clip_is_low_confidence,
      CASE WHEN s.vec_id IS NOT NULL THEN 'ok' WHEN e.vec_id IS NOT NULL THEN 'unreadable' ELSE 'image_not_found' END AS clip_status
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN (SELECT * FROM scored WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label <> 7)) s ON s.vec_id = d.doc_id),
    usable AS (SELECT * FROM labelled WHERE NOT coalesce(clip_is_noise, true) AND NOT coalesce(clip_is_low_confidence, true)),
    mix AS (SELECT profile, clip_top_label, n, 100.0 * n / sum(n) OVER (PARTITION BY profile) AS pct FROM (SELECT profile, clip_top_label, count(*) AS n FROM usable GROUP BY 1, 2))"""
)
register("j2_label_pipeline", lambda t: _images(t), f"WITH {_PIPELINE} SELECT * FROM labelled")
register(
    "d55_label_summary",
    lambda t: topics.label_summary(_images(t)),
    f"""WITH {_PIPELINE} SELECT count(*) AS n_total, count(*) FILTER (clip_is_noise) AS n_noise, count(*) FILTER (clip_is_low_confidence) AS n_low_confidence,
      (SELECT count(*) FROM usable) AS n_usable, 100.0 * count(*) FILTER (clip_is_noise) / count(*) AS pct_noise, 100.0 * count(*) FILTER (clip_is_low_confidence) / count(*) AS pct_low_confidence FROM labelled""",
)
register(
    "d55_top_labels",
    lambda t: topics.top_labels(_images(t), 5),
    f"WITH {_PIPELINE} SELECT profile, clip_top_label, n FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY n DESC, clip_top_label) AS r FROM mix) WHERE r <= 5",
)
register(
    "d56_label_mix",
    lambda t: reports.label_mix(topics.usable_labels(_images(t))),
    f"WITH {_PIPELINE} SELECT * FROM mix",
)
register(
    "d56_total_variation",
    lambda t: reports.total_variation(reports.label_mix(topics.usable_labels(_images(t))), study=STUDY).withColumn("tvd", F.round("tvd", 9)),
    f"""WITH {_PIPELINE}, p AS (SELECT unnest([{", ".join(f"'{p}'" for p in STUDY.profiles)}]) AS profile, unnest(range(5)) AS o)
    SELECT a.profile AS profile_a, b.profile AS profile_b, round(sum(abs(coalesce(x.pct, 0) - coalesce(y.pct, 0))) / 2, 9) AS tvd FROM p a JOIN p b ON a.o < b.o
      CROSS JOIN (SELECT DISTINCT clip_top_label AS l FROM mix) k LEFT JOIN mix x ON x.profile = a.profile AND x.clip_top_label = l LEFT JOIN mix y ON y.profile = b.profile AND y.clip_top_label = l GROUP BY 1, 2""",
)
register(
    "c17_labels_on_ads",
    lambda t: topics.with_labels(
        t.doc_ads.select("profile", "visit_id", "ad_hash", "advertiser_network"), topics.usable_labels(_images(t)), "inner"
    ).groupBy("advertiser_network", "clip_top_label").agg(F.count("*").alias("n")),
    f"""WITH {_PIPELINE} SELECT lang AS advertiser_network, clip_top_label, count(*) AS n FROM documents JOIN usable ON visit_id = doc_id GROUP BY 1, 2""",
)

# --- topics ----------------------------------------------------------------------------------


def _corpus(t):
    """The corpus with its topic numbers, written once as a fitted model's corpus is."""
    return t.stored("corpus_with_topics", lambda: _with_topics(t))


def _with_topics(t):
    """Documents with the topic of the vector with their id, else the outlier topic. Topics are those
    of the fit by density, named by their smallest label."""
    fitted = _fitted(t)
    names = fitted.where("topic >= 0").groupBy("topic").agg(F.min("label").alias("name"))
    vectors = fitted.join(names, "topic", "left").select(F.col("vec_id").alias("doc_id"), F.coalesce("name", F.lit(-1)).alias("topic"))
    return t.table("documents").join(vectors, "doc_id", "left").select(
        profile_of("doc_id").alias("profile"),
        clean_text("text").alias("ocr_text"),
        F.coalesce("topic", F.lit(-1)).alias("topic"),
    )


def _fitted(t):
    """Vectors drawn together by label, every tenth cast far away, and their topics by density."""
    return t.stored("density_topics", lambda: _density_topics(t))


def _density_topics(t):
    near = F.transform("embedding", lambda x: (x * 0.3).cast("double"))
    axis = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 4.0).otherwise(0.0))
    far = F.transform("embedding", lambda x: (x * 40).cast("double"))
    vector = F.when(F.col("vec_id") % 10 == 0, F.concat(far, F.array_repeat(F.lit(0.0), 10))).otherwise(F.concat(near, axis))
    rows = t.table("embeddings").select("vec_id", "label", vector.alias("vector"))
    return density.fit_density_topics(rows, "vector", 10).select("vec_id", "label", "topic")


register(
    "j4_density_topics",
    lambda t: _fitted(t).groupBy("label", (F.col("topic") < 0).alias("outlier")).agg(
        F.count("*").alias("n_vectors"), F.count_distinct("topic").alias("n_topics"), F.count_distinct("vec_id").alias("n_ids")
    ),
    "SELECT label, vec_id % 10 = 0 AS outlier, count(*) AS n_vectors, 1 AS n_topics, count(DISTINCT vec_id) AS n_ids FROM embeddings GROUP BY 1, 2",
)
register(
    "j4_density_topic_order",
    lambda t: _fitted(t).where("topic >= 0").groupBy("topic").agg(F.count("*").alias("n")).agg(
        F.sort_array(F.collect_list(F.struct("topic", "n"))).alias("l")
    ).select(F.size("l").alias("n_topics"), F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.get("l", i)["n"] <= F.get("l", i - 1)["n"]).alias("by_size")),
    "SELECT count(DISTINCT label) AS n_topics, true AS by_size FROM embeddings WHERE vec_id % 10 <> 0",
)


_TOPICS = f"""corpus AS (SELECT list_extract([{", ".join(f"'{p}'" for p in STUDY.profiles)}], CAST(doc_id % 5 + 1 AS INTEGER)) AS profile, {_CLEAN} AS ocr_text, coalesce(CASE WHEN vec_id % 10 <> 0 THEN label END, -1) AS topic
      FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
    words AS (SELECT topic, term, count(*) AS tf FROM (SELECT topic, unnest(string_split(ocr_text, ' ')) AS term FROM corpus) WHERE term <> '' GROUP BY 1, 2),
    per AS (SELECT topic, sum(tf) AS w FROM words GROUP BY 1),
    ranked AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY round(tf::DOUBLE / w * ln(1 + a / f), 12) DESC, term) AS r
      FROM words JOIN per USING (topic) JOIN (SELECT term, sum(tf) AS f FROM words GROUP BY 1) USING (term), (SELECT floor(avg(w)) AS a FROM per)),
    kw AS (SELECT topic AS topic_id, count(*) AS size, CASE WHEN topic = -1 THEN '<outliers / no clear topic>' ELSE (SELECT string_agg(term, ', ' ORDER BY r) FROM ranked k WHERE k.topic = c.topic AND r <= 8) END AS keywords
      FROM corpus c GROUP BY topic),
    dist AS (SELECT profile, topic, keywords, n_ads, round(n_ads * 100.0 / sum(n_ads) OVER (PARTITION BY profile), 2) AS pct_of_profile
      FROM (SELECT profile, topic, count(*) AS n_ads FROM corpus GROUP BY 1, 2) JOIN kw ON topic_id = topic)"""


def _distribution(t):
    corpus = _corpus(t)
    return topics.topic_distribution(corpus, topics.topic_keywords(corpus))


register("j5_topic_keywords", lambda t: topics.topic_keywords(_corpus(t)), f"WITH {_TOPICS} SELECT * FROM kw")
register("j6_topic_distribution", lambda t: _distribution(t), f"WITH {_TOPICS} SELECT * FROM dist")
register(
    "j7_differential_topics",
    lambda t: topics.differential_topics(_distribution(t), "household", study=STUDY).withColumns(
        {c: F.round(c, 9) for c in ("delta", "lift")}
    ),
    f"""WITH {_TOPICS} SELECT topic AS topic_id, min(keywords) AS keywords, coalesce(max(pct_of_profile) FILTER (profile = 'household'), 0) AS pct_a,
      coalesce(max(pct_of_profile) FILTER (profile = 'automobile'), 0) AS pct_b, round(pct_a - pct_b, 9) AS delta, round((pct_a + 0.1::DOUBLE) / (pct_b + 0.1::DOUBLE), 9) AS lift FROM dist GROUP BY 1""",
)
register(
    "k5_topic_grid",
    lambda t: reports.topic_grid(_distribution(t), study=STUDY, top_n=6),
    f"""WITH {_TOPICS}, g AS (SELECT topic, {", ".join(f"coalesce(max(pct_of_profile) FILTER (profile = '{p}'), 0.0::DOUBLE) AS {p}" for p in STUDY.profiles)},
      '#'||topic||': '||substr(min(keywords), 1, 50) AS label FROM dist WHERE topic <> -1 GROUP BY 1)
    SELECT * FROM g ORDER BY {" + ".join(STUDY.profiles)} DESC, topic LIMIT 6""",
)


def _fit(t):
    """What holds for any fit: every vector once, topics in order of size, none below the floor.
    Where the centres lie is left to the iterations."""
    fitted = topics.fit_topics(t.table("embeddings").select("vec_id", "embedding"), "embedding", k=10)
    sizes = fitted.groupBy("topic").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"))
    real = F.col("topic") >= 0
    listed = F.array_sort(F.collect_list(F.when(real, F.struct("topic", "n"))))
    return sizes.agg(
        F.sum("n").alias("n_vectors"),
        F.sum("ids").alias("n_ids"),
        F.coalesce(F.min(F.when(real, F.col("n"))) >= 10, F.lit(True)).alias("above_floor"),
        listed.alias("listed"),
    ).select(
        "n_vectors", "n_ids", "above_floor",
        (F.col("listed.n") == F.sort_array("listed.n", asc=False)).alias("in_order"),
    )


register(
    "j4_topic_fit",
    _fit,
    "SELECT count(*) AS n_vectors, count(DISTINCT vec_id) AS n_ids, true AS above_floor, true AS in_order FROM embeddings",
)
register(
    "e8_two_best_labels",
    lambda t: top_per_group(
        t.ads.groupBy("advertiser_network", "category").agg(F.count("*").alias("n")), ["advertiser_network"], [F.col("n").desc(), F.col("category")], 2
    ),
    with_ctes(
        "SELECT advertiser_network, category, n FROM (SELECT *, row_number() OVER (PARTITION BY advertiser_network ORDER BY n DESC, category NULLS FIRST) AS r FROM (SELECT advertiser_network, category, count(*) AS n FROM ads GROUP BY 1, 2)) WHERE r <= 2",
        "ads",
    ),
)
