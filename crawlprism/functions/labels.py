"""Rule labels as generated CASE expressions, and JSON label records."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlprism.config import (
    AD_NETWORK_PATTERNS,
    LABEL_DEFAULT,
    NETWORK_FAMILIES,
    PIXEL_SIGNATURES,
    REASON_EMPTY,
    REASON_EMPTY_CONTENT,
    REASON_UNREADABLE,
)
from crawlprism.functions.columns import any_of, col
from crawlprism.functions.suffixes import SuffixTrie
from crawlprism.functions.urls import domain_of_host, full_host


def first_match(text: str | Column, rules: Sequence[tuple[str, str]] = AD_NETWORK_PATTERNS) -> Column:
    """Label of the first (pattern, label) rule found in the text, ignoring case; else null."""
    label: Column | None = None
    for pattern, name in rules:
        hit = col(text).rlike(f"(?i){pattern}")
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label if label is not None else F.lit(None).cast("string")


def compatible_labels(
    a: str | Column, b: str | Column, families: Mapping[str, str] = NETWORK_FAMILIES
) -> Column:
    """Equal labels, or two labels of one family."""
    a, b = col(a), col(b)
    members: dict[str, list[str]] = {}
    for label, family in families.items():
        members.setdefault(family, []).append(label)
    same_family = any_of([a.isin(*m) & b.isin(*m) for m in members.values()])
    return F.coalesce((a == b) | same_family, F.lit(False))


def with_network(
    df: DataFrame,
    src: str,
    html: str,
    captured: str,
    out: str = "network",
    rules: Sequence[tuple[str, str]] = AD_NETWORK_PATTERNS,
    families: Mapping[str, str] = NETWORK_FAMILIES,
) -> DataFrame:
    """Add struct(network, source, agrees) from the URL, then the markup, then the captured label."""
    by_src, by_html, label = F.col("_by_src"), F.col("_by_html"), F.col(captured)
    matched = F.coalesce(by_src, by_html)
    has_label = label.isNotNull() & ~label.isin("unknown", "none", "")
    agrees = F.when(
        matched.isNotNull(), label.isNull() | compatible_labels(matched, label, families)
    ).otherwise(has_label)
    result = F.struct(
        F.coalesce(matched, F.when(has_label, label), F.lit("unknown")).alias("network"),
        F.when(by_src.isNotNull(), "src_regex")
        .when(by_html.isNotNull(), "outerhtml_regex")
        .when(has_label, "capture_metadata")
        .otherwise("unknown")
        .alias("source"),
        agrees.alias("agrees"),
    )
    return (
        df.withColumn("_by_src", first_match(src, rules))
        .withColumn("_by_html", F.when(by_src.isNull(), first_match(html, rules)))
        .withColumn(out, result)
        .drop("_by_src", "_by_html")
    )


def domain_pattern(domains: Sequence[str]) -> str:
    """Matches hosts that are one of the domains or below one; finds the longest domain."""
    ordered = sorted(domains, key=lambda d: (-len(d), d))
    return r"(?<![^.])(?:" + "|".join(re.escape(d) for d in ordered) + ")$"


def with_pixel(
    df: DataFrame,
    url: str = "url",
    out: str = "pixel",
    signatures: Sequence[tuple[str, Sequence[str], Sequence[str]]] = PIXEL_SIGNATURES,
    allow_domain_only: bool = False,
    rules: SuffixTrie | None = None,
) -> DataFrame:
    """Add struct(pixel_type, matched_domain, pattern) of the first signature that fits, else null.

    A signature fits when the host is one of its domains or below one, and one of its path
    patterns occurs in the URL. The longest matching domain is reported. With `allow_domain_only`
    a host match without a path counts too, with a null pattern.

    Hosts outside all domains cost a comparison of their end with each. The details are worked out for
    matches only.
    """
    host, address, found = F.col("_host"), F.col(url), F.col("_signature")
    label: Column | None = None
    for i, (_, domains, paths) in enumerate(signatures):
        fits = host.rlike(domain_pattern(domains))
        if not allow_domain_only:
            fits = fits & address.rlike("(?i)" + "|".join(f"(?:{p})" for p in paths))
        label = F.when(fits, i + 1) if label is None else label.when(fits, i + 1)
    every = [d for _, domains, _ in signatures for d in domains]
    # A quick look at the end of the host first: the pattern is tried at each letter of it.
    ends = any_of([host.endswith(d) for d in dict.fromkeys(every)])
    of_signature = lambda values: F.get(F.array(*values), found - 1)
    names = of_signature([F.lit(n) for n, _, _ in signatures])
    hosts = of_signature([F.lit(domain_pattern(d)) for _, d, _ in signatures])
    paths = of_signature([F.array(*[F.lit(p) for p in ps]) for _, _, ps in signatures])
    confirmed = F.filter(paths, lambda p: F.rlike(address, F.concat(F.lit("(?i)"), p)))
    hit = F.struct(
        names.alias("pixel_type"),
        F.regexp_substr(host, hosts).alias("matched_domain"),
        F.get(confirmed, F.lit(0)).alias("pattern"),
    )
    # As a case, so that the rules are walked for the few that fit and not before the signature is known.
    known = F.when(found.isNotNull(), domain_of_host(host, brand_tld=False, rules=rules).isNotNull())
    return (
        # The host is read out of an array: else a test on the result is pushed below it and repeats the search.
        df.select(*[F.col(c) for c in df.columns], F.explode(F.array(full_host(url))).alias("_host"))
        .withColumn("_signature", F.when(ends & host.rlike(domain_pattern(every)), label))
        .withColumn(out, F.when(known, hit))
        .drop("_host", "_signature")
    )


LABEL_TEXT_FIELDS = (
    "category", "product", "brand", "description", "content", "confidence", "reason",
)


def json_shape(text: str | Column) -> Column:
    """OBJECT, ARRAY or STRING by the first character of a JSON text; null for anything else."""
    first = F.substring(F.ltrim(col(text), F.lit(" \t\r\n")), 1, 1)
    return F.when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "STRING")


def kind_of(variant: Column) -> Column:
    """OBJECT, ARRAY or STRING; null for other values and for absent ones. Cheaper than the
    variant's schema, which walks the whole value."""
    return json_shape(F.to_json(variant))


def with_label_record(
    df: DataFrame, content: str, out: str = "label", duration: str | None = None
) -> DataFrame:
    """Add struct(is_valid_ad, category, …, reason) from a model's JSON answer.

    Missing fields take their default. The first object of an array counts; anything else gives
    the fallback record with a reason: no answer, empty content, or unreadable content.
    """
    value, record, fields = F.col("_value"), F.col("_record"), F.col("_fields")
    is_array = F.coalesce(kind_of(value) == "ARRAY", F.lit(False))
    first = F.try_variant_get(value, "$[0]", "variant")
    filled = is_array & first.isNotNull()
    empty = F.parse_json(F.lit("{}"))
    # An array that starts with something else than an object counts as an empty object.
    start = F.when(F.coalesce(kind_of(first) == "OBJECT", F.lit(False)), first).otherwise(empty)
    flag = F.try_variant_get(record, "$.is_valid_ad", "string")
    text = [
        F.try_variant_get(record, f"$.{n}", "variant").alias(n) for n in LABEL_TEXT_FIELDS
    ]
    bad_text = F.exists(
        F.array(*[fields[n] for n in LABEL_TEXT_FIELDS]),
        lambda v: v.isNotNull() & ~F.coalesce(kind_of(v) == "STRING", F.lit(False)),
    )
    has_flag = F.try_variant_get(record, "$.is_valid_ad", "variant").isNotNull()
    bad_flag = has_flag & F.col("_flag").isNull()
    answered = F.lit(True)
    if duration is not None:
        answered = F.coalesce(F.col(duration) > 0, F.lit(False))
    failure = (
        F.when(~answered, REASON_EMPTY)
        .when(F.coalesce(F.col(content), F.lit("")) == "", REASON_EMPTY_CONTENT)
        .when(record.isNull() | bad_text | bad_flag, REASON_UNREADABLE)
    )
    good = F.col("_failure").isNull()
    default = F.lit(LABEL_DEFAULT)

    def field(name: str, fallback: Column = default) -> Column:
        return F.when(
            good, F.coalesce(fields[name].cast("string"), default)
        ).otherwise(fallback)

    return (
        df.withColumn("_value", F.try_parse_json(content))
        .withColumn("_record", F.when(kind_of(value) == "OBJECT", value).when(filled, start))
        .withColumn("_fields", F.struct(*text))
        .withColumn("_flag", flag.try_cast("boolean"))
        .withColumn("_failure", failure)
        .withColumn(
            out,
            F.struct(
                F.coalesce(good & F.col("_flag"), F.lit(False)).alias("is_valid_ad"),
                *[field(n).alias(n) for n in LABEL_TEXT_FIELDS if n != "reason"],
                field("reason", F.col("_failure")).alias("reason"),
            ),
        )
        .drop("_value", "_record", "_fields", "_flag", "_failure")
    )
