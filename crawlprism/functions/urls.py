"""Hosts and registered domains as column expressions: no join, no shuffle, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crawlprism.functions import suffixes
from crawlprism.functions.columns import col

# scheme, userinfo, then the host up to port, path, query or fragment.
_HOST = r"^\s*(?:(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//)?(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:\s]*)"
# Addresses are no names: IPv4, and IPv6 in brackets.
_NO_NAME = r"^\[|^\d{1,3}(\.\d{1,3}){3}$"
# Two labels or more, none empty, and a last one that is no number: every set of rules finds a domain.
_PLAIN_NAME = r"^[^.\[\]]+(?:\.[^.\[\]]+)*\.[^.\[\]0-9][^.\[\]]*$"

# Top-level names and second-level registry words of the compact rules, which hold where
# the session has no list of suffixes.
GENERIC_TLDS = (
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "mobi", "asia",
    "jobs", "travel", "cat", "tel", "aero", "coop", "museum", "post", "xxx", "app", "dev", "page",
    "cloud", "online", "site", "store", "shop", "tech", "blog", "live", "news", "media", "agency",
    "digital", "network", "world", "today", "space", "website", "club", "xyz", "top", "link",
    "games", "finance", "software", "systems", "google", "fox", "goog", "youtube", "amazon",
    "microsoft", "apple", "arpa",
)
REGISTRY_WORDS = ("co", "com", "net", "org", "ac", "edu", "gov", "mil", "or", "ne", "go")
# Two-letter names that take registrations directly below a registry-like word.
FLAT_COUNTRIES = ("de", "fr", "nl", "ch", "se", "dk", "be", "eu", "io", "tv", "me", "co", "us")


def hostname(url: str | Column) -> Column:
    """The part between `://` and the next slash; '' when there is none."""
    return F.regexp_extract(col(url), "://([^/]+)", 1)


def full_host(url: str | Column) -> Column:
    """Lower-case host of a URL or bare host, without scheme, user, port and trailing dots."""
    return F.rtrim(F.lower(F.regexp_extract(col(url), _HOST, 1)), F.lit("."))


def _compact_pattern(brand_tld: bool) -> str:
    """One label and the longest public suffix by the compact rules: registry words below two-letter
    names, else the last label of a dotted host, listed or not. A host of one label is a suffix only
    if it is a generic or two-letter name."""
    flat, words, generic = map("|".join, (FLAT_COUNTRIES, REGISTRY_WORDS, GENERIC_TLDS))
    registry = rf"(?:{words})\.(?!(?:{flat})$)[a-z]{{2}}"
    last = r"(?![0-9]+$)[^.\[\]:\s]+"
    label_start = r"(?<![^.])"
    named = rf"(?!{registry}$)[^.]+\.(?:{registry}|{last})$"
    if brand_tld:
        return rf"{label_start}(?:{named}|(?<!\.)(?:{registry}|[a-z]{{2}}|{generic})$)"
    return rf"{label_start}{named}"


def _name(host: Column, domain: Column) -> Column:
    """The domain of a host; null for addresses and where it is empty."""
    return F.when(~host.rlike(_NO_NAME) & (domain != ""), domain)


def default_rules() -> suffixes.SuffixTrie | None:
    """The rules that hold where none are given: those of the session's Java runtime, as far as they are
    not private; None (the compact rules) where it brings no list."""
    return suffixes.installed()


def registered_domain(url: str | Column, brand_tld: bool = True, rules: suffixes.SuffixTrie | None = None) -> Column:
    """Registrable domain (public suffix plus one label), lower-case, by a trie of suffix rules.

    Null for null, empty, IP and unparseable input. A host that is itself a suffix gives that suffix
    with `brand_tld`, else null; of a host no rule names, the last label is the suffix if there is more
    than one. One expression in the scan stage, no join; `with_registered_domain` is quicker for whole
    tables. Without `rules`, see `default_rules`.
    """
    return domain_of_host(full_host(url), brand_tld, rules)


def domain_of_host(host: Column, brand_tld: bool = True, rules: suffixes.SuffixTrie | None = None) -> Column:
    """The same for a host as `full_host` gives it."""
    rules = rules or default_rules()
    if rules is None:
        return F.regexp_substr(host, F.lit(_compact_pattern(brand_tld)))
    # Bound step by step as the element of an array, which keeps generated code small wherever this stands.
    marked = F.transform(F.array(F.ltrim(host, F.lit("."))), lambda h: F.when(~h.rlike(_NO_NAME), rules.marked(h)))
    found = F.transform(marked, lambda m: rules.registered(m, brand_tld))
    return F.get(F.filter(found, lambda d: d != ""), F.lit(0))


def lacks_domain(host: Column, rules: suffixes.SuffixTrie | None = None) -> Column:
    """Whether a host (as `full_host` gives it) has no domain. Two labels and more of a plain name always
    have one, so that only odd hosts are looked up."""
    return F.when(host.rlike(_PLAIN_NAME), F.lit(False)).otherwise(domain_of_host(host, rules=rules).isNull())


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """A public-suffix file as rows (rule, labels, kind, suffix_labels)."""
    line = F.lower(F.substring_index(F.trim(F.col("value")), " ", 1))
    rule = F.regexp_replace(line, r"^(!|\*\.)", "")
    labels = F.size(F.split(rule, r"\."))
    return (
        spark.read.text(path)
        .where((F.trim("value") != "") & ~F.trim("value").startswith("//"))
        .select(
            rule.alias("rule"),
            labels.alias("labels"),
            F.when(line.startswith("!"), labels - 1)
            .when(line.startswith("*."), labels + 1)
            .otherwise(labels)
            .alias("suffix_labels"),
            F.when(line.startswith("!"), 2).otherwise(1).alias("rank"),
        )
    )


def with_registered_domain(
    df: DataFrame,
    url: str,
    out: str = "domain",
    *,
    rules: DataFrame | suffixes.SuffixTrie | None = None,
    brand_tld: bool = True,
) -> DataFrame:
    """Add the registrable domain, by a trie of rules or a rule table when one is given.

    A table up to `suffixes.TRIE_BYTES` becomes a trie. A larger one is joined: distinct hosts open into
    their dot suffixes, of any depth, which meet the rules; an exception beats a longer rule beats a
    shorter one, and a host that no rule names has its last label as suffix. The hosts then join back
    to the rows. No hints: the measured sizes decide which side, if any, is broadcast. Only that way is
    not for streams.
    """
    if isinstance(rules, DataFrame):
        rules = suffixes.from_table(rules) or rules
    if not isinstance(rules, DataFrame):
        rules = rules or default_rules()
        if rules is None:
            return df.withColumn(out, registered_domain(url, brand_tld))
        # In steps, so that generated code holds each of them once.
        return (
            df.withColumn("_host_of", F.ltrim(full_host(url), F.lit(".")))
            .withColumn("_marked_of", rules.marked(F.col("_host_of")))
            .withColumn("_domain_of", rules.registered(F.col("_marked_of"), brand_tld))
            .select(*[F.col(c) for c in df.columns], _name(F.col("_host_of"), F.col("_domain_of")).alias(out))
        )
    best = rules.groupBy("rule").agg(F.max(F.struct("rank", "suffix_labels")).alias("hit"))
    work = df.withColumn("_host", F.ltrim(full_host(url), F.lit(".")))
    hosts = work.select("_host").where(F.col("_host") != "").distinct()
    n = F.size(F.split(F.col("_host"), r"\."))
    hits = hosts.select("_host", F.explode(host_suffixes("_host")).alias("rule")).join(best, "rule")
    longest = hits.where(F.col("hit.suffix_labels") <= n).groupBy("_host").agg(F.max("hit").alias("hit"))
    ruled = hosts.join(longest, "_host", "left").withColumn("_n", F.coalesce("hit.suffix_labels", F.when(n > 1, 1)))
    cut = F.call_function("substring_index", F.concat(F.lit("!."), F.col("_host")), F.lit("."), -(F.col("_n") + 1))
    cut = F.replace(cut, F.lit("!."), F.lit("")) if brand_tld else F.split_part(cut, F.lit("!."), F.lit(1))
    domains = ruled.select("_host", _name(F.col("_host"), cut).alias("_domain_of"))
    return work.join(domains, "_host", "left").select(
        *[F.col(c) for c in df.columns], F.col("_domain_of").alias(out)
    )


def last_two_labels(host: str | Column) -> Column:
    """Naive domain: the last two labels; hosts with fewer labels come back whole."""
    return F.substring_index(col(host), ".", -2)


def host_suffixes(host: str | Column) -> Column:
    """Every dot-suffix of a host, longest first: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(col(host), r"\.")
    n = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")
    )


def has_http_scheme(url: str | Column) -> Column:
    return col(url).startswith("http")
