"""Owner labels and first/third-party tiers for requests, cookies and script calls."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from crawlprism.config import EXTERNAL, FIRST_PARTY, INTER_FAMILY, UNKNOWN_TIER
from crawlprism.functions.columns import col
from crawlprism.functions.suffixes import SuffixTrie, from_table
from crawlprism.functions.urls import full_host, lacks_domain, with_registered_domain
from crawlprism.session import fits_broadcast, written


@dataclass(frozen=True)
class EnrichmentTarget:
    """A table to enrich: where its own domain and its page context are found."""

    name: str
    domain_column: str
    context_column: str | None


ENRICHMENT_TARGETS = (
    EnrichmentTarget("http_requests", "url", "top_level_url"),
    EnrichmentTarget("javascript_cookies", "host", None),
    EnrichmentTarget("javascript", "script_url", "top_level_url"),
)


def entity_index(tree: DataFrame, path: str = "path") -> DataFrame:
    """Leaf domains of a path-encoded tree with their owners, one row per domain.

    A leaf is a path that is no other row's parent path.
    """
    parent = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    inner = tree.select(parent.alias("_inner")).where(F.col("_inner") != "").distinct()
    leaves = tree.join(inner, F.col(path) == F.col("_inner"), "left_anti")
    labelled = leaves.select(
        F.element_at(F.split(path, "/"), -1).alias("entity_domain"),
        F.struct(
            F.col(path),
            *[c for c in ("subsidiary_entity", "parent_entity", "source", "priority") if c in tree.columns],
        ).alias("leaf"),
    )
    # The same domain may hang in two places: keep the smaller path.
    return (
        labelled.groupBy("entity_domain")
        .agg(F.min("leaf").alias("leaf"))
        .select("entity_domain", "leaf.*")
        .drop(path)
    )


def entity_children(tree: DataFrame, path: str = "path") -> DataFrame:
    """Number of direct children of every inner node of the tree."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]+$", 1)
    return (
        tree.select(parent.alias("node"), F.col(path).alias("_child"))
        .where(F.col("node") != "")
        .groupBy("node")
        .agg(F.count_distinct("_child").alias("n_children"))
    )


def visit_domains(
    visits: DataFrame,
    keys: tuple[str, ...] = ("profile", "visit_id"),
    url: str = "site_url",
    rules: DataFrame | SuffixTrie | None = None,
) -> DataFrame:
    """Registered domain of the visited site, one row per visit, by the rules that the requests go by."""
    named = with_registered_domain(visits, url, "_site_domain", rules=rules)
    return named.groupBy(*keys).agg(F.max("_site_domain").alias("visit_domain"))


def with_owner(
    df: DataFrame, index: DataFrame, domain: str, prefix: str = "", fallback: bool = True
) -> DataFrame:
    """Attach subsidiary and parent of a domain. An unmapped domain is its own owner; a null
    domain has none."""
    owners = index.select(
        F.col("entity_domain").alias("_leaf"),
        F.col("subsidiary_entity").alias("_sub"),
        F.col("parent_entity").alias("_par"),
    )
    out = df.join(owners, F.col(domain) == F.col("_leaf"), "left")
    own = F.col(domain) if fallback else F.lit(None).cast("string")
    mapped = F.col("_leaf").isNotNull()
    return out.select(
        *[F.col(c) for c in df.columns],
        F.when(mapped, F.col("_sub")).otherwise(own).alias(f"{prefix}subsidiary_entity"),
        F.when(mapped, F.col("_par")).otherwise(own).alias(f"{prefix}parent_entity"),
    )


def relationship_flags(
    domain: str | Column,
    subsidiary: str | Column,
    parent: str | Column,
    top_domain: str | Column,
    top_subsidiary: str | Column,
    top_parent: str | Column,
) -> tuple[Column, Column, Column]:
    """(technical, subsidiary, parent) third-party flags, each nested in the one before."""
    technical = ~col(domain).eqNullSafe(col(top_domain))
    by_subsidiary = technical & ~col(subsidiary).eqNullSafe(col(top_subsidiary))
    by_parent = by_subsidiary & ~col(parent).eqNullSafe(col(top_parent))
    return technical, by_subsidiary, by_parent


def enrich(
    df: DataFrame,
    index: DataFrame,
    visits: DataFrame,
    *,
    domain_column: str,
    context_column: str | None = None,
    visit_keys: tuple[str, ...] = ("profile", "visit_id"),
    suffix_rules: DataFrame | SuffixTrie | None = None,
    keep_context: bool = False,
) -> DataFrame:
    """Add domain, subsidiary_entity, parent_entity, relationship_tier and is_technical_3p.

    The page's domain comes from the context column, else from the visit; all three go by the same
    suffix rules. Where either side stays unresolved the labels are '' and the tier is unknown.
    """
    if isinstance(suffix_rules, DataFrame):
        suffix_rules = from_table(suffix_rules) or suffix_rules
    has_context = context_column is not None and context_column in df.columns
    small = fits_broadcast(visits.select(*visit_keys, "site_url"))
    if not small and not df.isStreaming and not isinstance(suffix_rules, DataFrame) and _same_keys(df, visits, visit_keys):
        labelled = _labelled_in_slices(df, index, visits, domain_column, context_column if has_context else None, visit_keys, suffix_rules)
        return tiers_of(labelled, df.columns, keep_context=keep_context)
    site = visit_domains(visits, visit_keys, rules=suffix_rules)
    base = with_registered_domain(df, context_column, "_context", rules=suffix_rules) if has_context else df
    base = base.join(F.broadcast(site) if small else site, list(visit_keys), "left")
    base = base.withColumn("_top", F.coalesce("_context", "visit_domain") if has_context else F.col("visit_domain"))
    base = with_registered_domain(base, domain_column, "_domain", rules=suffix_rules)
    return with_tiers(base, df.columns, index, keep_context=keep_context)


#: Types of visit keys that equal each other just where their hashes do.
_HASHED_TYPES = ("string", "tinyint", "smallint", "int", "bigint", "date", "timestamp")


def _same_keys(df: DataFrame, visits: DataFrame, keys: Sequence[str]) -> bool:
    mine, theirs = dict(df.dtypes), dict(visits.dtypes)
    return all(mine[k] == theirs[k] and mine[k] in _HASHED_TYPES for k in keys)


def _labelled_in_slices(
    df: DataFrame,
    index: DataFrame,
    visits: DataFrame,
    domain_column: str,
    context_column: str | None,
    keys: Sequence[str],
    rules: SuffixTrie | None,
) -> DataFrame:
    """The rows with domains and owners of both sides, shuffled once.

    Rows are dealt by visit into as many slices as the session has shuffle partitions. The distinct hosts of
    each slice get their domain and owners in narrow tables, suffix rules and index being asked once a
    host, and come back to the slices, where rows, hosts and visits meet without another shuffle. A visit
    that makes a slice much larger than the others is spread over several; see `_spread`.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = _spread(df, keys, domain_column, n)
    slice_of, copies_of = _slices(keys, n, parts)
    by_slice = lambda frame: frame.repartitionById(n, F.col("_slice"))

    hosts = [full_host(domain_column)] + ([full_host(context_column)] if context_column else [])
    placed = visits.where(_known(keys)).select(*keys, full_host("site_url").alias("_host"), F.explode(copies_of).alias("_slice"))
    asked = df.select(slice_of(domain_column).alias("_slice"), F.explode(F.array(*hosts)).alias("_host"))
    asked = asked.unionByName(placed.select("_slice", "_host")).where(F.col("_host").isNotNull()).distinct()
    asked = written(asked, "hosts_of_slices")
    named = with_registered_domain(asked.select("_host").distinct(), "_host", "_domain", rules=rules)
    owners = written(asked.join(with_owner(named, index, "_domain", "_"), "_host"), "owners_of_slices")

    def owners_of(host: str, prefix: str, domain: str) -> DataFrame:
        labels = [F.col(f"_{c}").alias(f"{prefix}{c}") for c in ("subsidiary_entity", "parent_entity")]
        return by_slice(owners).select("_slice", F.col("_host").alias(host), F.col("_domain").alias(domain), *labels)

    own_host = owners_of("_host", "_r_", "_domain")
    top = ("_top", "_t_subsidiary_entity", "_t_parent_entity")
    site = by_slice(placed).join(owners_of("_host", "_t_", "_top"), ["_slice", "_host"], "left")
    site = site.groupBy("_slice", *keys).agg(F.max(F.struct(*top)).alias("_site"))
    site = site.select("_slice", *keys, *[F.col(f"_site.{c}").alias(c) for c in top])

    dealt = by_slice(df.withColumn("_slice", slice_of(domain_column)))

    def rows(lost: bool) -> DataFrame:
        """Rows whose page has no domain, or the others; both read the one shuffle."""
        out, kept = dealt.withColumn("_host", full_host(domain_column)), [*df.columns, "_slice", "_host"]
        if context_column:
            # Read out of an array: else Spark pushes the test below the shuffle, which is then made twice.
            page = F.struct(F.col("_page"), lacks_domain(F.col("_page"), rules).alias("lost"))
            out = out.withColumn("_page", full_host(context_column)).select(*kept, F.explode(F.array(page)).alias("_of"))
            out = out.where(F.col("_of.lost") == lost).select(*kept, *([] if lost else [F.col("_of._page").alias("_page")]))
        return out.join(own_host, ["_slice", "_host"], "left")

    columns = [*df.columns, "_domain", "_r_subsidiary_entity", "_r_parent_entity", *top]
    labelled = rows(True).join(site, ["_slice", *keys], "left").select(*columns)
    if context_column:
        paged = rows(False).join(owners_of("_page", "_t_", "_top"), ["_slice", "_page"], "left")
        labelled = paged.select(*columns).unionByName(labelled)
    return labelled


#: A slice is spread once it holds this many rows and three times its share.
HOT_SLICE_ROWS = 1_000_000


def _known(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _dealt(keys: Sequence[str], n: int, otherwise: str | None = None) -> Column:
    """The slice of a visit; rows without a visit, which meet none, go by another column."""
    deal = F.xxhash64(*keys)
    return F.pmod(deal if otherwise is None else F.when(_known(keys), deal).otherwise(F.xxhash64(otherwise)), F.lit(n)).cast("int")


def _spread(df: DataFrame, keys: Sequence[str], column: str, n: int) -> dict[int, int]:
    """Over how many slices the rows of each hot slice are spread: one count a slice comes to the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(_dealt(keys, n, column).alias("s")).agg(F.count("*")).collect()}
    share = max(1, sum(counts.values()) // n)
    return {s: min(n, -(-c // share)) for s, c in counts.items() if c >= HOT_SLICE_ROWS and c > 3 * share}


def _slices(keys: Sequence[str], n: int, parts: dict[int, int]):
    """The slice of a row by its visit and, in a hot slice, by its own host; and the slices of a visit."""
    if not parts:
        return (lambda column: _dealt(keys, n, column)), F.array(_dealt(keys, n))
    times = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])

    def slice_of(column: str) -> Column:
        dealt = _dealt(keys, n, column)
        step = F.pmod(F.xxhash64(column), F.coalesce(times[dealt], F.lit(1)))
        return F.pmod(dealt + step, F.lit(n)).cast("int")

    dealt = _dealt(keys, n)
    steps = F.sequence(F.lit(0), F.coalesce(times[dealt], F.lit(1)) - 1)
    return slice_of, F.transform(steps, lambda i: F.pmod(dealt + i, F.lit(n)).cast("int"))


def with_tiers(base: DataFrame, columns: Sequence[str], index: DataFrame, *, keep_context: bool = False) -> DataFrame:
    """Owners and tier of rows whose own domain is in `_domain` and whose page's is in `_top`."""
    labelled = with_owner(with_owner(base, index, "_domain", "_r_"), index, "_top", "_t_")
    return tiers_of(labelled, columns, keep_context=keep_context)


def tiers_of(labelled: DataFrame, columns: Sequence[str], *, keep_context: bool = False) -> DataFrame:
    """The tier of rows with domains and owners of both sides."""
    technical, by_sub, by_parent = relationship_flags(
        "_domain", "_r_subsidiary_entity", "_r_parent_entity",
        "_top", "_t_subsidiary_entity", "_t_parent_entity",
    )
    known = F.col("_domain").isNotNull() & F.col("_top").isNotNull()
    tier = F.when(by_parent, EXTERNAL).when(by_sub, INTER_FAMILY).otherwise(FIRST_PARTY)
    extra = (
        [F.col("_top").alias("top_domain"), F.col("_t_parent_entity").alias("top_parent_entity")]
        if keep_context
        else []
    )
    return labelled.select(
        *[F.col(c) for c in columns],
        F.coalesce("_domain", F.lit("")).alias("domain"),
        F.when(known, F.col("_r_subsidiary_entity")).otherwise("").alias("subsidiary_entity"),
        F.when(known, F.col("_r_parent_entity")).otherwise("").alias("parent_entity"),
        F.when(known, tier).otherwise(UNKNOWN_TIER).alias("relationship_tier"),
        F.when(known, technical.cast("double")).alias("is_technical_3p"),
        *extra,
    )


def tier_counts(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("relationship_tier").agg(F.count("*").alias("n_rows"))


def write_enriched(enriched: DataFrame, path: str) -> dict[str, int]:
    """Write an enriched table, partitioned by profile, and return the tier counts of that pass."""
    seen = Observation("tiers")
    tiers = {"first": FIRST_PARTY, "family": INTER_FAMILY, "external": EXTERNAL, "unknown": UNKNOWN_TIER}
    counted = enriched.observe(
        seen,
        *[F.count(F.when(F.col("relationship_tier") == t, 1)).alias(k) for k, t in tiers.items()],
    )
    (
        counted.hint("rebalance", "profile")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("profile")
        .parquet(path)
    )
    got = seen.get
    return {t: got[k] for k, t in tiers.items()}
