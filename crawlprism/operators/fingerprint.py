"""Script behaviour: API call counts and fingerprinting detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlprism.config import (
    AUDIO_READ_SYMBOLS,
    AUDIO_SETUP_SYMBOLS,
    CANVAS_READ_SYMBOLS,
    CANVAS_WRITE_SYMBOLS,
    ENTITY_LEVELS,
    NAVIGATOR_SYMBOLS,
    SCREEN_SYMBOLS,
    Study,
    TECHNIQUE_SYMBOLS,
    check_choice,
)
from crawlprism.functions.columns import (
    count_if,
    percent,
    round_to,
    third_party,
)
from crawlprism.operators.common import keep_top, profile_spine, visit_totals

TECHNIQUES = ("canvas", "audio", "navigator")
PROBE_SYMBOLS = NAVIGATOR_SYMBOLS + SCREEN_SYMBOLS


def api_calls(
    scripts: DataFrame, techniques: Mapping[str, Sequence[str]] = TECHNIQUE_SYMBOLS
) -> DataFrame:
    """Calls per (profile, technique, symbol). A symbol of two techniques counts in both: calls are
    counted per symbol first, and only those few rows meet the technique table."""
    pairs = [(t, s) for t, symbols in techniques.items() for s in symbols]
    table = scripts.sparkSession.createDataFrame(pairs, "technique string, symbol string")
    wanted = sorted({s for _, s in pairs})
    counts = (
        scripts.where(F.col("symbol").isin(*wanted))
        .groupBy("profile", "symbol")
        .agg(F.count("*").alias("n_calls"))
    )
    return (
        counts.join(table, "symbol")
        .select("profile", "technique", "symbol", "n_calls")
        .orderBy("profile", "technique", F.col("n_calls").desc(), "symbol")
    )


def _at_grain(found: DataFrame, keys: list[str], grain: str, sums: Sequence[str]) -> DataFrame:
    """Visit grain keeps one row per visit (n_visits is 1); script grain adds the visits up."""
    check_choice("grain", grain, ("visit", "script"))
    if grain == "visit":
        return found.withColumn("n_visits", F.lit(1).cast("long"))
    return found.groupBy(*[k for k in keys if k != "visit_id"]).agg(
        *[F.sum(c).alias(c) for c in sums], F.count("*").alias("n_visits")
    )


def detect_canvas(
    scripts: DataFrame,
    min_text_calls: int = 1,
    granularity: str = "parent_entity",
    grain: str = "visit",
    write: Sequence[str] = CANVAS_WRITE_SYMBOLS,
    read: Sequence[str] = CANVAS_READ_SYMBOLS,
) -> DataFrame:
    """Third-party scripts that write text to a canvas and read its pixels in one visit."""
    check_choice("granularity", granularity, ENTITY_LEVELS)
    keys = ["profile", "script_url", granularity, "visit_id"]
    s = F.col("symbol")
    found = (
        scripts.where(s.isin(*write, *read) & third_party())
        .groupBy(*keys)
        .agg(count_if(s.isin(*write)).alias("n_text_calls"), count_if(s.isin(*read)).alias("n_read_calls"))
        .where((F.col("n_text_calls") >= min_text_calls) & (F.col("n_read_calls") >= 1))
    )
    return _at_grain(found, keys, grain, ("n_text_calls", "n_read_calls"))


def detect_audio(
    scripts: DataFrame,
    granularity: str = "parent_entity",
    grain: str = "visit",
    setup: Sequence[str] = AUDIO_SETUP_SYMBOLS,
    read: Sequence[str] = AUDIO_READ_SYMBOLS,
) -> DataFrame:
    """Third-party scripts that build an audio graph and read samples in one visit."""
    check_choice("granularity", granularity, ENTITY_LEVELS)
    keys = ["profile", "script_url", granularity, "visit_id"]
    s = F.col("symbol")
    found = (
        scripts.where(s.isin(*setup, *read) & third_party())
        .groupBy(*keys)
        .agg(count_if(s.isin(*setup)).alias("_setup"), count_if(s.isin(*read)).alias("_read"))
        .where((F.col("_setup") >= 1) & (F.col("_read") >= 1))
        .select(*keys)
    )
    return _at_grain(found, keys, grain, ())


MASK_BITS = 62


def _symbol_masks(symbols: Sequence[str]) -> list[Column]:
    """One bit per listed symbol, as many masks as they need; 0 for other symbols. Distinct symbols
    are then bitwise ORs, which aggregate in place, unlike a collected set."""
    masks = []
    for first in range(0, len(symbols), MASK_BITS):
        bit = F.when(F.lit(False), F.lit(0).cast("long"))
        for i, name in enumerate(symbols[first : first + MASK_BITS]):
            bit = bit.when(F.col("symbol") == name, F.lit(1 << i).cast("long"))
        masks.append(F.bit_or(bit.otherwise(0)))
    return masks


def _distinct_symbols(masks: Sequence[Column]) -> Column:
    return sum((F.coalesce(F.bit_count(m), F.lit(0)) for m in masks), F.lit(0))


def detect_probers(
    scripts: DataFrame,
    min_attributes: int = 5,
    granularity: str = "parent_entity",
    symbols: Sequence[str] = PROBE_SYMBOLS,
) -> DataFrame:
    """Third-party scripts that read many different attributes in one visit."""
    check_choice("granularity", granularity, ENTITY_LEVELS)
    keys = ["profile", "script_url", granularity, "visit_id"]
    names = sorted(symbols)
    masks = _symbol_masks(names)
    columns = [F.col(f"_mask{i}") for i in range(len(masks))]

    def read(i: int) -> Column:
        return columns[i // MASK_BITS].bitwiseAND(F.lit(1 << i % MASK_BITS).cast("long")) != 0

    listed = F.array(*[F.when(read(i), n) for i, n in enumerate(names)])
    return (
        scripts.where(F.col("symbol").isin(*names) & third_party())
        .groupBy(*keys)
        .agg(*[m.alias(f"_mask{i}") for i, m in enumerate(masks)])
        .withColumn("_n", _distinct_symbols(columns))
        .where(F.col("_n") >= min_attributes)
        .select(
            *keys,
            F.col("_n").cast("long").alias("n_attributes_read"),
            F.array_join(F.array_compact(listed), ", ").alias("attributes_list"),
            F.lit(1).cast("long").alias("n_visits"),
        )
    )


def detections(
    scripts: DataFrame,
    *,
    min_text_calls: int = 1,
    min_attributes: int = 5,
    granularity: str = "parent_entity",
) -> DataFrame:
    """(profile, script_url, entity, visit_id, technique) of all three detectors from one scan."""
    check_choice("granularity", granularity, ENTITY_LEVELS)
    s = F.col("symbol")
    groups = {
        "_text": CANVAS_WRITE_SYMBOLS,
        "_pixels": CANVAS_READ_SYMBOLS,
        "_setup": AUDIO_SETUP_SYMBOLS,
        "_samples": AUDIO_READ_SYMBOLS,
    }
    every = sorted({x for g in (*groups.values(), PROBE_SYMBOLS) for x in g})
    per_visit = (
        scripts.where(s.isin(*every) & third_party())
        .groupBy("profile", "script_url", granularity, "visit_id")
        .agg(
            *[count_if(s.isin(*g)).alias(name) for name, g in groups.items()],
            _distinct_symbols(_symbol_masks(PROBE_SYMBOLS)).alias("_probes"),
        )
    )
    hits = F.array_compact(
        F.array(
            F.when((F.col("_text") >= min_text_calls) & (F.col("_pixels") >= 1), "canvas"),
            F.when((F.col("_setup") >= 1) & (F.col("_samples") >= 1), "audio"),
            F.when(F.col("_probes") >= min_attributes, "navigator"),
        )
    )
    return per_visit.select(
        "profile", "script_url", granularity, "visit_id", F.explode(hits).alias("technique")
    )


def fingerprinter_summary(found: DataFrame, *, study: Study) -> DataFrame:
    """Distinct scripts and script-visits per technique; every configured profile has a row."""
    per_script = found.groupBy("profile", "technique", "script_url").agg(F.count("*").alias("n"))
    t = F.col("technique")
    counts = per_script.groupBy("profile").agg(
        *[count_if(t == x).alias(f"n_{x}_fp_scripts") for x in TECHNIQUES],
        *[F.sum(F.when(t == x, F.col("n")).otherwise(0)).alias(f"{x}_fp_visits") for x in TECHNIQUES],
    )
    measures = [c for c in counts.columns if c != "profile"]
    return (
        profile_spine(found, study)
        .join(counts, "profile", "left")
        .select(
            "profile", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in measures]
        )
    )


def top_scripts(found: DataFrame, top_n: int = 20) -> DataFrame:
    """Scripts with the most detected visits over all profiles."""
    keys = ["script_url", "parent_entity", "technique"]
    return (
        found.groupBy(*keys, "profile")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.sum("n").alias("total_visits"), F.count("profile").alias("profiles_seen"))
        .orderBy(F.col("total_visits").desc(), *keys)
        .limit(top_n)
    )


def fingerprinter_frequency(found: DataFrame, visits: DataFrame, top_n: int = 20) -> DataFrame:
    """Visits per (profile, owner) with technique flags. A visit counts once however many scripts
    or techniques fired; the flags come from all of them."""
    t = F.col("technique")
    flags = [f"uses_{x}" for x in TECHNIQUES]
    per_visit = found.groupBy("profile", "parent_entity", "visit_id").agg(
        *[F.max((t == x).cast("int")).alias(f"uses_{x}") for x in TECHNIQUES]
    )
    counts = per_visit.groupBy("profile", "parent_entity").agg(
        F.count("*").alias("n_visits_seen"), *[F.max(f).alias(f) for f in flags]
    )
    return (
        keep_top(counts, "parent_entity", "n_visits_seen", top_n)
        .join(visit_totals(visits), "profile", "left")
        .select(
            "profile",
            "parent_entity",
            "n_visits_seen",
            round_to(percent("n_visits_seen", "total_visits"), 2).alias("pct_of_visits"),
            *flags,
            sum((F.col(f) for f in flags[1:]), F.col(flags[0])).alias("n_techniques"),
        )
        .orderBy("parent_entity", "profile")
    )
