"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from crawlprism.config import (
    CONFIDENCE_LEVELS,
    INTENSITY_BUCKETS,
    LARGE_AREA,
    LARGE_LABEL,
    LIFESPAN_BUCKETS,
    NOT_THIRD_PARTY_TIERS,
    OTHER_SIZE,
    SMALL_AREA,
    SMALL_LABEL,
    STANDARD_SIZES,
    THIRD_PARTY_TIERS,
)

def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: str | Column, digits: int) -> Column:
    """Round a double half away from zero on its binary value.

    `F.round` rounds the decimal text of the double instead, so 1.005 would become 1.01.
    """
    scale = float(10**digits)
    x = col(c).cast("double")
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def percent(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double") * 100.0, col(b).cast("double"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_true(c: str | Column) -> Column:
    """`c = TRUE`, false for null."""
    return F.coalesce(col(c), F.lit(False))


def is_not_true(c: str | Column) -> Column:
    return ~is_true(c)


def third_party(tier: str | Column = "relationship_tier") -> Column:
    return col(tier).isin(*THIRD_PARTY_TIERS)


def not_first_party(tier: str | Column = "relationship_tier") -> Column:
    """The exclusion form: any tier but first-party and unknown. Null tiers do not pass."""
    return ~col(tier).isin(*NOT_THIRD_PARTY_TIERS)


def confidence_floor(min_confidence: str = "high", column: str | Column = "confidence") -> Column:
    """Ordinal floor; an unknown level counts as 'high'."""
    levels = CONFIDENCE_LEVELS.get(min_confidence, CONFIDENCE_LEVELS["high"])
    return col(column).isin(*levels)


def valid_ad(
    min_confidence: str = "high",
    confidence: str | Column = "confidence",
    flag: str | Column = "is_valid_ad",
) -> Column:
    return is_true(flag) & confidence_floor(min_confidence, confidence)


def optional_confidence(min_confidence: str | None, column: str | Column = "confidence") -> Column:
    """None keeps all rows; 'high' and 'medium' are floors; other values keep all rows."""
    if min_confidence in ("high", "medium"):
        return confidence_floor(min_confidence, column)
    return F.lit(True)


def usable_label(c: str | Column) -> Column:
    """A label that is present after trimming and is not the text 'None'."""
    text = F.trim(col(c))
    return col(c).isNotNull() & (text != "") & (text != "None")


def member_or(c: str | Column, members: Sequence[str], default: str = "other") -> Column:
    return F.when(col(c).isin(*members), col(c)).otherwise(F.lit(default))


def id_like(c: str | Column, min_length: int = 10) -> Column:
    return (F.length(col(c)) >= min_length) & col(c).rlike(r"^[a-zA-Z0-9_.-]+$")


def ad_size(width: str | Column, height: str | Column) -> Column:
    w, h = col(width), col(height)
    label = None
    for sw, sh, name in STANDARD_SIZES:
        hit = (w == sw) & (h == sh)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return (
        label.when(w * h < SMALL_AREA, SMALL_LABEL)
        .when(w * h > LARGE_AREA, LARGE_LABEL)
        .otherwise(OTHER_SIZE)
    )


def lifespan_days(expiry: str | Column, start: str | Column, is_session: str | Column) -> Column:
    """Days between two timestamps; -1 without expiry or for session cookies."""
    micros = F.unix_micros(col(expiry).cast("timestamp")) - F.unix_micros(
        col(start).cast("timestamp")
    )
    return F.when(
        col(expiry).isNull() | F.coalesce(col(is_session) == 1, F.lit(False)), F.lit(-1.0)
    ).otherwise(micros / F.lit(86400e6))


def _buckets(value: Column, table, strict: bool) -> tuple[Column, Column]:
    label = order = None
    for i, (bound, name) in enumerate(table):
        if bound is None:
            return label.otherwise(name), order.otherwise(i)
        hit = value < bound if strict else value <= bound
        label = F.when(hit, name) if label is None else label.when(hit, name)
        order = F.when(hit, i) if order is None else order.when(hit, i)
    return label, order


def lifespan_bucket(days: str | Column) -> tuple[Column, Column]:
    """(label, order) of a lifespan. Negative lifespans are 'session'."""
    return _buckets(col(days), LIFESPAN_BUCKETS, strict=True)


def intensity_bucket(n: str | Column, table=INTENSITY_BUCKETS) -> tuple[Column, Column]:
    """(label, order) of a count of tracking entities; `table` holds inclusive upper bounds."""
    return _buckets(col(n), table, strict=False)


def smoothed_lift(a: str | Column, b: str | Column, add: float = 1.0) -> Column:
    return (col(a).cast("double") + add) / (col(b).cast("double") + add)


def sig_marker(p: str | Column, none: str = "") -> Column:
    return (
        F.when(col(p).isNull() | F.isnan(col(p)), none)
        .when(col(p) < 0.001, "***")
        .when(col(p) < 0.01, "**")
        .when(col(p) < 0.05, "*")
        .otherwise("ns")
    )


def condition_label(seeded: str | Column, measured: str | Column) -> Column:
    return F.concat(
        F.when(is_true(seeded), "Seeded+Pixel").otherwise("Not seeded"),
        F.lit("\n("),
        F.when(is_true(measured), "meas. pixel").otherwise("no meas. pixel"),
        F.lit(")"),
    )


def to_bool(c: str | Column) -> Column:
    """Coerce booleans that were stored as text; null, '' and anything unreadable are false."""
    return F.coalesce(col(c).cast("string").try_cast("boolean"), F.lit(False))


def text_or(c: str | Column, default: str = "") -> Column:
    return F.coalesce(col(c), F.lit(default))


def above_fold(y: str | Column, fold: float = 600) -> Column:
    return F.coalesce(col(y) < fold, F.lit(False))


def closed_set(c: str | Column, allowed: Sequence[str], default: str = "Other") -> Column:
    return F.when(col(c).isin(*allowed), col(c)).otherwise(F.lit(default))
