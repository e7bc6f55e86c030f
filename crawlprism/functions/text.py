"""Text columns: cleaning, tokens, keyword lexicons."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from crawlprism.functions.columns import any_of, col

# Python's \s on str also covers the Unicode separators; Java's default \s does not.
WHITESPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WHITESPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"

# A run of non-blanks with a mail-like part is dropped whole. The search starts only where a run
# starts and looks for the at-sign first, so a long junk run is read once.
_MAIL_LIKE_RUN = (
    f"(?<!{NOT_WHITESPACE})(?={NOT_WHITESPACE}*?{NOT_WHITESPACE}@{NOT_WHITESPACE}+?\\.{NOT_WHITESPACE})"
    f"{NOT_WHITESPACE}+"
)


def squeeze(c: str | Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(col(c), WHITESPACE + "+", " "))


def clean_text(c: str | Column, min_token: int = 3) -> Column:
    """Lower-case letter-only text without URLs, mail-like strings and tokens under `min_token`."""
    text = F.regexp_replace(
        F.coalesce(col(c), F.lit("")), f"https?://{NOT_WHITESPACE}+", " "
    )
    text = F.when(text.contains("@"), F.regexp_replace(text, _MAIL_LIKE_RUN, " ")).otherwise(text)
    letters = F.lower(F.regexp_replace(text, "[^a-zA-Z]+", " "))
    if min_token > 1:
        letters = F.regexp_replace(letters, rf"\b[a-z]{{1,{min_token - 1}}}\b", " ")
    return F.trim(F.regexp_replace(letters, "  +", " "))


def tokens(c: str | Column) -> Column:
    return F.filter(F.split(col(c), " "), lambda t: F.length(t) > 0)


def contains_any(c: str | Column, words: Sequence[str], wildcards: bool = False) -> Column:
    """Case-insensitive substring match of any word.

    A word is literal unless `wildcards` is set; then `%` and `_` keep their LIKE meaning.
    """
    if wildcards:
        return any_of([col(c).ilike(f"%{w}%") for w in words])
    lowered = F.lower(col(c))
    return any_of([lowered.contains(w.lower()) for w in words])


def first_category(
    c: str | Column, lexicon: Mapping[str, Sequence[str]], default: str = "Unknown"
) -> Column:
    """The first category, in lexicon order, one of whose words occurs in the lower-cased text."""
    text = F.lower(col(c))
    label: Column | None = None
    for name, words in lexicon.items():
        hit = text.rlike("|".join(re.escape(w) for w in words))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(default) if label is not None else F.lit(default)
