"""An index of text patterns by their rarest q-gram.

To find which of many substrings occur in each of many texts without walking the list for every text,
each pattern is posted under one gram of `Q` characters that it must contain: the one that the fewest
patterns contain (`.com` posts nothing where `clic` can). A text opens into its distinct grams, which
meet the postings in an equi-join; only the few patterns met are then tested on the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlprism.functions.columns import col

Q = 4
_WILD = re.compile(r"\\(.)|[%_]", re.S)


def like_pieces(pattern: str) -> list[str]:
    """The literal stretches of a LIKE pattern; a backslash makes the next character literal."""
    pieces, at = [""], 0
    for found in _WILD.finditer(pattern):
        pieces[-1] += pattern[at : found.start()]
        if found[1] is None:
            pieces.append("")
        else:
            pieces[-1] += found[1]
        at = found.end()
    pieces[-1] += pattern[at:]
    return [p for p in pieces if p]


def anchors(patterns: Sequence[str], like: bool = False) -> dict[str, str]:
    """The gram each pattern is posted under: of `Q` characters, or its longest literal stretch if that
    is shorter; '' where any text may match."""
    pieces = {p: like_pieces(p) if like else [p] for p in patterns}
    longest = {p: min(Q, max(map(len, some), default=0)) for p, some in pieces.items()}
    grams = {p: {x[i : i + longest[p]] for x in some for i in range(len(x) - longest[p] + 1)} for p, some in pieces.items()}
    shared = Counter(g for some in grams.values() for g in some)
    return {p: min(some, key=lambda g: (shared[g], g), default="") for p, some in grams.items()}


def text_grams(text: str | Column, sizes: Sequence[int]) -> Column:
    """The distinct grams of a text, of each size; the size 0 stands for the empty gram."""
    text = col(text)
    parts = [
        F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))) if n else F.array(F.lit(""))
        for n in sizes
    ]
    some = [F.when(F.length(text) >= n, part) for n, part in zip(sizes, parts)]
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in some])))


def with_matches(df: DataFrame, text: str, patterns: Sequence[str], out: str, *, like: bool = False) -> DataFrame:
    """One row per row and pattern found in its text. Each pattern counts once; null texts match none.
    No hint: the measured size of the postings decides how they are joined."""
    posted = anchors(list(dict.fromkeys(patterns)), like)
    postings = df.sparkSession.createDataFrame([(g, p) for p, g in posted.items()], f"_gram string, {out} string")
    sizes = sorted({len(g) for g in posted.values()})
    opened = df.where(F.col(text).isNotNull()).withColumn("_gram", F.explode(text_grams(text, sizes)))
    met = opened.join(postings, "_gram")
    hit = F.like(F.col(text), F.concat(F.lit("%"), F.col(out), F.lit("%"))) if like else F.col(text).contains(F.col(out))
    return met.where(hit).drop("_gram")
