"""Line dedup: three-line windows that were seen before are cut out of later documents.

Lines are the parts of a text between line feeds that hold a word. A line is compared without the
blanks around it; lines of blanks only belong to the line before them (leading ones to the first
line) and go or stay with it. Every three consecutive lines are a window. Of a window found more
than once, in any documents, the first occurrence by (id, text hash, position) stays and the lines
of every later one go; windows that overlap or touch merge into one cut. The first occurrence of
each line always survives.

Defined cases: a null text has no lines and stays null; null ids sort first. A text with fewer than
three lines has no window and stays as it is. A text cut whole becomes empty; its row stays. Rows
equal in id and text are one document and get the same result. Other columns are carried along;
`n_lines` and `n_removed` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from crawlprism.llm.common import WORD, stored

LINES_PER_WINDOW = 3
_BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """Lines with a word, each with the blank lines after it (the first also with those before)."""
    parts = F.split(text, r"\n(?=[^\n]*[^\x20\x09-\x0D])")
    opened = F.concat(F.array(F.concat_ws("\n", parts[0], parts[1])), F.slice(parts, 3, F.size(parts)))
    return (
        F.when(~text.rlike(WORD) | text.isNull(), F.array().cast("array<string>"))
        .when(text.rlike(r"^[\x20\x09\x0B-\x0D]*\n"), opened)
        .otherwise(parts)
    )


def window_table(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                 window: int = LINES_PER_WINDOW) -> DataFrame:
    """One row per window: 128 bits of hash (a, b), its document (id, th) and its first line (pos)."""
    text = F.col(text_column)
    lines = docs.select(
        F.col(id_column).alias("id"),
        F.xxhash64(text).alias("th"),
        F.transform(lines_of(text), lambda x: F.trim(x, F.lit(_BLANKS))).alias("lines"),
    ).where(F.size("lines") >= window)
    hashed = lines.select(
        "id", "th",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("ha"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("hb"),
    )

    def at(i: Column) -> Column:
        return F.struct(
            F.xxhash64(*[F.get("ha", i + k) for k in range(window)]).alias("a"),
            F.xxhash64(*[F.get("hb", i + k) for k in range(window)]).alias("b"),
            i.alias("pos"),
        )

    every = F.transform(F.sequence(F.lit(0), F.size("ha") - window), at)
    return hashed.select("id", "th", F.inline(every))


def cuts(windows: DataFrame, window: int = LINES_PER_WINDOW) -> DataFrame:
    """Per document that loses lines: (id, th, starts, ends) of its merged cuts, ends exclusive."""
    place = F.struct("id", "th", "pos")
    first = (
        windows.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select("a", "b", "first")
    )
    later = windows.join(first, ["a", "b"]).where(~place.eqNullSafe(F.col("first"))).select("id", "th", "pos")
    order = W.partitionBy("id", "th").orderBy("pos")
    edges = later.select(
        "id", "th", "pos", F.lag("pos").over(order).alias("before"), F.lead("pos").over(order).alias("after")
    )
    opens = F.col("before").isNull() | (F.col("pos") > F.col("before") + window)
    closes = F.col("after").isNull() | (F.col("after") > F.col("pos") + window)
    return (
        edges.where(opens | closes)
        .groupBy("id", "th")
        .agg(
            F.sort_array(F.collect_list(F.when(opens, F.col("pos")))).alias("starts"),
            F.sort_array(F.collect_list(F.when(closes, F.col("pos") + window))).alias("ends"),
        )
    )


def dedup_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                window: int = LINES_PER_WINDOW) -> DataFrame:
    """The documents without later occurrences of windows, with `n_lines` and `n_removed` (long).

    The windows are written once; of them only hashes and positions are shuffled. Texts move once, to
    meet the cuts of their document.
    """
    windows = stored(window_table(docs, id_column=id_column, text_column=text_column, window=window), "windows")
    found = stored(cuts(windows, window), "cuts").select(F.struct("id", "th", "starts", "ends").alias("__cut"))
    found = found.hint("merge")  # one plan at every size: texts move once, sorted, in partitions that spill
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", text_column)]
    joined = docs.select(*kept_columns, F.col(text_column).alias("__text")).join(
        found,
        docs[id_column].eqNullSafe(F.col("__cut.id")) & (F.xxhash64("__text") == F.col("__cut.th")),
        "left",
    )
    lined = joined.select(*kept_columns, "__text", "__cut", lines_of(F.col("__text")).alias("__lines"))
    between = F.zip_with(
        F.concat(F.array(F.lit(0)), F.col("__cut.ends")),
        F.concat(F.col("__cut.starts"), F.array(F.size("__lines"))),
        lambda s, e: F.struct(s.alias("s"), (e - s).alias("n")),
    )
    kept = F.flatten(F.transform(between, lambda r: F.slice("__lines", r.s + 1, r.n)))
    lengths = F.zip_with("__cut.starts", "__cut.ends", lambda s, e: (e - s).cast("long"))
    removed = F.coalesce(F.aggregate(lengths, F.lit(0).cast("long"), lambda x, y: x + y), F.lit(0).cast("long"))
    new_text = F.when(F.col("__cut").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))
    return lined.select(
        *[new_text.alias(c) if c == text_column else F.col(c) for c in docs.columns if c in kept_columns or c == text_column],
        F.size("__lines").cast("long").alias("n_lines"),
        removed.alias("n_removed"),
    )
