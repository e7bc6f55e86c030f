"""Benchmark decontamination: short test items inside long documents, by MinHash containment.

Texts are lower-cased (A-Z) and cut into words; shingles are five words, and an item or document
with fewer words is one shingle of all its words. A document holds an item if it has at least
`threshold` of the item's distinct shingles.

Search: items fall into partitions by size (distinct shingles). An item of q shingles needs
ceil(threshold * q) of them in the document, so at least one of its q - ceil(threshold * q) + 1
smallest hashes must be there: that bottom sketch is the item's MinHash signature, and its length
follows from the partition's size, so the search misses nothing. Documents probe the sketches of the
partitions they can contain: those whose needed shingles are no more than their own words allow.
Verification: candidate pairs are counted by distinct shingles themselves, as strings.

Defined cases: null and empty texts have no shingles and match nothing. Items repeated under several
ids each match. Repeated documents each match under their id; rows equal in id give one pair.
Other columns are ignored, and carried by `remove_contaminated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crawlprism.llm.common import lower_ascii, small, stored, words

SHINGLE = 5
THRESHOLD = 0.8


def _needed(q: Column, threshold: float) -> Column:
    return F.ceil(q * F.lit(threshold) - F.lit(1e-9)).cast("int")


def _hashes(size: int) -> Column:
    """Hashes of the shingles of `size` words of the column of word hashes `wh`."""
    at = lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(size)])
    every = F.transform(F.sequence(F.lit(0), F.size("wh") - size), at)
    return F.when(F.size("wh") >= size, every).otherwise(F.array().cast("array<bigint>"))


def _strings(size: int) -> Column:
    """The shingles of `size` words of the column of words `ws`, as text."""
    at = lambda i: F.array_join(F.slice("ws", i, size), " ")
    every = F.transform(F.sequence(F.lit(1), F.size("ws") - (size - 1)), at)
    return F.when(F.size("ws") >= size, every).otherwise(F.array().cast("array<string>"))


def _by_size(build, sizes: list[int]) -> Column:
    """All shingles of the given sizes as structs of size and value."""

    def tagged(k: int) -> Column:
        return F.transform(build(k), lambda v: F.struct(F.lit(k).alias("k"), v.alias("v")))

    return F.concat(*[tagged(k) for k in sizes])


def item_table(items: DataFrame, *, item_id: str = "item_id", text_column: str = "text", shingle: int = SHINGLE,
               threshold: float = THRESHOLD) -> DataFrame:
    """Items with words: item, k (words of a shingle), q (distinct shingles), need, part, sketch, strings."""
    base = items.select(F.col(item_id).alias("item"), words(lower_ascii(F.col(text_column))).alias("ws")).where(
        F.size("ws") > 0
    )
    hashed = base.select("item", "ws", F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"))
    k = F.least(F.size("wh"), F.lit(shingle))
    sized = hashed.select(
        "item", k.alias("k"),
        F.when(F.size("wh") < shingle, F.array(F.array_join("ws", " "))).otherwise(_strings(shingle)).alias("strings"),
        F.sort_array(F.array_distinct(
            F.when(F.size("wh") < shingle, F.array(_whole(shingle))).otherwise(_hashes(shingle))
        )).alias("hashes"),
    )
    counted = sized.select(
        "item", "k", F.array_distinct("strings").alias("strings"), "hashes",
        F.size(F.array_distinct("strings")).alias("q"),
    )
    needed = counted.withColumn("need", _needed(F.col("q"), threshold))
    return needed.select(
        "item", "k", "q", "need", F.floor(F.log2(F.col("q"))).cast("int").alias("part"), "strings",
        F.slice("hashes", 1, F.col("q") - F.col("need") + 1).alias("sketch"),
    )


def _whole(shingle: int) -> Column:
    """The hash of all words of a text of fewer than `shingle` words."""
    n = F.size("wh")
    result = F.lit(None).cast("bigint")
    for size in range(1, shingle):
        result = F.when(n == size, F.xxhash64(*[F.get("wh", F.lit(i)) for i in range(size)])).otherwise(result)
    return result


def contained_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id",
                    text_column: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per (document, item) with containment: id, th (text hash), item, n_item, n_shared."""
    table = stored(item_table(items, item_id=item_id, text_column=text_column, shingle=shingle, threshold=threshold), "items")
    shape = table.agg(
        F.collect_set("k").alias("sizes"),  # at most `shingle` values
        F.min("need").alias("least"),
        F.sum(F.size("sketch")).alias("sketch_rows"),
        F.sum("q").alias("item_rows"),
    ).first()
    sizes = sorted(shape.sizes) or [shingle]
    read = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.col(text_column)).alias("th"),
        words(lower_ascii(F.col(text_column))).alias("ws"),
    ).where(F.size("ws") >= sizes[0])

    sketch = table.select("k", "part", "item", "need", F.explode("sketch").alias("v"))
    probe = read.select("id", "th", F.size("ws").alias("n"), F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"))
    probes = probe.where(F.col("n") >= (shape.least or 0)).select("id", "th", "n", F.inline(_by_size(_hashes, sizes)))
    hits = probes.join(small(sketch, shape.sketch_rows or 0, 40), ["k", "v"]).where(
        F.col("need") <= F.col("n") - F.col("k") + 1
    )
    candidates = stored(hits.select("id", "th").distinct(), "candidates").select(
        F.struct("id", "th").alias("found")
    )

    matched = docs.select(F.col(doc_id).alias("id"), F.col(text_column).alias("text")).join(
        candidates, F.col("id").eqNullSafe(F.col("found.id")) & (F.xxhash64("text") == F.col("found.th")), "left_semi"
    )
    worded = matched.select("id", F.xxhash64("text").alias("th"), words(lower_ascii(F.col("text"))).alias("ws"))
    seen = worded.select("id", "th", F.inline(_by_size(lambda k: F.array_distinct(_strings(k)), sizes)))
    full = table.select("k", "item", "q", "need", F.explode("strings").alias("v"))
    shared = seen.join(small(full, shape.item_rows or 0, 200), ["k", "v"])
    return (
        shared.groupBy("id", "th", "item", "q", "need")
        .agg(F.count_distinct("v").alias("n_shared"))
        .where(F.col("n_shared") >= F.col("need"))
        .select("id", "th", "item", F.col("q").cast("long").alias("n_item"), "n_shared")
    )


def contaminated_pairs(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """Distinct (doc_id, item_id, n_item, n_shared); of several texts under one id, the best count."""
    return (
        contained_items(docs, items, **settings)
        .groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_item")
        .agg(F.max("n_shared").alias("n_shared"))
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text_column: str = "text",
                        **settings) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    found = stored(
        contained_items(docs, items, doc_id=doc_id, text_column=text_column, **settings).select("id", "th").distinct(),
        "contaminated",
    ).select(F.struct("id", "th").alias("__found"))
    return docs.join(
        found,
        docs[doc_id].eqNullSafe(F.col("__found.id")) & (F.xxhash64(docs[text_column]) == F.col("__found.th")),
        "left_anti",
    )
