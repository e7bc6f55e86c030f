"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a
length of at least max(12, 2q) that no neighbouring word extends keeping period q. All runs of a text
are found, nested and overlapping ones included.

Periods below `DIRECT` are found by direct lag scans: compare the words with themselves q further on.
Longer ones are found scale by scale, a scale being the periods from Q to 2Q - 1. Grams of k = Q/4
words are hashed (by doubling: a gram is two of the scale before) and every window of Q/2 grams gives
its leftmost smallest hash, the minimizer. A window of at most q words inside a run repeats q words
further on, so its minimizer does too: equal minimizers Q to 2Q - 1 apart are the seeds, and each seed
is extended to both sides word by word, which decides. Hashes only propose.

Grams that repeat too often would give a square of seeds. A gram with a period of at most k/2 lies in
exactly one run of a smaller scale, known by then. Two grams of one such run never seed a run of this
scale. Of two such runs, all seeds of one distance lie on one diagonal and prove the same thing, so
only those are followed that hold the last gram of either run. Any other gram recurs at most 16 times
within 2Q words. The seeds of a scale are thus linear in the text.

Texts are handled many at a time, laid end to end with a word between them that occurs once; a longer
single text is handled alone. No shuffle, no collected state between texts.

Defined cases: null and empty texts, and texts of blanks, have no words, no runs and an empty collapsed
text. Very long texts are searched whole. Repeated rows each get their row; only the id and text
columns are read, so other columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import DataFrame, functions as F

from crawlprism.llm.common import SLICE_BYTES, mix, words as words_of

SHORTEST = 12
DIRECT = 32

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, length, period
_NONE = np.empty(0, np.int64)


def _at_lag(ids: np.ndarray, q: int) -> Runs:
    """All stretches of period q, long enough to be runs."""
    same = np.flatnonzero(ids[q:] == ids[:-q])
    if len(same) < max(SHORTEST, 2 * q) - q:
        return _NONE, _NONE, _NONE
    breaks = np.flatnonzero(np.diff(same) > 1)
    starts = same[np.append(0, breaks + 1)]
    lengths = same[np.append(breaks, len(same) - 1)] - starts + 1 + q
    long = lengths >= max(SHORTEST, 2 * q)
    return starts[long], lengths[long], np.full(int(long.sum()), q)


def _minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost smallest hash of every window, by windows of doubled length."""
    least, at, width = hashes, np.arange(len(hashes)), 1
    while width < window:
        step = min(width, window - width)
        right = least[step:] < least[:-step]
        least = np.where(right, least[step:], least[:-step])
        at = np.where(right, at[step:], at[:-step])
        width += step
    return np.unique(at)


def _seeds(hashes: np.ndarray, text: np.ndarray, scale: int, k: int, known: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods q of equal minimizers i, i + q of one text with q in scale .. 2 scale - 1."""
    if len(hashes) < scale // 2:
        return _NONE, _NONE
    at = _minimizers(hashes, scale // 2)
    value = mix(hashes[at] + mix(text[at].astype(np.uint64)))
    order = np.argsort(value, kind="stable")
    at, value = at[order], value[order]
    first = np.append(True, value[1:] != value[:-1])
    again = ~first | np.append(~first[1:], False)
    at, first = at[again], first[again]
    if not len(at):
        return _NONE, _NONE
    group = np.cumsum(first)
    starts, lengths, periods = known
    of = np.full(len(at), -1)  # the run of a small period that holds the gram
    short = np.flatnonzero((periods <= k // 2) & (lengths >= k))
    if len(short):
        short = short[np.argsort(starts[short], kind="stable")]
        last = np.searchsorted(starts[short], at, "right") - 1
        inside = (last >= 0) & (at + k <= (starts + lengths)[short[last]])
        of[inside] = short[last[inside]]
    anchor = (of < 0) | np.append((group[1:] != group[:-1]) | (of[1:] != of[:-1]), True)
    wide = np.int64(len(text) + 4 * scale)
    place = group * wide + at
    found_i, found_j = [], []
    for some, low, high in ((np.flatnonzero(anchor), scale, 2 * scale), (np.flatnonzero(anchor & (of >= 0)), 1 - 2 * scale, 1 - scale)):
        begin, end = (np.searchsorted(place, place[some] + x) for x in (low, high))
        n = end - begin
        one = np.repeat(some, n)
        other = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        apart = (of[one] < 0) | (of[one] != of[other])
        one, other = at[one[apart]], at[other[apart]]
        found_i.append(np.minimum(one, other))
        found_j.append(np.maximum(one, other))
    i, j = np.concatenate(found_i), np.concatenate(found_j)

    def equal(by: int) -> np.ndarray:
        there = (i + by >= 0) & (j + by < len(hashes))
        return there & (hashes[np.where(there, i + by, 0)] == hashes[np.where(there, j + by, 0)])

    # A run matches itself over at least q >= 4k words, one gram of which is the seed.
    left, right = equal(-k), equal(k)
    likely = (left & right) | (left & equal(-2 * k)) | (right & equal(2 * k))
    i, q = i[likely], (j - i)[likely]
    order = np.lexsort((i, q))
    return i[order], q[order]


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences share from their start."""
    most, done, step = min(len(a), len(b)), 0, 64
    while done < most:
        some = a[done : done + step][: most - done] != b[done : done + step][: most - done]
        if some.any():
            return done + int(some.argmax())
        done += len(some)
        step *= 2
    return most


def _extended(ids: np.ndarray, i: np.ndarray, q: np.ndarray) -> Runs:
    """The stretches that seeds, sorted by period and place, extend to."""
    made, covered, period = [], 0, -1
    for at, lag in zip(i.tolist(), q.tolist()):
        if lag != period:
            covered, period = 0, lag
        if at < covered:
            continue
        right = _matching(ids[at:], ids[at + lag :])
        left = _matching(ids[at - 1 :: -1] if at else ids[:0], ids[at + lag - 1 :: -1])
        covered = at + right
        if left + right >= lag:
            made.append((at - left, left + right + lag, lag))
    return tuple(np.array(x, np.int64) for x in zip(*made)) if made else (_NONE, _NONE, _NONE)


def runs(ids: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> Runs:
    """All runs of texts laid end to end, by start, then period.

    `ids` are the words as integers, each text followed by one that occurs nowhere else; `text` is the
    number of each word's text and `sizes` the words of each text, the closing one not counted.
    """
    found: Runs = tuple(map(np.concatenate, zip(*[_at_lag(ids, q) for q in range(1, min(DIRECT, len(ids)))]))) if len(ids) > 1 else (_NONE,) * 3
    where = np.arange(len(ids))
    hashes, k, scale = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, DIRECT
    while len(sizes) and 2 * scale <= sizes.max():
        some = (sizes >= 2 * scale)[text]
        if not some.all():
            keep = some[where]
            where = where[keep]
            hashes = hashes[keep[: len(hashes)]]
            sizes = np.where(sizes >= 2 * scale, sizes, 0)
        # A gram that reached past a text dropped here held that text's closing word; it stays unique.
        while k < scale // 4 and len(hashes) > k:
            hashes = mix(hashes[:-k] * np.uint64(0x9E3779B97F4A7C15) + (hashes[k:] ^ (hashes[k:] >> np.uint64(29))))
            k *= 2
        own = ids[where]
        begin = np.searchsorted(where, found[0])
        held = begin < len(where)
        held[held] = where[begin[held]] == found[0][held]
        known = begin[held], found[1][held], found[2][held]
        got = _extended(own, *_seeds(hashes, text[where], scale, k, known))
        found = tuple(np.concatenate([a, b]) for a, b in zip(found, (where[got[0]], got[1], got[2])))
        scale *= 2
    starts, lengths, periods = found
    order = np.lexsort((periods, lengths, starts))  # of equal stretches the smallest period is the true one
    starts, lengths, periods = starts[order], lengths[order], periods[order]
    true = np.append(True, (starts[1:] != starts[:-1]) | (lengths[1:] != lengths[:-1]))[: len(starts)]
    starts, lengths, periods = starts[true], lengths[true], periods[true]
    order = np.lexsort((periods, starts))
    return starts[order], lengths[order], periods[order]


def _slices(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield texts[first:]


def _of_texts(texts: list[bytes]) -> tuple[list[int], Runs, np.ndarray, list[bytes]]:
    """Words of each text, all runs with starts inside their text, the number of each run's text, and
    the texts without what runs repeat."""
    split = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    sizes = np.array([len(ws) for ws in split], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    ids = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for b, ws in zip(begins.tolist(), split):
        ids[b : b + len(ws)] = [number.setdefault(w, len(number)) for w in ws]
    ids[begins + sizes] = -1 - np.arange(len(texts))
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    starts, lengths, periods = runs(ids, text, sizes)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, starts + lengths, -1)
    gone = np.cumsum(change[:-1]) > 0
    of = text[starts]
    collapsed = [b" ".join(ws) for ws in split]
    for i in np.unique(of).tolist():
        stay = ~gone[begins[i] : begins[i] + sizes[i]]
        collapsed[i] = b" ".join([split[i][w] for w in np.flatnonzero(stay).tolist()])
    return sizes.tolist(), (starts - begins[of], lengths, periods), of, collapsed


def find_runs(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n_words, `runs` (array of start, length, period in words, by start, then
    period) and `collapsed`, the words no run repeats, joined by one space."""
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    element = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for texts in _slices(batch.column(1).to_pylist(), SLICE_BYTES):
                sizes, found, of, collapsed = _of_texts(texts)
                ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], fields=list(element)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), lists,
                     pa.array(collapsed, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "runs", "collapsed"],
                )
                first += len(texts)

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(
        run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    ).withColumnRenamed("id", id_column)


def planted(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and text, a tenth of the texts made periodic from some word on, as their id's hash says. A
    null id counts as the empty string."""
    h = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), h.alias("h"))
    ws = words_of(F.col("text"))
    n = F.size("ws").cast("long")
    g = F.expr("h div 10")
    made = read.withColumn("ws", F.when(F.col("h") % 10 == 0, ws)).withColumn("a", F.when(n > 0, g % n)).withColumn(
        "p", F.expr("1 + (size(ws) - a) div (3 + (h div 10) % 8)")
    )
    moved = F.transform("ws", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("ws", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return made.select(
        F.col("id").alias(id_column), F.when(F.col("a").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias(text_column)
    )


def digest(found: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and hashes of the runs and of the
    collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(id_column, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed").select(
        id_column, "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
