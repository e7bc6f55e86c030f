"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its terms: words (runs of letters, digits and bytes beyond ASCII, A-Z lower-cased)
and, for inflected languages, the first bytes of longer words; each is hashed to one of 2**BITS
weights. The score is the logistic of

    bias + sum w[i] + 1/2 * (|sum v[i]|^2 - sum |v[i]|^2)

so besides its own weight each term has a vector, and the products of vectors learn what two terms
say only together. Training sees the labelled rows whose hold-out fold is not 0, at most
`MAX_TRAINING_ROWS` of them, those of the smallest hash of the id, then of the text; only terms in at least `MIN_ROWS` of
these rows that are common or tell the classes apart get weights, all others count as absent (choosing
by count alone was measured and costs a quarter of the recall; see the README). Fitting is
deterministic: minibatches in a fixed order, Adagrad, L1 on weights and L2. It runs in the driver over the
bounded sample; the weights (a fixed size) are then sent to all workers, and scoring is one pass without
a shuffle.

Defined cases: null and empty texts have no terms and get the bias's score. Without labelled rows, or
with one class only, every score is that class's rate (0 without rows). Labels that are null are
left out; a row labelled twice counts twice, within the bound. Very long texts are read whole. Inputs of
a score are the text alone; other columns are not read and may have any names. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlprism.llm.common import hold_out, small, text_slices, word_hashes

BITS = 20
FACTORS = 8
MAX_TRAINING_ROWS = 12_000
MIN_ROWS = 5
COMMON_SHARE = 0.05
MIN_RATIO = 15.0
PREFIXES = (4, 5, 6)
EPOCHS = 12
BATCH = 256
RATE = 0.1
L1 = 0.001
L2 = 1e-4
FOLDS = 5

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row of each distinct term, its slot) per slice of texts."""
    for first, last, data, offsets in text_slices(column):
        rows, hashes = word_hashes(data, offsets, blank=_BREAK, prefixes=PREFIXES)
        slots = hashes >> np.uint64(64 - BITS)
        both = np.unique((rows.astype(np.uint64) << np.uint64(BITS)) | slots)
        yield first, last, (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Machine:
    """Weights of the used slots only: `place` maps a slot to its row, 0 for all others."""

    bias: float
    place: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def scores(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        at = self.place[slots]
        rows, at = rows[at > 0], at[at > 0]
        raw = self.bias + np.bincount(rows, weights=self.weight[at], minlength=n)
        for v in self.factors.T:
            x = v[at]
            raw += 0.5 * (np.bincount(rows, weights=x, minlength=n) ** 2 - np.bincount(rows, weights=x * x, minlength=n))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def chosen_slots(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Common terms (they may matter only beside others) and rarer ones whose rows differ in labels
    from the rest by a log-likelihood ratio of at least `MIN_RATIO`."""
    n, rate = len(labels), labels.mean()
    count = np.bincount(slots, minlength=1 << BITS)
    toxic = np.bincount(slots, weights=labels[rows], minlength=1 << BITS)

    def part(k: np.ndarray, m: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            share = k / m
            return np.nan_to_num(k * np.log(share / rate)) + np.nan_to_num((m - k) * np.log((1 - share) / (1 - rate)))

    ratio = 2 * (part(toxic, count) + part(labels.sum() - toxic, n - count))
    return np.flatnonzero((count >= MIN_ROWS) & ((count >= COMMON_SHARE * n) | (ratio >= MIN_RATIO)))


def fit(rows: np.ndarray, slots: np.ndarray, labels: np.ndarray) -> Machine:
    """The machine of a training sample given as (row, slot) pairs and a 0/1 label per row."""
    n = len(labels)
    place = np.zeros(1 << BITS, np.int32)
    rate = labels.mean() if n else 0.0
    if not 0 < rate < 1:
        logit = 30.0 if rate else -30.0
        return Machine(logit, place, np.zeros(1), np.zeros((1, FACTORS)))
    used = chosen_slots(rows, slots, labels)
    place[used] = np.arange(1, len(used) + 1)
    at = place[slots]
    rows, at = rows[at > 0], at[at > 0]
    by_row = np.argsort(rows, kind="stable")
    rows, at = rows[by_row], at[by_row]
    begin = np.searchsorted(rows, np.arange(n + 1))

    random = np.random.default_rng(7)
    size = len(used) + 1
    w, v, bias = np.zeros(size), random.normal(0, 0.01, (size, FACTORS)), float(np.log(rate / (1 - rate)))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for i in range(0, n, BATCH):
            some = order[i : i + BATCH]
            lengths = begin[some + 1] - begin[some]
            local = np.repeat(np.arange(len(some)), lengths)
            index = np.repeat(begin[some] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
            ids = at[index]
            names, back = np.unique(ids, return_inverse=True)
            one_w, one_v = w[names][back], v[names][back]
            sums = np.stack([np.bincount(local, weights=x, minlength=len(some)) for x in one_v.T], axis=1)
            raw = bias + np.bincount(local, weights=one_w, minlength=len(some))
            raw += 0.5 * ((sums**2).sum(1) - np.bincount(local, weights=(one_v**2).sum(1), minlength=len(some)))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
            pull = error[local]
            g_w = np.bincount(back, weights=pull, minlength=len(names)) + L2 * w[names]
            g_v = np.stack(
                [np.bincount(back, weights=pull * (sums[local, k] - one_v[:, k]), minlength=len(names)) for k in range(FACTORS)],
                axis=1,
            ) + L2 * v[names]
            seen_w[names] += g_w**2
            seen_v[names] += g_v**2
            pace = RATE / np.sqrt(seen_w[names])
            moved = w[names] - pace * g_w
            w[names] = np.sign(moved) * np.maximum(np.abs(moved) - pace * L1, 0)
            v[names] -= 0.3 * RATE * g_v / np.sqrt(seen_v[names])
            seen_b += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(seen_b)
    w[0], v[0] = 0, 0
    return Machine(bias, place, w, v)


def training_sample(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                    label_column: str = "toxic", folds: int = FOLDS, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """text and label of at most `most` labelled rows outside fold 0."""
    marked = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")
    ).where(hold_out(F.col("id"), folds) != 0)
    chosen = marked.orderBy(F.xxhash64("id"), "id", "label").limit(most)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    met = texts.join(small(chosen, most, 16), "id").select("id", "text", "label")
    # An id with many rows would bring them all: the bound holds for rows, not for ids.
    return met.orderBy(F.xxhash64("id"), "id", F.xxhash64("text"), "text", "label").limit(most)


def train(sample: DataFrame) -> Machine:
    """Fit the machine. Each task turns its texts into slots; the bounded sample of slots is fitted on
    the driver, in the order of ids."""

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, rows, slots in terms(batch.column(0)):
                bounds = np.searchsorted(rows, np.arange(last - first + 1)).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(bounds), pa.array(slots.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, last - first), made], ["label", "slots"])

    ordered = sample.select("text", "label").mapInArrow(slots_of, "label int, slots array<int>")
    table = ordered.toArrow()
    labels = table.column("label").to_numpy().astype(np.int64)
    lists = table.column("slots").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False) if len(labels) else np.empty(0, np.int64)
    slots = lists.flatten().to_numpy(zero_copy_only=False) if len(labels) else np.empty(0, np.int32)
    rows = np.repeat(np.arange(len(labels), dtype=np.int32), lengths)
    # One order whatever the partitioning: by the content of a row.
    key = np.zeros(len(labels), np.uint64)
    np.add.at(key, rows, (slots.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.lexsort((labels, key))
    rank = np.empty(len(labels), np.int32)
    rank[order] = np.arange(len(labels))
    return fit(rank[rows], slots, labels[order])


def score(docs: DataFrame, machine: Machine, *, id_column: str = "doc_id", text_column: str = "text",
          folds: int = FOLDS) -> DataFrame:
    """Per document: id, held_out, score, predicted. `machine` has a fixed size bound."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.scores(rows, slots, last - first) for first, last, rows, slots in terms(batch.column(1))]
            made = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["id", "score"])

    kind = read.schema["id"].dataType.simpleString()
    scored = read.mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_column),
        (hold_out(F.col("id"), folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
