"""Language-model scores from a log-frequency Bloom filter.

Training texts are cut into words (A-Z lower-cased) and one end token each; single tokens and pairs of
neighbours are counted over all of them, as 64-bit hashes. A count c of at least `least` becomes the
level 1 + floor(log2(c / least)), and a gram is put into the filter once for each level up to its own.
To read a count back, levels 1, 2, ... are probed until one is missing; the answer is the middle of the
last level's counts. The filter is built in segments by tasks, sized by the measured number of entries
(`BITS_PER_ENTRY`), and broadcast. Pairs seen once are left out (`LEAST`), as usual for large models.

The probability of a token v after u is smoothed towards the token's own:

    p(v) = (c(v) + 1) / (N + V + 1)        p(v | u) = (min(c(uv), c(u)) + MASS * p(v)) / (c(u) + MASS)

The base score beside it takes exact counts of single tokens. Filter and counts are kept in segments by
the hash of the gram. While they measure at most `MOST_MODEL_BYTES` they are broadcast and probed where
the texts are. Beyond that the probes travel instead: texts are laid into slices, the distinct grams of
a slice go to the tasks of their segments, and the levels read there come back to the slice. Either
way the same bits are probed and the same scores result.

Defined cases: a null or empty text is the end token alone. Without training rows N and V are 0, all
counts are 0, and p(v) is 1. A null id counts as the empty string for the hold-out. Very long texts are
slices of their own and read whole. Repeated rows each count in training and are scored each for itself.
Hash collisions (64 bits) are taken as equal words. Only the named columns are read, others may have any
names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from crawlprism.llm.common import hold_out, mix, stored, text_slices, word_hashes

FOLDS, HELD_OUT = 7, 2
LEAST = (1, 2)  # smallest count kept, of single tokens and of pairs
BITS_PER_ENTRY = 16
PROBES = 4
SEGMENT_BITS = 1 << 23
MASS = 2000.0
MOST_MODEL_BYTES = 256 << 20
FLUSH = 2 << 20

_ONE = np.uint64(1)
END, START = (mix(np.array([x], np.uint64))[0] & ~_ONE for x in (0xE0D, 0x57A87))
_PAIR = np.uint64(0x9DDFEA08EB382D69)
_LEVEL = 0xD6E8FEB86659FD93


def token_streams(data: np.ndarray, offsets: np.ndarray):
    """(row, token, pair) of every token, ends included. Keys of tokens are even, those of pairs odd."""
    n = len(offsets) - 1
    rows, hashes = word_hashes(data, offsets)
    lengths = np.bincount(rows, minlength=n)
    tokens = np.insert(hashes & ~_ONE, np.cumsum(lengths), END)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths + 1) - (lengths + 1)] = START
    pairs = mix(before * _PAIR + tokens) | _ONE
    return np.repeat(np.arange(n), lengths + 1), tokens, before, pairs


def count_grams(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """(key, n): counts of tokens and pairs. Tasks add up what they hold before the shuffle."""
    read = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                _, tokens, _, pairs = token_streams(data, offsets)
                held += [tokens, pairs]
                if sum(map(len, held)) >= FLUSH:
                    yield flush()
        if held:
            yield flush()

    return read.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _is_pair():
    return F.col("key").bitwiseAND(F.lit(1)) == 1


def _level():
    least = F.when(_is_pair(), F.lit(LEAST[1])).otherwise(F.lit(LEAST[0]))
    return (F.floor(F.log2(F.col("n") / least) + 1e-9) + 1).cast("int")


def middle(levels: np.ndarray, least: int) -> np.ndarray:
    """The count that stands for a level; 0 for level 0."""
    return np.where(levels > 0, (least * 2.0 ** (levels - 1) + least * 2.0**levels - 1) / 2, 0.0)


def probability(pair, before, token, total: int, distinct: int):
    """log10 p(v | u) from read-back counts."""
    own = (token + 1) / (total + distinct + 1)
    return np.log10((np.minimum(pair, before) + MASS * own) / (before + MASS))


def places(keys: np.ndarray, level: int, size: int = SEGMENT_BITS) -> Iterator[np.ndarray]:
    """The bits of grams at a level, within their segment of `size` bits, one probe after the other."""
    h = mix(keys + np.uint64(level * _LEVEL & (1 << 64) - 1))
    step = (h >> np.uint64(32)) | _ONE
    for i in range(PROBES):
        yield (h + np.uint64(i) * step) & np.uint64(size - 1)


def read_levels(flat: np.ndarray, base: np.ndarray, keys: np.ndarray, size: int = SEGMENT_BITS) -> np.ndarray:
    """The levels of keys whose segments, of `size` bits, begin at the bytes `base` of `flat`."""
    found = np.zeros(len(keys), np.int64)
    alive = np.arange(len(keys))
    level = 0
    while len(alive) and level < 64:  # no count reaches a 64th level
        level += 1
        held = np.ones(len(alive), bool)
        for at in places(keys[alive], level, size):
            byte = flat[base[alive] + (at >> np.uint64(3)).astype(np.int64)]
            held &= (byte >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        alive = alive[held]
        found[alive] = level
    return found


def segments_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)


def exact_counts(sorted_keys: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, counts[at].astype(np.int64), 0)


@dataclass
class Filter:
    """Segments of bits. A gram's segment follows from its key, its bits from its key and the level."""

    bits: np.ndarray  # segments x bytes

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return segments_of(keys, len(self.bits))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        width = self.bits.shape[1]
        return read_levels(self.bits.ravel(), self.segment(keys) * width, keys, 8 * width)


def filter_segments(counts: DataFrame, segments: int, size: int = SEGMENT_BITS) -> DataFrame:
    """(segment, bits, keys, n): each segment is filled by one task from the grams that fall into it;
    beside its bits the exact counts of its single tokens, sorted by key."""
    keyed = counts.select(
        "key", "n", _level().alias("level"), (F.shiftrightunsigned("key", 32) % segments).cast("int").alias("segment")
    ).repartition("segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        single: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            keys, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            levels, where = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for s in np.unique(where).tolist():
                bits = made.setdefault(s, np.zeros(size // 8, np.uint8))
                at = where == s
                own, top = keys[at], levels[at]
                token = own & _ONE == 0
                single.setdefault(s, []).append((own[token], n[at][token]))
                for level in range(1, int(top.max()) + 1):
                    for place in places(own[top >= level], level, size):
                        np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        for s, bits in made.items():
            keys, n = map(np.concatenate, zip(*single[s]))
            order = np.argsort(keys)
            parts = [bits, keys[order], n[order]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["segment", "bits", "keys", "n"]
            )

    return keyed.mapInArrow(run, "segment int, bits binary, keys binary, n binary")


class Grams:
    """The tokens of some texts, with the distinct grams that are to be looked up."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.texts = len(offsets) - 1
        self.rows, tokens, before, self.pairs = token_streams(data, offsets)
        self.names, back = np.unique(np.append(tokens, START), return_inverse=True)
        self.which = back[:-1]
        self.context = back[np.where(before == START, len(tokens), np.arange(-1, len(tokens) - 1))]
        self.names = np.where(self.names == START, END, self.names)  # as many starts as ends

    def scores(self, exact: np.ndarray, names: np.ndarray, pairs: np.ndarray, total: int, distinct: int):
        """n_tokens, n_known, base_score, score per text, from the exact counts and levels of the names and the
        levels of the pairs."""
        read, seen = middle(names, LEAST[0]), middle(pairs, LEAST[1])
        logs = probability(seen, read[self.context], read[self.which], total, distinct)
        own = exact[self.which]
        base = np.log10((own + 1) / (total + distinct + 1))
        count = lambda weights=None: np.bincount(self.rows, weights, self.texts)
        return count(), count(own > 0).astype(np.int64), count(base), count(logs)


@dataclass
class Model:
    """What is broadcast: the filter, and the exact counts of single tokens, sorted by key."""

    total: int
    distinct: int
    filter: Filter
    keys: np.ndarray
    counts: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray):
        grams = Grams(data, offsets)
        exact = exact_counts(self.keys, self.counts, grams.names)
        return grams.scores(exact, self.filter.levels(grams.names), self.filter.levels(grams.pairs), self.total, self.distinct)


_RESULT = "n_tokens long, n_known long, base_score double, score double"
_NAMES = ["n_tokens", "n_known", "base_score", "score"]


def _by_broadcast(read: DataFrame, model: Model) -> DataFrame:
    sent = read.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                values = sent.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *map(pa.array, values)], ["id", *_NAMES]
                )

    return read.mapInArrow(run, f"id {read.schema['id'].dataType.simpleString()}, {_RESULT}")


def _in_slice(texts: pa.Array) -> tuple[Grams, np.ndarray]:
    """The grams of a slice and its distinct keys."""
    column = pa.array(texts.to_pylist(), pa.large_string())
    (_, _, data, offsets), *more = [*text_slices(column, 1 << 62)] or [(0, 0, np.empty(0, np.uint8), np.zeros(1, np.int64))]
    grams = Grams(data, offsets)
    return grams, np.unique(np.concatenate([grams.names, grams.pairs]))


def _by_shuffle(read: DataFrame, filled: DataFrame, segments: int, total: int, distinct: int) -> DataFrame:
    """The same with the probes sent to the segments, packed by slice and segment."""
    kind = read.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, _, _ in text_slices(batch.column(1)):
                ids, texts = (pa.ListArray.from_arrays(pa.array([0, last - first], pa.int32()), batch.column(i).slice(first, last - first)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([slices], pa.int64()), ids, texts], ["slice", "ids", "texts"])
                slices += 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, keys = _in_slice(texts.values)
                where = segments_of(keys, segments)
                order = np.argsort(where, kind="stable")
                keys, where = keys[order], where[order]
                at = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
                parts = [keys[s:e].tobytes() for s, e in zip(at.tolist(), [*at[1:].tolist(), len(keys)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where[at].astype(np.int32)), pa.array([number] * len(at), pa.int64()), pa.array(parts, pa.binary())],
                    ["segment", "slice", "asked"],
                )

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        slices = asked["slice"].to_pylist()
        parts = [np.frombuffer(x, np.uint64) for x in asked["asked"].to_pylist()]
        keys = np.concatenate([*parts, np.empty(0, np.uint64)])
        if segment.num_rows:
            bits, own, n = (np.frombuffer(segment[c][0].as_py(), t) for c, t in (("bits", np.uint8), ("keys", np.uint64), ("n", np.int64)))
            levels = read_levels(bits, np.zeros(len(keys), np.int64), keys, 8 * len(bits))
            exact = exact_counts(own, n, keys)
        else:
            levels = exact = np.zeros(len(keys), np.int64)
        made = np.stack([keys.view(np.int64), levels, exact], axis=1)
        ends = np.cumsum([len(x) for x in parts]).tolist()
        rows = [made[e - len(x) : e].tobytes() for x, e in zip(parts, ends)]
        return pa.table({"slice": pa.array(slices, pa.int64()), "answer": pa.array(rows, pa.binary())})

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        grams, _ = _in_slice(texts["texts"].chunk(0)[0].values)
        known = np.frombuffer(b"".join(answers["answer"].to_pylist()), np.int64).reshape(-1, 3)
        known = known[np.argsort(known[:, 0].view(np.uint64))]
        at = lambda keys: np.searchsorted(known[:, 0].view(np.uint64), keys)
        names, pairs = at(grams.names), at(grams.pairs)
        values = grams.scores(known[names, 2], known[names, 1], known[pairs, 1], total, distinct)
        return pa.table([texts["ids"].chunk(0)[0].values, *map(pa.array, values)], ["id", *_NAMES])

    slices = stored(read.mapInArrow(cut, f"slice long, ids array<{kind}>, texts array<string>"), "slices")
    asked = slices.select("slice", "texts").mapInArrow(ask, "segment int, slice long, asked binary")
    answers = asked.groupBy("segment").cogroup(filled.groupBy("segment")).applyInArrow(answer, "slice long, answer binary")
    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, f"id {kind}, {_RESULT}")


def score_texts(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                most_model_bytes: int = MOST_MODEL_BYTES, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held_out = hold_out(F.col(id_column), FOLDS) == HELD_OUT
    counted = count_grams(docs.where(~held_out), text_column=text_column)
    counts = stored(counted.where(~_is_pair() | (F.col("n") >= LEAST[1])), "counts")
    shape = counts.agg(
        F.sum(F.when(~_is_pair(), F.col("n"))).alias("total"),
        F.count(F.when(~_is_pair(), 1)).alias("distinct"),
        F.sum(_level()).alias("entries"),
    ).first()
    total, distinct, entries = shape.total or 0, shape.distinct, shape.entries or 0
    segments = max(1, -(-entries * BITS_PER_ENTRY // segment_bits))
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    filled = filter_segments(counts, segments, segment_bits)
    if segments * segment_bits // 8 + 16 * distinct <= most_model_bytes:
        bits = np.zeros((segments, segment_bits // 8), np.uint8)
        keys, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for row in filled.toLocalIterator():
            bits[row.segment] = np.frombuffer(row.bits, np.uint8)
            keys.append(np.frombuffer(row.keys, np.uint64))
            n.append(np.frombuffer(row.n, np.int64))
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys)
        n = n[order].astype(np.min_scalar_type(int(n.max(initial=0))))  # the narrowest type that holds every count
        model = Model(total, distinct, Filter(bits), keys[order], n)
        scored = _by_broadcast(read, model)
    else:
        scored = _by_shuffle(read, stored(filled, "filter"), segments, total, distinct)
    return scored.select(
        F.col("id").alias(id_column),
        (hold_out(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )
