"""Best-fit packing of tokenised documents by patterns, fitted by non-negative least squares.

Every document is its token ids and one closing id. A longer one than `capacity` is cut into pieces
of that length; the first piece takes the remainder. The histogram of piece lengths (at most
`capacity` numbers, whatever the input) decides everything else: patterns of up to `slots` length
classes that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, each pattern takes pieces of its classes, longest
first, and what remains is packed by best fit, longest first, into the room left or new sequences.
The result is a table of ranges: pieces number r..r+n of a length go to sequences s..s+n at an
offset. Pieces find their range by length and rank; ranks come from counts by task and length, so
nothing is sorted as a whole and no group meets in one task.

Token ids are those of the tokenizers library for the file. They are computed by tiktoken from the
same vocabulary, which gives the same ids (tests compare them); a text it can't take goes to the
tokenizers library itself.

Defined cases: null and empty texts are the closing id alone. Repeated rows are packed each. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from crawlprism.llm.common import small, stored
from crawlprism.llm.token_counts import byte_letters

CAPACITY = 2048
CLASSES = 256
SLOTS = 3
CLOSING_ID = 0


class Encoder:
    """Token ids of a byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in w): i for w, i in file["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        for word in special:
            ranks.pop(word.encode(), None)
        self.fast = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self.library = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # its regular expressions give up on some very long runs
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and the task and the running number
    among the task's pieces of that length."""
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    closing = np.array([CLOSING_ID], np.uint32)
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer_path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            row, piece, start, length, crc, number = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate([encode.ids(text), closing]).astype("<u4")
                begin, end = 0, (len(ids) - 1) % capacity + 1
                while begin < len(ids):
                    row.append(i)
                    piece.append(begin and piece[-1] + 1)
                    start.append(begin)
                    length.append(end - begin)
                    crc.append(zlib.crc32(ids[begin:end].tobytes()))
                    number.append(seen[end - begin])
                    seen[end - begin] += 1
                    begin, end = end, end + capacity
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([task] * len(row), pa.int32()),
                    pa.array(number, pa.int64()),
                ],
                names,
            )

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, number long"
    )


# --- the plan, from the histogram alone ------------------------------------------------------------


def patterns(classes: int, slots: int) -> list[tuple[int, ...]]:
    """Multisets of up to `slots` classes that add up to the number of classes: a full sequence."""
    found = []
    for n in range(1, slots + 1):
        for head in combinations_with_replacement(range(1, classes + 1), n - 1):
            last = classes - sum(head)
            if last >= (head[-1] if head else 1):
                found.append((*head, last))
    return found


def fit(shapes: list[tuple[int, ...]], target: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Repeat counts of the patterns by non-negative least squares: accelerated projected gradient.

    The matrix has one column per pattern with at most `slots` entries, so products with it are sums.
    """
    slots = max(map(len, shapes), default=1)
    index = np.array([[*p, *[0] * (slots - len(p))] for p in shapes], np.int64).reshape(-1, slots)
    goal = np.append(0.0, target)
    scale = max(goal.max(), 1.0)
    goal /= scale

    def times(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(index[:, k], weights=x, minlength=len(goal)) for k in range(slots))
        total[0] = 0
        return total

    def pulled(r: np.ndarray) -> np.ndarray:
        return r[index].sum(axis=1)

    x = y = np.zeros(len(index))
    norm = np.ones(len(index))
    for _ in range(20):  # the largest singular value squared, by power iteration
        norm = pulled(times(norm))
        largest = np.linalg.norm(norm)
        norm /= max(largest, 1e-12)
    step, momentum = 0.95 / max(largest, 1e-12), 1.0
    for _ in range(steps):
        moved = y - step * pulled(times(y) - goal)
        moved[moved < 1e-12] = 0.0
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = moved + (momentum - 1) / after * (moved - x)
        x, momentum = moved, after
    return x * scale


class Plan:
    """Ranges of sequences, filled piece by piece: rows are (length, rank, count, sequence, offset)."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.left, self.capacity = histogram.copy(), capacity
        self.rank = np.zeros(capacity + 1, np.int64)
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (sequence, count)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, int(self.rank[length]), count, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count

    def open(self, lengths: list[int], count: int) -> None:
        """`count` new sequences that each begin with pieces of these lengths."""
        offset = 0
        for length in lengths:
            self.put(length, count, self.sequences, offset)
            offset += length
        if offset < self.capacity:
            self.room[self.capacity - offset].append((self.sequences, count))
        self.sequences += count

    def best_fit(self) -> None:
        """All that is left, longest first, each into the smallest room that holds it."""
        for length in range(self.capacity, 0, -1):
            room = length
            while self.left[length]:
                while room <= self.capacity and not self.room[room]:
                    room += 1
                count = int(self.left[length])
                if room > self.capacity:
                    each = self.capacity // length  # new sequences take as many of this length as fit
                    if count >= each:
                        self.open([length] * each, count // each)
                    else:
                        self.open([length] * count, 1)
                    room = length
                    continue
                sequence, many = self.room[room].pop()
                if many > count:
                    self.room[room].append((sequence + count, many - count))
                    many = count
                self.put(length, many, sequence, self.capacity - room)
                if room > length:
                    self.room[room - length].append((sequence, many))


def plan(histogram: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES, slots: int = SLOTS) -> Plan:
    """Ranges for a histogram of lengths (index: length)."""
    made = Plan(histogram, capacity)
    if made.left[capacity]:
        made.open([capacity], int(made.left[capacity]))
    width = -(-capacity // classes)
    shapes = [p for p in patterns(classes, slots) if len(p) > 1]
    of_class = [[n for n in range(min(k * width, capacity), (k - 1) * width, -1)] for k in range(classes + 1)]
    target = np.array([sum(made.left[n] for n in of_class[k]) for k in range(1, classes + 1)], float)
    repeats = np.floor(fit(shapes, target) + 1e-6).astype(np.int64)
    for j in np.argsort(-repeats, kind="stable"):
        wanted = int(repeats[j])
        while wanted > 0:
            lengths: list[int] = []
            for k in sorted(shapes[j][1:], reverse=True):
                n = next((n for n in of_class[k] if made.left[n] > lengths.count(n)), None)
                if n is None:
                    break
                lengths.append(n)
            if len(lengths) < len(shapes[j]) - 1:
                break
            # Classes are rounded up: the smallest slot takes the longest piece that still fits.
            room = capacity - sum(lengths)
            n = next((n for n in range(room, (shapes[j][0] - 1) * width, -1) if made.left[n] > lengths.count(n)), None)
            if n is None:
                break
            lengths.append(n)
            count = min(wanted, *(int(made.left[n]) // lengths.count(n) for n in lengths))
            made.open(lengths, count)
            wanted -= count
    made.best_fit()
    return made


def pack(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces are written once. To the driver come the counts of at most `capacity` lengths; back
    goes the plan, whose size depends on `capacity` alone.
    """
    cut = stored(
        pieces(docs, tokenizer_path, id_column=id_column, text_column=text_column, capacity=capacity), "pieces"
    )
    counts = stored(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    rows = np.array(plan(histogram, capacity).rows, np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << 44) + rows[:, 1]

    ranked = cut.join(small(before, counts.count(), 24), ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("number")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(rows[at, 4])],
                [id_column, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = cut.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
