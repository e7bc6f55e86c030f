"""What the corpus operators share: the words of a text, the shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but these ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A table may be sent whole to every executor only while its measured size stays below this.
BROADCAST_BYTES = 64 << 20

#: Text bytes that the array code handles at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: `spark.checkpoint.dir`.

    Where it is unset, a plain local session (threads of one process) gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="crawlprism-llm-")
    return _local_folder[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors,
    and gives later joins a measured size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast for a frame of `rows` counted rows if that is within the bound; beyond it
    the join shuffles both sides and adaptive execution splits skewed partitions."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; `lower` is the quick way where a text is all ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def words(text: Column) -> Column:
    """The words of a text; of null, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def hold_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds. A null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


# --- texts as arrays -----------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_VALUE = np.random.default_rng(20260101).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15 | 3)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of a string column, in slices of about `most` bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE, fold: np.ndarray = _LOWER,
                prefixes: tuple[int, ...] = ()):
    """(row of each word, 64-bit hash of each word) for texts laid end to end, in text order. With
    `prefixes`, after them the rows and hashes of the words' first bytes, of words longer than that."""
    nothing = np.empty(0, np.int64), np.empty(0, np.uint64)
    if not len(data):
        return nothing
    folded = fold[data]
    word = ~blank[folded]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | begins[1:-1]
    at = np.flatnonzero(starts)
    if not len(at):
        return nothing
    lengths = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data)) - np.repeat(at, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _POWER, np.uint64))
    values = np.where(word, _BYTE_VALUE[folded], np.uint64(0))[at[0] :]
    rows = np.searchsorted(offsets, at, "right") - 1
    hashes = mix(np.add.reduceat(values * powers[place], at - at[0]))
    if not prefixes:
        return rows, hashes
    sizes = np.add.reduceat(word[at[0] :].astype(np.int64), at - at[0])
    all_rows, all_hashes = [rows], [hashes]
    for k in prefixes:
        long = sizes > k
        some = at[long]
        part = sum((_BYTE_VALUE[folded[some + j]] * powers[j] for j in range(k)), np.zeros(len(some), np.uint64))
        all_rows.append(rows[long])
        all_hashes.append(mix(part + np.uint64(k)))
    return np.concatenate(all_rows), np.concatenate(all_hashes)
