"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic transducers, composed, give the number of tokens without building any token:

* The boundary transducer reads character classes and emits where pieces begin (what the tokenizer's
  pattern calls a word, number, symbol run or blank run). It has 13 states. A text is cut into chunks;
  each chunk's map from entry state to exit state is computed for all states at once, the maps are
  composed by a parallel prefix scan, and a second pass emits from the entry states so found.
* The piece transducer reads the bytes of one piece. A state is what the rest of the piece can still
  depend on: the longest suffix that may grow into a token, and for each position in it the last
  token of the encoding up to there. Each transition is annotated with the change in the number of
  emitted tokens (it can be negative: a merge takes a token back). States and transitions are
  compiled from the vocabulary when first met and kept; pieces met before are looked up by hash.

Added tokens of the file (special strings) count one each wherever they occur in a text, as the
tokenizers library does by default. Character classes are those of that library.

Defined cases: null and empty texts have 0 bytes and 0 tokens. Repeated rows count each. Only the
named columns are read; other columns are dropped.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlprism.llm.common import mix

CHUNK = 256
SLICE_CHARS = 2 << 20
MOST_KNOWN = 1_500_000

# --- boundaries ----------------------------------------------------------------------------------

#: Character classes. x: one of s t m d.
CLASSES = ("x", "r", "v", "e", "l", "letter", "number", "space", "blank", "quote", "other", "end")
C = {name: i for i, name in enumerate(CLASSES)}
#: `open`: a piece begins with the next character. `quote`: a quote that began a piece; after it
#: 's 't 'm 'd 're 've 'll end at once. `space1`, `blank1`: a run of one blank; `...n`: longer runs.
STATES = ("open", "letter", "number", "other", "quote", "quote_r", "quote_v", "quote_l",
          "space1", "blank1", "spacen", "blankn")
S = {name: i for i, name in enumerate(STATES)}
NOW, BEFORE = 1, 2  # a piece begins at this character; at the one before
_LETTERS = ("x", "r", "v", "e", "l", "letter")


def _kind(c: str) -> str:
    return "letter" if c in _LETTERS else "blank" if c in ("space", "blank") else "other" if c == "quote" else c


def _step(state: str, c: str) -> tuple[str, int]:
    if c == "end":
        return "open", BEFORE if state in ("quote_r", "quote_v", "quote_l") else 0
    kind = _kind(c)
    fresh = {"letter": "letter", "number": "number", "other": "other"}.get(kind, c + "1")
    if c == "quote":
        fresh = "quote"
    if state in ("quote_r", "quote_v", "quote_l"):
        if c == {"quote_r": "e", "quote_v": "e", "quote_l": "l"}[state]:
            return "open", 0
        after, emitted = _step("letter", c)
        return after, emitted | BEFORE
    if state == "quote":
        if c == "x":
            return "open", 0
        if c in ("r", "v", "l"):
            return f"quote_{c}", 0
        return ("other", 0) if kind == "other" else (fresh, NOW)
    if state in ("space1", "blank1", "spacen", "blankn"):
        if kind == "blank":
            return c + "n", 0
        late = BEFORE if state.endswith("n") else 0
        if state.startswith("space"):  # the space joins what follows
            return ("other" if c == "quote" else fresh), late
        return fresh, late | NOW
    if state == kind:
        return state, 0
    return fresh, NOW


NEXT = np.zeros(len(STATES) * 16, np.uint8)
EMIT = np.zeros(len(STATES) * 16, np.uint8)
for _s in STATES:
    for _c in CLASSES:
        _after, _out = _step(_s, _c)
        NEXT[S[_s] * 16 + C[_c]], EMIT[S[_s] * 16 + C[_c]] = S[_after], _out


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """For rows of classes: the exit state of every entry state."""
    maps = np.tile(np.arange(len(STATES), dtype=np.uint8), (len(classes), 1))
    for k in range(classes.shape[1]):
        maps = NEXT[(maps << 4) | classes[:, k, None]]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row i becomes the composition of rows 0..i, in a logarithmic number of steps."""
    d = 1
    while d < len(maps):
        composed = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:d], composed])
        d *= 2
    return maps


def piece_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin, for texts that each end with the class `end`."""
    n = len(classes)
    rows = np.full(-(-n // chunk) * chunk, C["end"], np.uint8)
    rows[:n] = classes
    rows = rows.reshape(-1, chunk)
    state = np.zeros(len(rows), np.uint8)
    if len(rows) > 1:
        state[1:] = prefix_scan(chunk_maps(rows))[:-1, S["open"]]
    emitted = np.empty_like(rows)
    for k in range(chunk):
        at = (state << 4) | rows[:, k]
        emitted[:, k] = EMIT[at]
        state = NEXT[at]
    emitted = emitted.ravel()[:n]
    starts = (emitted & NOW).astype(bool)
    starts[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return starts


# --- tokens of a piece ---------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceTransducer:
    """The piece transducer of a vocabulary with ranked merges."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.tokens, self.merges = tokens, merges
        self.prefixes = {t[:i] for t in tokens for i in range(1, len(t) + 1)}
        self.bytes_of = {i: t for t, i in tokens.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.parts: list[tuple[bytes, tuple]] = [(b"", ((-1, 0),))]
        self.numbers = {self.parts[0]: 0}

    def encode(self, piece: bytes) -> list[int]:
        """Plain BPE of a short string: merge the pair of lowest rank, leftmost first."""
        ids = [self.tokens[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def follows(self, left: int, token: int) -> bool:
        """Whether the token stands as it is after `left` (-1: at the start of a piece)."""
        known = self.fits.get((left, token))
        if known is None:
            text = self.bytes_of[token] if left < 0 else self.bytes_of[left] + self.bytes_of[token]
            known = self.encode(text) == ([token] if left < 0 else [left, token])
            self.fits[left, token] = known
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, ends = self.parts[state]  # ends[j]: last token of the encoding up to j, and its count less the present one
        grown = suffix + bytes([byte])
        skip = 0
        while grown[skip:] not in self.prefixes:
            skip += 1
        change = None
        for j in range(skip, len(grown)):
            token = self.tokens.get(grown[j:])
            if token is not None and self.follows(ends[j][0], token):
                change = ends[j][1] + 1
                break
        if change is None:
            raise ValueError("the vocabulary is not closed under its merges")
        kept = tuple((t, n - change) for t, n in ends[skip:]) + ((token, 0),)
        parts = (grown[skip:], kept)
        number = self.numbers.get(parts)
        if number is None:
            number = self.numbers[parts] = len(self.parts)
            self.parts.append(parts)
            self.moves.append({})
        move = self.moves[state][byte] = (number, change)
        return move

    def count(self, piece: bytes) -> int:
        state = total = 0
        moves = self.moves
        for byte in piece:
            move = moves[state].get(byte)
            if move is None:
                move = self.compile(state, byte)
            state = move[0]
            total += move[1]
        if len(moves) > MOST_KNOWN:
            self.reset()
        return total


class Counter:
    """Counts tokens of texts for one tokenizer file. Kept for the life of a worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        vocabulary = file["model"]["vocab"]
        as_bytes = {w: bytes(letters[c] for c in w) for w in vocabulary}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.pieces = PieceTransducer({as_bytes[w]: i for w, i in vocabulary.items()}, merges)
        special = sorted((t["content"] for t in file.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.mark = os.path.commonprefix(special)  # what every added token begins with, maybe nothing
        self.classes = self._classes(Tokenizer.from_file(path).pre_tokenizer)
        self.value = mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)
        self.known: dict[int, int] = {}

    @staticmethod
    def _classes(splitter) -> np.ndarray:
        """A class for every code point: those of the library, tried where a current Unicode table
        says letter, number or blank (older tables know fewer)."""
        import regex

        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
        table = np.full(0x110000, C["other"], np.uint8)
        for name, beside, pattern in (("letter", "a", r"\p{L}"), ("number", "1", r"\p{N}"), ("blank", "\t", r"\s")):
            for run in regex.finditer(f"{pattern}+", every):
                for c in run.group():
                    if len(splitter.pre_tokenize_str(beside + c)) == 1:
                        table[ord(c)] = C[name]
        for c in "rvel":
            table[ord(c)] = C[c]
        for c in "stmd":
            table[ord(c)] = C["x"]
        table[ord(" ")], table[ord("'")] = C["space"], C["quote"]
        return table

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        result = np.zeros(len(texts), np.int64)
        parts, rows = texts, None
        if self.special and any(self.mark in t for t in texts):
            parts, rows = [], []
            for i, t in enumerate(texts):
                split = self.special.split(t)
                result[i] += len(split) - 1
                parts += split
                rows += [i] * len(split)
        first = 0
        while first < len(parts):
            last, chars = first, 0
            while last < len(parts) and (last == first or chars + len(parts[last]) < SLICE_CHARS):
                chars += len(parts[last]) + 1
                last += 1
            got = self._slice(parts[first:last])
            if rows is None:
                result[first:last] += got
            else:
                np.add.at(result, rows[first:last], got)
            first = last
        return result

    def _slice(self, texts: list[str]) -> np.ndarray:
        joined = "\n".join(texts) + "\n"
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        classes[ends] = C["end"]
        starts = piece_starts(classes)
        marks = starts.copy()
        marks[ends] = True
        at = np.flatnonzero(marks)
        lengths = np.diff(np.append(at, len(points)))
        place = np.arange(len(points), dtype=np.int64) - np.repeat(at, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        hashes = mix(np.add.reduceat(self.value[points] * powers[place], at) + lengths.astype(np.uint64))
        del place
        piece = starts[at]
        at, lengths = at[piece], lengths[piece]
        if not len(at):
            return np.zeros(len(texts), np.int64)
        distinct, where, back = np.unique(hashes[piece], return_index=True, return_inverse=True)
        keys = distinct.tolist()
        known = self.known
        found = list(map(known.get, keys))
        for i, n in enumerate(found):
            if n is None:
                begin = int(at[where[i]])
                found[i] = known[keys[i]] = self.pieces.count(joined[begin : begin + int(lengths[where[i]])].encode())
        if len(known) > MOST_KNOWN:
            known.clear()
        per_piece = np.array(found, np.int64)[back]
        return np.bincount(np.searchsorted(ends, at), weights=per_piece, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text",
                 limit: int = 512) -> DataFrame:
    """Per document: id, n_bytes, n_tokens (long), over_limit (more than `limit` tokens). One pass,
    no shuffle. `tokenizer_path` is a byte-level BPE file that every worker can open."""
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer_path)
        for batch in batches:
            n = tokens.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    kind = read.schema["id"].dataType.simpleString()
    counted = read.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
