"""Language ID of mixed-language texts: script ranges, word scores and Viterbi.

Training counts, per language and over all its training texts, the three-letter grams of its words
(lower case, word ends included, hashed to `BUCKETS`) and the scripts of its letters. The counts are
sums, so they are merged by a shuffle; the model is one row of `BUCKETS` numbers per language.

A text is labelled word by word. The script ranges narrow a word to the languages that write at least
`MIN_SHARE` of their letters in its script (a script of no learned language narrows nothing). Its
score in each of them is the smoothed log probability of its grams. Viterbi finds the labelling of the
whole text with the largest sum of scores less `SWITCH` per change of language; words without letters
have no say and take the label around them. Equal paths stay in their language, then take the first
by name. The language of a text is the one whose spans hold the most letters (ties: the first by
name), its score the share of the text's letters they hold.

Texts are worked on many at a time: grams of a slice of text at once, and Viterbi step by step over
all texts of a group, so a step costs one array operation for all of them.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if nothing
was learned. Null languages and null texts are not learned from; a null id counts as the empty string.
Very long texts are read whole, one at a time. Repeated rows each count in training and each get their
row; only the named columns are read. An empty table gives no rows. More than `MAX_LANGUAGES` distinct
languages raise an error, as then the column holds something else.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crawlprism.llm.common import SLICE_BYTES, hold_out, mix

BUCKETS = 1 << 15
SMOOTHING = 0.5
SWITCH = 12.0
MIN_SHARE = 0.01
MAX_LANGUAGES = 256
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
GROUP_BYTES = 8 << 20
GROUP_SCORES = 1 << 23
_NEVER = np.float32(-1e4)

#: Scripts by their ranges of code points, ends included.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF),
              (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Odia": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF)],
    "Khmer": [(0x1780, 0x17FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "Hiragana": [(0x3040, 0x309F)],
    "Katakana": [(0x30A0, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether a letter, whether a letter or mark, its lower case, its script (0: other)."""
    every = [chr(i) for i in range(0x110000)]
    letter = np.fromiter(map(str.isalpha, every), bool, len(every))
    part = letter | np.fromiter((unicodedata.category(c)[0] == "M" for c in every), bool, len(every))
    low = np.arange(len(every), dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        c = every[i].lower()
        if len(c) == 1:
            low[i] = ord(c)
    script = np.zeros(len(every), np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = number
    return letter, part, low, script


def _read(texts: list[str]):
    """The grams of texts, in order: per gram its bucket, word and script and whether its middle is a
    letter; and the number of words of each text."""
    letter, part, low, script = _characters()
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    word = np.cumsum(begins) - 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    sizes = np.diff(np.append(0, word[ends - 1] + 1))
    inside = part[codes]
    padded = np.zeros(len(codes) + 2, np.uint64)
    padded[1:-1] = np.where(inside, low[codes], 0)
    at = np.flatnonzero(inside)
    key = (padded[at] << np.uint64(42)) | (padded[at + 1] << np.uint64(21)) | padded[at + 2]
    bucket = (mix(key) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return bucket, word[at], script[codes[at]], letter[codes[at]], sizes


def _parts(texts: list[str], most: int) -> Iterator[list[str]]:
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield texts[first:]


@dataclass
class Model:
    """Log probabilities by (bucket, language), the languages each script allows, and the languages."""

    table: np.ndarray
    allowed: np.ndarray
    languages: list[str]


def gram_counts(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, slot, n): the grams of each language by bucket and, from slot `BUCKETS` on, its letters by
    script. Each task adds up its own rows first."""
    read = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")).dropna()
    slots = BUCKETS + len(SCRIPTS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            of_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of_lang.setdefault(lang, []).append(text)
            for lang, texts in of_lang.items():
                total = held.setdefault(lang, np.zeros(slots, np.int64))
                for some in _parts(texts, SLICE_BYTES):
                    bucket, _, script, letter, _ = _read(some)
                    total += np.bincount(bucket, minlength=slots)
                    total[BUCKETS:] += np.bincount(script[letter], minlength=len(SCRIPTS) + 1)
        for lang, total in held.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(total[some])], ["lang", "slot", "n"]
            )

    counted = read.mapInArrow(run, "lang string, slot int, n long")
    return counted.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, *, text_column: str = "text", lang_column: str = "lang") -> Model:
    """The model of all rows of `docs` that have a text and a language. Its size is bounded by
    `MAX_LANGUAGES` times `BUCKETS`, whatever the input, so it is built in the driver and broadcast."""
    known = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"))
    languages = sorted(r.lang for r in known.distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in {lang_column}")
    counts = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(languages)))
    if languages:
        got = gram_counts(docs, text_column=text_column, lang_column=lang_column).toArrow()
        number = {lang: i for i, lang in enumerate(languages)}
        column = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
        counts[got["slot"].to_numpy(), column] = got["n"].to_numpy()
    return model_of(counts, languages)


def model_of(counts: np.ndarray, languages: list[str]) -> Model:
    grams, letters = counts[:BUCKETS], counts[BUCKETS:]
    table = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
    allowed = (letters > 0) & (letters >= MIN_SHARE * letters.sum(axis=0))
    return Model(table, allowed | ~allowed.any(axis=1, keepdims=True), languages)


def word_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (word, language), at most 0 for the best; letters of each word; words of each text."""
    bucket, word, script, letter, sizes = _read(texts)
    scores = np.zeros((int(sizes.sum()), len(model.languages)), np.float32)
    letters = np.bincount(word, letter, len(scores)).astype(np.int64)
    if not len(bucket):
        return scores, letters, sizes
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    own = word[first]
    made = np.add.reduceat(model.table[bucket], first, axis=0)
    main = script[first]
    mixed = np.minimum.reduceat(script, first) != np.maximum.reduceat(script, first)
    if mixed.any():  # the script of most characters, the first listed of equal ones
        some = np.flatnonzero(np.repeat(mixed, np.diff(np.append(first, len(word)))))
        kinds = len(SCRIPTS) + 1
        pair, n = np.unique(word[some] * kinds + script[some], return_counts=True)
        order = np.lexsort((pair, -n, pair // kinds))
        top = pair[order][np.append(True, np.diff(pair[order] // kinds) > 0)]
        main[np.searchsorted(own, top // kinds)] = top % kinds
    made = np.where(model.allowed[main], made, _NEVER)
    scores[own] = made - made.max(axis=1, keepdims=True)
    return scores, letters, sizes


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of every word of texts laid end to end, by the best path of each text."""
    label = np.zeros(len(scores), np.int16)
    if scores.shape[1] < 2 or not len(scores):
        return label
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # texts with more words than t
    state = np.zeros((len(sizes), scores.shape[1]), np.float32)
    moved = np.zeros(scores.shape, bool)  # whether the best way to a label comes from another one
    before = np.zeros(len(scores), np.int16)
    for t, n in enumerate(alive.tolist()):
        at, held = begins[:n] + t, state[:n]
        if t:
            moved[at] = held < -switch
            before[at] = held.argmax(axis=1)
            held = np.maximum(held, np.float32(-switch))
        held = held + scores[at]
        state[:n] = held - held.max(axis=1, keepdims=True)
    now = state.argmax(axis=1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        n = int(alive[t])
        at, own = begins[:n] + t, now[:n]
        label[at] = own
        now[:n] = np.where(moved[at, own], before[at], own)
    return label


def label_spans(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, lang_pred, score and `spans`, an array of (start, n_words, lang) over its words."""
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    element = pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())])

    def group(texts: list[str]) -> list[pa.Array]:
        model = sent.value
        width = len(model.languages)
        names = pa.array([*model.languages, UNKNOWN], pa.string())
        if not width:
            spans = pa.array([[] for _ in texts], pa.list_(element))
            return [names.take(pa.array([0] * len(texts))), pa.array([0.0] * len(texts)), spans]
        made = [word_scores(some, model) for some in _parts(texts, max(1 << 16, SLICE_BYTES * 4 // (4 + width)))]
        scores, letters, sizes = (np.concatenate(x) for x in zip(*made))
        label = viterbi(scores, sizes)
        text = np.repeat(np.arange(len(texts)), sizes)
        held = np.bincount(text * width + label, letters, len(texts) * width).reshape(-1, width)
        total = held.sum(axis=1)
        best = np.where(total > 0, held.argmax(axis=1), width)
        share = np.where(total > 0, held.max(axis=1) / np.maximum(total, 1), 0.0)
        first = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (text[1:] != text[:-1]))[: len(label)])
        n = np.diff(np.append(first, len(label)))
        start = first - (np.cumsum(sizes) - sizes)[text[first]]
        ends = np.append(0, np.cumsum(np.bincount(text[first], minlength=len(texts)))).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(start), pa.array(n), names.take(pa.array(label[first]))], fields=list(element))
        return [names.take(pa.array(best)), pa.array(share), pa.ListArray.from_arrays(pa.array(ends), values)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = min(GROUP_BYTES, GROUP_SCORES // max(1, len(sent.value.languages)) * 4)
        for batch in batches:
            first = 0
            for texts in _parts(batch.column(1).to_pylist(), most):
                ids = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([ids, *group(texts)], ["id", "lang_pred", "score", "spans"])
                first += len(texts)

    kind = read.schema["id"].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double, spans array<struct<start:long,n_words:long,lang:string>>"
    return read.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def learnable(docs: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """The rows that are not held out."""
    return docs.where(hold_out(F.col(id_column), FOLDS) != HELD_OUT)


def identify(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Train on the rows that are not held out and label all."""
    model = train(learnable(docs, id_column=id_column), text_column=text_column, lang_column=lang_column)
    spans = label_spans(docs, model, id_column=id_column, text_column=text_column)
    held = (hold_out(F.col(id_column), FOLDS) == HELD_OUT).alias("held_out")
    return spans.select(id_column, held, "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
