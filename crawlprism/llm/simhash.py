"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has 64 bits: words (A-Z lower-cased), shingles of three with repeats, XXH64 of each
(UTF-8, seed 42), and every bit that is set in over half of the hashes. Two fingerprints link at
`MAX_BITS` = 3 or fewer differing bits, so of their eight positional bytes at least five agree.

Index. A posting of one byte at one position holds a 256th of all fingerprints, and its pairs grow
with the square of the table. Five agreeing positions out of eight always put three into one half
(positions 0-3 or 4-7), so the index posts the eight triples of positions instead: every pair with
five shared bytes still meets, in postings of 24 bits. Within a posting the shared positional bytes
of each pair are tallied, pairs with at least five are kept, and those are verified bit by bit. A
posting of more than `MOST` fingerprints is taken apart exactly: each of its fingerprints is posted
under the triple with every two further positions (a pair with five shared bytes has such a pair of
positions), which leaves 24 free bits; very large ones of these look up all neighbours of up to three
bits instead of comparing pairs. A posting yields a spanning forest of its links, never all pairs.

Equal fingerprints are one point. Points and links become components by alternating star steps, each
written to the shared folder.

Defined cases: null and empty texts, and texts of blanks, have fingerprint 0, which links like any
other. Texts of fewer words than a shingle are one shingle. A null id never is the smallest of its
component unless all are null. Repeated rows are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from crawlprism.llm.common import mix, small, stored

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BYTES = 8
NEEDED = BYTES - MAX_BITS  # each differing bit spoils one byte at most
MOST = 2048
_AGAIN, _FULL = 0xC2B2AE3D27D4EB4F, (1 << 64) - 1
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


# --- fingerprints ----------------------------------------------------------------------------------


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of a text, in order."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    if n == 1:
        made = xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: n - 1] + 1).tolist()]
        made = b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())])
    return np.frombuffer(made, ">u8").astype(np.uint64)


def _majority(hashes: np.ndarray) -> bytes:
    """Eight bytes, highest bit first: the bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 255 * 64):
        some = hashes[first : first + 255 * 64]
        bits = np.unpackbits(some.astype(">u8").view(np.uint8)).view(np.uint64).reshape(-1, 8)
        for i in range(0, len(bits), 255):  # 255 rows add up in bytes without a carry
            ones += bits[i : i + 255].sum(axis=0).view(np.uint8)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The fingerprint of a text as eight bytes, highest bit first."""
    return _majority(_shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """id, th (hash of the text) and fp (the fingerprint as a long) of every document."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("th"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = b"".join([fingerprint(t, shingle) for t in batch.column(2).to_pylist()])
            fp = np.frombuffer(made, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["id", "th", "fp"])

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, th long, fp long")


# --- links -------------------------------------------------------------------------------------------


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 56 - 8 * position).bitwiseAND(F.lit(255))


def _key(number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def _posted() -> Column:
    return F.explode(F.array(*[_key(i, t) for i, t in enumerate(TRIPLES)])).alias("key")


def _reposted() -> Column:
    """For a posting under triple number key >> 24: the keys of five positions that contain the triple."""
    fives = {five: i for i, five in enumerate(combinations(range(BYTES), NEEDED))}
    choices = [
        F.array(*[_key(i, five) for five, i in fives.items() if set(t) <= set(five)]) for t in TRIPLES
    ]
    return F.explode(F.element_at(F.array(*choices), (F.shiftright("key", 24) + 1).cast("int"))).alias("key")


def linked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints (uint64), as two arrays."""
    m = len(values)
    parent = np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def join(a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(np.stack([parent[a], parent[b]], axis=1), axis=0)
        for x, y in pairs[pairs[:, 0] != pairs[:, 1]].tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    if m <= 4 * MOST:
        for first in range(0, m, 256):
            different = values[first : first + 256, None] ^ values[None, :]
            spoiled = different | (different >> np.uint64(4))
            spoiled |= spoiled >> np.uint64(2)
            spoiled |= spoiled >> np.uint64(1)
            shared = BYTES - np.bitwise_count(spoiled & np.uint64(0x0101010101010101))  # the tally
            a, b = np.nonzero((shared >= NEEDED) & np.tri(*shared.shape, first - 1, dtype=bool))
            true = np.bitwise_count(different[a, b]) <= MAX_BITS
            join(a[true] + first, b[true])
    else:
        values = np.sort(values)
        free = int(np.bitwise_or.reduce(values ^ values[0]))
        bits = [1 << i for i in range(64) if free >> i & 1]
        for n in range(1, MAX_BITS + 1):
            for some in combinations(bits, n):
                other = values ^ np.uint64(sum(some))
                at = np.minimum(np.searchsorted(values, other), m - 1)
                a = np.flatnonzero(values[at] == other)
                join(a, at[a])
    top = np.array([root(i) for i in range(m)]) if m > 1 else parent
    child = np.flatnonzero(top != np.arange(m))
    return values[child], values[top[child]]


def near_links(points: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose components are those of all links."""
    posts = points.select(_posted(), "fp")
    sizes = stored(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "postings")
    met = posts.join(sizes, "key")
    usual = met.where(F.col("n") <= MOST).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    large = met.where(F.col("n") > MOST).select(_reposted(), "fp").distinct()
    fine = large.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0)
            values = fps.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.cumsum(fps.value_lengths().to_numpy(zero_copy_only=False))
            parts = [linked(values[e - n : e]) for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())]
            a, b = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.uint64)]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return usual.select("fps").union(fine.select("fps")).mapInArrow(run, "a long, b long").distinct()


# --- components --------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; the root is the smallest node of its component.

    Large-star and small-star steps alternate until nothing changes. Each is a map-side minimum per
    node and a join on the node; the minima are written first, so both sides of the join are shuffled or
    measured and adaptive execution splits the partitions of a hub. Neighbours are never gathered. Each
    step is written to the shared folder.
    """

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    edges = stored(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large_star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small_star")
        after = mark(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """id, th, fp and component_id of every document."""
    prints = stored(fingerprints(docs, id_column=id_column, text_column=text_column, shingle=shingle), "fingerprints")
    points = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "points")
    roots = stored(components(stored(near_links(points), "links")), "roots")
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_point = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of_point, "fp")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                    shingle: int = SHINGLE) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits) and component_id, the smallest id of its component."""
    return _grouped(docs, id_column, text_column, shingle).select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- keeping one of each group -------------------------------------------------------------------------

STAGE_SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_BITS = 68, 16
CHECK_BITS = 96
PRINTS = BANDS * BAND_BITS // 64 + 2  # 17 fingerprints make the bands, two are for the check
FEW = 20
BLOCK = 1024
CHUNK = 256
TILE_COLUMNS = 4096


def differing(similarity: float) -> float:
    """The share of bits expected to differ at a Jaccard similarity of two sets of one size; of sets
    of two sizes fewer differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def check_limit(similarity: float) -> int:
    """The most differing check bits of a proposed pair: four standard deviations above the mean."""
    p = differing(similarity)
    return int(np.ceil(CHECK_BITS * p + 4 * np.sqrt(CHECK_BITS * p * (1 - p))))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    return np.unique(_shingle_hashes(text, shingle))


def _majorities(words: np.ndarray) -> np.ndarray:
    """Per row: the bits set in over half of its words, counted in bit slices by full adders."""
    n, level, sums = words.shape[1], words, []
    if not n:
        return np.zeros(len(words), np.uint64)
    while True:
        carries = []
        while level.shape[1] > 1:
            k = level.shape[1] // 3
            a, b = (level[:, :k], level[:, k : 2 * k]) if k else (level[:, :1], level[:, 1:])
            one = a ^ b
            if k:
                c = level[:, 2 * k : 3 * k]
                carries.append((a & b) | (c & one))
                level = np.concatenate([one ^ c, level[:, 3 * k :]], axis=1)
            else:
                carries.append(a & b)
                level = one
        sums.append(level[:, 0])
        if not carries:
            break
        level = np.concatenate(carries, axis=1)
    more, same = np.zeros(len(words), np.uint64), np.full(len(words), _FULL, np.uint64)
    for i in reversed(range(len(sums))):
        if n // 2 >> i & 1:
            same &= sums[i]
        else:
            more |= same & sums[i]
            same &= ~sums[i]
    return more


def signature(hashes: np.ndarray, prints: int = PRINTS) -> np.ndarray:
    """Several fingerprints of one set of hashes. Each but the first hashes the hashes again."""
    some = max(1, (1 << 20) // max(1, len(hashes)))
    made = []
    for first in range(0, prints, some):
        salts = np.array([i * _AGAIN & _FULL for i in range(first, min(prints, first + some))], np.uint64)
        words = mix(hashes[None, :] + salts[:, None])
        if not first:
            words[0] = hashes
        made.append(_majorities(words))
    return np.concatenate(made)


def signatures(docs: DataFrame, *, id_column: str, text_column: str, shingle: int, similarity: float) -> DataFrame:
    """id, th (hash of the text), point (hash of the set of shingles), sig and, of sets of at most
    `FEW`, those smallest hashes of which two sets of that similarity share one."""
    from xxhash import xxh64_intdigest

    text = F.coalesce(F.col(text_column), F.lit(""))
    read = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("th"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, made, few = [], [], []
            for t in batch.column(2):
                hashes = shingle_set(t.as_py(), shingle)
                n = len(hashes)
                points.append(xxh64_intdigest(hashes.tobytes(), SEED))
                made.append(signature(hashes).tobytes())
                few.append(hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1].tobytes() if 0 < n <= FEW else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(points, np.uint64).view(np.int64)),
                 pa.array(made, pa.binary()), pa.array(few, pa.binary())],
                ["id", "th", "point", "sig", "few"],
            )

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(run, f"id {kind}, th long, point long, sig binary, few binary")


def _postings(points: np.ndarray, sigs: np.ndarray, few: list[bytes]) -> np.ndarray:
    """Rows of six uint32: key, point (two), check bits (three). A key is a band and its bits, or 31
    bits of a hash below a leading one."""
    n = len(points)
    bits = np.unpackbits(sigs[:, : BANDS * BAND_BITS // 64].astype(">u8").view(np.uint8).reshape(n, -1), axis=1)
    keys = bits.reshape(n, BANDS, BAND_BITS).astype(np.uint32) @ (np.uint32(1) << np.arange(BAND_BITS, dtype=np.uint32))
    keys += np.arange(BANDS, dtype=np.uint32) << np.uint32(BAND_BITS)
    own = np.concatenate([points.reshape(-1, 1).view(np.uint32), sigs[:, -2:].copy().view(np.uint32)[:, : CHECK_BITS // 32]], axis=1)
    short = np.frombuffer(b"".join(few), np.uint64)
    rows = np.concatenate([np.repeat(np.arange(n), BANDS), np.repeat(np.arange(n), [len(x) // 8 for x in few])])
    every = np.concatenate([keys.ravel(), (short >> np.uint64(33)).astype(np.uint32) | np.uint32(1 << 31)])
    return np.concatenate([every[:, None], own[rows]], axis=1)


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def met_members(posted: np.ndarray, loose: int, tight: int, block: int) -> tuple[np.ndarray, ...]:
    """(key, point, other): the members of each key that differ from another member in at most `loose`
    check bits, each with the first member before it at `tight` bits or less (itself if there is none).

    Of a key with more than `block` members all are given; they are compared in blocks, for `other` only.
    """
    posted = posted[np.lexsort((posted[:, 1], posted[:, 2], posted[:, 0]))]
    keys, check = posted[:, 0], posted[:, 3:]
    points = posted[:, 1:3].copy().view(np.uint64).ravel()
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    sizes = np.diff(np.append(starts, len(keys)))
    run = np.repeat(np.arange(len(starts)), sizes)
    wide = (sizes > block)[run]
    pieces = (np.arange(len(keys)) - np.repeat(starts, sizes)) // block + (np.cumsum(-(-sizes // block)) - -(-sizes // block))[run]
    near = wide.copy()
    other = np.arange(len(keys))
    alive = np.flatnonzero((sizes > 1)[run])
    for d in range(1, block):
        alive = alive[alive + d < len(keys)]
        alive = alive[pieces[alive + d] == pieces[alive]]
        if not len(alive):
            break
        bits = _differences(check[alive], check[alive + d])
        some = alive[bits <= loose]
        near[some] = near[some + d] = True
        close = alive[bits <= tight]
        other[close + d] = np.minimum(other[close + d], close)
    at = np.flatnonzero(near)
    return keys[at].astype(np.int64), points[at].view(np.int64), points[other[at]].view(np.int64)


def proposed(points: DataFrame, *, loose: int, tight: int, block: int) -> DataFrame:
    """(key, n, point, other) of what `met_members` finds, n its members of the key. Postings travel packed, many to a row, in slots
    of keys; a task holds one slot at a time and there are more slots the more points there are."""
    slots = 1 << max(8, int(points.count() * BANDS >> 16).bit_length())

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, PRINTS)
            made = _postings(batch.column(0).to_numpy().view(np.uint64), sigs, batch.column(2).to_pylist())
            slot = (mix(made[:, 0].astype(np.uint64)) % np.uint64(slots)).astype(np.int32)
            order = np.argsort(slot, kind="stable")
            made, slot = made[order], slot[order]
            at = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            rows = [made[s:e].tobytes() for s, e in zip(at.tolist(), [*at[1:].tolist(), len(made)])]
            yield pa.RecordBatch.from_arrays([pa.array(slot[at]), pa.array(rows, pa.binary())], ["slot", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, slot = [], None

        def done() -> pa.RecordBatch:
            keys, *made = met_members(np.frombuffer(b"".join(held), np.uint32).reshape(-1, 6), loose, tight, block)
            _, at, sizes = np.unique(keys, return_inverse=True, return_counts=True)  # a key is whole in its slot
            return pa.RecordBatch.from_arrays([*map(pa.array, (keys, sizes[at], *made))], ["key", "n", "point", "other"])

        for batch in batches:
            for of, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and of != slot:
                    yield done()
                    held = []
                slot = of
                held.append(data)
        if held:
            yield done()

    posts = points.select("point", "sig", "few").mapInArrow(post, "slot int, data binary")
    return posts.repartition("slot").sortWithinPartitions("slot").mapInArrow(meet, "key long, n long, point long, other long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    first, second = (sets.select(F.col("point").alias(c), F.col("set").alias(f"set_{c}")) for c in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two of some sets share, by products of 0/1 matrices over a part of the
    shingles at a time; shingles of one set only are left out."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    every = np.concatenate([*sets, np.empty(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.append(True, every[1:] != every[:-1])[: len(every)]
    column = np.cumsum(new) - 1
    twice = np.bincount(column)[column] > 1 if len(column) else new
    owner, column = owner[twice], column[twice]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])[: len(column)]) - 1
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, TILE_COLUMNS):
        begin, end = np.searchsorted(column, [first, first + TILE_COLUMNS])
        part = np.zeros((len(sets), TILE_COLUMNS), np.float32)
        part[owner[begin:end], column[begin:end] - first] = 1
        total += part @ part.T
    return total.astype(np.int64)


def tile_links(points: list[int], groups: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links among the members of a tile that join its groups as far as exact similarity does: a
    spanning forest over the groups, not all pairs."""
    shared = shared_counts(sets)
    sizes = np.array([len(x) for x in sets])
    near = shared >= similarity * (sizes[:, None] + sizes[None, :] - shared)
    group = np.array(groups)
    a, b = np.nonzero(np.tril(near & (group[:, None] != group[None, :]), -1))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(groups[i]), root(groups[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((points[i], points[j]))
    return found


def _own_tiles(members: DataFrame, chunk: int, star: bool) -> DataFrame:
    """(key, tile, point, group): each key's members cut into chunks by hash; every chunk by itself, or
    with `star` the first chunk with every other."""
    parts = F.ceil(F.col("n") / chunk).cast("int")
    of = F.pmod(F.xxhash64("point"), parts).cast("int")
    if star:
        of = F.explode(F.when(of == 0, F.sequence(F.lit(1), F.greatest(F.lit(1), parts - 1))).otherwise(F.array(of)))
    return members.select("key", of.alias("tile"), "point", "group").withColumn("tile", F.col("tile").cast("string"))


def _outer_tiles(members: DataFrame, chunk: int) -> DataFrame:
    """(key, tile, point, group) of members whose key is a group: every chunk of those outside that group
    with every chunk of those inside, and with every other chunk of those outside."""
    inside = F.col("group") == F.col("key")
    sizes = members.groupBy("key").agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))
    split = members.join(sizes, "key")
    n_in, n_out = (F.greatest(F.lit(1), F.ceil(F.col(c) / chunk).cast("int")) for c in ("n_in", "n_out"))
    own = F.pmod(F.xxhash64("point"), F.when(inside, n_in).otherwise(n_out)).cast("int")
    name = lambda i, j: F.concat_ws(",", i, j)
    # Tile i, j is the outer chunk i with the inner chunk j, of which there is one at least, and so the outer
    # chunk with itself; i, -1 - j are two outer chunks, i < j.
    with_inside = F.transform(F.sequence(F.lit(0), F.when(inside, n_out).otherwise(n_in) - 1),
                              lambda k: F.when(inside, name(k, own)).otherwise(name(own, k)))
    with_outside = F.when(inside, F.array().cast("array<string>")).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), n_out - 1), lambda k: k != own), lambda k: name(F.least(own, k), -1 - F.greatest(own, k)))
    )
    return split.select("key", F.explode(F.concat(with_inside, with_outside)).alias("tile"), "point", "group")


def _compared(tiles: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links that tiles give. A tile of one group needs no work."""
    tiles = stored(tiles, "tiles")
    several = tiles.groupBy("key", "tile").agg(F.min("group").alias("l"), F.max("group").alias("h")).where("l <> h").select("key", "tile")

    def compare(group: pa.Table) -> pa.Table:
        some = [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
        found = tile_links(group["point"].to_pylist(), group["group"].to_pylist(), some, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    work = tiles.join(several, ["key", "tile"]).join(sets, "point").select("key", "tile", "point", "group", "set")
    return stored(work.groupBy("key", "tile").applyInArrow(compare, "a long, b long"), "compared")


def packed_members(met: DataFrame) -> DataFrame:
    """One row a member: point, `keys` (all its keys) and `own`, those that are some member's largest one,
    with their sizes. A member has a key for each band and few more, so rows stay small, and what is
    worked out a member joins once a member instead of once a key."""
    picked = met.groupBy("point").agg(F.max(F.struct("n", "key")).alias("top")).select("top.key").distinct()
    own = met.join(stored(picked, "picked"), "key").groupBy("point").agg(F.collect_list(F.struct("key", "n")).alias("own"))
    return met.groupBy("point").agg(F.collect_list("key").alias("keys")).join(own, "point")


def linked_in_tiles(members: DataFrame, sets: DataFrame, stars: DataFrame, similarity: float, chunk: int) -> list[DataFrame]:
    """Links (a, b) that join what the `packed_members` of each key are joined by, beyond the links `stars`.

    Members are compared in tiles of at most two chunks, exactly and inside one task each; a tile whose
    members share a group needs no work, and groups that link become one. First each member's largest key:
    its chunks by themselves, then the first chunk with the others. That leaves large groups and some
    members outside them. Then every key stands only for the groups in it: all groups that meet a larger
    one in any key are compared with that one, member by member, once, however many keys they share.
    The rows of joins are members and their places in tiles, never pairs.
    """
    links = [stars]
    points = members.select("point")

    def grouped() -> DataFrame:
        roots = components(reduce(DataFrame.union, links)).withColumnRenamed("node", "point")
        return stored(points.join(roots, "point", "left").select("point", F.coalesce("root", "point").alias("group")), "groups")

    groups = grouped()
    for star in (False, True):
        now = members.select("point", "own").join(groups, "point").select("point", "group", F.inline("own"))
        made = _compared(_own_tiles(now.where(F.col("n") > chunk) if star else now, chunk, star), sets, similarity)
        if not made.isEmpty():
            links.append(made)
            groups = grouped()
    met = members.select("point", "keys").join(groups, "point").select(F.explode("keys").alias("key"), "group")
    met = stored(met.distinct(), "met_groups")
    size = groups.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    main = met.join(size, "group").groupBy("key").agg(F.max(F.struct("size", "group")).alias("top"), F.count(F.lit(1)).alias("n"))
    others = met.join(main.where("n > 1").select("key", F.col("top.group").alias("main")), "key").select("main", "group").distinct()
    outer = stored(others.join(groups, "group").select(F.col("main").alias("key"), "point", "group"), "outer")
    links.append(_compared(_outer_tiles(outer, chunk), sets, similarity))
    return links


def similar_links(docs: DataFrame, points: DataFrame, *, id_column: str, text_column: str, shingle: int,
                  similarity: float, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Pairs (a, b) of points of that Jaccard similarity whose components are those of all such pairs
    that the index proposes.

    Close members are gathered into groups first and each is verified against the smallest of its
    group, so most dense groups need one comparison per member. What is still apart after that is compared
    in tiles.
    """
    loose, tight = check_limit(similarity), round(CHECK_BITS * differing((1 + similarity) / 2))
    met = stored(proposed(points, loose=loose, tight=tight, block=block), "met")
    members = stored(packed_members(met), "members")
    need = members.select("point")
    wanted = stored(
        points.join(need, "point").select(F.struct(F.col("least.id").alias("id"), F.col("least.th").alias("th"), "point").alias("__want")),
        "wanted",
    )
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.col(text_column).alias("text"))
    wanted_texts = texts.join(
        small(wanted, wanted.count(), 64), F.col("id").eqNullSafe(F.col("__want.id")) & (F.col("th") == F.col("__want.th"))
    ).select(F.col("__want.point").alias("point"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["point", "set"])

    sets = stored(wanted_texts.mapInArrow(run, "point long, set binary").dropDuplicates(["point"]), "sets")
    close = met.where("point <> other").select(F.col("point").alias("a"), F.col("other").alias("b")).distinct()
    roots = components(close).where("node <> root")
    stars = stored(verified(roots.select(F.col("node").alias("a"), F.col("root").alias("b")), sets, similarity), "stars")
    return reduce(DataFrame.union, linked_in_tiles(members, sets, stars, similarity, chunk))


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shingle: int = STAGE_SHINGLE,
             similarity: float = SIMILARITY, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The documents, one of each group of near duplicates: that of the smallest id (then text hash).

    Near duplicates are linked where their distinct shingles have that Jaccard similarity, computed
    exactly. The fingerprints only propose: 68 bands of 16 bits, of which two sets of similarity 0.8
    share one with probability 0.994, then a check of 96 more bits with a limit four deviations above
    their mean. Sets of at most `FEW` shingles also meet in their smallest hashes, as bits of small
    sets differ more. Texts of equal sets are one point.
    """
    made = stored(
        signatures(docs, id_column=id_column, text_column=text_column, shingle=shingle, similarity=similarity), "signatures"
    )
    place = F.struct("id", "th")
    points = stored(
        made.groupBy("point").agg(F.min(place).alias("least"), F.min("sig").alias("sig"), F.min("few").alias("few")), "points"
    )
    links = stored(
        similar_links(docs, points, id_column=id_column, text_column=text_column, shingle=shingle, similarity=similarity, block=block, chunk=chunk),
        "links",
    )
    roots = components(links)
    rooted = points.join(roots, points["point"] == roots["node"], "left").select("least", F.coalesce("root", "point").alias("root"))
    kept = stored(rooted.groupBy("root").agg(F.min("least").alias("__kept")).select("__kept"), "kept")
    one = docs.join(
        kept.hint("merge"),
        docs[id_column].eqNullSafe(F.col("__kept.id")) & (F.xxhash64(docs[text_column]).eqNullSafe(F.col("__kept.th"))),
        "left_semi",
    )
    # Rows equal in id and text are the same to the join; only where there are any do they cost a pass.
    repeats = made.groupBy("id", "th").count().where("count > 1").limit(1).count()
    return one.dropDuplicates([id_column, text_column]) if repeats else one
