"""The corpus operators against brute force, on awkward inputs and on the test tables."""

import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from crawlprism.llm import (  # noqa: E402
    decontaminate, language, lm_scoring, line_dedup, packing, periodic, pii, quality, simhash, token_counts, toxicity, warc,
)

sys.path.insert(0, str(Path(entry.__file__).parent / "tools"))
from check import TABLES, rows_of  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "doc_id long, text string, id string, th long, fp string, key int, n_removed string, source string, n int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}x{seed % 7}" for _ in range(n))


def lines(*parts: str) -> str:
    return "\n".join(parts)


SHARED = lines(prose(901, 12), prose(902, 14), prose(903, 13))
LONG = "\n".join(prose(1000 + i, 40, 5000) for i in range(600))
TEXTS = [
    None, "", " \n\t ", "one", "One TWO three", prose(1, 120), prose(1, 120), prose(1, 119) + " changed",
    lines(prose(2, 10), SHARED, prose(3, 10)), lines(SHARED, prose(4, 10)), lines("", prose(5, 9), "", " ", SHARED, ""),
    lines(prose(6, 8), *["again and again"] * 7), LONG, LONG + "\nlast", "É" * 30 + " naïve Ünïcode 　 wide",
    "a@b.example, +1 (555) 010-9999, 10.0.0.1 and 4111 1111 1111 1111 at https://x.example/a?b=c.",
    "x" * 200_000, "1" * 50_000 + "@" * 1000, prose(7, 60) + " " + prose(8, 30), prose(9, 25) + " " + prose(8, 30),
    "<|endoftext|>a<|endoftext|>", "it's we're\n's  '  you'll", " " * 3000 + "z", lines(*[prose(10, 9)] * 4),
]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", f"host{i % 3}" if i % 5 else None, None) for i, t in enumerate(TEXTS)] + [(None, prose(11, 30), None, None, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """The same documents twice, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], "a", 1, "b", 2, "c", r[3], 3) for r in rows] * 2, ODD)


def collected(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = [(1, prose(8, 30)), (2, prose(8, 30)), (3, "one"), (4, None), (5, ""), (6, prose(77, 20)), (7, "one two three")]


# --- every operator: empty tables, repeated rows, clashing columns --------------------------------------------

RUNS = {
    "line_dedup": lambda d, spark: line_dedup.dedup_lines(d),
    "lm": lambda d, spark: lm_scoring.score_texts(d),
    "lm_join": lambda d, spark: lm_scoring.score_texts(d, most_model_bytes=0),
    "decontaminate": lambda d, spark: decontaminate.contaminated_pairs(d, spark.createDataFrame(ITEMS, "item_id int, text string")),
    "clean": lambda d, spark: decontaminate.remove_contaminated(d, spark.createDataFrame(ITEMS, "item_id int, text string")),
    "simhash": lambda d, spark: simhash.near_duplicates(d),
    "keep_one": lambda d, spark: simhash.keep_one(d),
    "quality": lambda d, spark: quality.judge(d),
    "keep_good": lambda d, spark: quality.keep_good(d, max_host_rate=1.0),
    "tokens": lambda d, spark: token_counts.count_tokens(d, tokenizer()),
    "pack": lambda d, spark: packing.pack(d, tokenizer()),
    "pii": lambda d, spark: pii.digest(pii.find_personal_data(d)),
    "redact": lambda d, spark: pii.redact(d),
    "periodic": lambda d, spark: periodic.digest(periodic.find_runs(periodic.planted(d))),
    "language": lambda d, spark: language.identify(d, lang_column="source"),
    "warc": lambda d, spark: warc.derivatives(warc.responses(d, id_column="doc_id", url_column="source", html_column="text")),
}


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, none, name):
    assert RUNS[name](none, spark).collect() == []


@pytest.mark.parametrize("name", [n for n in RUNS if n not in ("lm", "lm_join", "pack", "language")])
def test_repeated_rows_and_clashing_columns(spark, docs, odd, name):
    """Every row comes back as often as it went in (kept once where one of each group stays)."""
    once, twice = RUNS[name](docs, spark), RUNS[name](odd, spark)
    shared = [c for c in once.columns if c in twice.columns and c not in ("host_rate", "kept", "n_removed", "source")]
    single, double = collected(once.select(*shared)), collected(twice.select(*shared))
    assert set(single) == set(double)
    assert len(double) == len(single) * (1 if name in ("keep_one", "decontaminate") else 2)


# --- one by one ---------------------------------------------------------------------------------------------


def test_line_dedup(spark, docs, rows):
    want = brute.dedup_lines([(r[0], r[1]) for r in rows])
    got = {(r.doc_id, want_text(rows, r.doc_id)): (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want
    assert sum(v[2] for v in want.values()) > 20


def want_text(rows, doc_id):
    return next(r[1] for r in rows if r[0] == doc_id)


def test_line_dedup_keeps_every_line_once(spark):
    pick = random.Random(5)
    some = [(i, "\n".join(f"line {pick.randrange(6)}" for _ in range(pick.randrange(12)))) for i in range(60)]
    df = spark.createDataFrame(some, "doc_id int, text string")
    want = brute.dedup_lines(some)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {d: v[0] for (d, _), v in want.items()}
    before, after = ({x for t in texts for x in t.split("\n") if x} for texts in ((t for _, t in some), got.values()))
    assert before == after


@pytest.mark.parametrize("most", [lm_scoring.MOST_MODEL_BYTES, 0])
def test_lm_scores(docs, rows, most):
    """Against exact quantised counts: the filter answers a few absent grams falsely."""
    want = brute.lm([(r[0], r[1]) for r in rows], lm_scoring.MASS)
    got = lm_scoring.score_texts(docs, most_model_bytes=most).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=0.05)


def test_lm_scores_do_not_depend_on_the_size_of_the_model(spark, odd):
    """Probing a broadcast filter and sending the probes to its segments give the same numbers, with
    several segments, repeated rows, and one word and one text in a third of all rows."""
    some = odd.select("doc_id", "text")
    hot = spark.range(400).selectExpr("id + 1000 AS doc_id", "concat('the the ', if(id % 3 = 0, 'same words', cast(id % 50 AS string)), ' the') AS text")
    every = some.union(hot)
    one, other = (collected(lm_scoring.score_texts(every, most_model_bytes=m, segment_bits=1 << 15)) for m in (lm_scoring.MOST_MODEL_BYTES, 0))
    assert len(one) == len(other) == every.count()
    for a, b in zip(one, other):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_lm_predicts_held_out_texts_better_than_its_base(spark):
    got = entry.queries()["op2_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out")
    score, base = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_filter_reads_back_levels():
    keys = np.arange(1, 20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    levels = 1 + np.arange(len(keys)) % 5
    bits = np.zeros((3, lm_scoring.SEGMENT_BITS // 8), np.uint8)
    made = lm_scoring.Filter(bits)
    for level in range(1, 6):
        some = keys[levels >= level]
        for at in lm_scoring.places(some, level):
            np.bitwise_or.at(bits, (made.segment(some), (at >> np.uint64(3)).astype(np.int64)), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    assert (made.levels(keys) >= levels).all()
    assert (made.levels(keys) == levels).mean() > 0.99
    assert (made.levels(keys + np.uint64(2)) > 0).mean() < 0.01


def test_decontamination(spark, docs, rows):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = set(map(tuple, decontaminate.contaminated_pairs(docs, items).collect()))
    want = brute.contained([(r[0], r[1]) for r in rows], ITEMS)
    assert got == want and len(want) > 5
    clean = {r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()}
    assert clean == {r[0] for r in rows} - {d for d, *_ in want}


def test_decontamination_threshold_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr("crawlprism.llm.common.BROADCAST_BYTES", 0)
    item = prose(50, 24, 9000)
    w = item.split()
    some = [(i, prose(60 + i, 40, 9000) + " " + " ".join(w[:cut]) + " " + prose(90 + i, 9, 9000)) for i, cut in enumerate(range(4, 25))]
    docs, items = spark.createDataFrame(some, "doc_id int, text string"), [(9, item.upper())]
    got = decontaminate.contaminated_pairs(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert set(map(tuple, got)) == brute.contained(some, items) and got


@pytest.mark.parametrize("most", [simhash.MOST, 3])
def test_simhash(spark, docs, rows, most, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", most)
    base = prose(30, 300, 3000).split()
    near = []
    for i in range(40):
        w = list(base)
        w[(i * 7) % 300] = f"edit{i}"
        near.append((100 + i, " ".join(w), "en", "host0", 0))
    every = [*rows, *near]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(every, SCHEMA)).collect()}
    prints = [brute.fingerprint(r[1]) for r in every]
    root = brute.groups(len(every), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    for i, r in enumerate(every):
        assert got[r[0]].fingerprint == f"{prints[i]:016x}"
        members = [every[j][0] for j in range(len(every)) if root[j] == root[i]]
        assert got[r[0]].component_id == min((m for m in members if m is not None), default=None)
    assert len(set(root)) < len(every) - 10


def test_linked_by_neighbours_equals_linked_by_pairs(monkeypatch):
    pick = np.random.default_rng(3)
    values = np.unique(pick.integers(0, 1 << 14, 3000).astype(np.uint64) | np.uint64(7 << 50))

    def parts(a, b):
        root = {int(v): int(v) for v in values}
        for x, y in zip(a.tolist(), b.tolist()):
            root[x] = y
        return root

    pairs = parts(*simhash.linked(values))
    monkeypatch.setattr(simhash, "MOST", 10)
    other = parts(*simhash.linked(values))
    names = {v: [u for u in pairs if pairs[u] == pairs[v]] for v in list(pairs)[:50]}
    assert all(sorted(names[v]) == sorted(u for u in other if other[u] == other[v]) for v in names)


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_keep_one_of_each_group(spark, block):
    texts = []
    for g in range(12):
        w = prose(200 + g, 400, 5000).split()
        for c in range(1 + g):
            w[c * 30] = f"edit{c}"
            texts.append((len(texts), " ".join(w), g))
    texts.append((0, texts[0][1], 0))  # a row once more
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id int, text string, g int"), block=block).collect()
    assert Counter(r.g for r in kept) == Counter(range(12))
    assert {r.doc_id for r in kept} == {min(t[0] for t in texts if t[2] == g) for g in range(12)}


def test_keep_one_links_by_exact_similarity(spark):
    """8 changed words of 400 leave a Jaccard similarity of 0.817, 9 leave 0.796; short texts are exact."""
    texts, want = [], set()
    for g in range(60):
        w = prose(800 + g, 400, 5000).split()
        texts.append((len(texts), " ".join(w)))
        want.add(texts[-1][0])
        edits = 8 if g < 30 else 9
        for c in range(edits):
            w[20 + c * 40] = f"edit{c}"
        texts.append((len(texts), " ".join(w)))
        want |= {texts[-1][0]} if edits == 9 else set()
    for g in range(20):
        short = prose(900 + g, 9, 5000)
        texts += [(len(texts), short), (len(texts) + 1, short.rsplit(" ", 1)[0])]  # 4 of 5 shingles
        want.add(texts[-2][0])
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id int, text string")).collect()
    assert {r.doc_id for r in kept} == want


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b))
    return shared / (len(a) + len(b) - shared)


def same_groups(nodes: list[int], some, other) -> bool:
    def named(links):
        root = {n: n for n in nodes}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        return [top(n) for n in nodes]

    return named(some) == named(other)


def test_members_of_keys():
    """Every member near another is given once, with a tight one before it if there is any."""
    pick = np.random.default_rng(5)
    base = pick.integers(0, 1 << 32, (6, 3), dtype=np.uint32)
    check = np.repeat(base, 50, axis=0)
    check[:, 0] ^= np.uint32(1) << pick.integers(0, 32, 300).astype(np.uint32)
    lone = np.array([[8, 1, 1, 0, 0, 0], [8, 2, 2, 0xFFFFFFFF, 0xFFFFFFFF, 0], [9, 3, 3, 0, 0, 0]], np.uint32)
    posted = np.concatenate([np.full((300, 1), 7, np.uint32), np.arange(600, dtype=np.uint32).reshape(300, 2), check], axis=1)
    for block in (1024, 40):
        keys, points, other = simhash.met_members(np.concatenate([lone, posted]), 29, 10, block)
        assert (keys == 7).all() and len(np.unique(points)) == len(points) == 300
        assert (points == other).sum() == 6 if block > 300 else 6 <= (points == other).sum() < 60


def test_tiles_link_what_all_pairs_link():
    pick = np.random.default_rng(6)
    for case in range(20):
        base = pick.integers(0, 1 << 62, 60 + 9000 * (case == 19)).astype(np.uint64)
        sets = []
        for i in range(30):
            own = base.copy()
            at = pick.integers(0, len(base), max(1, len(base) // 12))
            own[at] = pick.integers(0, 1 << 62, len(at)).astype(np.uint64)
            sets.append(np.unique(own[: len(own) - i % 3]))
        sets.append(np.empty(0, np.uint64))
        shared = simhash.shared_counts(sets)
        assert all(shared[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(31) for j in range(i))
        groups = [i // 3 for i in range(31)]
        within = [(i, j) for i in range(31) for j in range(i) if groups[i] == groups[j]]
        all_pairs = [(i, j) for i in range(30) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
        found = simhash.tile_links(list(range(31)), groups, sets, 0.8)
        assert set(found) <= set(all_pairs) and len(found) < 11
        assert same_groups(list(range(31)), within + found, within + all_pairs)


@pytest.mark.parametrize("edits, chunk", [(5, simhash.CHUNK), (6, 32)])
def test_many_copies_close_to_the_limit(spark, edits, chunk):
    """1,000 copies, two of which differ by twice the edits: pairs lie around 0.8, and no row is a pair."""
    pick = random.Random(edits)
    base = prose(77, 560, 50_000).split()
    texts = []
    for i in range(1000):
        w = list(base)
        for at in pick.sample(range(0, 560, 5), pick.choice([edits, edits, edits + 2, edits + 9])):
            w[at] = f"edit{i}x{at}"
        texts.append((i, " ".join(w)))
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in texts]
    sizes = np.array([len(x) for x in sets])
    shared = simhash.shared_counts(sets)
    a, b = np.nonzero(np.tril(shared >= 0.8 * (sizes[:, None] + sizes[None, :] - shared), -1))
    root = list(range(1000))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    want = {i for i in range(1000) if top(i) == i}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id int, text string"), chunk=chunk).collect()}
    assert want <= kept and len(kept - want) <= 2  # the index proposes 99 % of pairs at 0.8
    assert len(want) > 5


def test_members_are_joined_once_however_many_keys_they_share(spark):
    met = spark.createDataFrame(
        [(k, 3, p, 1) for k in range(40) for p in (1, 2, 3)] + [(90, 2, 3, 3), (90, 2, 4, 3)], "key long, n long, point long, other long"
    )
    members = {r.point: r for r in simhash.packed_members(met).collect()}
    assert {p: len(r.keys) for p, r in members.items()} == {1: 40, 2: 40, 3: 41, 4: 1}
    # Of the keys only those that are some member's largest: the greatest of the equal ones, and 4's only one.
    assert {p: sorted(map(tuple, r.own)) for p, r in members.items()} == {1: [(39, 3)], 2: [(39, 3)], 3: [(39, 3), (90, 2)], 4: [(90, 2)]}


@pytest.mark.parametrize("n_in, n_out, chunk", [(9, 5, 64), (9, 40, 8), (1, 30, 8)])
def test_outer_tiles_hold_every_pair_without_a_tile_twice(spark, n_in, n_out, chunk):
    rows = [(7, i, 7 if i < n_in else 100 + i) for i in range(n_in + n_out)]
    members = spark.createDataFrame(rows, "key long, point long, group long")
    tiles = {}
    for r in simhash._outer_tiles(members, chunk).collect():
        tiles.setdefault(r.tile, set()).add(r.point)
    met = {(a, b) for t in tiles.values() for a in t for b in t if a < b}
    assert met >= {(a, b) for a in range(n_in + n_out) for b in range(max(a + 1, n_in), n_in + n_out)}
    assert not any(a < b for a in tiles.values() for b in tiles.values())  # no tile is inside another
    if max(n_in, n_out) <= chunk:
        assert list(map(len, tiles.values())) == [n_in + n_out]


def test_proposals_carry_the_members_of_their_key(spark):
    texts = [(i, f"{prose(7, 300, 3000)} end{i}") for i in range(6)] + [(9, prose(8, 300, 3000))]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    made = simhash.signatures(docs, id_column="doc_id", text_column="text", shingle=5, similarity=0.8)
    met = simhash.proposed(made.select("point", "sig", "few"), loose=29, tight=10, block=1024).collect()
    sizes = Counter(r.key for r in met)
    assert met and all(r.n == sizes[r.key] for r in met)


def test_quality_measures_and_hosts(spark, docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in rows:
        g = got[r[0]]
        want = brute.measures(r[1])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == {d for d, r in got.items() if r.kept}


def test_bad_host_loses_its_good_pages_and_a_small_one_does_not(spark):
    good, bad = prose(1, 40), "too short"
    some = [(h, good if i % 10 else bad) for h in ("a", "b", "c") for i in range(200)]
    some += [("spam", bad if i % 10 else good) for i in range(200)] + [("tiny", bad), ("tiny", good)]
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(some)], "doc_id int, text string, source string")
    verdict = {r.host: r.host_rejected for r in quality.host_verdicts(quality.base_measures(df, carry=("doc_id", "source"))).collect()}
    assert verdict == {"a": False, "b": False, "c": False, "spam": True, "tiny": False}
    assert {r.source for r in quality.keep_good(df).collect()} == {"a", "b", "c", "tiny"}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


def test_token_counts(docs, rows, library):
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, tokenizer()).collect()}
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        g = got[r[0]]
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len((r[1] or "").encode()), n, n > 512)


def test_tokens_of_random_texts_and_all_characters(library):
    pick = random.Random(2)
    letters = "abcdest'rvlm  \n\t.,!?123é漢 　ßX"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(3000)]
    texts += [f"a{chr(c)}1{chr(c)}'{chr(c)}!{chr(c)} {chr(c)}" for c in [*range(1, 0xD800, 11), *range(0xE000, 0x30000, 37)]]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.counter(tokenizer()).counts(texts).tolist() == [len(ids) for ids in want]
    encode = packing.encoder(tokenizer())
    assert [encode.ids(t).tolist() for t in texts] == want


def test_chunks_of_any_size_give_the_same_pieces():
    classes = np.random.default_rng(1).integers(0, len(token_counts.CLASSES), 3000).astype(np.uint8)
    classes[-1] = token_counts.C["end"]
    whole = token_counts.piece_starts(classes, chunk=5000)
    assert all((token_counts.piece_starts(classes, chunk=c) == whole).all() for c in (1, 7, 256))


def checked_packing(placed, texts: dict, library, capacity: int = 2048) -> int:
    """Every rule of a packing; returns the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in placed:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for d, parts in by_doc.items():
        ids = np.array([*library.encode(texts[d] or "", add_special_tokens=False).ids, 0], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in parts[1:])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(docs, rows, library):
    placed = packing.pack(docs, tokenizer()).collect()
    n = checked_packing(placed, {r[0]: r[1] for r in rows}, library)
    assert n <= -(-sum(r.length for r in placed) // 2048) + 1


def test_packing_of_a_table_is_close_to_the_bound(spark, library):
    path = "/root/testdata/sf0.01"
    placed = entry.queries()["op9_packing"](spark, path).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert checked_packing(placed, texts, library) <= 1.005 * sum(r.length for r in placed) / 2048 + 1


def test_plan_uses_every_piece_once():
    pick = np.random.default_rng(4)
    for n in (1, 10, 3000):
        histogram = np.bincount(pick.integers(1, 2049, n), minlength=2049) * int(pick.integers(1, 50))
        made = packing.plan(histogram)
        for length in np.flatnonzero(histogram):
            ranges = sorted((r[1], r[1] + r[2]) for r in made.rows if r[0] == length)
            assert ranges[0][0] == 0 and ranges[-1][1] == histogram[length]
            assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_pii(docs, rows):
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(docs)).collect()}
    import hashlib

    for r in rows:
        want = brute.personal_data(r[1])
        g = got[r[0]]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == x for k, *_ in want) for x in pii.BASE]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert g.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(g.spans.split(","))


def test_pii_on_random_texts():
    pick = random.Random(3)
    for _ in range(20_000):
        letters = pick.choice(["ab@.-+%1", "0123456789 -.+()", "12.@ +a-", "İa@b.c1"])
        text = "".join(pick.choice(letters) for _ in range(pick.randrange(40)))
        assert [s for s in pii.spans(text) if s[0] in pii.BASE] == brute.personal_data(text), text


def test_phone_with_long_separator_runs():
    for run in (" ", ".", "-", "( "):
        for n in (4090, 4100, 9000):
            for digits in ("2345678901", "2345", "23456789012345678"):
                text = "call +1 " + run * n + " " + digits + " now"
                got = [x for x in pii.spans(text) if x[0] == "phone"]
                want = [m.span() for m in dict(brute.PII)["phone"].finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
                assert [x[1:] for x in got] == want and len(want) == (len(digits) == 10)


def test_pii_added_spans():
    text = "See https://a.example/x?y=1. Account number: AB-1234-99, IBAN DE89 3704 0044 0532 0130 00; account of him"
    found = {(k, text[a:b]) for k, a, b in pii.spans(text)}
    assert {("url", "https://a.example/x?y=1"), ("account", "AB-1234-99"), ("iban", "DE89 3704 0044 0532 0130 00")} <= found
    assert sum(k == "account" for k, _ in found) == 1


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.example now"), (2, None), (3, "none")], "doc_id int, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "mail [email] now", 2: None, 3: "none"}


@pytest.mark.parametrize("path,least", [("/root/testdata/sf0.1", 0.8)])
def test_toxicity_on_held_out_rows(spark, path, least):
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    scored = entry.queries()["op4_toxicity"](spark, path)
    assert scored.count() == docs.count()
    held = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    hits = Counter((r.predicted, r.toxic) for r in held)
    assert hits[1, 1] / (hits[1, 1] + hits[0, 1]) > least
    assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.9
    assert all(0 <= r.score <= 1 for r in held)


def test_toxicity_learns_what_only_pairs_say():
    """Label 1 only where both of two terms are there: no sum of single weights says so."""
    pick = np.random.default_rng(0)
    n = 4000
    a, b = pick.random(n) < 0.5, pick.random(n) < 0.5
    rows = np.concatenate([np.flatnonzero(a), np.flatnonzero(b), np.arange(n)])
    slots = np.concatenate([np.full(a.sum(), 11), np.full(b.sum(), 22), 100 + pick.integers(0, 50, n)])
    labels = (a ^ b).astype(np.int64)
    machine = toxicity.fit(rows, slots, labels)
    assert ((machine.scores(rows, slots, n) >= 0.5) == labels).mean() > 0.95


def slow_scores(machine, texts: list[list[int]]) -> list[float]:
    """The machine's formula, pair by pair."""
    made = []
    for slots in texts:
        at = [machine.place[s] for s in slots if machine.place[s]]
        raw = machine.bias + sum(machine.weight[i] for i in at)
        raw += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(at) for j in at[:n])
        made.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
    return made


def test_toxicity_scores_equal_sums_over_pairs():
    pick = np.random.default_rng(2)
    texts = [sorted(set(pick.integers(0, 60, pick.integers(0, 25)).tolist())) for _ in range(400)]
    rows = np.repeat(np.arange(400), [len(t) for t in texts])
    slots = np.concatenate([np.array(t, np.int64) for t in texts])
    labels = np.array([int(3 in t and 7 in t or 11 in t) for t in texts])
    machine = toxicity.fit(rows, slots, labels)
    assert len(machine.weight) > 5
    assert machine.scores(rows, slots, 400) == pytest.approx(slow_scores(machine, texts), abs=1e-9)


def test_toxicity_bound_holds_for_rows_and_other_columns_do_not_matter(spark, docs, odd):
    marked = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    many = docs.where("doc_id = 1").crossJoin(spark.range(50)).drop("id").union(docs)
    sample = toxicity.training_sample(many, marked, most=20)
    assert sample.count() == 20
    once = toxicity.train(toxicity.training_sample(docs, marked))
    plain = collected(toxicity.score(docs, once))
    assert collected(toxicity.score(odd, once)) == sorted(plain * 2, key=repr)


def test_toxicity_of_odd_tables(spark, docs, none):
    marked = spark.createDataFrame([(5, 1), (6, 1), (None, 0), (7, None)], "doc_id long, toxic int")
    for labels, want in ((marked, 1.0), (marked.limit(0), 0.0)):
        machine = toxicity.train(toxicity.training_sample(docs, labels))
        got = toxicity.score(docs, machine).collect()
        assert len(got) == len(TEXTS) + 1 and all(r.score == pytest.approx(want, abs=1e-9) for r in got)
    assert toxicity.score(none, machine).collect() == []


PAGES = [
    (1, "http://a.example/", "<html lang=de><head><title>T &amp; x</title><script>no</script></head><body><p>Eins<br>zwei</p>"
     "<!-- gone --><a href='/l'>link</a><a href=\"/l\">again</a> caf&eacute;</body></html>"),
    (2, None, None), (3, "", ""), (4, "u", "plain < text"), (5, "u", "<p" * 50_000 + "<!-- open"), (1, "http://a.example/", "x"),
]


def test_warc_records(spark):
    responses = warc.responses(spark.createDataFrame(PAGES, "page_id int, url string, html string"))
    made = warc.derivatives(responses).collect()
    assert Counter(r.type for r in made) == {"metadata": len(PAGES), "conversion": len(PAGES)}
    source = {(r.record_id, r.payload_digest): r for r in responses.collect()}
    for r in made:
        origin = source[r.refers_to, r.refers_to_digest]
        assert (r.refers_to, r.target_uri, r.date, r.source_headers) == (
            origin.record_id, origin.target_uri, origin.date, origin.source_headers)
        assert r.block_digest == warc.digest(r.block.encode())
    first = {r.type: r.block for r in made if r.refers_to_digest == warc.digest(PAGES[0][2].encode())}
    assert first["conversion"] == "Eins\nzwei\nlinkagain café"
    assert first["metadata"].split("\r\n")[:5] == ["title: T & x", "languages-declared: de", "link-count: 1", "outlink: /l", ""]


def test_warc_goes_on_after_damaged_records():
    good = [dict.fromkeys(warc.FIELDS) | {"type": "resource", "block": f"body {i}", "source_headers": ""} for i in range(4)]
    parts = [warc.record_bytes(r) for r in good]
    for bad in (b"junk\r\n\r\n", b"WARC/1.1\r\nContent-Length: x\r\n\r\nlost\r\n\r\n",
                *(parts[0].replace(b"Content-Length: 6", b"Content-Length: " + n) for n in (b"2", b"60", b"99999"))):
        assert bad != parts[0]
        got = list(warc.parse_records(parts[0] + bad + b"".join(parts[1:])))
        assert [r["block"] for r in got if r["type"] and r["block"].startswith("body")] == [f"body {i}" for i in range(4)], bad
        assert any(r["type"] is None for r in got)


def test_warc_files_round_trip(spark, tmp_path):
    responses = warc.responses(spark.createDataFrame(PAGES, "page_id int, url string, html string"))
    every = responses.union(warc.derivatives(responses))
    data = b"".join(bytes(r.data) for r in warc.serialise(every).collect())
    import gzip

    for name, content in (("a.warc", data), ("b.warc.gz", gzip.compress(data)), ("c.warc", b"not an archive"), ("d.warc", b"")):
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "content")
    back = warc.read_records(files)
    want = collected(every.select(*warc.FIELDS))
    for name in ("a.warc", "b.warc.gz"):
        assert collected(back.where(F.col("id").startswith(name)).select(*warc.FIELDS)) == want
    broken = back.where(F.col("id").startswith("c.warc")).collect()
    assert [(r.type, r.block) for r in broken] == [(None, "not an archive")]
    again = warc.derivatives(back.where(F.col("id").startswith("a.warc")))
    assert collected(again.select(*warc.FIELDS)) == collected(warc.derivatives(responses).select(*warc.FIELDS))


# --- registered queries ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_decontamination", "op6_quality_rules", "op12_conversation_repair"])
def test_query_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_registered_names():
    names = {re.match(r"op(\d+)_", n)[1] for n in entry.queries() if n.startswith("op")}
    assert names == {str(i) for i in range(1, 14)} and "pipeline" in entry.queries()
