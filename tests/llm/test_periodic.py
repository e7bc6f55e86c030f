"""Periodic runs against a scan of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from crawlprism.llm import periodic


def every_run(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing the words at every lag."""
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.empty(0, int)
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]]).astype(int)
        edge = np.flatnonzero(np.diff(same))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start + q >= max(12, 2 * q):
                found.setdefault((start, end - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def ours(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    _, (start, length, period), of, _ = periodic._of_texts([" ".join(t).encode() for t in texts])
    made: list[list] = [[] for _ in texts]
    for s, n, q, i in zip(start.tolist(), length.tolist(), period.tolist(), of.tolist()):
        made[i].append((s, n, q))
    return made


def fibonacci(n: int) -> list[str]:
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def text(pick: random.Random, kind: int) -> list[str]:
    """Random words, repeated blocks of blocks, and words known for their many or missing runs."""
    n = pick.randrange(1, 500)
    some = lambda n, size: [str(pick.randrange(size)) for _ in range(n)]
    if kind == 0:
        return some(n, pick.choice([2, 50]))
    if kind == 1:
        block = some(pick.randrange(1, 120), pick.choice([1, 2, 3, 100]))
        return some(pick.randrange(30), 5) + (block * 10)[:n] + some(pick.randrange(30), 5)
    if kind == 2:
        return fibonacci(n)
    if kind == 3:
        return ["ab"[bin(i).count("1") % 2] for i in range(n)]
    if kind == 4:  # two runs of one small period that meet out of step
        return (["a", "b"] * 200)[: pick.randrange(20, 200)] * pick.randrange(2, 5)
    block = some(pick.randrange(1, 6), 2)
    parts = [(block * 40)[: pick.randrange(8, 150)] + ["x"] * pick.randrange(2) for _ in range(pick.randrange(2, 7))]
    return (sum(parts, []) * pick.randrange(1, 4))[:900]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    pick = random.Random(seed)
    texts = [text(pick, kind) for kind in (0, 0, 1, 1, 2, 3, 4, 4, 5, 5, 5) for _ in range(6)] + [[], ["one"]]
    assert ours(texts) == [every_run(t) for t in texts]


def test_work_stays_linear_on_one_word():
    """A square of seeds would take hours here."""
    assert ours([["again"] * 400_000, ["again"] * 300_000])[0] == [(0, 400_000, 1)]
    block = [str(i * i % 997) for i in range(5000)]
    longest = max(ours([block * 30])[0], key=lambda r: r[1])
    assert longest[:2] == (0, 150_000) and longest[2] == 5000


def test_registered_query_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in entry.queries()["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = every_run(words)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        want = [len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else [None] * 4)]
        for x in ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)):
            want.append(hashlib.sha256(x.encode()).hexdigest())
        r = got[doc.doc_id]
        assert [r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256] == want
    assert planted > 5


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 12), (4, "a " * 12), (None, "b c " * 7), (5, "É x " * 13)]
    got = sorted(map(tuple, periodic.find_runs(spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=repr)
    one = (4, 12, [(0, 12, 1)], "a")
    assert got == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), one, one, (None, 14, [(0, 14, 2)], "b c"), (5, 13, [(0, 13, 1)], "É x")], key=repr
    )
