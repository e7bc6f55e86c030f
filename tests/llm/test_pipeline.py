"""The pipeline, stage by stage, against brute force on its own input."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_corpus import ODD, SCHEMA, checked_packing, library, prose  # noqa: E402, F401

import corpus_pipeline  # noqa: E402
from crawlprism.llm import quality  # noqa: E402


def documents() -> list[tuple]:
    pick = random.Random(8)
    shared = "\n".join(prose(700 + i, 30, 3000) for i in range(4))
    item = prose(900, 40, 3000)
    texts: list[tuple] = []

    def add(text, host="good"):
        texts.append((len(texts), text, "en", host, len(text or "")))

    for i in range(60):
        add("\n".join(prose(1000 + 10 * i + k, 40, 3000) for k in range(4)), f"host{i % 4}")
    for i in range(8):  # a passage of four lines in many documents
        add(prose(2000 + i, 60, 3000) + "\n" + shared + "\n" + prose(3000 + i, 60, 3000), "host1")
    base = prose(4000, 500, 3000).split()
    for i in range(12):  # near copies of one text
        base[(37 * i) % 500] = f"edit{i}"
        add(" ".join(base), "host2")
    for i in range(5):  # exact copies of another
        add(prose(5000, 200, 3000), "host3")
    for i in range(4):  # a benchmark item inside
        add(prose(6000 + i, 80, 3000) + " " + item + " " + prose(7000 + i, 80, 3000), "host0")
    for i in range(40):  # a host of bad pages and one good page
        add("buy now", "spam")
    add(prose(8000, 90, 3000), "spam")
    add(None)
    add("")
    add("again and again " * 30)
    add(" ".join(prose(9000 + pick.randrange(9), 1000, 3000) for _ in range(4)))
    return texts, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs, item = documents()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(901, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, folder, library):  # noqa: F811
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]

    def step(name, df):
        out = corpus_pipeline.stored(stages[name](spark, df, folder), "step")
        if name != "best-fit packing":
            assert out.columns == columns
        return out

    before = rows(docs)
    good = step("quality rules", docs)
    failed = {r[0] for r in before if (m := brute.measures(r[1]))[0] < 20 or 100 * m[4] > 30 * m[0]}
    hosts = Counter(r[3] for r in before)
    bad = Counter(r[3] for r in before if r[0] in failed)
    rate = {h: bad[h] / n for h, n in hosts.items()}
    mean = sum(bad.values()) / len(before)
    square = sum(hosts[h] * rate[h] ** 2 for h in hosts) / len(before)
    mean, weight = quality.beta_prior(len(before), len(hosts), mean, square, quality.STRONGEST_PRIOR)

    def low(h: str) -> float:
        r = (mean * weight + bad[h]) / (weight + hosts[h])
        return r - quality.BOUND * (r * (1 - r) / (weight + hosts[h] + 1)) ** 0.5

    rejected = {h for h in hosts if low(h) > quality.MAX_HOST_RATE}
    assert rejected == {"spam"}
    assert rows(good) == sorted((r for r in before if r[0] not in failed and r[3] not in rejected), key=repr)

    cut = step("line dedup", good)
    want = brute.dedup_lines([(r[0], r[1]) for r in rows(good)])
    assert rows(cut) == sorted(((r[0], t := want[r[0], r[1]][0], r[2], r[3], len(t)) for r in rows(good)), key=repr)
    assert sum("\n" in (want[k][0] or "") and want[k][2] > 0 for k in want) >= 7

    one = step("SimHash near-dedup", cut)
    sets = {r[0]: set(brute.shingles(r[1])) for r in rows(cut)}
    ids = sorted(sets)

    def similar(i: int, j: int) -> bool:
        a, b = sets[ids[i]], sets[ids[j]]
        return bool(a or b) and len(a & b) >= 0.8 * len(a | b)

    root = brute.groups(len(ids), similar)
    assert {r[0] for r in rows(one)} == {ids[i] for i, g in enumerate(root) if i == g}
    assert len(ids) - len(rows(one)) == 11 + 4

    clean = step("benchmark decontamination", one)
    found = {d for d, *_ in brute.contained([(r[0], r[1]) for r in rows(one)], [(1, documents()[1])])}
    assert len(found) == 4 and rows(clean) == [r for r in rows(one) if r[0] not in found]

    placed = step("best-fit packing", clean).collect()
    n = checked_packing(placed, {r[0]: r[1] for r in rows(clean)}, library)
    assert n <= brute.first_fit([r.length for r in placed]) + 1


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "step")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, folder).select(*key)) == rows(docs.select(*key))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, folder, name, stage):
    """Empty, with nulls in every column, repeated rows, extra columns that clash with internal names."""
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, folder).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, prose(1, 50), None, None, None)] * 2, SCHEMA)
    got = stage(spark, nulls, folder).collect()
    want = {"quality rules": (0, 2), "line dedup": (4,), "SimHash near-dedup": (2,), "benchmark decontamination": (4,), "best-fit packing": (4,)}
    assert len(got) in want[name]
    odd = spark.createDataFrame([(i, prose(i, 50), "x", 1, "y", 2, "z", "h", 3) for i in range(6)], ODD)
    made = stage(spark, odd, folder)
    assert made.count() == 6
    if name != "best-fit packing":
        assert made.columns == odd.columns and made.select("th", "key").distinct().collect() == [(1, 2)]


def test_long_texts_pass_every_stage(spark, folder):
    long = "\n".join(prose(i, 60, 50_000) for i in range(3000))
    docs = spark.createDataFrame([(1, long, "en", "h", len(long)), (2, "word " * 200_000, "en", "h", 5)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "step")
        assert docs.where(F.col("doc_id") == 1).count() == 1
    assert docs.count() == 1
