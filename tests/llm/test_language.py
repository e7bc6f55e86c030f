"""Language ID: Viterbi against all labellings, script ranges, mixed texts, held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlprism.llm import language

SCHEMA = "doc_id long, text string, lang string"
WORDS = {
    "one": "stone river winter mother answer", "two": "prazo manhã coração janela verão", "three": "снег река зима мать ответ",
    "four": "雪山 河川 冬天 母亲 回答",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"{words} {words}", lang) for i, (lang, words) in enumerate(WORDS.items())]
    return language.train(spark.createDataFrame(rows, SCHEMA))


def test_viterbi_equals_the_best_of_all_labellings():
    pick = np.random.default_rng(3)
    sizes = np.array([1, 5, 0, 6, 4, 6, 0])
    scores = -pick.integers(0, 12, (int(sizes.sum()), 3)).astype(np.float32)
    got = language.viterbi(scores, sizes, 7.0)
    end = 0
    for n in sizes.tolist():
        part, own = scores[end : end + n], got[end : end + n].tolist()
        worth = lambda path: sum(part[t, s] for t, s in enumerate(path)) - 7.0 * sum(a != b for a, b in itertools.pairwise(path))
        assert n == 0 or worth(own) == max(map(worth, itertools.product(range(3), repeat=n)))
        end += n


def test_word_scores_equal_sums_over_grams(model):
    text = "Stone, PRAZO! 42 река雪 x"
    scores, letters, sizes = language.word_scores([text, "", "river"], model)
    assert sizes.tolist() == [5, 0, 1] and letters.tolist() == [5, 5, 0, 5, 1, 5]
    assert scores.shape == (6, 4) and (scores.max(axis=1) == 0).all() and (scores[2] == 0).all()
    names = model.languages
    for word, row in (("stone", 0), ("prazo", 1), ("river", 5)):
        sums = np.zeros(4, np.float32)
        for i in range(len(word)):
            key = 0
            for c in (word[i - 1] if i else "", word[i], word[i + 1] if i + 1 < len(word) else ""):
                key = key << 21 | (ord(c) if c else 0)
            sums += model.table[int(language.mix(np.array([key], np.uint64))[0]) % language.BUCKETS]
        latin = [names.index("one"), names.index("two")]
        assert scores[row, latin] == pytest.approx(sums[latin] - sums[latin].max(), abs=1e-4)
        assert (np.delete(scores[row], latin) < -1000).all()  # the script narrows the candidates


def test_spans_of_mixed_texts(spark, model):
    rows = [(1, "stone river winter. снег река зима? prazo manhã coração", "x"), (2, "river 17 -- 3 stone", "y"), (3, "12 34 !", "z"), (4, None, "z"), (5, "", "z")]
    got = {r.doc_id: r for r in language.label_spans(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert [tuple(s) for s in got[1].spans] == [(0, 3, "one"), (3, 3, "three"), (6, 3, "two")]
    assert got[1].lang_pred == "two" and got[1].score == pytest.approx(17 / 45)
    assert [tuple(s) for s in got[2].spans] == [(0, 5, "one")] and got[2].score == 1
    assert [(got[i].lang_pred, got[i].score) for i in (3, 4, 5)] == [("und", 0)] * 3


def test_training_leaves_out_nulls_and_held_out_rows(spark):
    rows = [(i, "stone river", "one" if i % 2 else None) for i in range(40)] + [(41, None, "two"), (None, "prazo janela", "two")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = language.learnable(docs)
    ids = {r.doc_id for r in kept.collect()}
    import zlib

    assert ids == {i for i, *_ in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 3 != 1}
    counts = {(r.lang, r.slot): r.n for r in language.gram_counts(docs).collect()}
    latin = language.BUCKETS + 1
    assert counts[("one", latin)] == 20 * 10 and counts[("two", latin)] == 11
    assert language.train(docs.limit(0)).languages == []
    assert {r.lang_pred for r in language.label_spans(docs, language.train(docs.limit(0))).collect()} == {"und"}
    with pytest.raises(ValueError, match="languages"):
        language.train(docs.select("doc_id", "text", F.concat(F.lit("l"), F.monotonically_increasing_id()).alias("lang")).union(
            spark.range(300).select("id", F.lit("x"), F.col("id").cast("string"))))


def test_long_text_in_one_piece(spark, model):
    pick = random.Random(1)
    parts = [(lang, " ".join(pick.choice(WORDS[lang].split()) for _ in range(20_000))) for lang in ("one", "two", "one")]
    docs = spark.createDataFrame([(1, " ".join(t for _, t in parts), None)], SCHEMA)
    row = language.label_spans(docs, model).first()
    assert [tuple(s) for s in row.spans] == [(0, 20_000, "one"), (20_000, 20_000, "two"), (40_000, 20_000, "one")]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op13_language_id"](spark, sf).where("held_out").join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_repeated_rows_and_clashing_columns(spark, model):
    rows = [(1, "stone river"), (2, "prazo manhã"), (3, None), (None, "река")]
    odd = spark.createDataFrame(rows * 2, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS spans", "'x' AS score", "'y' AS lang_pred", "'one' AS lang")
    once = [tuple(r) for r in language.label_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    twice = [tuple(r) for r in language.label_spans(odd, model).collect()]
    assert sorted(twice, key=repr) == sorted(once * 2, key=repr)
    assert len(language.identify(odd).collect()) == 8
