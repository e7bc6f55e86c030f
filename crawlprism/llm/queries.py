"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlprism.llm import (
    decontaminate, language, line_dedup, lm_scoring, packing, periodic, pii, quality, repair, simhash,
    token_counts, toxicity, warc,
)
from crawlprism.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    machine = toxicity.train(toxicity.training_sample(docs, table(spark, folder, "labels")))
    return toxicity.score(docs, machine)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def _tokenizer() -> str:
    """The tokenizer file of the registered queries; every worker has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, folder, "pages"))).withColumnRenamed("id", "page_id")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), _tokenizer())


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), _tokenizer())


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, folder, "documents")))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.planted(table(spark, folder, "documents"))))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, folder, "conversations")))


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_line_dedup, op2_lm_scoring, op3_decontamination, op4_toxicity, op5_simhash, op6_quality_rules, op7_warc,
        op8_token_counts, op9_packing, op10_pii, op11_periodic_runs,
        op12_conversation_repair, op13_language_id,
    )
    return {f.__name__: _ready(f) for f in own}


def _ready(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return build(spark, folder)

    return run


def oracle_sql() -> dict[str, str]:
    from crawlprism.llm import sql

    return sql.ORACLES
