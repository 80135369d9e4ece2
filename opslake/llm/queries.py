"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opslake.llm import bpe, decontaminate, html_text, language, neardup, oracles, phrases, pii, quality, secret_scan, spans, spelling, suffixes, toxicity, vectors

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")), secret_scan.BASE_KINDS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    out = quality.held_out("doc_id", language.FOLDS, language.HELD_OUT).alias("held_out")
    return found.select("doc_id", out, "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(pii.find_personal_data(table(spark, sf_dir, "documents")), pii.BASE_KINDS)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.repeated(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_neardup": op2_neardup,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_vectors": op6_vectors,
    "op7_language": op7_language,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_html_text": op10_html_text,
    "op11_spelling": op11_spelling,
    "op12_phrases": op12_phrases,
    "op13_suffixes": op13_suffixes,
}

ORACLES: dict[str, str] = oracles.ORACLES
