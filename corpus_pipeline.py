"""From raw documents to token ids: five stages, each one of the text operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  ``run`` writes
what a stage returns as Parquet into the shared folder and reads it back as the
documents of the next one, so a lost executor repeats tasks of one stage only.
All stages but the last keep the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.functions.scratch import materialize, remove
from opslake.llm import bpe, decontaminate, neardup, quality, secret_scan
from opslake.llm.queries import VOCABULARY, table

#: Put in place of each secret.
MASK = "[secret]"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return neardup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked, and n_chars follows where the text changed."""
    # The row travels as one column, so no name of its own can clash with those of the scan.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    scanned = secret_scan.with_spans(docs.select(row.alias("_row"), F.coalesce("text", F.lit("")).alias("_text")), text_col="_text")
    hit = F.size("_spans") > 0
    masked = secret_scan.masked(scanned, "_text", "_spans", MASK)
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    fields = ((c, F.col("_row").getField(c)) for c in docs.columns)
    return masked.select(*((F.when(hit, new[c]).otherwise(old) if c in new else old).alias(c) for c, old in fields))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the number of tokens, digests of the ids and of the bytes they decode to, and the ids."""
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.encode_documents(docs, vocabulary, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_level_bpe", byte_level_bpe),
]

#: Learned models and signatures are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(before)
        before = docs
    return docs
