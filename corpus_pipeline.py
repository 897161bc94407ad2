"""The corpus pipeline: five stages over ``documents``, each a table written before the next reads it.

Every stage but the last returns the columns of ``documents``. A stage works on
all that its predecessor kept; null and empty texts have no language and go in
the first stage. Models are learned from the stage's own input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalmill.llm import exact_dedup, language_id, packing, simhash_similar, toxicity
from evalmill.session import ship_package, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text has a language."""
    return language_id.accepted_documents(docs, language_id.learned_from(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted_documents(docs, toxicity.learned_from(docs, labels), 0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest doc_id."""
    index = exact_dedup.scratch_index(spark)
    kept = exact_dedup.kept_documents(docs, index)
    index.close()
    return kept


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates keep one document.

    Texts are linked by SimHash fingerprints within two bits, through the pivot
    distance tables of operator 7, and beyond their reach by a similarity of 0.8
    or more over shingles of five words.
    """
    return simhash_similar.first_of_each_group(docs, similarity=0.8, shingle_words=5, pivot_shingle_words=3)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    import public_tokenizers

    # Executors that have run the stages before have less memory to spare for words.
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), most_words=250_000))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: Learned models, fingerprints and token ids are beyond SQL; tests/llm holds the operators, not the stages, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
