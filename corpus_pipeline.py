"""The training-data pipeline: quality rules, language ID, near-duplicates, mixing, packing.

Each stage reads all rows its predecessor kept. The filters and the mix return
whole documents with all their columns; the last stage returns token pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesora.llm import langid, mixing, packing, quality, shingles
from tesora.llm.base import documents, small_batches, write_shared

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A text whose main language has a smaller share of its words is no text of one language.
LEAST_SHARE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a counting rule or score below the threshold go."""
    small_batches(spark)
    model = quality.fit(docs, quality.labels_of(spark, sf_dir))
    return quality.judge(docs, model, prefix="__").where("__kept").select(*_columns(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letters, or no language with half of the words."""
    small_batches(spark)
    crf = langid.fit(docs, F.lit(True))
    found = langid.predict(docs, crf, names=("__lang", "__share"))
    return found.where((F.col("__lang") != "und") & (F.col("__share") >= LEAST_SHARE)).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles or more) stays."""
    small_batches(spark)
    return shingles.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix leaves out go; one it takes twice is there twice; rows stand in training order."""
    return mixing.curriculum(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents of the mix, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing_sources", mixing_sources),
    ("best_fit", best_fit),
]

#: Model scores, fingerprints and tokenizers have no SQL form; the tests hold the result against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = spark.read.parquet(write_shared(stage(spark, docs, sf_dir), f"pipeline_{name}"))
    return docs
