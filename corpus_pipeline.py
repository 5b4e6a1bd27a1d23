"""A corpus pipeline of five stages; each reads what the one before wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import line_dedup, near_dedup, packing, quality, surrogates
from tributary.llm.common import shared_folder, unused
from tributary.llm.queries import SURROGATE_KEY

#: A quality model and surrogates can't be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on the given documents' labels, scores 0.5 and more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs.columns, "score")
    return quality.score_documents(docs, model, keep=tuple(docs.columns), score_column=score).where(F.col(score) >= 0.5).drop(score)


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out without the counts that an operator adds."""
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share but for the last of these."""
    return _as_before(line_dedup.deduplicate_lines(docs), docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Documents without words are no copies and stay."""
    return near_dedup.one_of_each(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    return _as_before(surrogates.replace_entities(docs, SURROGATE_KEY), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result is written to a new folder of spark.checkpoint.dir and read again. What a stage has read goes when its result is written; the last result stays."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _remove(spark, before)
        before = path
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
