"""Columns of a user's own, whatever their names, go through every operator and stage."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tributary.llm import bpe, media, near_dedup, packing, sharding, substring_dedup

NAMES = ("score", "__text", "__doc", "__digest", "__new", "__keep", "__kept", "__lines", "row", "doc", "digest", "id", "bucket", "kept", "pairs", "bits", "component_id", "slot", "length", "ids", "a.b")
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(documents):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{words} number {i % 7}\nMail a{i}@bb.com today, please") for i in range(30)] + [(40, None), (41, ""), (None, words), (3, words)]
    out = documents(rows)
    for n in NAMES:
        out = out.withColumn(n, F.lit(7))
    return out


def test_operators(docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    operators = {
        "substring": substring_dedup.remove_repeated, "near": near_dedup.near_duplicates, "media": media.text_media, "bpe": lambda d: bpe.decode_documents(bpe.encode_documents(d, ranks), ranks),
        "packing": lambda d: packing.piece_table(d, public_tokenizers.path("word_bpe_49k.json")),
    }
    for name, operator in operators.items():
        rows = [sorted(map(str, operator(d).collect())) for d in (docs, plain)]
        assert rows[0] == rows[1] and rows[0], name
    placed = sharding.assign_shards(docs, ["doc_id"], ("a", "b"), 101)
    assert placed.columns == [c for c in docs.columns if c not in ("slot", "shard")] + ["slot", "shard"] and placed.count() == docs.count()


def test_stages(spark, docs):
    given = docs.select(*(F.col(f"`{c}`") for c in docs.columns))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, given, SF)
        assert out.columns == given.columns and out.count() > 0
        assert all(tuple(r)[5:] == (7,) * len(NAMES) for r in out.collect())
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for n in NAMES:
        table = table.withColumn(n, F.lit(7))
    out = corpus_pipeline.STAGES[0][1](spark, table, SF)
    assert out.columns == table.columns and all(tuple(r)[5:] == (7,) * len(NAMES) for r in out.select(*(F.col(f"`{c}`") for c in out.columns)).collect())
