"""The pipeline's stages against plain Python, each on its own input."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import test_line_dedup, test_near_dedup

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    inputs = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs[name] = docs
        out = stage(spark, docs, SF)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    first, second = inputs["quality_classifier"], inputs["line_dedup"]
    kept = {r["doc_id"] for r in second.collect()}
    marked = [i for i in labels if i in {r["doc_id"] for r in first.collect()}]
    wrong = [i for i in marked if (i in kept) != (labels[i] == 1)]
    assert len(wrong) <= 0.03 * len(marked)
    want = test_line_dedup.brute(rows(second))
    got = test_line_dedup.run(second)
    assert got == want
    third = inputs["near_dedup"]

    stays = {r[0] for r in test_near_dedup.brute(rows(third)) if r[3]}
    fourth = inputs["pii_surrogates"]
    assert {r["doc_id"] for r in fourth.collect()} == stays
    fifth = inputs["best_fit_packing"]
    before, after = dict(rows(fourth)), dict(rows(fifth))
    assert set(before) == set(after) and sum(before[i] != after[i] for i in before) >= 1
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {}
    for r in docs.collect():
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert lengths == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in after.items()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
