import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tributary.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    random.seed(5)
    parts = ["a", "Bc", "é", "ß", "日本", " ", "  ", "\n", "\t", " ", "　", "'", "''", "'s", "'t", "'re", "'ll", "'ve", "'l", "'r", "'S", "12", "²", "½", ".", "...", "!?", "_", "\U0001f600", "́", "\x1c", "\x85", "<|endoftext|>", "\x00"]
    made = ["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(1500)]
    return ["", None, " ", "  ", "'", "it's 's'same we'll  've", "x" * 3000, "-=" * 5000, " \n\n a", "a \n", *made, "long text it's " * 20_000, made[0]]


def test_as_the_library(documents, library):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in bpe.encode_documents(documents(rows), PATH).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i]["ids"] == library.encode_ordinary(text or ""), repr(text)[:200]
        sizes = [len(library.decode_single_token_bytes(t)) for t in got[i]["ids"]]
        assert got[i]["ends"] == [sum(sizes[: k + 1]) for k in range(len(sizes))] if len(sizes) < 3000 else got[i]["ends"][-1] == sum(sizes)


def test_decoding(documents):
    rows = list(enumerate(texts()))
    back = bpe.decode_documents(bpe.encode_documents(documents(rows), PATH), PATH)
    got = {r["doc_id"]: r["h"] for r in back.select("doc_id", F.sha2("decoded", 256).alias("h")).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}


def test_empty(documents):
    assert bpe.decode_documents(bpe.encode_documents(documents([]), PATH), PATH).collect() == []


def test_merger():
    random.seed(9)
    merger = bpe.Merger(bpe.load_ranks(PATH))
    pieces = list({bytes(random.choices(b"aeinrst \xc3\xa9", k=random.randint(1, 70))) for _ in range(3000)})
    assert {p: list(memoryview(ids).cast("i")) for p, ids in merger.merge(pieces).items()} == {p: bpe.merge(p, merger.ranks) for p in pieces}
    assert merger.merge([]) == {}


def test_spans(documents):
    rows = [(i, t) for i, t in enumerate(texts()[:200]) if t is None or len(t) < 100]
    encoded = bpe.encode_documents(documents(rows), PATH)
    asked = encoded.select("doc_id", "ids", "ends", F.posexplode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 7), (3, 4), (2, 60), (5, 5), (-4, 2), (900, 1000), (None, 3))))).alias("k", "s"))
    got = bpe.decode_spans(asked.select("doc_id", "ids", "ends", F.col("s.a").alias("start"), F.col("s.b").alias("stop")), PATH).collect()
    raw = {i: (t or "").encode() for i, t in rows}
    assert len(got) == 7 * len(rows)
    assert all(bytes(r["decoded"]) == (b"" if r["start"] is None else raw[r["doc_id"]][max(0, r["start"]) : max(0, r["stop"])]) for r in got)
