import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tributary.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(rows, capacity=2048):
    """Checks that sequences are filled without gap from 0; returns how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_is_best_fit_decreasing():
    random.seed(3)
    for _ in range(200):
        capacity = random.choice([7, 20, 64])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(1, 80))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        rows = []
        for length, rank, many, sequence, offset in packing.plan(counts, capacity):
            rows += [{"sequence_id": sequence + k, "offset": offset, "length": length, "rank": rank + k} for k in range(many)]
        assert sorted((r["length"], r["rank"]) for r in rows) == sorted((x, k) for x, n in counts.items() for k in range(n))
        room = []
        for x in sorted(lengths, reverse=True):  # one piece at a time
            fits = [k for k, r in enumerate(room) if r >= x]
            if fits:
                room[min(fits, key=lambda k: room[k])] -= x
            else:
                room.append(capacity - x)
        assert placed(rows, capacity) == len(room)


def test_pack_documents(documents):
    random.seed(1)
    texts = [None, "", " \n\t ", "Éa b|c <|endoftext|> it's 12", "word " * 5000, "a\x1cb　c\xa0d é", *(" ".join(random.choices(["alpha", "Beta", "x1", "ñu"], k=random.randint(1, 900))) for _ in range(60))]
    docs = documents(list(enumerate(texts)) + [(3, texts[3])])
    got = [r.asDict() for r in packing.pack_documents(docs, PATH).collect()]
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, text in [*enumerate(texts), (3, texts[3])]:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == sorted(want)
    total = sum(r["length"] for r in got)
    assert placed(got) <= -(-total // 2048) + 1


def test_empty_table(documents):
    out = packing.pack_documents(documents([]), PATH)
    assert out.collect() == [] and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
