import math
import random
import re
from collections import Counter

import pytest

from tributary.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k=10):
    split = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in split:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(1, total)
            score = 0
            for t in terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(docs, items, k=10):
    found = lexical.search(docs, items, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def planted(n=150):
    random.seed(6)
    vocabulary = [f"w{i}é" if i % 3 else f"W{i}" for i in range(60)]
    # The first words are in nearly all documents.
    text = lambda size: " ".join(vocabulary[min(int(random.expovariate(0.12)), 59)] for _ in range(size))
    rows = [(i, text(random.randint(0, 60))) for i in range(n)]
    rows += [(500, None), (501, ""), (502, "-- !"), rows[3], (4, rows[7][1]), (None, rows[8][1]), (None, text(30)), (503, text(5000))]
    rows += [(600 + i, rows[1][1]) for i in range(40)]  # ties
    items = [(i, text(random.randint(1, 30))) for i in range(25)] + [(30, None), (31, ""), (32, "unknown"), (3, text(4)), (None, text(6)), (33, "w1é " * 9), (34, rows[1][1])]
    return rows, items


def test_random(documents, benchmark):
    rows, items = planted()
    want = brute(rows, items)
    assert run(documents(rows).repartition(5), benchmark(items)) == want
    assert len(want) > 200


def test_small_shards_and_blocks(documents, benchmark, monkeypatch):
    rows, items = planted()
    monkeypatch.setattr(lexical, "SHARD_DOCUMENTS", 16)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 15)
    assert run(documents(rows).repartition(3), benchmark(items)) == brute(rows, items)


def test_bundles_lose_what_cannot_win(documents, benchmark, monkeypatch):
    """With few places most documents leave on the way, and the best stay."""
    rows, items = planted()
    assert run(documents(rows), benchmark(items), 2) == brute(rows, items, 2)


def test_owners():
    import numpy as np

    df = np.array([5, 1, 900, 30, 30, 34])
    owners = lexical._owners(df)
    assert owners[2] == max(owners) and owners[1] == 0 and all((owners[a] <= owners[b]) for a in range(6) for b in range(6) if df[a] < df[b])


def test_empty(documents, benchmark):
    assert run(documents([]), benchmark([(1, "a b")])) == []
    assert run(documents([(1, "a b")]), benchmark([])) == []
    assert run(documents([(1, None)]), benchmark([(1, "a")])) == []
