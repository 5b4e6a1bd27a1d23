import math
import random

import numpy as np
import pytest

from tributary.llm import topk


def brute(rows, k, every=50):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in good:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, v in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shift", [0.0, -0.5, 0.5])
def test_kernel(shift):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 24)) + shift
    rows = np.floor(64 * (centres[rng.integers(0, 6, 7000)] + rng.normal(0, 0.2, (7000, 24)))).astype(np.int64)
    rows[100:200] = rows[0]
    ids = np.arange(7000) * 3
    shard = topk.Shard(np.ascontiguousarray(rows.T), ids)
    for q in range(0, 7000, 501):
        scores = rows @ rows[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:5]
        want = [(int(scores[i]), int(ids[i])) for i in order]
        assert topk.max_score(shard, rows[q], int(ids[q]), 5) == topk.max_score(shard, rows[q], int(ids[q]), 5, want[-1][0]) == want
        assert [x for x in topk.max_score(shard, rows[q], int(ids[q]), 5, want[2][0]) if x[0] >= want[2][0]] == [x for x in want if x[0] >= want[2][0]]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    random.seed(1)
    make = lambda n: [float(np.float32(random.gauss(0, 1))) for _ in range(n)]
    same = make(8)
    rows = [(i, same if i % 3 == 0 else make(8)) for i in range(400)]
    rows += [(401, None), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (450, []), (500, [1.0]), (None, same), (7, make(8))]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()) == brute(rows, 5)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [-2.0]), (3, [4.0])], "vec_id long, embedding array<float>")
    assert len(topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()) == 4
    assert topk.top_k(df.limit(0), df.limit(0), 5).collect() == []
    assert topk.top_k(df, df.limit(0), 5).collect() == []


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e8]), (1, [1e8])], "vec_id long, embedding array<double>")
    assert topk.top_k(df, df.where("vec_id = 0"), 5, scale=1).collect()[0]["score"] == 10**16
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(df, df.where("vec_id = 0"), 5, scale=256).collect()
