import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import quality


def brute_indicators(text):
    """Words and runs of shapes, by name instead of by hash: how many different ones there are."""
    found, shapes, before = set(), [], None
    for w in text.encode().split():
        kind = lambda b: 1 if chr(b).isascii() and chr(b).isalpha() or b >= 128 else 2 if 48 <= b <= 57 else b
        lower, upper = sum(97 <= b <= 122 for b in w), sum(65 <= b <= 90 for b in w)
        shapes.append((kind(w[0]), kind(w[-1]), upper > 1 and not lower, w == before, upper == 1 and lower > 0))
        found.add(("word", w))
        if before is not None:
            found.add(("pair", before, w))
        before = w
    for n in range(1, 5):
        found |= {tuple(shapes[i : i + n]) for i in range(len(shapes) - n + 1)}
    return len(found)


def test_indicators():
    texts = ["", "One two two TWO, 12 é", "a", "x | y | z", "", "The the the the"]
    raw = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    text, feature = quality.indicators(np.frombuffer(b"".join(raw), np.uint8), starts)
    for i, t in enumerate(texts):
        assert abs((text == i).sum() - brute_indicators(t)) <= 1  # a collision may join two
        alone = quality.indicators(np.frombuffer(raw[i], np.uint8), np.array([0, len(raw[i])]))[1]
        assert np.array_equal(feature[text == i], alone)


def test_dual_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(120)]
    good = np.array([(3 in r or 5 in r) for r in rows])
    model = quality.fit(rows, good, bits=6, rounds=400)
    x = np.zeros((len(rows), 64))
    for i, r in enumerate(rows):
        v = model.scale[r]
        x[i, r] = v / max(1e-9, np.sqrt(v @ v))
    cost = np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))
    y = np.where(good, 1, -1)
    value = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = value(model.weights, model.bias)
    for _ in range(300):  # no better point near by
        assert value(model.weights + rng.normal(0, 0.05, 64), model.bias + rng.normal(0, 0.05)) >= best - 1e-2


def test_documents(spark, documents):
    random.seed(2)
    word = lambda: "".join(random.choices(["an", "er", "th", "ou"], k=random.randint(1, 4)))
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(w + ("***" if bad else "") for w in (word() for _ in range(random.randint(1, 80))))
        rows.append((i, text))
        marks.append((i, 0 if bad else 1, 0))
    rows += [(1000, None), (1001, ""), (1002, "word " * 30_000), rows[1]]
    docs, labels = documents(rows).withColumnRenamed("lang", "score"), spark.createDataFrame([*marks, marks[0], (None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    of = {r["doc_id"]: r["score"] for r in got}
    assert of[1000] == of[1001]
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((of[i] >= 0.5) == (i % 4 != 0) for i in unseen)
    # What is held out is never learnt from: its labels may be anything.
    turned = labels.withColumn("quality", (1 - labels["quality"]) * quality.held_out().cast("int") + labels["quality"] * (~quality.held_out()).cast("int"))
    assert np.array_equal(quality.train(docs, turned).weights, model.weights)


def test_no_labels(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["score"] for r in quality.score_documents(docs, model).collect()] == [0.5, 0.5]
    assert quality.score_documents(documents([]), model).collect() == []


def test_scores_as_plain_python(spark, documents):
    """Counts, ratios, the fit's margin and the score by dictionaries of named indicators; only the weights come from the model."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "Fine", "bad!", "x1", "12", "ABC"] if i % 2 else ["meh", "no", "bad!", "Q"]) for _ in range(rng.randint(1, 30)))) for i in range(90)]
    marks = [(i, i % 2, 0) for i in range(90)]
    docs = documents(rows)
    model = quality.train(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    raw = {i: t.encode() for i, t in rows}
    features = {i: quality.indicators(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[1].tolist() for i, r in raw.items()}
    learnt = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    count = {which: {} for which in (0, 1)}
    for i in learnt:
        for f in features[i]:
            count[i % 2][f] = count[i % 2].get(f, 0) + 1
    total = {which: sum(count[which].values()) + 2**quality.BITS for which in (0, 1)}
    ratio = {f: math.log((count[1].get(f, 0) + 1) / total[1]) - math.log((count[0].get(f, 0) + 1) / total[0]) for f in {*count[0], *count[1]} if count[1].get(f, 0) + count[0].get(f, 0) > 1}
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    for i in raw:
        x = {f: ratio.get(f, 0.0) for f in features[i]}
        size = math.sqrt(sum(v * v for v in x.values()))
        margin = sum(v * model.weights[f] for f, v in x.items()) / max(size, 1e-9) + model.bias
        assert abs(got[i] - 1 / (1 + math.exp(-3 * margin))) < 1e-5


def test_any_names_of_columns_and_bounds(spark, documents):
    docs = documents([(i, "good word" if i % 2 else "bad thing") for i in range(40)] + [(3, "another text")])
    for n in ("score", "__text", "doc", "label", "hash", "features", "a.b"):
        docs = docs.withColumn(n, F.lit(7))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert np.array_equal(model.weights, quality.train(docs.repartition(3), labels).weights)
    out = quality.score_documents(docs, model, keep=tuple(docs.columns), score_column="_score")
    assert out.columns == [*docs.columns, "_score"] and all(tuple(r)[5:-1] == (7,) * 7 for r in out.collect())
    with pytest.raises(ValueError):
        quality.score_documents(docs, model, keep=("score",))
    few = quality.train(docs, labels, features_per_class=1)  # one document of each class
    assert np.count_nonzero(few.weights) <= 20
