"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes log-count ratios.

Indicators are hashed: words, pairs of neighbouring words, and runs of one to four word shapes (how a word begins and ends, whether it is in capitals,
whether it repeats the word before). Each is multiplied by the logarithm of its smoothed count in one class over that
in the other; dual coordinate descent then fits the weights. The model is an array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpoint, chunks, joined, keep_only, mix, word_hashes, words

BITS = 18
#: The classifier is fitted on at most so many labelled rows of each class, those whose hashed id is smallest.
ROWS_PER_CLASS = 3000
#: And on no more of them than have so many indicators together in a class: what comes to the driver.
FEATURES_PER_CLASS = 8_000_000
LONGEST_RUN = 4


def indicators(data: np.ndarray, starts: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, of texts that begin at `starts` in data."""
    begins, ends, of_text = words(data, starts)
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(of_text))
    same_text = np.concatenate([[False], text[1:] == text[:-1]])
    spelt = word_hashes(data, begins, ends)
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    large = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower, upper = small[ends] - small[begins], large[ends] - large[begins]
    repeats = same_text & np.concatenate([[False], spelt[1:] == spelt[:-1]])

    def kind(b: np.ndarray) -> np.ndarray:
        """Letters and digits by class, other bytes as they are."""
        letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
        return np.where(letter, 1, np.where((b >= 48) & (b <= 57), 2, b)).astype(np.uint64)

    shape = kind(data[begins]) | (kind(data[ends - 1]) << np.uint64(8)) | (((upper > 1) & (lower == 0)).astype(np.uint64) << np.uint64(16))
    shape = mix(shape | (repeats.astype(np.uint64) << np.uint64(17)) | (((upper == 1) & (lower > 0)).astype(np.uint64) << np.uint64(18)) | np.uint64(1 << 20))
    found = [(text << bits) | (spelt >> np.uint64(64 - bits)).astype(np.int64)]
    neighbours = same_text[1:]
    found.append((text[1:][neighbours] << bits) | (joined(spelt[:-1], spelt[1:])[neighbours] >> np.uint64(64 - bits)).astype(np.int64))
    run = shape
    for n in range(1, LONGEST_RUN + 1):
        if n > 1:
            run = mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[n - 1 :])
        whole = text[: len(run)] == text[n - 1 :]
        found.append((text[: len(run)][whole] << bits) | (run[whole] >> np.uint64(64 - bits)).astype(np.int64))
    pairs = np.unique(np.concatenate([np.unique(f) for f in found]))
    return pairs >> bits, pairs & ((1 << bits) - 1)


@dataclass
class Model:
    scale: np.ndarray  # log-count ratios
    weights: np.ndarray
    bias: float

    def margins(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        scaled = self.scale[feature]
        size = np.sqrt(np.bincount(text, scaled * scaled, n))
        return np.bincount(text, scaled * self.weights[feature], n) / np.maximum(size, 1e-9) + self.bias


def fit(rows: list[np.ndarray], good: np.ndarray, bits: int = BITS, cost: float = 1.0, rounds: int = 30, smoothing: float = 1.0) -> Model:
    """rows: each document's features; good: whether it is of the class that a positive margin stands for.

    Without rows of both classes the model has no weights and its bias is the sign of the class that there is, or 0.
    """
    size = 1 << bits
    if good.all() or not good.any():
        return Model(np.zeros(size), np.zeros(size), 0.0 if not len(good) else 1.0 if good.all() else -1.0)
    counts = [np.full(size, float(smoothing)) for _ in range(2)]
    for count, which in zip(counts, (True, False), strict=True):
        own = [r for r, g in zip(rows, good, strict=True) if g == which]
        for k in range(0, len(own), 200):
            count += np.bincount(np.concatenate(own[k : k + 200]), minlength=size)
    scale = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    scale[(counts[0] + counts[1]) <= 2 * smoothing + 1] = 0  # seen once or never
    values = []
    for r in rows:
        v = scale[r]
        values.append((v / max(1e-9, np.sqrt(v @ v))).astype(np.float32))
    weights, bias = np.zeros(size), 0.0
    dual = np.zeros(len(rows))
    sign = np.where(good, 1.0, -1.0)
    most = np.where(good, cost * len(good) / (2 * good.sum()), cost * len(good) / (2 * (~good).sum()))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, f = values[i], rows[i]
            norm = float(x @ x) + 1.0  # the bias is a feature of value 1
            gradient = sign[i] * (float(weights[f] @ x) + bias) - 1
            new = min(max(dual[i] - gradient / norm, 0.0), most[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weights[f] += step * x
                bias += step
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return Model(scale, weights, bias)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that the classifier never learns from."""
    return F.crc32(F.col(id_column).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_class: int = ROWS_PER_CLASS, bits: int = BITS, features_per_class: int = FEATURES_PER_CLASS) -> Model:
    """The model for labels.<label>, from labelled rows that aren't held out; at most rows_per_class of each class, whole texts, and no more once these have features_per_class indicators.

    An id labelled more than once counts with its smallest label; of texts repeated under one id that with the smallest hash counts. Null labels and ids are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"))
    sample = None
    for which in (0, 1):
        some = known.where(F.col("label") == which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        sample = some if sample is None else sample.unionByName(some)
    # At most 2 * rows_per_class ids and labels: the bound of this broadcast.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, starts in chunks(batch.column(1)):
                text, feature = indicators(data, starts, bits)
                places = pa.array(np.searchsorted(text, np.arange(last - first + 1)), pa.int32())
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.ListArray.from_arrays(places, pa.array(feature, pa.int32()))], ["doc_id", "label", "hash", "features"])

    found = texts.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int"), F.xxhash64("text").alias("hash")).mapInArrow(features, "doc_id long, label int, hash long, features array<int>")
    found = checkpoint(found.groupBy("doc_id").agg(F.min_by(F.struct("label", "features"), "hash").alias("f")).select("doc_id", "f.*"))
    # A row for each of the sample's documents, at most rows_per_class to a class.
    sizes = found.select("doc_id", "label", F.size("features").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")) - F.col("n")
    taken = sizes.withColumn("before", before).where(F.col("before") < features_per_class).select("doc_id")
    got = found.join(F.broadcast(taken), "doc_id", "left_semi").toArrow()
    lists = [row for chunk in got["features"].chunks for row in _views(chunk)]
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    return fit([lists[i] for i in order], got["label"].to_numpy()[order] == 1, bits)


def _views(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists as arrays, without copies."""
    flat, places = lists.values.to_numpy(), lists.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(places, places[1:], strict=False))


def score_documents(docs: DataFrame, model: Model, bits: int = BITS, keep: tuple[str, ...] = ("doc_id",), score_column: str = "score") -> DataFrame:
    """The `keep` columns of docs, whatever their names, and score_column (0 to 1), which must be none of them. Null and empty texts have the score of no features at all."""
    if score_column.lower() in [k.lower() for k in keep]:
        raise ValueError(f"{score_column} is a column that is to be kept")
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.scale.astype(np.float32), model.weights.astype(np.float32), model.bias))
    own_names = [f"c{k}" for k in range(len(keep))]  # a frame's columns come to Python by names without dots

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("quality")
        for batch in batches:
            for first, last, data, starts in chunks(batch.column(len(keep))):
                text, feature = indicators(data, starts, bits)
                margin = shared.value.margins(text, feature, last - first)
                own = [batch.column(k).slice(first, last - first) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(1 / (1 + np.exp(-3 * margin)))], [*own_names, "score"])

    narrow = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own_names, strict=True)], F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(score, T.StructType([*narrow.schema.fields[:-1], T.StructField("score", T.DoubleType())])).toDF(*keep, score_column)
