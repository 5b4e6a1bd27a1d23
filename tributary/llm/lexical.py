"""Ranked lexical search by pipelined term partitioning.

The postings of the items' terms are dealt to term owners, the rarest terms to the first one, in shares of about equal size, and within an owner to shards
of documents. Each shard has a bundle for each item: a sparse accumulator of scores, by document. The bundles go through the owners, one
stage after another: a cogroup brings a shard's bundles together with the owner's postings there, and the owner adds the integer contributions of its terms. A
bundle also carries what the owners to come can still add at most. So documents that can't be among the shard's best any more leave, and none
joins that can't become one; with equal scores allowed, this loses nothing. The last stage gives each shard's best, and these are merged.

Shards bound what a task holds, whatever a term's number of documents: a bundle has at most SHARD_DOCUMENTS scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpoint, chunks, keep_only, terms, text_bytes
from .exchange import planes, unplanes

#: Stages that a bundle goes through.
OWNERS = 4
#: Documents of a shard, fewer where a block has many items: a shard has at most SHARD_SCORES scores in all its bundles.
SHARD_DOCUMENTS, SHARD_SCORES = 8192, 1 << 24
#: Bytes of items' texts, and items, that are searched for in one go.
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 1 << 13

_INDEX = "shard long, n_docs long, n_terms long, doc_ids binary, known binary, sizes binary, docs binary, terms binary, times binary"
_DEALT = "shard long, owner int, docs binary, terms binary, parts binary, doc_ids binary, known binary, rest binary"
_BUNDLES = "shard long, doc_ids binary, known binary, rest binary, items binary, docs binary, scores binary"


class Items:
    """A block of items as bags of terms: `terms` (sorted hashes of all terms), and item by item the places of its terms there, with how often it has each; `begins` says where each item's begin."""

    def __init__(self, texts: list[str | None]):
        hashes, of_text = terms(*text_bytes(pa.array(texts, pa.string())))
        self.n = len(texts)
        self.terms, term = np.unique(hashes, return_inverse=True)
        base = max(1, len(self.terms))
        pair, self.times = np.unique(np.repeat(np.arange(self.n), np.diff(of_text)) * base + term, return_counts=True)
        self.item, self.term = pair // base, pair % base
        self.begins = np.searchsorted(self.item, np.arange(self.n + 1))


def _packed(values: np.ndarray, dtype: str) -> bytes:
    return planes(values.astype(dtype)) if len(values) else b""


def _unpacked(data: bytes | None, dtype: str) -> np.ndarray:
    return unplanes(data or b"", dtype).astype(np.int64)


def _indexed(docs: DataFrame, wanted: np.ndarray, n_items: int) -> DataFrame:
    """A row for each shard: its documents' ids and numbers of terms, and the postings of the wanted terms, by document; n_docs and n_terms count documents with a term, and all terms."""
    most = min(SHARD_DOCUMENTS, max(64, SHARD_SCORES // max(1, n_items)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("lexical")
        held: list[tuple[np.ndarray, ...]] = []
        place = TaskContext.get().partitionId() << 33

        def shard(parts: list[tuple[np.ndarray, ...]], number: int) -> pa.RecordBatch:
            ids, known, sizes, doc, term, times = zip(*parts, strict=True)
            before = np.cumsum([0, *map(len, ids)])
            doc = [d + b for d, b in zip(doc, before, strict=False)]
            sizes = np.concatenate(sizes)
            columns = zip((np.concatenate(ids), np.concatenate(known), sizes, *map(np.concatenate, (doc, term, times))), ("i8", "u1", "i8", "u2", "u4", "u4"), strict=True)
            counts = [number, int((sizes > 0).sum()), int(sizes.sum())]
            return pa.RecordBatch.from_arrays([*(pa.array([c], pa.int64()) for c in counts), *(pa.array([_packed(*c)], pa.binary()) for c in columns)], [c.split()[0] for c in _INDEX.split(", ")])

        n = 0
        for batch in batches:
            for first, last, data, starts in chunks(batch.column(1)):
                hashes, of_text = terms(data, starts)
                at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == hashes) if len(wanted) else np.zeros(0, np.int64)
                doc = np.searchsorted(of_text, hit, "right") - 1
                pair, times = np.unique(doc * max(1, len(wanted)) + at[hit], return_counts=True)
                doc, term = pair // max(1, len(wanted)), pair % max(1, len(wanted))
                own = batch.column(0).slice(first, last - first)
                ids, known, sizes = own.fill_null(0).to_numpy(), ~own.is_null().to_numpy(zero_copy_only=False), np.diff(of_text)
                for a in range(0, last - first, most):
                    b = min(last - first, a + most)
                    if held and n + b - a > most:
                        yield shard(held, place)
                        held, n, place = [], 0, place + 1
                    x, y = np.searchsorted(doc, [a, b])
                    held.append((ids[a:b], known[a:b], sizes[a:b], doc[x:y] - a, term[x:y], times[x:y]))
                    n += b - a
        if held:
            yield shard(held, place)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(index, _INDEX)


def _frequencies(index: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of n terms is; as many rows as terms come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("lexical")
        total = np.zeros(n, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.bincount(_unpacked(blob, "u4"), minlength=n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "n"])

    out = np.zeros(n, np.int64)
    for r in index.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term, in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


def _owners(df: np.ndarray) -> np.ndarray:
    """Each term's owner: the rarest terms are the first one's, and all have about as many postings."""
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    out = np.empty(len(df), np.int64)
    out[order] = before * OWNERS // max(1, int(df.sum()))
    return out


def _deal(index: DataFrame, items: Items, weights: np.ndarray, owners: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """For each shard a row for each owner, with its postings' contributions for one occurrence in an item, and one of owner -1, with what each owner can add to each item at most."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("lexical")
        for batch in batches:
            for row in batch.to_pylist():
                sizes, doc, term, times = (_unpacked(row[c], k) for c, k in (("sizes", "i8"), ("docs", "u2"), ("terms", "u4"), ("times", "u4")))
                m = 25 + (75 * sizes * n_docs) // max(1, n_terms)
                part = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
                order = np.argsort(term, kind="stable")
                doc, term, part = doc[order], term[order], part[order]
                most = np.zeros(len(items.terms), np.int64)
                np.maximum.at(most, term, part)
                rest = np.zeros((OWNERS, items.n), np.int64)
                np.add.at(rest, (owners[items.term], items.item), items.times * weights[items.term] * most[items.term])
                out = [(row["shard"], -1, None, None, None, row["doc_ids"], row["known"], _packed(rest.ravel(), "i8"))]
                for owner in range(OWNERS):
                    own = owners[term] == owner
                    out.append((row["shard"], owner, _packed(doc[own], "u2"), _packed(term[own], "u4"), _packed(part[own], "u4"), None, None, None))
                kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 6)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _DEALT.split(", ")])

    return index.mapInArrow(deal, _DEALT)


def _best(score: np.ndarray, most: int) -> int:
    """The score that a document must at least be able to reach: the most-th best so far, or 1."""
    return max(1, int(np.partition(score, len(score) - most)[len(score) - most])) if len(score) >= most else 1


def _stage(owner: int, items: Items, weights: np.ndarray, k: int):
    """A cogroup's function: a shard's bundles, and this owner's postings there, to the bundles with what the owner adds."""

    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        keep_only("lexical")
        names = [c.split()[0] for c in _BUNDLES.split(", ")]
        if not len(bundles):
            return pa.table({n: pa.array([], pa.int64() if n == "shard" else pa.binary()) for n in names})
        row = bundles.to_pylist()[0]
        rest = _unpacked(row["rest"], "i8").reshape(OWNERS, items.n)
        later = rest[owner + 1 :].sum(axis=0)
        held = [_unpacked(row[c], t) for c, t in (("items", "u4"), ("docs", "u2"), ("scores", "i8"))]
        cuts = np.searchsorted(held[0], np.arange(items.n + 1))
        (owned,) = postings.to_pylist()
        doc, term, part = (_unpacked(owned[c], t) for c, t in (("docs", "u2"), ("terms", "u4"), ("parts", "u4")))
        n_docs = len(row["known"])
        low, high = np.searchsorted(term, items.term, "left"), np.searchsorted(term, items.term, "right")
        out = []
        for item in range(items.n):
            score = np.zeros(n_docs, np.int64)
            score[held[1][cuts[item] : cuts[item + 1]]] = held[2][cuts[item] : cuts[item + 1]]
            best = _best(score[score > 0], k)
            before = score > 0
            for at in range(items.begins[item], items.begins[item + 1]):
                a, b = low[at], high[at]
                if a < b:
                    score[doc[a:b]] += items.times[at] * weights[items.term[at]] * part[a:b]
            # One that no owner before has met can reach what this one and the later ones give at most.
            if rest[owner, item] + later[item] < best:
                score[~before] = 0
            best = max(best, _best(score[score > 0], k))
            stay = np.flatnonzero((score > 0) & (score + later[item] >= best))
            out.append((np.full(len(stay), item), stay, score[stay]))
        new = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        sent = [_packed(x, t) for x, t in zip(new, ("u4", "u2", "i8"), strict=True)]
        return pa.table([pa.array([row["shard"]], pa.int64()), *(pa.array([c], pa.binary()) for c in (row["doc_ids"], row["known"], row["rest"], *sent))], names=names)

    return add


def _told(k: int):
    """The best k of each bundle: (item, doc_id, score); of equal scores the smallest ids, null ids last."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("lexical")
        for batch in batches:
            for row in batch.to_pylist():
                ids, known = _unpacked(row["doc_ids"], "i8"), _unpacked(row["known"], "u1") > 0
                item, doc, score = (_unpacked(row[c], t) for c, t in (("items", "u4"), ("docs", "u2"), ("scores", "i8")))
                order = np.lexsort((ids[doc], ~known[doc], -score, item))
                item, doc, score = item[order], doc[order], score[order]
                good = np.arange(len(item)) - np.searchsorted(item, item) < k
                doc = doc[good]
                yield pa.RecordBatch.from_arrays([pa.array(item[good].astype(np.int32)), pa.array(ids[doc], pa.int64(), mask=~known[doc]), pa.array(score[good])], ["item", "doc_id", "score"])

    return tell


def _search(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame | None:
    """(item, doc_id, score): of each shard the best k for each item of a block; None if no item has a term."""
    items = Items(texts)
    if not len(items.terms):
        return None
    index = checkpoint(_indexed(docs, items.terms, items.n))
    counts = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).head()
    n_docs, n_terms = counts["n"] or 0, counts["l"] or 0
    df = _frequencies(index, len(items.terms))
    weights, owners = _weights(df, n_docs), _owners(df)
    dealt = checkpoint(_deal(index, items, weights, owners, n_docs, n_terms))
    empty = F.lit(None).cast("binary")
    bundles = dealt.where("owner = -1").select("shard", "doc_ids", "known", "rest", empty.alias("items"), empty.alias("docs"), empty.alias("scores"))
    for owner in range(OWNERS):
        postings = dealt.where(F.col("owner") == owner).select("shard", "docs", "terms", "parts")
        bundles = bundles.groupBy("shard").cogroup(postings.groupBy("shard")).applyInArrow(_stage(owner, items, weights, k), _BUNDLES)
    return bundles.mapInArrow(_told(k), "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best rows of docs (doc_id, text) for each row of items (item_id, text); fewer if fewer have a score above 0.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased, told apart by 64-bit hashes. With N documents that hold a term, L terms in all of them, n in one, df documents
    that hold a term and tf occurrences, a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a document's score sums w * ((10^9 tf) div (1000 tf + 8 m)),
    m = 25 + (75 n N) div L, over the item's terms, repeats included. Equal scores go by doc_id, null ids last. Null and empty texts have no terms. Rows repeated under one id are documents, and
    items, of their own. Items come in blocks of bounded size, each searched for in all documents.
    """
    known = items.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    counts = known.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n")).head()
    blocks = max(1, -(-(counts["bytes"] or 0) // BLOCK_BYTES), -(-counts["n"] // BLOCK_ITEMS))
    spark, found = docs.sparkSession, []
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        hits = _search(docs, [r["text"] for r in rows], k)
        if hits is not None:
            ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), items.schema["item_id"]]))
            best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            found.append(hits.withColumn("rank", best).where(F.col("rank") <= k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.union, found)
