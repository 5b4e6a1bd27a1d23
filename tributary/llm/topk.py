"""Exact top-k inner products by MaxScore.

A component of a vector is a term, and the vectors in which it helps a query's score are its postings. In a shard each term has a bound:
the most that it can add to the query's score there. Terms are taken by bound, largest first; those at the end whose bounds together can't
reach the score of the k-th best so far are non-essential. Only vectors in the postings of an essential term are candidates, and a candidate is
probed in the other terms only while its score so far plus the bounds still to come is competitive. The k-th best score of a first shard counts in
all of them from the start. Shards' results are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint

#: Vectors of a shard and queries of a block: what a task holds at once.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
#: Vectors after which the k-th best score is looked at again, and terms probed at once.
STEP, PROBES = 2048, 8


def quantised(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """id and v: floor(scale * x) of each component. Null ids, null vectors, and vectors with a null or non-finite component are left out."""
    x = F.transform(F.col(f"`{vector_column}`"), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    wanted = F.col(f"`{id_column}`").isNotNull() & F.col(f"`{vector_column}`").isNotNull()
    return vectors.where(wanted).where(~bad).select(F.col(f"`{id_column}`").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row of numbers for each vector; shorter ones are filled up with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Shard:
    """Vectors as rows of terms, with each term's postings: the places of the vectors in which it is positive, and of those in which it is negative, step by step."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.most, self.least = vectors.max(axis=1, initial=0), vectors.min(axis=1, initial=0)
        self.steps = []
        for start in range(0, vectors.shape[1], STEP):
            block = vectors[:, start : start + STEP]
            self.steps.append((start, block, [np.flatnonzero(row > 0) for row in block], [np.flatnonzero(row < 0) for row in block]))


def max_score(shard: Shard, query: np.ndarray, own: int, k: int, floor: float | None = None) -> list[tuple[int, int]]:
    """The k best (score, id) of a shard. Vectors with the query's own id take no part; those below the floor may be left out."""
    most = np.maximum(0, np.maximum(query * shard.most, query * shard.least))
    terms = np.argsort(-most, kind="stable")
    weights, most = query[terms], most[terms]
    rest = np.concatenate([np.cumsum(most[::-1])[::-1], [0]])  # rest[t]: bounds of the terms from t on
    best_scores, best_ids = np.zeros(0, shard.vectors.dtype), np.zeros(0, np.int64)
    for start, block, positive, negative in shard.steps:
        ids = shard.ids[start : start + STEP]
        known = [x for x in (floor, best_scores[-1] if len(best_scores) == k else None) if x is not None]
        least = max(known, default=None)
        if least is None or least <= 0:  # every term is essential, and vectors in no postings count too
            candidates = np.flatnonzero(ids != own)
            scores = query @ block[:, candidates]
        else:
            essential = int(np.searchsorted(-rest, -least, "right"))  # the first term from which on the bounds stay below the least score that counts
            met = np.zeros(block.shape[1], bool)
            for t, weight in zip(terms[:essential].tolist(), weights[:essential].tolist(), strict=True):
                if weight:
                    met[(positive if weight > 0 else negative)[t]] = True
            candidates = np.flatnonzero(met & (ids != own))
            scores, t = weights[:essential] @ block[terms[:essential, None], candidates], essential
            while True:
                good = scores + rest[t] >= least
                candidates, scores = candidates[good], scores[good]
                if t == len(terms) or not len(candidates):
                    break
                probe = slice(t, t + PROBES)
                scores = scores + weights[probe] @ block[terms[probe][:, None], candidates]
                t = min(len(terms), t + PROBES)
        scores, found_ids = np.concatenate([best_scores, scores]), np.concatenate([best_ids, ids[candidates]])
        order = np.lexsort((found_ids, -scores))[:k]
        best_scores, best_ids = scores[order], found_ids[order]
    return list(zip(best_scores.astype(np.int64).tolist(), best_ids.tolist(), strict=True))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of queries its k highest integer inner products with rows of vectors.

    Ties go to the smaller id; rows with the query's own id take no part; a query has fewer than k rows if there are fewer vectors. Shards and
    blocks of queries have bounded sizes and meet in a grid: each shard goes once to each block. Before that each query meets one shard,
    and its k-th best score there is the least that counts in all others. A query that comes twice
    is answered once. Vectors of different lengths are filled up with zeros. Scores beyond 64 bits are an error.
    """
    v = quantised(vectors, scale, id_column, vector_column)
    q = quantised(queries, scale, id_column, vector_column).groupBy("id").agg(F.first("v").alias("v"))
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    shard_of = v.select("id", "v", deal(shards).alias("shard"))

    def cell(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if len(shard) and len(block):
            order = np.argsort(shard["id"].to_numpy(), kind="stable")
            ids, rows, wanted = shard["id"].to_numpy()[order], _matrix(shard["v"])[order], _matrix(block["v"])
            width = max(rows.shape[1], wanted.shape[1], 1)
            rows, wanted = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (rows, wanted))
            largest = float(np.abs(rows).max()) * float(np.abs(wanted).max()) * width
            if largest >= 2**63:
                raise OverflowError("inner products beyond 64 bits")
            if largest < 2**52:
                rows, wanted = rows.astype(np.float64), wanted.astype(np.float64)  # sums of whole numbers this small are exact
            held = Shard(np.ascontiguousarray(rows.T), ids)
            for query_id, query, floor in zip(block["id"].to_pylist(), wanted, block["floor"].to_pylist(), strict=True):
                out += [(query_id, found, score) for score, found in max_score(held, query, query_id, k, floor)]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    def cells(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, "query_id long, vec_id long, score long")

    asked = q.select("id", "v", F.lit(None).cast("long").alias("floor"), deal(query_blocks).alias("block"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if shards > 1:
        first = cells(shard_of.where("shard = 0").withColumn("block", every(query_blocks)), asked.withColumn("shard", F.lit(0)))
        floors = checkpoint(first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "floor"))
        asked = asked.drop("floor").join(floors, "id", "left")
    found = cells(shard_of.withColumn("block", every(query_blocks)), asked.withColumn("shard", every(shards)))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
