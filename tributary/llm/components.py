"""Connected components of a table of edges, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, counted, join_counted

#: So many edges, counted, and fewer are closed in one task; more are contracted further.
LAST_EDGES = 10_000


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, to) of the nodes of at most LAST_EDGES edges: the smallest node that each reaches, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["rep", "to"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of each node of edges (a, b): the smallest node that it reaches.

    Each round every node joins its first neighbour, if that comes before itself, and that one's own choice; then edges run between what nodes have
    become, and those within one node go. First is by id in even rounds, which closes stars at once, and by a hash in odd ones, which
    shortens paths by a factor. So edges shrink from round to round, and when few are left one task closes them. Rounds are written to the
    checkpoint folder; the driver only learns how many edges are left, counted as they are written. No edges, no rows.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, left = counted(both)
    if left <= LAST_EDGES:
        return checkpoint(_closed(both).toDF("id", "component"))
    nodes, turn = None, 0
    while left > LAST_EDGES:
        order = lambda c, t=turn: F.struct((F.xxhash64(F.lit(t), F.col(c)) if t % 2 else F.lit(0).cast("long")).alias("h"), F.col(c).alias("id"))
        chosen = both.groupBy("a").agg(F.min(order("b")).alias("first")).select(F.col("a").alias("rep"), F.least(F.col("first"), order("a"))["id"].alias("to"))
        second = chosen.select(F.col("rep").alias("to"), F.col("to").alias("next"))
        chosen = checkpoint(chosen.join(second, "to").select("rep", F.col("next").alias("to")))
        nodes = chosen.toDF("id", "rep") if nodes is None else checkpoint(_moved(nodes, chosen))
        from_a = both.join(chosen.withColumnRenamed("rep", "a"), "a").select(F.col("to").alias("a"), "b")
        both, left = counted(from_a.join(chosen.withColumnRenamed("rep", "b"), "b").select("a", F.col("to").alias("b")).where("a <> b").distinct())
        turn += 1
    if left:
        nodes = _moved(nodes, _closed(both))
    if turn == 1:
        # Only rounds by hash leave a component's smallest node.
        return checkpoint(nodes.toDF("id", "component"))
    nodes = checkpoint(nodes)
    # Written, as a join with the aggregate itself would take its partitioning over and bring a large component to one task.
    least = checkpoint(nodes.groupBy("rep").agg(F.min("id").alias("component"), F.count("*").alias("n")))
    return checkpoint(join_counted(nodes, least, ["rep"]).select("id", "component"))


def _closed(both: DataFrame) -> DataFrame:
    return both.repartition(1).mapInArrow(_close, "rep long, to long")


def _moved(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """nodes (id, rep) after what they have become so far has become something else, as chosen (rep, to) says."""
    return nodes.join(chosen, "rep", "left").select("id", F.coalesce("to", "rep").alias("rep"))


def with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """found, components (id, component), after further links (a, b), also of nodes that aren't in it. Only what the links lead to is contracted anew."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(found.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    merged = connected_components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    new = merged.select("id", F.col("id").alias("rep")).join(found, "id", "left_anti")
    return checkpoint(_moved(found.toDF("id", "rep").union(new), merged.toDF("rep", "to")).toDF("id", "component"))
