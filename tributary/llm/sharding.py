"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table. Shards take turns, each claiming the
slot that it likes best among those still free, until the table is full. So each shard has as many slots as any other, to
within one, and when a shard goes, few slots of the others change hands. The table is as large as its prime and
no larger, so it can be broadcast: a row finds its shard with one hash and one lookup, without any shuffle of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Prime number of slots; a hundred slots or more for each shard keep the shares within one percent.
SLOTS = 65_537


def _number(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{text}".encode(), digest_size=8).digest(), "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot the index of the shard that claims it."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} isn't prime")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one and not more than slots")
    place = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    claimed = 0
    while True:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            owner[place[i]] = i
            claimed += 1
            if claimed == slots:
                return np.array(owner, np.int32)


def slot_of(keys: Sequence[str], slots: int = SLOTS) -> Column:
    """The slot of a row's key columns. Nulls hash like any other value: rows with the same key share a slot."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(slots)).cast("int")


def assign_shards(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row. Columns of those names in df are replaced; an empty df stays empty.

    Equal keys get equal shards, repeated rows included. The table (slots rows, fixed) is broadcast; df isn't shuffled.
    """
    owner = lookup_table(shards, slots)
    rows = [(i, shards[s]) for i, s in enumerate(owner.tolist())]
    lookup = df.sparkSession.createDataFrame(rows, f"`{slot_column}` int, `{shard_column}` string")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_column, shard_column)]
    placed = df.select(*kept, slot_of(keys, slots).alias(slot_column))
    out = placed.join(F.broadcast(lookup), slot_column, "left")
    return out.select(*kept, slot_column, shard_column)


def write_shards(df: DataFrame, path: str, shard_column: str = "shard", rows_per_file: int = 1_000_000) -> None:
    """One folder for each shard, in files of about rows_per_file rows.

    A shard's rows, counted first, are dealt out over as many tasks as it gets files, by the partitions that they come from, so that neither a shard nor a
    row that is there very often goes to one task whole. An empty df writes no shard.
    """
    shard, files, place = unused(df.columns, "shard_of_files", "files", "place")
    sizes = df.groupBy(shard_column).agg(F.count("*").alias("n"))
    parts = sizes.select(F.col(shard_column).alias(shard), F.ceil(F.col("n") / rows_per_file).cast("long").alias(files))  # a row for each shard
    joined = df.withColumn(place, F.spark_partition_id()).join(F.broadcast(parts), F.col(f"`{shard_column}`").eqNullSafe(F.col(shard)))
    dealt = joined.withColumn(place, F.pmod(F.col(place), F.col(files)))
    tasks = max(1, parts.agg(F.sum(files)).head()[0] or 1)
    dealt.repartition(tasks, F.col(f"`{shard_column}`"), F.col(place)).drop(shard, files, place).write.option("maxRecordsPerFile", rows_per_file).partitionBy(shard_column).parquet(path)
