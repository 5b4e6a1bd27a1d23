"""Exchanges of hashed keys as blocks.

A Python task turns a batch of documents into millions of (key, numbers) entries. As rows these would cost far more than their bytes, so
the entries of a batch that go to one bucket travel as one row of arrays; Spark deals the rows by bucket and gives a task one
bucket at a time. A bucket is a range of keys. Buckets grow in number with spark.sql.shuffle.partitions, so that setting bounds their size.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import partitions


def bucket_count(spark: SparkSession) -> int:
    return max(1024, 4 * partitions(spark))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of equal width; keys are uniform 64-bit hashes."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


_ID_SHIFTS = (5, 11, 23, 41)


def id_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The same as id_bucket_column."""
    bits = ids.astype(np.int64).view(np.uint64)
    folded = bits.copy()
    for shift in _ID_SHIFTS:
        folded ^= bits >> np.uint64(shift)
    return (folded.view(np.int64) % buckets).astype(np.int32)


def id_bucket_column(ids: Column, buckets: int) -> Column:
    """Even for ids that count up, and for those that do so in steps."""
    folded = ids
    for shift in _ID_SHIFTS:
        folded = folded.bitwiseXOR(F.shiftrightunsigned(ids, shift))
    return F.pmod(folded, F.lit(buckets).cast("long")).cast("int")


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: small numbers then compress well."""
    wide = np.ascontiguousarray(values)
    return wide.view(np.uint8).reshape(len(wide), -1).T.tobytes()


def unplanes(data: bytes, dtype: str | np.dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def blocks(bucket: np.ndarray, columns: dict[str, np.ndarray], constant: dict[str, int] | None = None) -> pa.RecordBatch:
    """A row for each bucket that has entries: bucket, the constants, and each column's values there."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    arrays = [pa.array(bucket[cuts[:-1]], pa.int32())]
    arrays += [pa.array(np.full(len(cuts) - 1, v), pa.int32()) for v in (constant or {}).values()]
    for values in columns.values():
        dealt = values[order]
        arrays.append(pa.array([planes(dealt[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *(constant or {}), *columns])


def entries(blobs: Iterable, dtype: str | np.dtype) -> np.ndarray:
    """The values of a column of blocks, one block after another."""
    parts = [unplanes(b, dtype) for b in blobs if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
