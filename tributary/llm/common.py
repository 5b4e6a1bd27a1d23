"""Helpers that several operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.loops import checkpoint, counted, shared_folder

__all__ = ["checkpoint", "counted", "shared_folder"]

#: Bytes of text that a Python task looks at in one go.
CHUNK_BYTES = 1 << 20

#: What operators keep in a Python worker between tasks, by operator.
kept: dict[str, dict] = {}


def keep_only(operator: str) -> None:
    """Drops what other operators have kept in this worker; workers outlive their tasks, and their memory counts."""
    for name, cache in kept.items():
        if name != operator:
            cache.clear()


def unused(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front of those that are taken, in any case; for columns of an operator's own beside a user's."""
    known = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name.lower() in known:
            name = f"_{name}"
        known.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys of more rows than a part of LISTED of all, and than LEAST_OFTEN, are joined by broadcast: there are at most LISTED of them.
LISTED, LEAST_OFTEN = 65_536, 1 << 20


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with table (keys, n: how many rows each key has, and more), without the n. No task gets a key that many rows have.

    Frequent keys' rows stay where they are; the bound on their number bounds the broadcast, and with it what one key brings to a task of the other join.
    """
    total, most = table.agg(F.sum("n"), F.max("n")).head()
    often = F.col("n") > max(LEAST_OFTEN, (total or 0) // LISTED)
    if (most or 0) <= max(LEAST_OFTEN, (total or 0) // LISTED):
        return rows.join(table.drop("n"), keys)
    listed = F.broadcast(table.where(often).drop("n"))
    rest = rows.join(listed.select(keys), keys, "left_anti").join(table.where(~often).drop("n"), keys)
    return rows.join(listed, keys).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each text begins (one more for the end); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts) of runs of whole texts of about `most` bytes each."""
    data, starts = text_bytes(column)
    row, n = 0, len(starts) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
        yield row, end, data[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair, in this order. Mixing between any two steps keeps structure in the values, such as words made of few letters, from cancelling out."""
    return mix(a * np.uint64(0xD1342543DE82EF95) + b)


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that are inside (one flag for each byte): each run's first byte, its end, and where each text's runs begin. A run ends with its text."""
    within = np.zeros(len(inside) + 2, bool)
    within[1:-1] = inside
    edges = within[1:] != within[:-1]
    # A text's last word ends with the text, even if the next text begins with a word.
    begins = np.flatnonzero(edges & within[1:])
    ends = np.flatnonzero(edges & within[:-1])
    cuts = starts[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(inside))])
    cuts = cuts[within[cuts] & within[cuts + 1]]
    if len(cuts):
        begins = np.sort(np.concatenate([begins, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return begins, ends, np.searchsorted(begins, starts)


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 0x20 and 0x09-0x0D: each word's first byte, its end, and where each text's words begin."""
    return runs((data != 32) & ((data < 9) | (data > 13)), starts)


#: Bytes of terms: digits, letters, and all of longer UTF-8 sequences.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True


def terms(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, where each text's begin) of the terms of texts: runs of digits, letters and characters beyond ASCII, with A-Z lower-cased."""
    data = lowered(data)
    begins, ends, of_text = runs(TERM_BYTES[data], starts)
    return word_hashes(data, begins, ends), of_text


#: By number of bytes, what a block of eight keeps.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 64


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's length and bytes, eight at a time."""
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    size = ends - begins
    out = joined(size.astype(np.uint64), eights[begins] & _MASKS[np.minimum(size, 8)])
    for done in range(8, LONG_WORD, 8):
        more = np.flatnonzero((size > done) & (size <= LONG_WORD))
        if not len(more):
            break
        out[more] = joined(out[more], eights[begins[more] + done] & _MASKS[np.minimum(size[more] - done, 8)])
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[begins[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive word hashes, at the place of the first; fewer words, no windows. Runs of 1, 2, 4, .. words are put together."""
    run, size, out, have = hashes, 1, None, 0
    while width:
        n = len(hashes) - have - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        if width & 1:
            out, have = run if out is None else joined(out[:n], run[have : have + n]), have + size
        width >>= 1
        if width:
            run, size = joined(run[:-size], run[size:]), 2 * size
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes, those of longer UTF-8 sequences too, stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
