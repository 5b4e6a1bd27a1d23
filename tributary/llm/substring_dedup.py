"""Substring dedup with difference-cover anchors.

A difference cover modulo a period holds, for any two places in any two documents, a shift at which both places are in the cover. So
short windows (anchors) are hashed only at places whose number modulo the period is in the cover, and still any two equal
long windows share an anchor at the same shift. Anchors found more than once are extended: only the long windows
around them are compared, by a hash of their words' hashes, which deals them out, and a cryptographic digest of the very words. Texts are exchanged
once, by document; the two comparisons exchange hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, window_hashes, word_hashes, words
from .exchange import blocks, bucket_count, bucket_of, entries, id_bucket, id_bucket_column

WIDTH = 35
# A perfect difference set; its differences are all numbers modulo the period.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)

BLOCK = "bucket int, kind int, key binary, check binary, doc binary, pos binary, local binary"
#: Kinds of blocks: entries to compare, and entries already known to be repeated, on their way to their documents.
COMPARE, FOUND = 0, 1
#: Bytes of text to a bucket of documents.
BUCKET_BYTES = 64 << 20


def _checks(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """A digest of 32 bits of the words of each window that begins at one of `places`, joined by a space."""
    size = ends - begins + 1
    spelt_at = np.concatenate([[0], np.cumsum(size)])
    spelt = data.take(np.repeat(begins - spelt_at[:-1], size) + np.arange(spelt_at[-1]), mode="clip")
    spelt[spelt_at[1:] - 1] = 32
    raw = spelt.tobytes()
    digests = [hashlib.blake2b(raw[a:b], digest_size=4).digest() for a, b in zip(spelt_at[places].tolist(), (spelt_at[places + width] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), np.uint32)


def _same_as_before(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether each entry of sorted ones equals the one before it in all columns, with a False at the end."""
    same = np.zeros(len(sorted_columns[0]) + 1, bool)
    same[1:-1] = np.logical_and.reduce([c[1:] == c[:-1] for c in sorted_columns])
    return same


def _compared(key: np.ndarray, check: np.ndarray | None, doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A batch's entries: each key (and check) goes out once, however often the batch has it; places of keys that it has repeatedly are found at once.

    So a key that a third of all documents hold gives its bucket one entry for each batch.
    """
    order = np.argsort(key, kind="stable") if check is None else np.lexsort((check, key))
    key, doc, pos = key[order], doc[order], pos[order]
    check = None if check is None else check[order]
    same = _same_as_before(key) if check is None else _same_as_before(key, check)
    first, local = ~same[:-1], same[1:] | same[:-1]
    sent = {"key": key[first], "doc": doc[first], "pos": pos[first], "local": local[first].view(np.uint8)} | ({} if check is None else {"check": check[first]})
    yield _block(bucket_of(sent["key"], buckets), sent, COMPARE)
    if local.any():
        yield _found(None if check is None else check[local], doc[local], pos[local], buckets)


def _block(bucket: np.ndarray, columns: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
    """The columns that an entry of this kind hasn't are null."""
    out = blocks(bucket, columns, {"kind": kind})
    nothing = pa.nulls(len(out), pa.binary())
    names = [c.split(" ")[0] for c in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([out.column(c) if c in out.schema.names else nothing for c in names], names)


def _found(check: np.ndarray | None, doc: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    return _block(id_bucket(doc, buckets), {"doc": doc, "pos": pos} | ({} if check is None else {"check": check}), FOUND)


def _compare(table: pa.Table, buckets: int) -> pa.Table:
    """A bucket's entries whose keys (and checks) came from several batches or are repeated in one; what was found before passes through."""
    kind = table["kind"].to_numpy()
    passing = table.filter(pa.array(kind == FOUND))
    table = table.filter(pa.array(kind == COMPARE))
    key, check, doc, pos, local = (entries(table[c].to_pylist(), t) for c, t in (("key", "u8"), ("check", "u4"), ("doc", "i8"), ("pos", "i4"), ("local", "u1")))
    checked = len(check) > 0
    order = np.lexsort((check, key)) if checked else np.argsort(key, kind="stable")
    same = _same_as_before(key[order], check[order]) if checked else _same_as_before(key[order])
    several = (same[1:] | same[:-1]) & (local[order] == 0)
    found = _found(check[order][several] if checked else None, doc[order][several], pos[order][several], buckets)
    return pa.concat_tables([passing, pa.Table.from_batches([found])])


def _places(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, check) of what was found for a bucket of documents, by document; checks are 0 where there are none."""
    doc, pos, check = (entries(table[c].to_pylist(), t) for c, t in (("doc", "i8"), ("pos", "i4"), ("check", "u4")))
    check = check if len(check) else np.zeros(len(doc), np.uint32)
    order = np.argsort(doc, kind="stable")
    return doc[order], pos[order], check[order]


def _at(found: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index among all words of the chunk, check) of what was found for its documents; places past a document's end are left out.

    Those come from other rows with the same id.
    """
    low, high = np.searchsorted(found[0], ids, "left"), np.searchsorted(found[0], ids, "right")
    counts = high - low
    which = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    row = np.repeat(np.arange(len(ids)), counts)
    place = of_text[row] + found[1][which]
    inside = place < of_text[row + 1]
    return place[inside], found[2][which][inside]


def _whole(of_text: np.ndarray, n: int, width: int) -> np.ndarray:
    """Of n windows, those that don't cross from one text into the next."""
    ends = np.repeat(of_text[1:], np.diff(of_text))
    return np.arange(n) + width <= ends[:n]


def remove_repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space).

    A word is removed if it is in a window of `width` words of one text that also starts anywhere else, the same text included. Every
    row counts as a text of its own, rows repeated under one id too, and those without an id. Null and empty texts have no words; texts shorter than a window stay.
    """
    if width < PERIOD + 1:
        raise ValueError(f"width must be over {PERIOD}")
    anchor = width - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    # Rows without an id are dealt by their texts.
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    buckets = max(bucket_count(docs.sparkSession), size // BUCKET_BYTES)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for row, end, data, starts in chunks(batch.column(1)):
                begins, ends, of_text = words(data, starts)
                hashes = window_hashes(word_hashes(data, begins, ends), anchor)
                pos = np.arange(len(begins)) - np.repeat(of_text[:-1], np.diff(of_text))
                taken = np.flatnonzero(cover[pos[: len(hashes)] % PERIOD] & _whole(of_text, len(hashes), anchor))
                doc = np.repeat(ids[row:end], np.diff(of_text))
                parts.append((hashes[taken], doc[taken], pos[taken].astype(np.int32)))
            if parts:
                key, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield from _compared(key, None, doc, pos, buckets)

    def extend(texts: pa.Table, found: pa.Table) -> pa.Table:
        known, out = _places(found), []
        ids = texts["id"].to_numpy()
        for row, end, data, starts in chunks(texts["text"].combine_chunks()) if len(known[0]) else ():
            begins, ends, of_text = words(data, starts)
            hashes = window_hashes(word_hashes(data, begins, ends), width)
            place, _ = _at(known, ids[row:end], of_text)
            near = np.zeros(len(begins) + 1, np.int64)  # windows that hold an anchor begin up to width - anchor words before it
            np.add.at(near, np.maximum(place - (width - anchor), 0), 1)
            np.add.at(near, place + 1, -1)
            taken = np.flatnonzero((np.cumsum(near)[: len(hashes)] > 0) & _whole(of_text, len(hashes), width))
            pos = np.arange(len(begins)) - np.repeat(of_text[:-1], np.diff(of_text))
            doc = np.repeat(ids[row:end], np.diff(of_text))
            out.append((hashes[taken], _checks(data, begins, ends, taken, width), doc[taken], pos[taken].astype(np.int32)))
        if not out:
            out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        return pa.Table.from_batches(_compared(*(np.concatenate(x) for x in zip(*out, strict=True)), buckets))

    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        known = _places(found)
        ids, own = texts["id"].to_numpy(), texts["doc_id"]
        n_words, n_removed, kept = [], [], []
        for row, end, data, starts in chunks(texts["text"].combine_chunks()):
            begins, ends, of_text = words(data, starts)
            place, check = _at(known, ids[row:end], of_text)
            n = max(0, len(begins) - width + 1)
            good = place < n
            good[good] = _whole(of_text, n, width)[place[good]]
            place, check = place[good], check[good]
            place = place[_checks(data, begins, ends, place, width) == check]  # others come from other rows with the same id
            change = np.zeros(len(begins) + 1, np.int64)
            np.add.at(change, place, 1)
            np.add.at(change, place + width, -1)
            stays = np.cumsum(change)[:-1] == 0
            raw = data.tobytes()
            for k in range(end - row):
                a, b = of_text[k], of_text[k + 1]
                mask = stays[a:b]
                left = int(np.count_nonzero(mask))
                spelt = raw[starts[k] : starts[k + 1]].split()
                n_words.append(int(b - a))
                n_removed.append(int(b - a) - left)
                kept.append((b" ".join(spelt) if left == b - a else b" ".join(compress(spelt, mask.tolist()))).decode())
        return pa.table({"doc_id": own, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, buckets)

    texts = narrow.withColumn("bucket", id_bucket_column(F.col("id"), buckets))
    found = narrow.select("id", "text").mapInArrow(anchors, BLOCK).groupBy("bucket").applyInArrow(compare, BLOCK)
    repeated = texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(extend, BLOCK).groupBy("bucket").applyInArrow(compare, BLOCK)
    return texts.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")
