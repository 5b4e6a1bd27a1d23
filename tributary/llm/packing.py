"""Best-fit packing planned over a histogram of lengths.

Sequences are planned from how many pieces have each length, not from the pieces: at most `capacity` counts, whatever the
number of documents. Going from long to short, all pieces of a length go at once to the open sequences with the least
room that still suffices. The plan says which ranks within a length take which sequences; pieces get their rank within
their length and take their places by a join.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, keep_only, kept

CAPACITY = 2048
#: A third of all pieces may have one length, so the ranks of a length are counted in as many groups, then added up.
RANK_GROUPS = 1024
#: Words whose ids a Python worker keeps.
CACHED_WORDS = 500_000

#: Spellings of plain words that a Python worker keeps besides.
CACHED_SPELLINGS = 400_000

def _ids(encoding) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return np.array(encoding.ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", encoding.ids).tobytes()


def _plain(word: bytes) -> tuple[bytes, bytes] | None:
    """The lower-case spelling and the mark of a word of Latin-1 letters with a full stop or comma behind it or without; None for other words."""
    mark = word[-1:] if word[-1] in b".," else b""
    core = word[:-1] if mark else word
    if core.isalpha():  # ASCII letters
        return core.lower(), mark
    text = core.decode()
    if text.isalpha() and max(text) < "\u0100":
        return text.lower().encode(), mark
    return None


class _Words:
    """The ids of words, kept up to a bound; words without room are encoded again when they come back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that its normaliser and its pattern leave in one piece, so without those two.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.marks = {m: _ids(self.tokenizer.encode(m.decode(), add_special_tokens=False)) for m in (b".", b",")} | {b"": b""}
        self.known: dict[bytes, bytes] = {}
        self.spelt: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Plain words by their spelling, which they share with others; the rest go through the whole tokenizer."""
        parts = list(map(_plain, words))
        spelt = self.spelt
        wanted = list({p[0] for p in parts if p is not None and p[0] not in spelt})
        new = dict(zip(wanted, map(_ids, self.plain.encode_batch_fast([w.decode() for w in wanted], add_special_tokens=False)), strict=True))
        if len(spelt) + len(new) <= CACHED_SPELLINGS:
            spelt |= new
            new = spelt
        else:
            new |= {p[0]: spelt[p[0]] for p in parts if p is not None and p[0] in spelt}
        marks = self.marks
        found = {w: new[p[0]] + marks[p[1]] for w, p in zip(words, parts, strict=True) if p is not None}
        rest = [w for w, p in zip(words, parts, strict=True) if p is None]
        found |= zip(rest, map(_ids, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)), strict=True)
        return found


#: Bytes of text whose words are looked up together.
GROUP_BYTES = 4 << 20

_loaded: dict[str, _Words] = kept.setdefault("packing", {})


def _encoded(texts: list[bytes], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers.

    This tokenizer drops white space and never merges across it, so a text's ids are those of its words, one after another.
    """
    if path not in _loaded:
        _loaded[path] = _Words(path)
    known = _loaded[path].known
    split = [t.split() for t in texts]  # bytes.split() splits at 0x20 and 0x09-0x0D
    wanted = {w for words in split for w in words if w not in known}
    new = _loaded[path].encode(list(wanted)) if wanted else {}
    if len(known) + len(new) <= CACHED_WORDS:
        known |= new
        new = {}
    for words in split:
        yield b"".join([known[w] if w in known else new[w] for w in words] if new else [known[w] for w in words])


def piece_table(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. Null text is empty: one piece, the end id alone."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("packing")
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            row = 0
            while row < len(ids):
                group: list[bytes] = []
                size, first = 0, row
                while row < len(ids) and size < GROUP_BYTES:
                    group.append((texts[row].as_py() or "").encode())
                    size += len(group[-1])
                    row += 1
                out = []
                for doc, encoded in zip(ids[first:row], _encoded(group, tokenizer_path), strict=True):
                    encoded += end
                    for k in range(0, len(encoded), 4 * capacity):
                        piece = encoded[k : k + 4 * capacity]
                        out.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over a histogram: rows (length, first rank, ranks, first sequence, offset).

    Ranks [first, first + ranks) of a length take the sequences from `first sequence` on, one each, at `offset`.
    Open sequences are kept as runs of neighbouring numbers with equal room, so the work depends on the number
    of lengths and runs, not of pieces.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: runs (first sequence, how many)
    rows, opened = [], 0
    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit")
        left, rank, room = counts[length], 0, length
        while left and room <= capacity:
            if not rooms[room]:
                room += 1
                continue
            first, many = rooms[room].pop()
            take = min(left, many)
            if take < many:
                rooms[room].append((first + take, many - take))
            rows.append((length, rank, take, first, capacity - room))
            if room > length:
                rooms[room - length].append((first, take))
            left, rank = left - take, rank + take
            room = max(length, min(room, room - length))  # what was just filled may take another of this length
        while left:  # new sequences, each filled with as many of this length as it takes
            fit = capacity // length
            full, rest = divmod(left, fit)
            for many, each in ((full, fit), (1 if rest else 0, rest)):
                if many:
                    for k in range(each):
                        rows.append((length, rank, many, opened, k * length))
                        rank += many
                    if capacity - each * length:
                        rooms[capacity - each * length].append((opened, many))
                    opened += many
            left = 0
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = RANK_GROUPS) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32; kept, as they are read twice) with sequence_id and offset.

    The plan has at most a few rows for each length, so it is broadcast. Ranks: a length's rows are dealt into `groups` by a
    hash of document and piece, ranked within each, and moved by what the groups before hold; no task sees a whole length.
    Repeated documents are packed as often as they come. Empty tables give no rows.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    spark = pieces.sparkSession
    planned = spark.createDataFrame(plan(counts, capacity), "length long, first_rank long, ranks long, first_sequence long, offset long")
    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    before = (
        dealt.groupBy("length", "dealt").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("dealt")) - F.col("n"))
        .select("length", "dealt", "before")
    )
    within = Window.partitionBy("length", "dealt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(within)).join(before, ["length", "dealt"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    fits = (ranked["length"] == planned["length"]) & (ranked["rank"] >= planned["first_rank"]) & (ranked["rank"] < planned["first_rank"] + planned["ranks"])
    return ranked.join(F.broadcast(planned), fits).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs. The pieces, a few numbers each, are written once, so that texts are tokenised once."""
    return pack(checkpoint(piece_table(docs, tokenizer_path, end_id, capacity)), capacity)
