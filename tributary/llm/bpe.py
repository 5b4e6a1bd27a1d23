"""Byte-level BPE with vectorised pre-tokenisation.

Texts become arrays of codepoints, codepoints become symbols of a small alphabet, and a symbol is a function from state to
state. Composing such functions is associative, so a chunk of many texts is cut into equal segments: every segment's
functions are composed side by side, the segments' own functions are composed one after another, and a second pass
over all segments at once finds each codepoint's state, and with it the places where a pre-token begins. No regular expression runs. The
slices between those places go through a cache of merged pairs.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, keep_only, kept

# The codepoints of Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# What follows an apostrophe in a contraction that is a pre-token of its own.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")

# Symbols. SPACE: U+0020 before something that isn't white space. ALONE: other white space in that place.
# WHITE: white space before white space or the end. SHORT and LONG: an apostrophe with such an ending behind it.
LETTER, DIGIT, OTHER, SPACE, ALONE, WHITE, SHORT, LONG = range(8)
# States: what the pre-token so far is. PREFIXED: one space, which takes in the run behind it. TWO, ONE: letters that a contraction still needs.
CLOSED, LETTERS, DIGITS, OTHERS, WHITES, PREFIXED, TWO, ONE = range(8)

CACHED_PIECES = 300_000
#: Longer slices are merged one by one, by way of a heap, and not kept.
SHORT_PIECE = 64
SEGMENT = 64


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token begins) by symbol and state. Symbols from 8 on are the same at the start of a text."""
    after = np.zeros((16, 8), np.uint8)
    begins = np.ones((16, 8), bool)

    def rule(symbol: int, otherwise: int, **going_on: int) -> None:
        after[symbol] = otherwise
        for state, to in going_on.items():
            after[symbol, globals()[state]] = to
            begins[symbol, globals()[state]] = False

    rule(LETTER, LETTERS, LETTERS=LETTERS, PREFIXED=LETTERS, TWO=ONE, ONE=CLOSED)
    rule(DIGIT, DIGITS, DIGITS=DIGITS, PREFIXED=DIGITS)
    rule(OTHER, OTHERS, OTHERS=OTHERS, PREFIXED=OTHERS)
    rule(SPACE, PREFIXED)
    rule(ALONE, CLOSED)
    rule(WHITE, WHITES, WHITES=WHITES)
    rule(SHORT, ONE, OTHERS=OTHERS, PREFIXED=OTHERS)
    rule(LONG, TWO, OTHERS=OTHERS, PREFIXED=OTHERS)
    after[8:] = after[:8, [CLOSED]]
    return after, begins


_AFTER, _BEGINS = _machine()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """LETTER, DIGIT, OTHER or WHITE for every codepoint."""
    if not _classes:
        kinds = {"L": LETTER, "N": DIGIT}
        found = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        found[list(WHITE_SPACE)] = WHITE
        _classes.append(found)
    return _classes[0]


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of each codepoint; starts: the first codepoint of each text that has any."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[starts] = first[n] = True
    last = first[1:]  # the next codepoint is another text's
    white = kind == WHITE
    before_solid = white & ~last
    before_solid[:-1] &= ~white[1:]
    out = kind.copy()
    out[before_solid] = np.where(points[before_solid] == 32, SPACE, ALONE)
    quotes = np.flatnonzero((points == 39) & ~last)
    if len(quotes):
        second = points[np.minimum(quotes + 2, n - 1)]
        second = np.where((quotes + 2 < n) & ~last[np.minimum(quotes + 1, n - 1)], second, 0)
        following = points[quotes + 1]
        for ending in LONG_ENDINGS:
            out[quotes[(following == ord(ending[0])) & (second == ord(ending[1]))]] = LONG
        out[quotes[np.isin(following, [ord(x) for x in SHORT_ENDINGS])]] = SHORT
    out[first[:-1]] += 8
    return out


def scan(codes: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each symbol: a prefix scan over transition functions."""
    n = len(codes)
    rows = max(1, -(-n // SEGMENT))
    grid = np.full(rows * SEGMENT, OTHER, np.uint8)
    grid[:n] = codes
    columns = np.ascontiguousarray(grid.reshape(rows, SEGMENT).T).astype(np.int64) * 8
    step = _AFTER.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # each segment's function, as a list of results
    for column in columns:
        whole = step[column[:, None] + whole]
    entering = np.zeros(rows, np.uint8)
    state = CLOSED
    for row, function in enumerate(whole.tolist()):
        entering[row] = state
        state = function[state]
    begins = np.empty((SEGMENT, rows), bool)
    at = entering
    starting = _BEGINS.ravel()
    for k, column in enumerate(columns):
        place = column + at
        begins[k] = starting[place]
        at = step[place]
    return begins.T.ravel()[:n]


def boundaries(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bytes at which pre-tokens begin, in texts of UTF-8 that begin at `starts` (one more for the end)."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    begins = np.unique(starts[:-1][starts[:-1] < starts[1:]])
    return at[scan(symbols(points, np.searchsorted(at, begins)))]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a slice: the pair of lowest rank is merged, the first of equals, until none is left.

    Pairs wait in a heap, so that a slice of any length takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[pair], i, pair) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != pair:
            continue  # one of the two has been merged since
        parts[i], parts[j] = pair, None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (wider := pair + parts[right[i]]) in ranks:
                heapq.heappush(heap, (ranks[wider], i, wider))
        if left[i] >= 0 and (wider := parts[left[i]] + pair) in ranks:
            heapq.heappush(heap, (ranks[wider], left[i], wider))
    return [ranks[p] for p in parts if p is not None]


class Merger:
    """Merges many slices side by side: slices of one length are a matrix of tokens, and every step merges each row's pair of lowest rank, the first of equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {ranks[t[:k]] * self.size + ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        #: Ids of slices, as bytes of little-endian 32-bit numbers.
        self.known: dict[bytes, bytes] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges into; size where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.size)

    def _rows(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of slices of one length."""
        n = len(pieces)
        tokens = self.bytes[np.frombuffer(b"".join(pieces), np.uint8).reshape(n, -1)]
        best = self._pairs(tokens[:, :-1], tokens[:, 1:])
        out: list[bytes] = [b""] * n
        row = np.arange(n)
        while len(row):
            at = best.argmin(axis=1) if best.shape[1] else np.zeros(len(row), np.int64)
            going = best[np.arange(len(row)), at] < self.size if best.shape[1] else np.zeros(len(row), bool)
            if not going.all():
                ended, width = tokens[~going].astype("<i4").tobytes(), 4 * tokens.shape[1]
                for k, r in enumerate(row[~going].tolist()):
                    out[r] = ended[k * width : (k + 1) * width]
                row, at, tokens, best = row[going], at[going], tokens[going], best[going]
                if not len(row):
                    break
            each, last = np.arange(len(row)), tokens.shape[1] - 2
            tokens[each, at] = best[each, at]
            place = np.arange(last + 1)
            tokens = np.take_along_axis(tokens, place + (place > at[:, None]), 1)
            best = np.take_along_axis(best, place[:-1] + (place[:-1] >= at[:, None]), 1)
            for k, good in ((at, at < last), (at - 1, at > 0)):
                best[each[good], k[good]] = self._pairs(tokens[each[good], k[good]], tokens[each[good], k[good] + 1])
        return out

    def merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct slices."""
        out = {p: np.array([self.ranks[p]], "<i4").tobytes() for p in pieces if p in self.ranks}
        by_length: dict[int, list[bytes]] = {}
        for p in pieces:
            if len(p) > SHORT_PIECE:
                out[p] = np.array(merge(p, self.ranks), "<i4").tobytes()
            elif p not in out:
                by_length.setdefault(len(p), []).append(p)
        for same in by_length.values():
            out |= zip(same, self._rows(same), strict=True)
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        new = self.merge(list(set(pieces) - known.keys()))
        if len(known) + len(new) <= CACHED_PIECES:
            known |= {p: ids for p, ids in new.items() if len(p) <= SHORT_PIECE}
            new = {p: ids for p, ids in new.items() if len(p) > SHORT_PIECE}
        return [known[p] if p in known else new[p] for p in pieces] if new else [known[p] for p in pieces]


_mergers: dict[str, Merger] = kept.setdefault("bpe", {})
_vocabularies: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' bytes one after another, and where each id's begin (one more for the end)."""
    if path not in _vocabularies:
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        _vocabularies[path] = np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    return _vocabularies[path]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def encode_documents(docs: DataFrame, ranks_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and ends (array of int: the byte of the text after each token).

    Null and empty texts have empty arrays; rows that repeat come back as often. No special tokens: their strings are ordinary text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("bpe")
        if ranks_path not in _mergers:
            _mergers[ranks_path] = Merger(load_ranks(ranks_path))
        lengths = np.diff(_vocabulary(ranks_path)[1])
        for batch in batches:
            for first, last, data, starts in chunks(batch.column(1)):
                begins = boundaries(data, starts)
                raw, cuts = data.tobytes(), begins.tolist()
                pieces = _mergers[ranks_path].encode([raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)] if cuts else [])
                ids = np.frombuffer(b"".join(pieces), "<i4")
                of_piece = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4)])
                before = of_piece[np.searchsorted(begins, starts)]
                ends = np.cumsum(lengths[ids]) - np.repeat(starts[:-1], np.diff(before))
                counts = np.diff(before)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), _lists(ids, counts), _lists(ends, counts)], ["doc_id", "ids", "ends"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(encode, "doc_id long, ids array<int>, ends array<int>")


def _decoded(ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray, places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of all rows' ids, looked up all at once, and where each row's begin (one more for the end)."""
    lengths = places[ids + 1] - places[ids]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return tokens[np.repeat(places[ids] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes(), ends[np.concatenate([[0], np.cumsum(counts)])]


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and decoded (binary) of encoded (doc_id, ids). Null ids are empty."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = _vocabulary(ranks_path)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                ids = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                decoded, cuts = _decoded(ids, counts, tokens, places)
                out = pa.array([decoded[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded binary")


def decode_spans(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, start, stop and decoded (binary) of encoded (doc_id, ids, ends, start, stop): the bytes [start, stop) of each text.

    The retained offsets say which tokens hold them, so only those are decoded. What lies outside the text is left out; nulls give no bytes.
    """
    ends, start, stop = F.col("ends"), F.when(F.col("start") < 0, 0).otherwise(F.col("start")).cast("long"), F.col("stop").cast("long")
    first = F.size(F.filter(ends, lambda e: e <= start))
    number = F.size(F.filter(ends, lambda e: e < stop)) + 1 - first
    covered = F.when(stop > start, F.slice("ids", first + 1, F.greatest(number, F.lit(0))))
    before = F.when(first > 0, F.try_element_at(ends, first)).otherwise(F.lit(0))
    wanted = encoded.select(F.col("doc_id"), F.coalesce(covered, F.array().cast("array<int>")).alias("ids"), F.struct("start", "stop", (start - before).alias("skip"), (stop - start).alias("length")).alias("span"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, places = _vocabulary(ranks_path)
        for batch in batches:
            ids = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            decoded, cuts = _decoded(ids, batch.column(1).value_lengths().to_numpy(zero_copy_only=False), tokens, places)
            spans = batch.column(2).to_pylist()
            out = [decoded[a:b][s["skip"] or 0 :][: max(0, s["length"] or 0)] for a, b, s in zip(cuts.tolist(), cuts[1:].tolist(), spans, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s["start"] for s in spans], pa.int64()), pa.array([s["stop"] for s in spans], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "start", "stop", "decoded"])

    return wanted.mapInArrow(decode, "doc_id long, start long, stop long, decoded binary")
