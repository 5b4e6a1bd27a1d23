"""Benchmark decontamination with suffix arrays of the training texts.

The documents of a task are cut into shards, and each shard's words get a suffix array: the places of the words, in the order of what follows
from there. Every suffix of every test item that a window can begin is looked up in it by binary search, word by word, which gives all places of its window at
once; a place whose word before matches too belongs to a longer match, the others are followed to the end of what is equal. So each test item
gets its longest verbatim matches and where they are. A document's result needs its own words and the items only, so documents are never shuffled.

Items come to the tasks in blocks of bounded size, one pass over the documents for each block; benchmarks of up to BLOCK_BYTES are one block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, chunks, keep_only, terms, text_bytes, unused

#: Words of a window; an item of fewer is one window.
WIDTH = 10
#: Bytes of items' texts that a pass over the documents takes.
BLOCK_BYTES = 8 << 20
#: Bytes of texts, and words, that one suffix array covers; longer texts have several, which overlap by a window.
SHARD_BYTES, SHARD_WORDS = 4 << 20, 1 << 20
#: Places that are looked at in one go.
PLACES = 1 << 20

MATCHES = "array<struct<item_id:string,item_start:int,start:int,length:int>>"
_FIELDS = [pa.field("item_id", pa.string()), pa.field("item_start", pa.int32()), pa.field("start", pa.int32()), pa.field("length", pa.int32())]


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The places of tokens, by the `depth` tokens that begin there; the end comes before all tokens. Runs of 1, 2, 4, .. tokens are ranked, each time only where ranks are still equal."""
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    new = np.ones(n, bool)
    new[1:] = tokens[order][1:] != tokens[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
    size = 1
    while size < depth:
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            break
        at = order[slots]
        after = np.where(at + size < n, rank[np.minimum(at + size, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[slots] = at = at[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[by][1:] != key[by][:-1]
        new[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        size *= 2
    return order


def _bound(tokens: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int, after: bool) -> np.ndarray:
    """Of each range low..high of a suffix array, equal in the first `depth` tokens, the first place whose next token is wanted or above; with `after`, above."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        found = tokens[order[middle] + depth]
        right = found <= wanted[open_] if after else found < wanted[open_]
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]
        open_ = open_[low[open_] < high[open_]]
    return low


class Items:
    """A block of test items as word hashes: `hashes` of all words, of_item where each item's begin, `ids` as texts or None."""

    def __init__(self, ids: Sequence[str | None], texts: Sequence[str | None], width: int):
        self.hashes, self.of_item = terms(*text_bytes(pa.array(texts, pa.string())))
        self.ids = pa.array(ids, pa.string())
        sizes = np.diff(self.of_item)
        self.least = np.minimum(sizes, width)
        item = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(item)) - self.of_item[:-1][item]
        starts = np.flatnonzero(place + self.least[item] <= sizes[item])
        #: Suffixes that a window begins: their first word, their item, and the window's length.
        self.suffix, self.item = starts, item[starts]
        self.width = self.least[self.item]

    def search(self, tokens: np.ndarray, order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix, first, last): the ranges of a suffix array that begin with a suffix's window. wanted: the items' words as the array's tokens, -1 for those it hasn't."""
        live = np.arange(len(self.suffix))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(order))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        depth = 0
        while len(live):
            full = self.width[live] == depth
            done.append((live[full], low[full], high[full]))
            live, low, high = live[~full], low[~full], high[~full]
            word = wanted[self.suffix[live] + depth]
            known = word > 0
            live, low, high, word = live[known], low[known], high[known], word[known]
            low, high = _bound(tokens, order, low, high, word, depth, False), _bound(tokens, order, low, high, word, depth, True)
            found = low < high
            live, low, high = live[found], low[found], high[found]
            depth += 1
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3

    def matches(self, hashes: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        """Rows item, item_start, start (among all words), length: the longest matches of at least a window within one text."""
        known, ranked = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(known, self.hashes), len(known) - 1)
        wanted = np.where(known[at] == self.hashes, at + 1, -1) if len(known) else np.full(len(self.hashes), -1)
        text = np.repeat(np.arange(len(of_text) - 1), np.diff(of_text))
        # A 0 behind each text keeps runs within it.
        spread = np.arange(len(hashes)) + text
        deep = int(self.least.max(initial=0))
        tokens = np.zeros(len(hashes) + len(of_text) + deep, np.int64)
        tokens[spread] = ranked + 1
        out = [np.zeros((4, 0), np.int64)]
        for begin in range(0, len(hashes) + len(of_text) - 1 if deep else 0, SHARD_WORDS):
            end = min(len(tokens), begin + SHARD_WORDS + deep)
            part = tokens[begin:end]
            order = suffix_array(part, deep)
            padded = np.concatenate([part, np.zeros(deep, np.int64)])
            suffix, low, high = self.search(padded, order, wanted)
            counts = high - low
            cuts = np.searchsorted(np.cumsum(counts), np.arange(PLACES, counts.sum() + PLACES, PLACES)) + 1
            for a, b in zip(np.append(0, cuts), cuts, strict=False):
                n = counts[a:b]
                which = np.repeat(np.arange(a, min(b, len(counts))), n)
                place = order[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())] + begin
                good = place < begin + SHARD_WORDS
                out.append(self._longest(tokens, wanted, suffix[which[good]], place[good]))
        found = np.concatenate(out, axis=1)
        # Back from places with a 0 behind each text.
        found[2] -= np.searchsorted(of_text[1:] + np.arange(1, len(of_text)), found[2], "right")
        return found

    def _longest(self, tokens: np.ndarray, wanted: np.ndarray, suffix: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The matches at these places that no longer one holds, followed to their ends."""
        word, item = self.suffix[suffix], self.item[suffix]
        before = (word > self.of_item[item]) & (place > 0)
        longer = before & (tokens[place - 1] == wanted[word - 1])
        word, item, place = word[~longer], item[~longer], place[~longer]
        length = self.least[item].copy()
        end = self.of_item[item + 1]
        going = np.flatnonzero(word + length < end)
        while len(going):
            on = tokens[place[going] + length[going]] == wanted[word[going] + length[going]]
            going = going[on]
            length[going] += 1
            going = going[word[going] + length[going] < end[going]]
        return np.stack([item, word - self.of_item[item], place, length])


def _pass(items: Items, keep: int, carried: bool, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of columns to keep, text, and with `carried` the matches of earlier blocks; as many of them as names say come back, with n_words, n_hit and matches."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("decontamination")
        for batch in batches:
            for first, last, data, starts in chunks(batch.column(keep), SHARD_BYTES):
                hashes, of_text = terms(data, starts)
                found = items.matches(hashes, of_text)
                doc = np.searchsorted(of_text, found[2], "right") - 1
                ids, rows = items.ids.take(pa.array(found[0])), [doc, found[1], found[2] - of_text[doc], found[3]]
                if carried:
                    old = batch.column(keep + 1).slice(first, last - first)
                    flat = old.flatten()
                    sizes = np.diff(old.offsets.to_numpy())
                    ids = pa.concat_arrays([flat.field(0), ids])
                    rows = [np.concatenate(x) for x in zip([np.repeat(np.arange(len(sizes)), sizes), *(flat.field(k).to_numpy() for k in (1, 2, 3))], rows, strict=True)]
                doc, item_start, start, length = rows
                change = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(change, of_text[doc] + start, 1)
                np.add.at(change, of_text[doc] + start + length, -1)
                hits = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
                order = np.lexsort((item_start, start, doc))
                struct = pa.StructArray.from_arrays([ids.take(pa.array(order)), *(pa.array(x[order].astype(np.int32)) for x in (item_start, start, length))], fields=_FIELDS)
                offsets = pa.array(np.searchsorted(doc[order], np.arange(last - first + 1)).astype(np.int32))
                own = [batch.column(k).slice(first, last - first) for k in range(len(names) - 3)]
                counts = [np.diff(of_text), hits[of_text[1:]] - hits[of_text[:-1]]]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c.astype(np.int64)) for c in counts), pa.ListArray.from_arrays(offsets, struct)], names)

    return mark


def find_matches(docs: DataFrame, items: DataFrame, keep: Sequence[str] = ("doc_id",), width: int = WIDTH) -> tuple[DataFrame, dict[str, str]]:
    """docs' columns `keep` with n_words, n_hit and matches; and the names that these three have, changed where keep takes them.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. items: item_id, text. A window is `width` words of an item that follow each other, all of an
    item of fewer. matches are the longest runs of words that document and item share and that hold a window: (item_id as text, its first
    word in the item, in the document, number of words), by document place; a word in any of them is hit. Null and empty texts have no words and match nothing; every row of docs comes back once,
    repeated ids and null ids too. Rows of items are items of their own; those without id match too, with a null id. Words are compared by 64-bit hashes.
    """
    known = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    # Columns go by place: a user's may have any names.
    out = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").cast("string").alias("text"))
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found, last = Items([r["item_id"] for r in rows], [r["text"] for r in rows], width), block == blocks - 1
        schema = T.StructType([*out.schema.fields[: len(keep) + (not last)], *T.StructType.fromDDL(f"n_words long, n_hit long, matches {MATCHES}")])
        wanted = out.select(*out.columns[: len(keep) + 1], *(["matches"] if block else []))
        out = wanted.mapInArrow(_pass(found, len(keep), block > 0, schema.names), schema)
        out = out if last else checkpoint(out)
    names = unused(keep, "n_words", "n_hit", "matches")
    return out.toDF(*keep, *names), dict(zip(("n_words", "n_hit", "matches"), names, strict=True))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, in all their columns, without those that hold a window of an item (see find_matches)."""
    found, names = find_matches(docs, items, docs.columns, width)
    return found.where(F.col(names["n_hit"]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
