"""MinHash near-dedup with tensored banding.

A table of an LSH index needs several minhashes as its key, and many tables need many minhashes. Here two small collections of M
pairs of minhashes each are made, and the key of table (i, j) joins pair i of the first with pair j of the second: M * M tables out
of 4 * M minhashes. Documents travel once for each pair of the first collection, carrying all pairs of the second, so the exchange
grows with M as well, and the tables (i, 1) .. (i, M) are formed where the documents with an equal pair i meet.

Documents with equal shingle sets are one class, and only classes are compared. A table's small groups give all their pairs. In a large
group every class is compared with the one most like the group's majority. No task holds a group that grows with the input: classes of frequent first
pairs are dealt out by table instead, and in frequent groups even of those only counts, sums of bits and the middle travel. Large groups that overlap are a family; whoever isn't in its family's
largest component after that is met with its other members in a second round: through its rarest shingles where the family has many such members, else
in blocks of bounded size. All links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, chunks, counted, join_counted, joined, keep_only, lowered, mix, partitions, unused, word_hashes, words
from .components import connected_components, with_links
from .exchange import blocks, bucket_count, bucket_of, entries

SHINGLE = 5
#: Link where PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Pairs in each collection. Two sets of similarity s meet in no table with a chance of about 2 * (1 - s * s) ** M: 4e-6 for 0.75.
M = 16
HASHES = 4 * M
#: Groups of at most so many classes give all their pairs.
SMALL = 8
#: First pairs, and groups, of more classes than this are frequent, and more than this many of either are never listed: the bound grows with the input where they would be.
LARGE = 2048
LISTED = 65_536
#: Classes whose places in all groups are made in one go.
CHUNK_CLASSES = 2048
#: Of the 64 one-bit minhashes, equal sets share 64, sets of similarity 0.75 share 56 on average; fewer than this, one pair in 13 million of them does.
LEAST_BITS = 40
#: Classes of a family that a task of the second round holds on either side.
BLOCK_ROWS = 512
#: Families with more blocks of open members are looked up by rare shingles, as far as that gives a member few candidates: so many, or one of its family's blocks.
MANY_BLOCKS, FEW_CANDIDATES = 16, 1000

_MULTIPLIERS = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, where each text's begin): the distinct shingles of texts, in order of hash. Texts of fewer words have one shingle, all their words."""
    begins, ends, of_text = words(data, starts)
    hashed = word_hashes(data, begins, ends)
    counts = np.diff(of_text)
    run, found = hashed, []
    for n in range(1, size + 1):
        if n > 1:
            run = joined(run[:-1], hashed[n - 1 :])
        if n < size:
            text = np.flatnonzero(counts == n)
            found.append((text, run[of_text[text]]))
    whole = np.maximum(counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), whole)
    found.append((text, run[of_text[text] + np.arange(len(text)) - np.repeat(np.cumsum(whole) - whole, whole)]))
    text, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def minhashes(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A row of HASHES minhashes for each set that isn't empty."""
    full = places[:-1][places[:-1] < places[1:]]
    out = np.empty((len(full), HASHES), np.uint64)
    if len(full):
        for k, multiplier in enumerate(_MULTIPLIERS):
            out[:, k] = np.minimum.reduceat(hashes * multiplier, full)
    return out


def _fingerprints(hashes: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each whole set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)]) for h in (mix(hashes), mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
    return [(s[places[1:]] - s[places[:-1]]).view(np.int64) for s in sums]


def text_digest() -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, two hashes of the whole set, the minhashes (two collections of M pairs, each pair as one number) and 64 one-bit minhashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for batch in batches:
            for first, last, data, starts in chunks(batch.column(1)):
                hashes, places = shingle_sets(lowered(data), starts)
                counts = np.diff(places)
                fp = _fingerprints(hashes, places)
                low = minhashes(hashes, places)
                pairs = mix(low[:, 0::2] * np.uint64(0x9E3779B97F4A7C15) ^ mix(low[:, 1::2] + np.arange(2 * M, dtype=np.uint64)))
                bits = np.packbits((mix(low) & np.uint64(1)).astype(np.uint8), axis=1)
                signed = np.zeros(last - first, np.int64)
                signed[counts > 0] = np.arange(len(low))
                column = lambda rows: pa.array([rows[k].tobytes() if n else None for k, n in zip(signed.tolist(), counts.tolist(), strict=True)], pa.binary())  # noqa: E731,B023
                own = [batch.column(k).slice(first, last - first) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(fp[0]), pa.array(fp[1]), column(pairs), column(bits)], ["doc_id", "digest", "n_shingles", "fp1", "fp2", "pairs", "bits"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_digest().alias("digest"))
    return narrow.mapInArrow(sign, "doc_id long, digest long, n_shingles long, fp1 long, fp2 long, pairs binary, bits binary")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 64 - np.bitwise_count(a ^ b)


def _paired(by: np.ndarray, new: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rows a, b, star: the pairs of each group's entries. by: entries, group after group, by id in each; new: whether an entry there begins a group (but for the first)."""
    if not len(by):
        return np.zeros((3, 0), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(by)]])
    sizes = np.diff(cuts)
    size_at = np.repeat(sizes, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)
    found: list[np.ndarray] = []
    for step in range(1, SMALL):
        good = np.flatnonzero((group[step:] == group[:-step]) & (size_at[step:] <= SMALL))
        x, y = by[good], by[good + step]
        near = _agreement(bits[x], bits[y]) >= LEAST_BITS
        found.append(np.stack([ids[x[near]], ids[y[near]], np.zeros(near.sum(), np.int64)]))
    for g in np.flatnonzero(sizes > SMALL):
        members = by[cuts[g] : cuts[g + 1]]
        most = np.packbits(np.unpackbits(bits[members].view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0) >= 0.5).view("u8")[0]
        middle = members[np.argmax(_agreement(bits[members], most))]  # of equals the smallest id
        found.append(np.stack([np.full(len(members), ids[middle]), ids[members], np.ones(len(members), np.int64)]))
    return np.concatenate(found, axis=1)


def _pair_table(found: np.ndarray) -> pa.Table:
    """Each pair (a < b) once."""
    out = np.unique(np.stack([np.minimum(found[0], found[1]), np.maximum(found[0], found[1]), found[2]])[:, found[0] != found[1]], axis=1)
    return pa.table({"a": out[0], "b": out[1], "star": out[2].astype(bool)})


def _candidates(table: pa.Table) -> pa.Table:
    """Pairs of classes (a < b) that share a table of this bucket, each once, and whether a large group was compared with its middle only."""
    key, ids, bits = (entries(table[c].to_pylist(), t) for c, t in (("key", "u8"), ("id", "i8"), ("bits", "u8")))
    others = entries(table["others"].to_pylist(), np.dtype(("V", 4 * M)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    order = order[same[1:] | same[:-1]]
    key, ids, bits = key[order], ids[order], bits[order]
    others = others[order].view("u4").reshape(len(order), M)
    found: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
    for j in range(M if len(key) else 0):
        by = np.lexsort((ids, others[:, j], key))
        k, o = key[by], others[by, j]
        found.append(_paired(by, (k[1:] != k[:-1]) | (o[1:] != o[:-1]), ids, bits))
    return _pair_table(np.concatenate(found, axis=1))


def _grouped_candidates(table: pa.Table) -> pa.Table:
    """The same for entries that are dealt by group."""
    key, ids, bits = (entries(table[c].to_pylist(), t) for c, t in (("key", "u8"), ("id", "i8"), ("bits", "u8")))
    by = np.lexsort((ids, key))
    return _pair_table(_paired(by, key[by][1:] != key[by][:-1], ids, bits))


def _among(values: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in a sorted list, and where."""
    if not len(listed):
        return np.zeros(values.shape, bool), np.zeros(values.shape, np.int64)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values, at


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, pairs, bits, and the keys of the first pairs."""
    n = len(batch)
    pairs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(n, 2 * M)
    bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64)
    return batch.column(0).to_numpy(), pairs, bits, mix(pairs[:, :M] + np.arange(M, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _in_groups(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bits, row, group) of some classes at a time: the groups of each one's frequent first pairs, row being its place in ids and bits."""
    for batch in batches:
        for at in range(0, len(batch), CHUNK_CLASSES):
            ids, pairs, bits, keys = _unpacked(batch.slice(at, CHUNK_CLASSES))
            row, i = np.nonzero(_among(keys, frequent)[0])
            groups = mix(keys[row, i][:, None] + pairs[row, M:] * np.uint64(0xD1342543DE82EF95))
            yield ids, bits, np.repeat(row, M), groups.ravel()


def _frequent(counted: DataFrame, most: int) -> np.ndarray:
    """Of rows (key, n), the keys whose numbers add up to more than `most`, sorted."""
    rows = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _counts(keys: np.ndarray) -> pa.RecordBatch:
    found, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])


def _frequent_group_pairs(classes: DataFrame, frequent: np.ndarray, groups: np.ndarray) -> DataFrame:
    """Pairs (a, b, star) of the members of frequent groups with their group's middle. Groups' bits are added up and their middles chosen by partial aggregates; members stay where they are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for _, bits, row, key in _in_groups(batches, frequent):
            good, at = _among(key, groups)
            order = np.argsort(at[good], kind="stable")
            row, at = row[good][order], at[good][order]
            if not len(at):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
            sums = np.add.reduceat(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1)[row], cuts, axis=0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cuts) + 1) * 64, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts].astype(np.int32)), pa.array(np.diff(np.append(cuts, len(at)))), lists], ["at", "n", "sums"])

    added = classes.mapInArrow(add, "at int, n long, sums array<long>").groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(64)))
    most = F.concat(*(F.when(2 * F.col(f"s{k}") >= F.col("n"), "1").otherwise("0") for k in range(64)))
    majority = np.zeros(len(groups), np.uint64)
    for r in added.select("at", most.alias("most")).collect():
        majority[r["at"]] = np.packbits(np.frombuffer(r["most"].encode(), np.uint8) - 48).view("u8")[0]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for ids, bits, row, key in _in_groups(batches, frequent):
            good, at = _among(key, groups)
            row, at = row[good], at[good]
            like = _agreement(bits[row], majority[at]).astype(np.int64)
            order = np.lexsort((ids[row], -like, at))
            row, at, like = row[order], at[order], like[order]
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(like[first]), pa.array(ids[row[first]])], ["at", "like", "id"])

    middles = classes.mapInArrow(best, "at int, like long, id long").groupBy("at").agg(F.min(F.struct((-F.col("like")).alias("unlike"), "id")).alias("first"))
    middle = np.zeros(len(groups), np.int64)
    for r in middles.select("at", "first.id").collect():
        middle[r["at"]] = r["id"]

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for ids, _, row, key in _in_groups(batches, frequent):
            good, at = _among(key, groups)
            yield from _pair_table(np.stack([middle[at[good]], ids[row[good]], np.ones(good.sum(), np.int64)])).to_batches()

    return classes.mapInArrow(stars, "a long, b long, star boolean")


def _candidate_pairs(classes: DataFrame, n: int) -> DataFrame:
    """classes: n rows id, pairs, bits."""
    buckets = bucket_count(classes.sparkSession)
    narrow = classes.select("id", "pairs", "bits")

    def first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for batch in batches:
            yield _counts(_unpacked(batch)[3].ravel())

    frequent = _frequent(narrow.mapInArrow(first_pairs, "key long, n long"), max(LARGE, M * n // LISTED))

    def entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for batch in batches:
            if not len(batch):
                continue
            ids, pairs, bits, keys = _unpacked(batch)
            row, i = np.nonzero(~_among(keys, frequent)[0])
            others = np.ascontiguousarray((pairs[:, M:] >> np.uint64(32)).astype(np.uint32)).view(np.dtype(("V", 4 * M))).ravel()
            yield blocks(bucket_of(keys[row, i], buckets), {"key": keys[row, i], "id": ids[row], "bits": bits[row], "others": others[row]})

    schema = "a long, b long, star boolean"
    dealt = narrow.mapInArrow(entry, "bucket int, key binary, id binary, bits binary, others binary")
    pairs = dealt.groupBy("bucket").applyInArrow(_candidates, schema)
    if len(frequent):

        def group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_only("near_dedup")
            for _, _, _, key in _in_groups(batches, frequent):
                yield _counts(key)

        groups = _frequent(narrow.mapInArrow(group_counts, "key long, n long"), max(LARGE, M * M * n // LISTED))

        def group_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_only("near_dedup")
            for ids, bits, row, key in _in_groups(batches, frequent):
                rest = ~_among(key, groups)[0]
                row, key = row[rest], key[rest]
                yield blocks(bucket_of(key, buckets), {"key": key, "id": ids[row], "bits": bits[row]})

        by_group = narrow.mapInArrow(group_entry, "bucket int, key binary, id binary, bits binary")
        pairs = pairs.union(by_group.groupBy("bucket").applyInArrow(_grouped_candidates, schema))
        if len(groups):
            pairs = pairs.union(_frequent_group_pairs(narrow, frequent, groups))
    return pairs.groupBy("a", "b").agg(F.max("star").alias("star"))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, star) with `linked`, whether the full shingle sets (id, shingles) are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(3), batch.column(4), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(linked, pa.bool_())], ["a", "b", "star", "linked"])

    # A middle is in as many pairs as its group has members: they are dealt by both ends, and its set goes along once for each part.
    parts = max(32, partitions(pairs.sparkSession))
    part = lambda c: F.when(F.col("star"), F.pmod(F.xxhash64(c), F.lit(parts))).otherwise(0).cast("int")
    joined = pairs.withColumns({"part_a": part("b"), "part_b": part("a")})
    for end in ("a", "b"):
        wanted = joined.select(end, f"part_{end}").distinct()
        joined = joined.join(wanted.join(sets.select(F.col("id").alias(end), F.col("shingles").alias(f"of_{end}")), end), [end, f"part_{end}"])
    return joined.select("a", "b", "star", "of_a", "of_b").mapInArrow(compare, "a long, b long, star boolean, linked boolean")


def _confirm(docs: DataFrame, pairs: DataFrame, percent: int, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b, star) with `linked`; and the shingle sets (id, shingles) of their documents. nodes: where ids are repeated, (id, doc_id, fp1, fp2) of each class; else its id is its document's."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for batch in batches:
            for first, last, data, starts in chunks(batch.column(1)):
                hashes, places = shingle_sets(lowered(data), starts)
                sets = pa.array([hashes[a:b].tobytes() for a, b in zip(places, places[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *map(pa.array, _fingerprints(hashes, places)), sets], ["id", "fp1", "fp2", "shingles"])

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = ids if nodes is None else nodes.join(ids, "id", "left_semi")
    of_docs = ids if nodes is None else wanted.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(of_docs, "id", "left_semi")
    sets = texts.mapInArrow(collect, "id long, fp1 long, fp2 long, shingles binary")
    if nodes is None:
        sets = sets.select("id", "shingles")
    else:
        sets = sets.withColumnRenamed("id", "doc_id").join(wanted, ["doc_id", "fp1", "fp2"]).groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = checkpoint(sets)
    return _compared(pairs, sets, percent), sets


def _tokens(members: DataFrame) -> DataFrame:
    """(family, id, component, size, token): a row for each shingle of each member."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup")
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                held = [np.frombuffer(b, np.int64) for b in part.column(3).to_pylist()]
                size = np.array([len(h) for h in held], np.int64)
                columns = [np.repeat(part.column(k).to_numpy(), size) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.repeat(size, size)), pa.array(np.concatenate(held))], ["family", "id", "component", "size", "token"])

    return members.select("family", "id", "component", "shingles").mapInArrow(spread, "family long, id long, component long, size long, token long")


def _by_rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links of open members, found through their rarest shingles; the open members for which that would make too many candidates).

    A set that is similar enough to one of n shingles shares ceil(n * percent / 100) of them with it, so at least one of any n - ceil(n * percent / 100) + 1. Of each open
    member those that fewest members of its family have are looked up among all members' shingles; each of those that is met is compared in full.
    """
    tokens = _tokens(members)
    own = _tokens(members.where("is_open"))
    often = tokens.join(own.select("family", "token").distinct(), ["family", "token"], "left_semi").groupBy("family", "token").agg(F.count("*").alias("n_having"))
    rarest = F.row_number().over(Window.partitionBy("id").orderBy("n_having", "token"))
    enough = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    looked_up = own.join(often, ["family", "token"]).withColumn("place", rarest).where(F.col("place") <= enough)
    cost = looked_up.groupBy("id", "family").agg(F.sum("n_having").alias("cost")).join(members.select("id", "n"), "id")
    few = checkpoint(cost.select("id", (F.col("cost") <= F.greatest(F.lit(FEW_CANDIDATES), F.col("n") / BLOCK_ROWS)).alias("few")))
    wanted = looked_up.join(few.where("few"), "id", "left_semi").select("family", "token", F.col("id").alias("open_id"), F.col("component").alias("open_component"))
    met = tokens.join(wanted, ["family", "token"]).where(F.col("component") != F.col("open_component"))
    pairs = met.select(F.least("id", "open_id").alias("a"), F.greatest("id", "open_id").alias("b"), F.lit(True).alias("star")).distinct()
    links = _compared(checkpoint(pairs), sets, percent).where("linked").select("a", "b")
    return links, few.where("NOT few").select("id")


def _second_round(star: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between members of families that aren't in their family's largest component and all its members; None if all are.

    star: the pairs of large groups with their middles; found: components of the links so far. Of a class's links to one
    component one is enough. In families with many open members these are looked up by their rarest shingles. The others, and those whose shingles are
    all frequent, are compared in blocks: a family's members and its open ones are dealt into blocks, and each pair of blocks is one task.
    """
    families = connected_components(star).withColumnRenamed("component", "family")
    members = checkpoint(families.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")))
    counts = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    counts = counts.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("n_open")).where("n_open > 0")
    many, seen = F.col("n_open") > MANY_BLOCKS * BLOCK_ROWS, Observation()
    counts = checkpoint(counts.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(many).alias("n_many")))
    if not seen.get["n"]:
        return None
    if not seen.get["n_many"]:
        return _in_blocks(members.join(counts, "family").withColumn("is_open", F.col("component") != F.col("largest")).join(sets, "id"), percent)
    within = checkpoint(members.join(counts, "family").withColumn("is_open", F.col("component") != F.col("largest")).join(sets, "id"))
    links, dense = _by_rare_shingles(within.where(many), sets, percent)
    left = within.join(dense.withColumn("dense", F.lit(True)), "id", "left").withColumn("is_open", F.col("is_open") & (~many | F.col("dense").isNotNull()))
    left = left.drop("n_open").join(left.groupBy("family").agg(F.count_if("is_open").alias("n_open")).where("n_open > 0"), "family")
    return links.union(_in_blocks(left, percent))


def _in_blocks(within: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the open ones of members (family, id, component, is_open, n, n_open, shingles) and all of their family."""
    deal = lambda n: F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / BLOCK_ROWS)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / BLOCK_ROWS).cast("int") - 1))
    left = within.select("family", "id", "component", "shingles", deal("n").alias("block"), each("n_open").alias("open_block"))
    right = within.where("is_open").select(
        F.col("family").alias("of"), F.col("id").alias("open_id"), F.col("component").alias("open_component"), F.col("shingles").alias("open_shingles"), each("n").alias("b1"), deal("n_open").alias("b2")
    )

    def link(all_: pa.Table, open_: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if len(all_) and len(open_):
            sized = [np.frombuffer(b, np.uint64) for b in all_["shingles"].to_pylist()]
            sizes = np.array([len(x) for x in sized])
            tokens, inverse = np.unique(np.concatenate(sized), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            owner = np.repeat(np.arange(len(sized)), sizes)[order]
            places = np.searchsorted(inverse[order], np.arange(len(tokens) + 1))
            ids, component = all_["id"].to_numpy(), all_["component"].to_numpy()
            for own, own_component, shingles in zip(open_["open_id"].to_pylist(), open_["open_component"].to_pylist(), open_["open_shingles"].to_pylist(), strict=True):
                wanted = np.frombuffer(shingles, np.uint64)
                at = np.minimum(np.searchsorted(tokens, wanted), len(tokens) - 1)
                at = at[tokens[at] == wanted]
                counts = places[at + 1] - places[at]
                which = np.repeat(places[at] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(at) else np.zeros(0, np.int64)
                both = np.bincount(owner[which], minlength=len(sized))
                good = np.flatnonzero((100 * both >= percent * (sizes + len(wanted) - both)) & (component != own_component))
                for k in good[np.unique(component[good], return_index=True)[1]]:
                    out.append((min(own, int(ids[k])), max(own, int(ids[k]))))
        columns = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return left.groupBy("family", "block", "open_block").cogroup(right.groupBy("of", "b1", "b2")).applyInArrow(link, "a long, b long")


#: A class whose documents are all rows of ids that other texts have too gets a number from here on, beyond usual ids.
NUMBERED = 1 << 62


def _repeated(signed: DataFrame) -> tuple[DataFrame, int]:
    """doc_id and n (rows) of ids that rows of different sets have, with the least of these sets; sets without shingles come last. And how many ids that are."""
    of_row = F.struct((F.col("n_shingles") == 0).alias("blank"), "fp1", "fp2")
    rows = signed.groupBy("doc_id").agg(F.min(of_row).alias("least"), F.max(of_row).alias("most"), F.count("*").alias("n"))
    return counted(rows.where("least <> most").select("doc_id", "n", F.col("least.fp1").alias("least1"), F.col("least.fp2").alias("least2")))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, digest, n_shingles, component_id, and of_text: the component of the row's text alone, without what other texts of its id are linked with, and text_id, the smallest doc_id there. Rows without doc_id are left out.

    A class of equal sets is a node by its smallest id. An id with several sets is that of the least one; its other sets get numbers, and links to the first for component_id.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    signed = checkpoint(signatures(known))
    repeated, several = _repeated(signed)
    keys, nodes = ["fp1", "fp2", "n_shingles"], None
    full = signed.where("n_shingles > 0").withColumn("node", F.col("doc_id"))
    if several:
        first = (F.col("fp1") == F.col("least1")) & (F.col("fp2") == F.col("least2"))
        number = F.xxhash64("doc_id", "fp1", "fp2").bitwiseAND(F.lit(NUMBERED - 1)) + F.lit(NUMBERED)
        met = join_counted(full, repeated, ["doc_id"]).withColumn("node", F.when(first, F.col("doc_id")).otherwise(number))
        full = checkpoint(full.join(repeated, "doc_id", "left_anti").unionByName(met.select(full.columns)))
    least = F.min_by(F.struct(F.col("node").alias("id"), "doc_id"), "node")
    classes, n = counted(full.groupBy(*keys).agg(least.alias("least"), F.first("pairs").alias("pairs"), F.first("bits").alias("bits")).select(*keys, "least.id", "least.doc_id", "pairs", "bits"))
    if several:
        nodes = classes.select("id", "doc_id", "fp1", "fp2")
    confirmed, sets = _confirm(known, checkpoint(_candidate_pairs(classes, n)), percent, nodes)
    confirmed, apart = counted(confirmed, F.col("star") & ~F.col("linked"))
    links = confirmed.where("linked").select("a", "b")
    found = connected_components(links)
    # Where all are linked with their middles, each family is in one component.
    more = _second_round(confirmed.where("star").select("a", "b"), found, sets, percent) if apart else None
    if more is not None:
        more, n_more = counted(more)
        if n_more:
            links = links.union(more)
            found = with_links(found, more)
    of_class = checkpoint(classes.select(*keys, "id").join(found, "id", "left").select(*keys, "id", F.coalesce("component", "id").alias("of_text")))
    rows = signed.select("doc_id", "digest", *keys)
    if not several:
        out = rows.join(of_class.drop("id"), keys, "left")
        component = F.coalesce("of_text", "doc_id")
        return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), component.alias("of_text"), component.alias("text_id"))
    # Components of texts and of ids have the smallest of their documents' ids, not of their nodes' numbers.
    rows = checkpoint(rows.join(of_class, keys, "left"))
    ties = rows.where("id IS NOT NULL").join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "id").agg(F.first("of_text").alias("of_text"))
    ties = ties.join(ties.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b"))
    by_id = connected_components(links.union(checkpoint(ties)))
    rows = checkpoint(rows.join(by_id, "id", "left").withColumn("of_id", F.coalesce("component", "id")).drop("component"))
    for column, least_id in (("of_text", "text_id"), ("of_id", "component_id")):
        smallest = checkpoint(rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("doc_id").alias(least_id), F.count("*").alias("n")))
        rows = join_counted(rows, smallest, [column]).unionByName(rows.where(F.col(column).isNull()).withColumn(least_id, F.lit(None).cast("long")))
        rows = checkpoint(rows)
    # A blank text goes with its id's other ones.
    of_ids = checkpoint(rows.join(repeated.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("of_doc"), F.count("*").alias("n")))
    single = rows.join(of_ids, "doc_id", "left_anti").withColumn("of_doc", F.lit(None).cast("long"))
    rows = join_counted(rows, of_ids, ["doc_id"]).unionByName(single)
    return rows.select("doc_id", "digest", "n_shingles", F.coalesce("of_doc", "component_id", "doc_id").alias("component_id"), F.coalesce("of_text", "doc_id").alias("of_text"), F.coalesce("text_id", "doc_id").alias("text_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets of five-word shingles, and a component is all that
    links connect; component_id is its smallest doc_id and kept marks that document. Null and blank texts have no set and are alone. Rows
    repeated under one id, with one text or several, are one node of the graph. Rows with a null id are linked with nothing and kept.
    """
    out = _grouped(docs, percent).select("doc_id", "n_shingles", "component_id")
    alone = signatures(docs.where(F.col("doc_id").isNull())).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, in all their columns, without near copies: of the texts that links connect the one of the smallest id stays, of several texts of that id the one with the smallest digest.

    An id with several texts may lose some and keep others. Rows without id or without words stay; so do rows that repeat both id and text of one that stays.
    """
    rows = _grouped(docs, percent)
    blank = F.col("n_shingles") == 0
    # Blank rows are all kept: their groups are those of equal ids and texts.
    group = [blank.alias("blank"), F.when(~blank, F.col("of_text")).alias("of_text"), F.when(blank, F.col("doc_id")).alias("own"), F.when(blank, F.col("digest")).alias("own_digest")]
    kept = rows.where(blank | (F.col("doc_id") == F.col("text_id"))).groupBy(*group).agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    (doc, digest) = unused(docs.columns, "doc", "digest")
    stays = kept.select(F.col("first.doc_id").alias(doc), F.col("first.digest").alias(digest))
    known = docs.where(F.col("doc_id").isNotNull())
    left = known.join(stays, (known["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(known["text"].cast("string")) == F.col(digest)), "left_semi")
    return left.unionByName(docs.where(F.col("doc_id").isNull()))
