"""The prefix trie of conversations, by the Euler-tour technique.

A node is a sequence of first turns; conversations that begin with it are its members. Prefixes are told apart by two 64-bit sums (exclusive or) of
their turns' hashes, each taken with its place, so they are added up over blocks of turns and no task holds a whole conversation. Nodes are numbered by
(smallest member, depth). Each gets an arc that enters it and one that leaves it, and each arc its successor in the tour: the first child's entering
arc, the next sibling's, or the parent's leaving one. The list of arcs is ranked by contraction: chains of arcs that lie in one task, mostly whole
runs of the numbering, become one; then arcs that a coin chooses join those before them, round by round, until LAST_ARCS are left for one task; and the places go back
the same way. With the places come the sums of leaves and savings up to each arc, so a node's subtree has the difference between its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, join_counted, keep_only, partitions

#: Turns that a conversation takes over are at most one fewer.
SHARED = 6
#: Turns of a conversation whose prefixes one task adds up.
BLOCK_TURNS = 4096
#: Arcs whose chains a task contracts in one go, and arcs, counted, that one task ranks.
CHUNK_ARCS, LAST_ARCS = 1 << 18, 1 << 16
#: Ids that are spelt in one piece.
PIECE = 512

_SUMS = ("place", "leaves", "saved")


def rebuilt_from(conv_id: Column) -> tuple[Column, Column]:
    """The conversation whose first turns one takes over, and how many."""
    return conv_id - conv_id % 100, F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def _hashes(*parts: Column) -> list[Column]:
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *reversed(parts))]


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), k1, k2 (hashes of role and text), length (code points of the text), in order of turn (null first), then role and text. n: the conversation's number of turns."""
    known = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    order = ("conv_id", "turn", "role", "text")
    k1, k2 = _hashes(F.col("role"), F.col("text"))
    # Texts are needed for the order only. A row's number has its partition's number in the upper bits, its place there in the lower 33.
    ranged = known.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = checkpoint(ranged.select("conv_id", k1.alias("k1"), k2.alias("k2"), F.length("text").cast("long").alias("length"), F.monotonically_increasing_id().alias("at")))
    parts = rows.groupBy("conv_id", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    # A row for each partition that a conversation is in.
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("rows")
    parts = checkpoint(parts.select("conv_id", "part", "first", before.alias("before"), F.col("rows").alias("n"), F.sum("rows").over(Window.partitionBy("conv_id")).alias("turns")))
    placed = join_counted(rows.withColumn("part", F.shiftright("at", 33)), parts, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("pos"), "k1", "k2", "length", F.col("turns").alias("n"))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows conv_id, depth, k1, k2, length of all conversations as rebuilt; conv_id and n_turns of each, of those without turns too)."""
    rows = checkpoint(numbered_turns(turns))
    base, taken = rebuilt_from(F.col("conv_id"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", "n", base.alias("base"), taken.alias("taken"))
    there = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(there, "base", "left").withColumn("heads", F.least("taken", F.coalesce("base_n", F.lit(0))))
    convs = checkpoint(convs.select("conv_id", "n", "base", "taken", "heads"))
    # Of a conversation at most SHARED - 1 turns, for at most 100 others.
    heads = rows.where((F.col("pos") < SHARED) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "base")
    heads = convs.where("heads > 0").select("conv_id", "base", "heads").join(heads, "base").where("pos <= heads").select("conv_id", F.col("pos").alias("depth"), "k1", "k2", "length")
    _, own_taken = rebuilt_from(F.col("conv_id"))
    own = join_counted(rows.drop("n").where(F.col("pos") > own_taken), convs.select("conv_id", "n", "heads", "taken"), ["conv_id"])
    own = own.select("conv_id", (F.col("heads") + F.col("pos") - F.col("taken")).alias("depth"), "k1", "k2", "length")
    n_turns = F.col("heads") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))
    return heads.union(own), convs.select("conv_id", n_turns.alias("n_turns"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Rebuilt rows with p1, p2 of the prefix that ends there and q1, q2 of the one before."""
    z1, z2 = F.xxhash64("depth", "k1", "k2"), F.xxhash64("k2", "depth", "k1")
    rows = rows.select("conv_id", "depth", "length", z1.alias("z1"), z2.alias("z2"), F.floor((F.col("depth") - 1) / BLOCK_TURNS).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    within = checkpoint(rows.select("conv_id", "depth", "length", "block", "z1", "z2", F.bit_xor("z1").over(inside).alias("p1"), F.bit_xor("z2").over(inside).alias("p2")))
    totals = within.where(F.col("depth") % BLOCK_TURNS == 0).select("conv_id", (F.col("block") + 1).alias("block"), "p1", "p2")
    # A row for each full block.
    earlier = Window.partitionBy("conv_id").orderBy("block")
    before = totals.select("conv_id", "block", F.bit_xor("p1").over(earlier).alias("b1"), F.bit_xor("p2").over(earlier).alias("b2"))
    first, later = within.where("block = 0"), within.where("block > 0")
    later = later.join(before, ["conv_id", "block"]).withColumns({c: F.col(c).bitwiseXOR(F.col(b)) for c, b in (("p1", "b1"), ("p2", "b2"))})
    both = first.unionByName(later.select(first.columns))
    return both.select("conv_id", "depth", "length", "p1", "p2", *(F.col(p).bitwiseXOR(F.col(z)).alias(q) for p, z, q in (("p1", "z1", "q1"), ("p2", "z2", "q2"))))


def nodes_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """node (a number, by smallest member and depth), conv_id, depth, p1, p2, parent, parent_conv_id (null at the root), n_convs, length of the last text."""
    found = rows.groupBy("depth", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("length"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    root = convs.groupBy(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = root.withColumns({c: F.lit(0).cast("long") for c in ("length", "q1", "q2")})
    every = found.unionByName(root)
    ranged = every.repartitionByRange(partitions(rows.sparkSession), "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    placed = checkpoint(ranged.withColumn("node", F.monotonically_increasing_id()))
    above = placed.where("depth > 0").groupBy((F.col("depth") - 1).alias("above"), "q1", "q2").agg(F.count("*").alias("n"))
    parents = placed.select(F.col("depth").alias("above"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = checkpoint(above.join(parents, ["above", "q1", "q2"]))
    below = join_counted(placed.where("depth > 0").withColumn("above", F.col("depth") - 1), parents, ["above", "q1", "q2"])
    columns = ("node", "conv_id", "depth", "p1", "p2", "parent", "parent_conv_id", "n_convs", "length")
    top = placed.where("depth = 0").withColumns({c: F.lit(None).cast("long") for c in ("parent", "parent_conv_id")})
    return checkpoint(below.select(*columns).unionByName(top.select(*columns)))


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs: arc, next and what each adds to place, leaves and saved; node and n_children of those with children). Node v is entered by arc 2 v and left by 2 v + 1; children go by number."""
    families = checkpoint(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("first_child"), F.count("*").alias("n_children")))
    # Siblings follow each other in an order of all nodes; a family may be long, so ranges of the order are looked at, not families.
    ordered = nodes.where("parent IS NOT NULL").select("parent", "node").repartitionByRange(partitions(nodes.sparkSession), "parent", "node").sortWithinPartitions("parent", "node")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, next sibling) in a range; of its first and last row (parent, node) too, with their place."""
        keep_only("trie")
        last: tuple[int, int] | None = None
        for batch in batches:
            parent, node = (batch.column(k).to_numpy() for k in (0, 1))
            if not len(node):
                continue
            if last is None:
                yield _ends(0, parent[0], node[0])
            else:
                parent, node = np.append(last[0], parent), np.append(last[1], node)
            same = parent[1:] == parent[:-1]
            yield pa.RecordBatch.from_arrays([pa.nulls(int(same.sum()), pa.int32()), pa.nulls(int(same.sum()), pa.int64()), pa.array(node[:-1][same]), pa.array(node[1:][same])], ["edge", "parent", "node", "sibling"])
            last = (parent[-1], node[-1])
        if last is not None:
            yield _ends(1, *last)

    followed = checkpoint(ordered.mapInArrow(follow, "edge int, parent long, node long, sibling long"))
    # Two rows for each partition: the last of a range goes on with the first of the next one.
    edges = followed.where("edge IS NOT NULL")
    by_place = Window.orderBy("parent", "node", "edge")
    joined = edges.select("edge", "parent", "node", F.lead("edge").over(by_place).alias("e"), F.lead("parent").over(by_place).alias("p"), F.lead("node").over(by_place).alias("sibling")).where("edge = 1 AND e = 0 AND p = parent").select("node", "sibling")
    siblings = followed.where("edge IS NULL").select("node", "sibling").union(joined)
    placed = nodes.join(families, "node", "left").join(siblings, "node", "left")
    saved = (F.col("n_convs") - 1) * F.col("length")
    zero = F.lit(0).cast("long")
    enter = F.struct((2 * F.col("node")).alias("arc"), F.coalesce(2 * F.col("first_child"), 2 * F.col("node") + 1).alias("next"), F.lit(1).cast("long").alias("place"), F.when(F.col("first_child").isNull(), 1).otherwise(0).cast("long").alias("leaves"), saved.alias("saved"))
    leave = F.struct((2 * F.col("node") + 1).alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"), F.lit(1).cast("long").alias("place"), zero.alias("leaves"), zero.alias("saved"))
    arcs = placed.select(F.explode(F.array(enter, leave)).alias("a")).select("a.*")
    return arcs, families.select("node", "n_children")


def _ends(edge: int, parent: int, node: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([edge], pa.int32()), pa.array([int(parent)], pa.int64()), pa.array([int(node)], pa.int64()), pa.nulls(1, pa.int64())], ["edge", "parent", "node", "sibling"])


def _chains(arc: np.ndarray, next_: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the chain's head, whether the arc ends its chain, sums up to and with it) of each arc, where arcs whose successor is here too form chains; by jumps that double."""
    order = np.argsort(arc)
    at = np.minimum(np.searchsorted(arc, next_, sorter=order), len(arc) - 1)
    there = arc[order[at]] == next_
    before = np.full(len(arc), -1)
    before[order[at[there]]] = np.flatnonzero(there)
    head, sums = np.arange(len(arc)), sums.copy()
    jump = before.copy()
    while (going := np.flatnonzero(jump >= 0)).size:
        to = jump[going]
        added, heads, onward = sums[:, to], head[to], jump[to]
        sums[:, going] += added
        head[going] = np.where(onward >= 0, to, heads)
        jump[going] = onward
    return head, ~there, sums


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arc, next, head, and sums up to and with the arc; a row for each chain's head has `whole`, the chain's sums, and the successor of its end in next."""
    keep_only("trie")
    held, n = [], 0

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        arc, next_ = table["arc"].to_numpy(), table["next"].fill_null(-1).to_numpy()
        head, ends, sums = _chains(arc, next_, np.stack([table[c].to_numpy() for c in _SUMS]))
        is_head = head == np.arange(len(arc))
        behind, whole = np.full(len(arc), -1), np.zeros_like(sums)
        behind[head[ends]], whole[:, head[ends]] = next_[ends], sums[:, ends]
        masked = lambda values, mask: pa.array(values, pa.int64(), mask=mask)
        columns = [pa.array(arc), pa.array(arc[head]), *map(pa.array, sums), masked(behind, ~is_head | (behind < 0)), *(masked(w, ~is_head) for w in whole)]
        return pa.RecordBatch.from_arrays(columns, ["arc", "head", *_SUMS, "next", *(f"whole_{c}" for c in _SUMS)])

    for batch in batches:
        for at in range(0, len(batch), CHUNK_ARCS):
            part = batch.slice(at, CHUNK_ARCS)
            if held and n + len(part) > CHUNK_ARCS:
                yield out(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if n:
        yield out(held)


_CONTRACTED = "arc long, head long, place long, leaves long, saved long, next long, whole_place long, whole_leaves long, whole_saved long"


def rank(arcs: DataFrame) -> DataFrame:
    """arc with the sums of place, leaves and saved over the list up to and with it. arcs: arc, next (null at the end), and what each adds; one list.

    Chains within a task first; then each round the arcs whose coin shows a head behind one whose coin doesn't are taken into that one, a quarter of them on
    average, by one join by arc. LAST_ARCS and fewer, counted, are ranked in one task. What was taken in gets its sums from what took it, round by round back.
    """
    # In the order of their numbers most arcs lie near their successors.
    ranged = checkpoint(arcs).repartitionByRange(partitions(arcs.sparkSession), "arc").sortWithinPartitions("arc")
    contracted = checkpoint(ranged.mapInArrow(contract, _CONTRACTED))
    live = checkpoint(contracted.where("whole_place IS NOT NULL").select("arc", "next", *(F.col(f"whole_{c}").alias(c) for c in _SUMS)))
    rounds: list[DataFrame] = []
    while live.count() > LAST_ARCS:
        turn = len(rounds)
        coin = lambda c, t=turn: F.xxhash64(F.lit(t), F.col(c)) % 2 == 0  # noqa: E731,B023
        takes = ~coin("arc") & F.col("next").isNotNull() & coin("next")
        takers = live.where(takes).select(F.col("next").alias("met"), "arc", *_SUMS)
        others = live.where(coin("arc")).select(F.col("arc").alias("met"), F.col("next").alias("on"), *(F.col(c).alias(f"o_{c}") for c in _SUMS))
        met = checkpoint(takers.join(others, "met", "right"))
        rounds.append(met.where("arc IS NOT NULL").select(F.col("met").alias("arc"), F.col("arc").alias("taker"), *(F.col(f"o_{c}").alias(c) for c in _SUMS)))
        grown = met.where("arc IS NOT NULL").select("arc", F.col("on").alias("next"), *((F.col(c) + F.col(f"o_{c}")).alias(c) for c in _SUMS))
        alone = met.where("arc IS NULL").select(F.col("met").alias("arc"), F.col("on").alias("next"), *(F.col(f"o_{c}").alias(c) for c in _SUMS))
        live = checkpoint(grown.union(alone).union(live.where(~coin("arc") & ~takes)))
    done = checkpoint(live.repartition(1).mapInArrow(_last, "arc long, place long, leaves long, saved long"))
    for taken in reversed(rounds):
        # Up to the end of a taker is up to the end of what it took last; without that, up to its own.
        of_taker = checkpoint(taken.join(done.select(F.col("arc").alias("taker"), *(F.col(c).alias(f"t_{c}") for c in _SUMS)), "taker"))
        whole = of_taker.select("arc", *(F.col(f"t_{c}").alias(c) for c in _SUMS))
        own = of_taker.select(F.col("taker").alias("arc"), *((F.col(f"t_{c}") - F.col(c)).alias(c) for c in _SUMS))
        done = checkpoint(done.join(of_taker.select(F.col("taker").alias("arc")), "arc", "left_anti").union(whole).union(own))
    before = done.select(F.col("arc").alias("head"), *(F.col(c).alias(f"b_{c}") for c in _SUMS))
    heads = contracted.where("whole_place IS NOT NULL").join(before, "head").select("head", *((F.col(f"b_{c}") - F.col(f"whole_{c}")).alias(f"b_{c}") for c in _SUMS))
    return contracted.select("arc", "head", *_SUMS).join(heads, "head").select("arc", *((F.col(f"b_{c}") + F.col(c)).alias(c) for c in _SUMS))


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_only("trie")
    parts = list(batches)
    if parts:
        table = pa.Table.from_batches(parts)
        arc = table["arc"].to_numpy()
        _, _, sums = _chains(arc, table["next"].fill_null(-1).to_numpy(), np.stack([table[c].to_numpy() for c in _SUMS]))
        yield pa.RecordBatch.from_arrays([pa.array(arc), *map(pa.array, sums)], ["arc", *_SUMS])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, p1, p2 and ends_sha256: the digest of the ids (conv_id) at each prefix, ascending, joined by commas. ends: depth, p1, p2, conv_id.

    Ids are spelt in pieces by ranges of the order, so the task that digests a prefix reads them as texts of PIECE ids, one after another, and holds one batch at a time.
    """
    keys = ("depth", "p1", "p2")
    ranged = ends.repartitionByRange(partitions(ends.sparkSession), *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("trie")
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            ids = batch.column(3).to_numpy()
            if not len(ids):
                continue
            new = np.ones(len(ids), bool)
            new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
            since = np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            cuts = np.append(np.flatnonzero(since % PIECE == 0), len(ids))
            pieces = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[cuts[:-1]]) for k in key), pa.array(ids[cuts[:-1]]), pa.array(pieces, pa.string())], [*keys, "first", "piece"])

    spelt = ranged.select(*keys, "conv_id").mapInArrow(spell, "depth long, p1 long, p2 long, first long, piece string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("trie")
        key, running = None, None
        for batch in batches:
            out = []
            for *own, piece in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if own != key:
                    if key is not None:
                        out.append((*key, running.hexdigest()))
                    key, running = own, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(piece.encode())
            yield _digests(out)
        if key is not None:
            yield _digests([(*key, running.hexdigest())])

    dealt = spelt.repartition(partitions(ends.sparkSession), *keys).sortWithinPartitions(*keys, "first")
    return dealt.mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["depth", "p1", "p2", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie of rebuilt conversations.

    turns: conv_id, turn, role, text; other columns don't count. Rows without conv_id belong to no conversation and are left out. Null turns come first, equal ones go by role, then text; null role and text are
    empty. A conversation begins with the first h turns of the one whose number ends in 00 below it, h being its id's CRC-32 modulo 6, and goes on with its own after the first h. conv_id is the
    smallest member, saved_tokens the code points that members share: (n_convs - 1) times each last text's, over the subtree. No conversations, no rows.
    """
    rows, convs = rebuild(turns)
    convs = checkpoint(convs)
    rows = checkpoint(prefixes(rows))
    nodes = nodes_of(rows, convs)
    arcs, children = tour(nodes)
    ranked = rank(arcs)
    # Sums grow along the tour, so a subtree's are those of the node's last arc without those before its first.
    subtree = ranked.groupBy(F.shiftright("arc", 1).alias("node")).agg(*((F.max(c) - F.min(c)).alias(c) for c in _SUMS[1:]))
    last = rows.join(convs.where("n_turns > 0").withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"]).select("depth", "p1", "p2", "conv_id")
    none = convs.where("n_turns = 0").select(*(F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2")), "conv_id")
    digests = end_digests(last.union(none))
    out = nodes.join(subtree, "node").join(children, "node", "left").join(digests, ["depth", "p1", "p2"], "left")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.col("leaves") + leaf).alias("n_leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("length")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
