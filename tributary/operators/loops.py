"""Loops over a table of edges: breadth-first search, peeling by degree, strongly connected components.

Frontiers stay in Spark and are written to the folder of spark.checkpoint.dir each round, so that plans don't grow and a lost
executor costs one round. The driver only learns how many rows were written. No side is broadcast by hint: adaptive
execution broadcasts a frontier whose size it has measured. What is left of a graph when it has at most LAST_EDGES edges, counted, is finished in
one task instead of one round for each level; the result is the same. Larger graphs are dealt into islands, sets of objects that no edge leaves: those of at most
LAST_EDGES rows, counted, are each finished in one task, many of them side by side, and the loops walk what is larger.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many edges, counted, and fewer are walked in one task.
LAST_EDGES = 100_000
#: Unions of parts that are written already are written anew each so many rounds only; the driver collects its garbage before each so many frames are written.
GATHER = 8
_written = 0
#: Searches of so few levels take their rounds; islands aren't looked for.
FEW_LEVELS = 3
#: Spark's setting by which the shuffle files of a statement go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where neither context nor session names one, a temporary one is set on a local master, as in tests, and a cluster, whose machines share no such folder, gets an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None and context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found or tempfile.mkdtemp(prefix="spark-")


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here go as soon as it is."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder. The shuffle files it was made from go as soon as it is written, not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    global _written
    _written += 1
    if _written % GATHER == 0:
        # Earlier rounds' folders, where spark.cleaner.referenceTracking.cleanCheckpoints is set, and shuffle files go when the driver collects its garbage; with little to do it rarely would.
        spark._jvm.System.gc()
    with _tidy(spark):
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting that holds when it is made


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """df, written, and how many rows it has, or for how many `what` holds, counted as they are written."""
    seen = Observation()
    written = checkpoint(df.observe(seen, F.count_if(F.lit(True) if what is None else what).alias("n")))
    return written, seen.get["n"]


def _adjacent(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, list[str]], list[str]]:
    """Of rows (near, far): whom each near end leads to, and the near ends without a far one."""
    to, alone = defaultdict(list), []
    for batch in batches:
        for near, far in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if far is None:
                alone.append(near)
            else:
                to[near].append(far)
    return to, alone


def _last_search(depth: int | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, frontier = _adjacent(batches)
        level = dict.fromkeys(frontier, 0)
        while frontier and (depth is None or level[frontier[0]] < depth):
            reached = dict.fromkeys(far for near in frontier for far in to[near] if far not in level)
            level |= dict.fromkeys(reached, level[frontier[0]] + 1)
            frontier = list(reached)
        yield pa.RecordBatch.from_arrays([pa.array(level.keys(), pa.string()), pa.array(level.values(), pa.int32())], ["id", "level"])

    return search


def _last_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (src, dst, far), and (src, null, level) for levels known so far: (id, level) of the far ends, the longest path that ends there, null in or behind a cycle."""
    to, missing, known = defaultdict(list), defaultdict(int), {}
    for batch in batches:
        for src, dst, far in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if dst is None:
                known[src] = max(known.get(src, 0), far)
            else:
                to[src].append((dst, far))
                missing[dst] += 1
    level = {near: known.get(near, 0) for near in to if near not in missing}
    free = list(level)
    for near in free:  # grows as nodes become free
        for dst, far in to.get(near, ()):
            level[dst] = max(level.get(dst, known.get(dst, 0)), level[near] + far)
            missing[dst] -= 1
            if not missing[dst]:
                free.append(dst)
    ids = list(missing)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([None if missing[i] else level[i] for i in ids], pa.int32())], ["id", "level"])


def _last_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (src, dst), and (id, null) for each known node: (id, level) of the known nodes, the longest path that ends there, null in or behind a cycle. Edges from or to other nodes don't count."""
    to, known = _adjacent(batches)
    level, missing = dict.fromkeys(known, 0), defaultdict(int)
    for near, fars in to.items():
        for far in fars:
            missing[far] += near in level
    free = [i for i in level if not missing.get(i)]
    for near in free:  # grows as nodes become free
        for far in to.get(near, ()):
            if far in level:
                level[far] = max(level[far], level[near] + 1)
                missing[far] -= 1
                if not missing[far]:
                    free.append(far)
    yield pa.RecordBatch.from_arrays([pa.array(level, pa.string()), pa.array([None if missing.get(i) else n for i, n in level.items()], pa.int32())], ["id", "level"])


def _last_depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, depth) of the near ends without a far one and of what they reach: the longest path from them, without nodes in or behind a cycle."""
    to, roots = _adjacent(batches)
    reached, first = list(dict.fromkeys(roots)), set(roots)
    seen, missing = set(reached), defaultdict(int)
    for near in reached:  # grows as nodes are reached
        for far in to.get(near, ()):
            if far not in seen:
                seen.add(far)
                reached.append(far)
            missing[far] += far not in first
    depth = {near: 0 for near in reached if not missing[near]}
    free = list(depth)
    for near in free:
        for far in to.get(near, ()):
            if far not in first:
                depth[far] = max(depth.get(far, 0), depth[near] + 1)
                missing[far] -= 1
                if not missing[far]:
                    free.append(far)
    yield pa.RecordBatch.from_arrays([pa.array(free, pa.string()), pa.array([depth[i] for i in free], pa.int32())], ["id", "depth"])


def _last_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of the nodes in strongly connected components of two and more: what is found forwards and backwards from a node, by two searches in depth."""
    to, _ = _adjacent(batches)
    back = defaultdict(list)
    for near, fars in to.items():
        for far in fars:
            back[far].append(near)
    done, seen = [], set()
    for start in list(to):
        if start in seen:
            continue
        seen.add(start)
        path = [(start, iter(to[start]))]
        while path:
            node, fars = path[-1]
            far = next((f for f in fars if f not in seen), None)
            if far is None:
                done.append(node)
                path.pop()
            else:
                seen.add(far)
                path.append((far, iter(to.get(far, ()))))
    ids, components, left = [], [], seen
    for start in reversed(done):
        if start in left:
            left.discard(start)
            members = [start]
            for node in members:  # grows as members are found
                nears = [n for n in dict.fromkeys(back.get(node, ())) if n in left]
                left.difference_update(nears)
                members += nears
            if len(members) > 1:
                ids += members
                components += [min(members)] * len(members)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(components, pa.string())], ["id", "component"])


def _last_islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, island) of the ends of rows (a, b): the least end that each is connected with."""
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
    parts = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([root(x) for x in parts], pa.int64())], ["part", "island"])


def _in_file(df: DataFrame, path: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """Like counted, in files of path, which whoever names it deletes. What Spark knows of the size is the files', where a checkpoint's is multiplied at each join that led to it."""
    seen = Observation()
    with _tidy(df.sparkSession):
        df.observe(seen, F.count_if(F.lit(True) if what is None else what).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def _islands(pairs: DataFrame, path: str) -> DataFrame:
    """(part, island) of the ends of pairs (a, b), numbers: ends that are connected have one island.

    Each round an end joins its first neighbour, by a hash that is another each round, if that comes before itself, and that one's own choice; pairs then run between what ends have become, so they
    shrink by a factor in each round. LAST_EDGES and fewer, counted, are closed in one task. Rounds are written to folders of path.
    """
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both, n = _in_file(pairs.union(turned).distinct(), f"{path}/pairs-0")
    found, turn = None, 0

    def moved(step: DataFrame) -> DataFrame:
        return step if found is None else found.join(step.toDF("island", "to"), "island", "left").select("part", F.coalesce("to", "island").alias("island"))

    while n > LAST_EDGES:
        turn += 1
        order = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), F.col(c)).alias("h"), F.col(c).alias("id"))
        chosen = both.groupBy("a").agg(F.min(order("b")).alias("first")).select(F.col("a").alias("part"), F.least("first", order("a"))["id"].alias("island"))
        onward = chosen.select(F.col("part").alias("island"), F.col("island").alias("further"))
        chosen, _ = _in_file(chosen.join(onward, "island").select("part", F.col("further").alias("island")), f"{path}/chosen-{turn}")
        found = chosen if found is None else _in_file(moved(chosen), f"{path}/found-{turn}")[0]
        from_a = both.join(chosen.toDF("a", "from"), "a").select("from", "b")
        between = from_a.join(chosen.toDF("b", "to"), "b").where("from <> to").select(F.col("from").alias("a"), F.col("to").alias("b"))
        both, n = _in_file(between.distinct(), f"{path}/pairs-{turn}")
    last, _ = _in_file(both.repartition(1).mapInArrow(_last_islands, "part long, island long"), f"{path}/last")
    return moved(last)


def _finished(rows: DataFrame, last: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> tuple[DataFrame, DataFrame | None]:
    """(what `last` gives for the rows of islands of LAST_EDGES rows and fewer; the other rows, None if there are none), written. rows: two ends, the second null for a node alone.

    An island is a set of objects that no row leaves; objects are what stands before an id's first dot. Objects and islands go by hashes: of two that have one hash the islands are one, which changes no result.
    """
    spark, (near, far) = rows.sparkSession, rows.columns
    part = lambda end: F.xxhash64(F.substring_index(end, ".", 1))
    path = f"{shared_folder(spark)}/islands-{uuid.uuid4().hex}"
    try:
        found = _islands(rows.where(F.col(far).isNotNull()).select(part(near).alias("a"), part(far).alias("b")).where("a <> b").distinct(), path)
        sized = rows.groupBy(part(near).alias("part")).agg(F.count("*").alias("n")).join(found, "part", "left").select("part", F.coalesce("island", "part").alias("island"), "n")
        sized, _ = _in_file(sized, f"{path}/sized")
        large = sized.groupBy("island").agg(F.sum("n").alias("n")).where(F.col("n") > LAST_EDGES).select("island", F.lit(True).alias("large"))
        placed = sized.join(large, "island", "left").select("part", F.when(F.col("large").isNull(), F.col("island")).alias("island"))
        placed, n_large = _in_file(placed, f"{path}/placed", F.col("island").isNull())
        met = rows.withColumn("part", part(near)).join(placed, "part").select(near, far, "island")
        done = checkpoint(_by_island(met.where("island IS NOT NULL"), last, schema))
        return done, checkpoint(met.where("island IS NULL").select(near, far)) if n_large else None
    finally:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _by_island(rows: DataFrame, last: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `last` gives for rows with island, taken in turns of whole islands of LAST_EDGES rows together, about."""
    most = LAST_EDGES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n + batch.num_rows > most:
                islands = batch.column("island")
                begins = islands.index(islands[-1]).as_py()  # islands are sorted: the batch's last one begins here and may go on
                if begins or (held and held[-1].column("island")[-1].as_py() != islands[0].as_py()):
                    yield from last(iter([*held, batch.slice(0, begins)]))
                    held, n, batch = [], 0, batch.slice(begins)
            held.append(batch)
            n += batch.num_rows
        yield from last(iter(held))

    return rows.repartition("island").sortWithinPartitions("island").mapInArrow(each, schema)


def small_depths(edges: DataFrame, roots: DataFrame) -> DataFrame | None:
    """(id, depth): the longest paths from roots (id), in one task, if edges (src, dst) and roots are LAST_EDGES and fewer, counted; else None."""
    rows = edges.select("src", "dst").union(roots.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"))).distinct()
    rows, n = counted(rows)
    return checkpoint(rows.repartition(1).mapInArrow(_last_depths, "id string, depth int")) if n <= LAST_EDGES else None


def bfs(edges: DataFrame, roots: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """(id, level): every node that roots (id) reach over edges (src, dst), at its least distance; up to depth if given. Roots are there even if no edge knows them."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    steps, n_steps = counted(edges.select(F.col(near).alias("near"), F.col(far).alias("far")).distinct())
    visited, n_roots = counted(roots.select("id").distinct().withColumn("level", F.lit(0)))
    rows, done = steps.union(visited.select("id", F.lit(None).cast("string"))), None
    if n_steps + n_roots <= LAST_EDGES:
        return checkpoint(rows.repartition(1).mapInArrow(_last_search(depth), "id string, level int"))
    if depth is None or depth > FEW_LEVELS:
        done, large = _finished(rows, _last_search(depth), "id string, level int")
        if large is None:
            return done
        steps, visited = large.where("far IS NOT NULL"), large.where("far IS NULL").select(F.col("near").alias("id"), F.lit(0).alias("level"))
    frontier, level = visited, 0
    while depth is None or level < depth:
        level += 1
        reached = steps.join(frontier.select(F.col("id").alias("near")), "near", "left_semi").select(F.col("far").alias("id")).distinct()
        frontier, n = counted(reached.join(visited, "id", "left_anti").withColumn("level", F.lit(level)))
        if not n:
            break
        visited = _gathered(visited.union(frontier), level)
    return visited if done is None else done.union(visited)


def _gathered(parts: DataFrame, turn: int) -> DataFrame:
    return checkpoint(parts) if turn % GATHER == 0 else parts


def numbered(df: DataFrame, order: Sequence[str], column: str, n: int | None = None) -> DataFrame:
    """df with the place of each row in an order (from 1). Ranges of the order are numbered apart and moved by what the ranges before hold, so no task sorts them all; n, where known, says that they are few."""
    if n is not None and n <= LAST_EDGES:
        return df.withColumn(column, F.row_number().over(Window.orderBy(*order)).cast("long"))
    # A row's number has its partition's number in the upper bits, its place in the partition in the lower 33.
    placed = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(column, F.monotonically_increasing_id()))
    part = F.shiftright(column, 33)
    before = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    return placed.join(before, part == before["part"]).select(*df.columns, (F.col("before") + F.col(column).bitwiseAND(F.lit(2**33 - 1)) + 1).alias(column))


def walked(edges: DataFrame, visited: DataFrame, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """The edges that a search walks: those at whose near end a node of level < depth was."""
    near = "dst" if reverse else "src"
    inner = visited if depth is None else visited.where(F.col("level") < depth)
    return edges.join(inner.select(F.col("id").alias(near)), near, "left_semi").select(edges.columns)


def _contracted(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges without inner nodes, inner nodes, nodes of rings). Inner nodes have one edge in and one out; each comes with head, the node that its chain begins at, and far, its distance from there; a ring's with least, its smallest id.

    Chains are followed in steps that double, so one of any length takes as many rounds as its length has binary digits; those that go on longer are rings. edges: src, dst, far.
    """
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"), F.min("src").alias("head"), F.max("far").alias("far"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    inner, n_inner = counted(into.join(out, "id").where("n_in = 1 AND n_out = 1 AND head <> id").select("id", "head", "far"))
    inner, n_open, turn = inner.withColumns({"least": F.least("id", "head"), "going": F.lit(True)}), n_inner, 0
    while n_open and turn <= n.bit_length():
        ahead = inner.select(F.col("id").alias("head"), F.col("head").alias("next"), F.col("far").alias("more"), F.col("least").alias("less"))
        met = inner.join(ahead, "head", "left")
        inner, n_open = counted(met.select("id", F.coalesce("next", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.least("least", "less").alias("least"), F.col("next").isNotNull().alias("going")), F.col("going"))
        turn += 1
    rings = inner.where("going").select("id", "least")
    inner = inner.where("NOT going").select("id", "head", "far")
    ids = inner.select(F.col("id").alias("dst")).union(rings.select(F.col("id").alias("dst")))
    of_src = inner.select(F.col("id").alias("src"), "head", F.col("far").alias("before"))
    left = edges.join(ids, "dst", "left_anti").join(of_src, "src", "left").select(F.coalesce("head", "src").alias("src"), "dst", (F.col("far") + F.coalesce("before", F.lit(0))).alias("far"))
    return left.groupBy("src", "dst").agg(F.max("far").alias("far")), inner, rings


def peel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, rest). A node's level is the longest path that ends in it; rest are the nodes in a cycle or behind one. Edges from or to unknown nodes don't count, self-loops keep a node.

    Small graphs, and small islands, are done in one task each.
    """
    ends = edges.select("src", "dst")
    rows, n = counted(ends.union(nodes.select("id").distinct().select("id", F.lit(None).cast("string"))))
    if n <= LAST_EDGES:
        done, large = checkpoint(rows.repartition(1).mapInArrow(_last_order, "id string, level int")), None
    else:
        done, large = _finished(rows, _last_order, "id string, level int")
    levels, rest = done.where("level IS NOT NULL"), done.where("level IS NULL").select("id")
    if large is None:
        return levels, rest
    more, left = _peel_rounds(large.where("dst IS NULL").select(F.col("src").alias("id")), large.where("dst IS NOT NULL"))
    return levels.union(more), rest.union(left)


def _peel_rounds(known: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """peel's rounds, for large graphs. known: the nodes (id), once each.

    Chains become single edges first. Then each round the edges whose source has no incoming edge leave, and tell their targets how far these are at least. If
    none leaves, those that are left begin in or behind cycles. LAST_EDGES and fewer, counted, are done in one task.
    """
    live = edges.select("src", "dst").distinct().withColumn("far", F.lit(1))
    live, n = counted(live.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    inner = None
    if n > LAST_EDGES:
        live, inner, rings = _contracted(live, n)
        live, n = counted(live)
    found = known.limit(0).withColumn("level", F.lit(0))
    rest, turn = known.limit(0), 0
    while n:
        levels = found.groupBy("id").agg(F.max("level").alias("level"))
        if n <= LAST_EDGES:
            near = live.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            told = levels.join(near, "id", "left_semi").select("id", F.lit(None).cast("string"), "level")
            last = checkpoint(live.select("src", "dst", "far").union(told).repartition(1).mapInArrow(_last_levels, "id string, level int"))
            found = found.union(last.where("level IS NOT NULL"))
            rest = last.where("level IS NULL").select("id")
            break
        has_in = live.select(F.col("dst").alias("src"), F.lit(True).alias("has_in")).distinct()
        marked = live.join(has_in, "src", "left").join(levels.withColumnRenamed("id", "src"), "src", "left")
        marked, n_free = counted(marked.select("src", "dst", "far", F.coalesce("level", F.lit(0)).alias("level"), F.col("has_in").isNull().alias("free")), F.col("free"))
        if not n_free:
            rest = checkpoint(live.select(F.col("dst").alias("id")).distinct())
            break
        found = found.union(marked.where("free").select(F.col("dst").alias("id"), (F.col("level") + F.col("far")).alias("level")))
        turn += 1
        if turn % GATHER == 0:
            found = checkpoint(found.groupBy("id").agg(F.max("level").alias("level")))
        live, n = marked.where("NOT free").select("src", "dst", "far"), n - n_free
    longest = found.groupBy("id").agg(F.max("level").alias("level"))
    levels = known.join(rest, "id", "left_anti").join(longest, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))
    if inner is None:
        return levels, rest
    outer = checkpoint(levels.join(inner, "id", "left_anti").join(rings, "id", "left_anti"))
    placed = checkpoint(inner.join(outer.withColumnRenamed("id", "head"), "head", "left").select("id", (F.col("level") + F.col("far")).cast("int").alias("level")))
    return outer.union(placed.where("level IS NOT NULL")), rest.union(rings.select("id")).union(placed.where("level IS NULL").select("id"))


def closed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def scc(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes in strongly connected components of two nodes and more; component is the least id.

    Graphs, and islands, of LAST_EDGES edges and fewer, counted, are done in one task, larger ones by colours. Without nodes all ends of edges are nodes.
    """
    edges = edges.where("src <> dst").select("src", "dst")
    edges, n = counted(edges if nodes is None else closed_edges(edges, nodes))
    if n <= LAST_EDGES:
        return _small_components(edges)
    done, large = _finished(edges, _last_components, "id string, component string")
    return done if large is None else done.union(_large_components(large))


def _large_components(edges: DataFrame) -> DataFrame:
    """scc of large graphs: nodes outside cycles are peeled off at both ends, and chains become single edges: a chain is in a component if its two ends are, and a ring is one."""
    edges = checkpoint(edges.distinct())
    rest = checkpoint(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    rest, edges, n = _without_ends(rest, edges)
    if n <= LAST_EDGES:
        return _small_components(edges)
    core, inner, rings = _contracted(edges.withColumn("far", F.lit(1)), n)
    _, back, _ = _contracted(_turned(edges).withColumn("far", F.lit(1)), n)
    core, n = counted(core.where("src <> dst").select("src", "dst"))
    outer = checkpoint(rest.join(inner, "id", "left_anti").join(rings, "id", "left_anti"))
    found = _small_components(core) if n <= LAST_EDGES else _coloured(outer, core)
    labels = checkpoint(outer.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    of_end = lambda end, name: labels.select(F.col("id").alias(end), F.col("component").alias(name))
    chains = inner.select("id", "head").join(back.select("id", F.col("head").alias("tail")), "id").join(of_end("head", "component"), "head").join(of_end("tail", "of_tail"), "tail")
    every = checkpoint(labels.union(chains.where("component = of_tail").select("id", "component")).union(rings.select("id", F.col("least").alias("component"))))
    least = every.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return every.join(least, "component").select("id", F.col("least").alias("component"))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _without_ends(rest: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes and edges without those before and behind all cycles, and the number of edges left."""
    n = 0
    for reverse in (False, True):
        _, rest = _peel_rounds(checkpoint(rest), _turned(edges) if reverse else edges)
        edges, n = counted(closed_edges(edges, rest))
    return rest, edges, n


def _small_components(edges: DataFrame) -> DataFrame:
    return checkpoint(edges.repartition(1).mapInArrow(_last_components, "id string, component string"))


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of components of two nodes and more, by colours: each node takes the least id that reaches it, and the nodes of a colour that reach its origin are a component; they leave and the rest starts anew, until it is small."""
    rest, found = nodes, None
    while True:
        rest, edges, n = _without_ends(rest, edges)
        if n <= LAST_EDGES:
            last = _small_components(edges)
            return last if found is None else found.union(last)
        colours, changed = rest.withColumn("colour", F.col("id")), 1
        while changed:
            incoming = edges.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("theirs")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("theirs").alias("theirs"))
            # What reaches the origin of a node's colour reaches the node, so paths are walked in steps that double.
            further = colours.select(F.col("id").alias("colour"), F.col("colour").alias("origins"))
            met = colours.join(incoming, "id", "left").join(further, "colour", "left")
            new, changed = counted(met.select("id", F.least("colour", "theirs", "origins").alias("colour"), F.col("colour").alias("before")), F.col("colour") != F.col("before"))
            colours = new.select("id", "colour")
        inside = (
            edges.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("of_src")), "src")
            .join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("of_dst")), "dst").where("of_src = of_dst")
        )
        component = bfs(inside, colours.where("id = colour").select("id"), reverse=True).select("id").join(colours, "id").select("id", F.col("colour").alias("component"))
        component = checkpoint(component)
        several = component.join(component.groupBy("component").agg(F.count("*").alias("n")).where("n > 1"), "component", "left_semi").select("id", "component")
        several = checkpoint(several)
        found = several if found is None else checkpoint(found.union(several))
        rest = checkpoint(rest.join(component, "id", "left_anti"))
        edges = checkpoint(closed_edges(edges, rest))
