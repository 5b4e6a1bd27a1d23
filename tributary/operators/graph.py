"""Graph queries over lineage edges. Frames of nodes have id, and level where a search says how far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, rules
from ..sources.catalog import Catalog, canonical, filter_apps_fuzzy, scan_fields
from .edges import attach_meta, rel_filter
from .loops import bfs, checkpoint, closed_edges, numbered, peel, scc, small_depths, walked

REL_ORDER = ("intra", "writeBack", "view")


def impact(edges: DataFrame, roots: DataFrame, depth: int = 3, rel: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes with level, edges) downstream of roots (id). An edge back to a node seen before is kept; roots are nodes even if unknown.

    For several roots this is the union of their graphs: a node's least level is under depth exactly when its level from some root is.
    """
    wanted = rel_filter(edges, rel)
    visited = bfs(wanted, roots, depth)
    return visited, walked(wanted, visited, depth)


def trace(edges: DataFrame, roots: DataFrame, depth: int = 3, rel: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same upstream, over upstream_edges; edges still point from source to target."""
    wanted = rel_filter(edges, rel)
    visited = bfs(wanted, roots, depth, reverse=True)
    return visited, walked(wanted, visited, depth, reverse=True)


def closed_graph(downstream: DataFrame, upstream: DataFrame, roots: DataFrame, depth: int, rel: int = 4) -> tuple[DataFrame, DataFrame]:
    """The impact of all roots together with everything upstream of any of its nodes, over intra and write-back edges whatever the depth."""
    visited, edges = impact(downstream, roots, depth, rel)
    sources = rel_filter(upstream, 4)
    closure = bfs(sources, visited, None, reverse=True)
    more = walked(sources, closure, None, reverse=True)
    all_edges = edges.unionByName(more).distinct()
    nodes = closure.select("id").join(visited, "id", "left")
    return nodes, all_edges


def explain(edges: DataFrame, roots: DataFrame, definitions: DataFrame, depth: int = 3, reverse: bool = False) -> DataFrame:
    """Per reached node a shortest path from its root: root, id, object, field, path_len, steps (rel, source, target, reason; root first), path, summary.

    Of several parents the one with the least (id, rel) counts. definitions: the catalog's fields, for reasons. Paths are carried along, one level a round.
    """
    near, far = ("dst", "src") if reverse else ("src", "dst")
    rules_ = definitions.withColumn("__field", canonical()).select(
        names.node_id(F.col("object_type"), F.col("__field")).alias("dst"),
        F.coalesce("trigger_expr", "expression", "virtual_expr").alias("formula"), rules.parse_write_back(F.col("write_back_expr")).alias("rule"), "id",
    ).groupBy("dst").agg(F.min_by("formula", "id").alias("formula"), F.min_by("rule", "id").alias("rule"))
    told = edges.join(rules_, "dst", "left")
    step = F.struct("rel", F.col("src").alias("source"), F.col("dst").alias("target"), rules.edge_reason(F.col("rel"), F.col("src"), F.col("dst"), F.col("formula"), F.col("rule")).alias("reason"))
    told = checkpoint(told.select(F.col(near).alias("near"), F.col(far).alias("far"), F.struct(F.col(near).alias("parent"), "rel").alias("tie"), step.alias("step")))
    kind = "array<struct<rel:string,source:string,target:string,reason:string>>"
    frontier = checkpoint(roots.select(F.col("id").alias("root"), "id", F.array().cast(kind).alias("steps"), F.lit(0).alias("path_len")).distinct())
    reached = frontier
    for level in range(1, depth + 1):
        met = told.join(frontier.withColumnRenamed("id", "near"), "near")
        best = met.groupBy("root", F.col("far").alias("id")).agg(F.min_by(F.struct("steps", "step"), "tie").alias("b"))
        new = best.join(reached.select("root", "id"), ["root", "id"], "left_anti")
        frontier = checkpoint(new.select("root", "id", F.concat("b.steps", F.array("b.step")).alias("steps"), F.lit(level).alias("path_len")))
        if frontier.isEmpty():
            break
        reached = checkpoint(reached.union(frontier))
    object_type, field = names.split_node_id(F.col("id"))
    summary = F.format_string("%s is affected by %s, path length %d", "id", "root", "path_len")
    return reached.where("path_len > 0").select("root", "id", object_type.alias("object"), field.alias("field"), "path_len", "steps", rules.format_path(F.col("steps")).alias("path"), summary.alias("summary"))


def object_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects with their number of fields, edges between objects with their number) of a graph."""
    objects = nodes.select(names.split_node_id(F.col("id"))[0].alias("object"), "id").groupBy("object").agg(F.countDistinct("id").alias("fields"))
    between = edges.groupBy("src_object", "rel", "dst_object").agg(F.count("*").alias("edges"))
    return objects, between


def cross_object_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between different objects with their row number, by number of edges, most first, then by names."""
    between = object_graph(nodes, edges)[1].where("src_object <> dst_object").withColumn("fewer", -F.col("edges"))
    return numbered(between, ("fewer", "src_object", "rel", "dst_object"), "row").drop("fewer")


def object_edge_details(edges: DataFrame, src_object: str, dst_object: str, rel: str | None = None) -> DataFrame:
    found = edges.where((F.col("src_object") == src_object) & (F.col("dst_object") == dst_object))
    return found if rel is None else found.where(F.col("rel") == rel)


def global_graph(catalog: Catalog, edges: DataFrame, apps: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst) of every edge that begins at a field of the apps; targets may be of others. No search: edges joined with their beginnings."""
    starts = filter_apps_fuzzy(scan_fields(catalog), apps).select(names.node_id(F.col("object_type"), canonical()).alias("src")).where("src IS NOT NULL").distinct()
    return edges.join(starts, "src", "left_semi").select("src", "dst").distinct()


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes in cycles; a node with an edge to itself alone is a component of its own."""
    found = scc(None, edges)
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().join(found, "id", "left_anti")
    return found.unionByName(loops.select("id", F.col("id").alias("component")))


def deep_chains(edges: DataFrame, threshold: int = 10) -> DataFrame:
    """root, length and path of the longest chain from each node without incoming edges, if it has threshold edges or more; longest first, then by path.

    Edges inside a cycle don't count, so lengths are exact. Of equal chains the one through the least ids is told.
    """
    pairs = checkpoint(edges.select("src", "dst").distinct())
    turned = lambda some: some.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    heights, before_cycles = peel(_ends(pairs), turned(pairs))
    free = pairs
    if not before_cycles.isEmpty():
        component = cycles(closed_edges(pairs, before_cycles))
        inside = (
            pairs.join(component.select(F.col("id").alias("src"), F.col("component").alias("c1")), "src")
            .join(component.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").where("c1 = c2").select("src", "dst")
        )
        free = checkpoint(pairs.join(inside, ["src", "dst"], "left_anti"))
        heights, _ = peel(_ends(pairs), turned(free))
    heights = checkpoint(heights.withColumnRenamed("level", "height"))
    next_ = (
        free.join(heights.select(F.col("id").alias("src"), "height"), "src").join(heights.select(F.col("id").alias("dst"), F.col("height").alias("below")), "dst")
        .where("below = height - 1").groupBy("src").agg(F.min("dst").alias("next"))
    )
    targets = free.select(F.col("dst").alias("id")).distinct()
    chains = checkpoint(heights.where(F.col("height") >= threshold).join(targets, "id", "left_anti").select(F.col("id").alias("root"), F.col("height").alias("length")))
    longest = chains.agg(F.max("length")).head()[0] or 0
    # Steps of 1, 2, 4, .. edges; a place on a chain is reached by the steps of its binary digits, the largest first.
    steps = [checkpoint(next_)]
    while 2 ** len(steps) <= longest:
        onward = steps[-1].select(F.col("src").alias("next"), F.col("next").alias("further"))
        steps.append(checkpoint(steps[-1].join(onward, "next").select("src", F.col("further").alias("next"))))
    places = chains.select("root", F.lit(0).alias("place"), F.col("root").alias("at"))
    for k in reversed(range(len(steps))):
        moved = places.join(steps[k].withColumnRenamed("src", "at"), "at").select("root", (F.col("place") + 2**k).alias("place"), F.col("next").alias("at"))
        places = checkpoint(places.union(moved))
    path = places.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "at"))).alias("nodes")).select("root", F.array_join("nodes.at", " -> ").alias("path"))
    return chains.join(path, "root").select("root", "length", "path").orderBy(F.desc("length"), "path")


def trigger_fields(edges: DataFrame, fields: DataFrame, object_type: str | None = None, field: str | None = None) -> DataFrame:
    """Catalog rows of fields whose formulas on the same object use a field; without arguments for all fields."""
    used = edges.where(F.col("rel") == "intra")
    if object_type is not None:
        used = used.where((F.col("src_object") == object_type) & (F.col("src_field") == field))
    rows = fields.withColumns({"dst_object": F.col("object_type"), "dst_field": canonical()})
    return used.select("src", "dst_object", "dst_field").distinct().join(rows, ["dst_object", "dst_field"])


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, level and in_cycle: nodes by level, then id; those in a cycle or behind one come last with the flag and no level."""
    levels, rest = peel(nodes, edges)
    return levels.select("id", "level", F.lit(False).alias("in_cycle")).unionByName(rest.select("id", F.lit(None).cast("int").alias("level"), F.lit(True).alias("in_cycle")))


def longest_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth): the longest path from the roots to each node that they reach; nodes in or behind a cycle are left out."""
    small = small_depths(edges, roots)
    if small is not None:
        return small
    reached = bfs(edges, roots)
    inner = edges.join(reached.select(F.col("id").alias("src")), "src", "left_semi").join(roots.select(F.col("id").alias("dst")), "dst", "left_anti")
    levels, _ = peel(reached, inner)
    return levels.withColumnRenamed("level", "depth")


def shortest_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return bfs(edges, roots).withColumnRenamed("level", "depth")


def incoming_types(edges: DataFrame, rels: tuple[str, ...] = REL_ORDER) -> DataFrame:
    return edges.where(F.col("rel").isin(list(rels))).groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("rel")).alias("types"))


def fix_steps(edges: DataFrame, roots: DataFrame, longest: bool = True) -> DataFrame:
    """object, field, depth and incoming types of the nodes behind the roots, in order: by depth, intra before write-back, then by object and field."""
    depths = (longest_depth if longest else shortest_depth)(edges, roots).where("depth > 0")
    steps = depths.join(incoming_types(edges), "id", "left")
    object_type, field = names.split_node_id(F.col("id"))
    return steps.select(object_type.alias("object"), field.alias("field"), "depth", "types").orderBy("depth", ~F.array_contains("types", "intra"), "object", "field")


def dirty_set(edges: DataFrame, roots: DataFrame, rels: tuple[str, ...] = ("intra", "writeBack")) -> DataFrame:
    """The nodes to compute anew after a change of roots: the roots and all that these edges reach from them."""
    return bfs(edges.where(F.col("rel").isin(list(rels))), roots).select("id")


def normalise_roots(roots: DataFrame, fields: DataFrame) -> DataFrame:
    """roots (object, field) with id: the catalog field of that canonical name, else of that name in camel case, else as given."""
    known = fields.select(F.col("object_type").alias("object"), canonical().alias("known")).where("known IS NOT NULL").distinct()
    camel = F.when(F.col("field").contains("_"), names.snake_to_camel(F.col("field"))).otherwise(F.col("field"))
    placed = roots.withColumn("camel", camel)
    exact = known.select("object", F.col("known").alias("field"), F.lit(True).alias("is_exact"))
    near = known.select("object", F.col("known").alias("camel"), F.lit(True).alias("is_near"))
    both = placed.join(exact, ["object", "field"], "left").join(near, ["object", "camel"], "left")
    final = F.when(F.col("is_exact"), F.col("field")).when(F.col("is_near"), F.col("camel")).otherwise(F.col("field"))
    return both.select("object", "field", names.node_id(F.col("object"), final).alias("id"))


def graph_stats(edges: DataFrame, samples: tuple[int, int] = (20, 10)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts of sources, edges, nodes and roots; the first edges; the first roots) of a graph (src, dst)."""
    ends = _ends(edges)
    roots = ends.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    counts = edges.agg(F.countDistinct("src").alias("sources"), F.count("*").alias("edges"))
    counts = counts.join(ends.agg(F.count("*").alias("nodes")), F.lit(True)).join(roots.agg(F.count("*").alias("roots")), F.lit(True))
    return counts, edges.orderBy("src", "dst").limit(samples[0]), roots.orderBy("id").limit(samples[1])


def impact_report(paths: DataFrame, edges: DataFrame, fields: DataFrame, roots: DataFrame) -> DataFrame:
    """A row for each node of an impact: object, field, title, types, role (root, affected, related), relations, path and formulas.

    paths: explain's rows; edges: the graph's.
    """
    ends = _ends(edges).unionByName(roots.select("id")).distinct()
    labels = incoming_types(edges).select("id", F.array_join("types", ", ").alias("relations"))
    best = paths.groupBy("id").agg(F.min_by("path", F.struct("path_len", "root")).alias("path"))
    placed = attach_meta(ends, fields).join(labels, "id", "left").join(best, "id", "left").join(roots.select("id", F.lit(True).alias("is_root")).distinct(), "id", "left")
    role = F.when(F.col("is_root"), "root").when(F.col("path").isNotNull(), "affected").otherwise("related")
    return placed.select("object", "field", "title", "type", "biz_type", role.alias("role"), F.coalesce("relations", F.lit("")).alias("relations"), F.coalesce("path", F.lit("")).alias("path"), "trigger_expr", "expression", "virtual_expr")
