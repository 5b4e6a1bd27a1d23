"""The lineage edges of a catalog, as one table built once.

Edges are (src_object, src_field, dst_object, dst_field, src, dst, rel) with rel intra, writeBack or view. Formulas are tokenised once
per field; everything else is equi joins on what the tokens say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, rules
from ..functions.formulas import contains_run, extract_sequence
from ..sources.catalog import Catalog, canonical, sequences
from .loops import checkpoint
from .views import view_column_lineage

COLUMNS = ("src_object", "src_field", "dst_object", "dst_field", "src", "dst", "rel")


def _edges(frame: DataFrame, src_object: str, src_field: str, dst_object: str, dst_field: str, rel: str) -> DataFrame:
    four = [F.col(c).alias(n) for c, n in zip((src_object, src_field, dst_object, dst_field), COLUMNS, strict=False)]
    ids = [names.node_id(F.col(src_object), F.col(src_field)).alias("src"), names.node_id(F.col(dst_object), F.col(dst_field)).alias("dst")]
    return frame.select(*four, *ids, F.lit(rel).alias("rel"))


def intra_edges(fields: DataFrame) -> DataFrame:
    """From each field in a formula to the formula's field, on one object; the source need not be in the catalog."""
    return _intra(sequences(fields)).distinct()


def _intra(seqs: DataFrame) -> DataFrame:
    used = seqs.select("object_type", "field", F.explode("seq").alias("used")).where("used <> field")
    return _edges(used, "object_type", "used", "object_type", "field", "intra")


def alias_edges(fields: DataFrame) -> DataFrame:
    """From a triggered field to each other field of its object whose formulas hold the trigger's fields as one run.

    Candidates meet on the run's rarest field in the object, so only fields that use it are compared.
    """
    return _alias(sequences(fields)).distinct()


def _alias(seqs: DataFrame) -> DataFrame:
    runs = seqs.where(F.size("trigger_seq") > 0).select("object_type", F.col("field").alias("source"), F.col("trigger_seq").alias("run")).distinct()
    using = seqs.select("object_type", "field", "seq", F.explode("seq").alias("token"))
    often = using.groupBy("object_type", "token").agg(F.count("*").alias("n"))
    # A trigger's own formulas hold its run, so each of its fields is counted; of equal ones the first by name is met on.
    met_on = runs.select("object_type", "source", "run", F.explode("run").alias("token")).join(often, ["object_type", "token"])
    met_on = met_on.groupBy("object_type", "source", "run").agg(F.min(F.struct("n", "token")).alias("rarest")).select("object_type", "source", "run", "rarest.token")
    met = met_on.join(using, ["object_type", "token"]).where((F.col("source") != F.col("field")) & contains_run(F.col("seq"), F.col("run")))
    return _edges(met, "object_type", "source", "object_type", "field", "intra")


def _rules(catalog: Catalog) -> DataFrame:
    """object_type, field and rule of the fields with a rule that parses. Rules are parsed once and written: filters and explodes would each parse them again."""
    if "rules" not in catalog.read_once:
        texts = catalog.fields.where(rules.has_text(F.col("write_back_expr")))
        catalog.read_once["rules"] = checkpoint(texts.select("object_type", canonical().alias("field"), rules.parse_write_back(F.col("write_back_expr")).alias("rule")))
    return catalog.read_once["rules"].where("rule IS NOT NULL AND field IS NOT NULL")


def _sequences(catalog: Catalog) -> DataFrame:
    """Formulas are tokenised once; the lists of their fields, written, serve all kinds of edges in both directions."""
    if "sequences" not in catalog.read_once:
        catalog.read_once["sequences"] = checkpoint(sequences(catalog.fields).select("object_type", "field", "seq", "trigger_seq"))
    return catalog.read_once["sequences"]


def _view_edges(catalog: Catalog, texts: DataFrame) -> DataFrame:
    """view_edges, written, once for the same frame of texts."""
    of, found = catalog.read_once.get("view edges", (None, None))
    if of is not texts:
        found = checkpoint(view_edges(texts))
        catalog.read_once["view edges"] = texts, found
    return found


def write_back_edges(catalog: Catalog) -> DataFrame:
    """Downstream: from the fields in a rule's expression, on its source object and on those that its condition names, to the field; other objects only."""
    return _write_back(catalog).distinct()


def _write_back(catalog: Catalog) -> DataFrame:
    rows = _rules(catalog).withColumn("src_object", F.explode(rules.write_back_objects(F.col("rule"))))
    used = rows.withColumn("src_field", F.explode(extract_sequence(F.col("rule.expression")))).where("src_object <> object_type")
    return _edges(used, "src_object", "src_field", "object_type", "field", "writeBack")


def write_back_sources(catalog: Catalog) -> DataFrame:
    """Upstream: the rule's source object alone; conditions don't count, the own object does."""
    rows = _rules(catalog).withColumn("src_object", F.col("rule.srcObjectType"))
    used = rows.withColumn("src_field", F.explode(extract_sequence(F.col("rule.expression"))))
    return _edges(used, "src_object", "src_field", "object_type", "field", "writeBack").distinct()


def view_edges(texts: DataFrame) -> DataFrame:
    """From the source table's object and column to the view's output column."""
    lineage, _ = view_column_lineage(texts)
    named = lineage.where("table <> 'UNKNOWN'").select(
        names.table_to_object(F.col("table")).alias("so"), names.snake_to_camel(F.col("column")).alias("sf"), F.col("view_name").alias("do"), names.snake_to_camel(F.col("output")).alias("df")
    )
    return _edges(named.where("sf <> '' AND df <> ''"), "so", "sf", "do", "df", "view").distinct()


def downstream_edges(catalog: Catalog, texts: DataFrame | None = None) -> DataFrame:
    seqs = _sequences(catalog)
    # Edges of different rel are different, and view edges are distinct.
    out = _intra(seqs).union(_alias(seqs)).union(_write_back(catalog)).distinct()
    return out if texts is None else out.union(_view_edges(catalog, texts))


def upstream_edges(catalog: Catalog, texts: DataFrame | None = None) -> DataFrame:
    """What a search against the edges' direction walks: no alias rule, sources of rules only."""
    out = _intra(_sequences(catalog)).distinct().union(write_back_sources(catalog))
    return out if texts is None else out.union(_view_edges(catalog, texts))


def direct_upstream(upstream: DataFrame, object_type: str | None = None, field: str | None = None, intra: bool = True, write_back: bool = True) -> DataFrame:
    """The sources one step before a field, by kind; without arguments of all fields."""
    wanted = [r for r, on in (("intra", intra), ("writeBack", write_back)) if on]
    found = upstream.where(F.col("rel").isin(wanted))
    return found if object_type is None else found.where((F.col("dst_object") == object_type) & (F.col("dst_field") == field))


def rel_filter(edges: DataFrame, rel: int | None = 0, names_: tuple[str, ...] | None = None) -> DataFrame:
    """Edges by number: 0 all, 1 writeBack, 2 intra, 3 view, 4 intra and writeBack; or by names in any case, of which none known means intra and writeBack."""
    if names_ is not None:
        known = {"intra": "intra", "writeback": "writeBack", "view": "view"}
        wanted = [known[n.strip().lower()] for n in names_ if n.strip().lower() in known] or ["intra", "writeBack"]
    else:
        wanted = {0: None, 1: ["writeBack"], 2: ["intra"], 3: ["view"], 4: ["intra", "writeBack"]}[rel]
    return edges if wanted is None else edges.where(F.col("rel").isin(wanted))


def attach_meta(nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """nodes (id, ..) with object, field and the catalog's title, types and formulas; null where the catalog doesn't know the node."""
    object_type, field = names.split_node_id(F.col("id"))
    meta = fields.withColumn("__field", canonical()).groupBy(F.col("object_type").alias("object"), F.col("__field").alias("field")).agg(
        F.min_by(F.struct("title", "type", "biz_type", "api_name", "expression", "trigger_expr", "virtual_expr", "write_back_expr"), "id").alias("m")
    )
    placed = nodes.withColumns({"object": object_type, "field": field})
    return placed.join(meta, ["object", "field"], "left").select(*nodes.columns, "object", "field", "m.*")


def overlay_definitions(local: DataFrame, latest: DataFrame) -> DataFrame:
    """Each local field's latest definition as a whole row, found by API name, name or the name in camel case, in this order; else its own row. from_latest says which."""
    value = [c for c in local.columns if c not in ("object_type", "id")]
    keys = latest.select("object_type", F.struct(*value).alias("new"), "id", F.posexplode(F.array("api_name", "name", names.snake_to_camel(F.col("name")))).alias("order", "key")).where("key IS NOT NULL AND key <> ''")
    best = keys.groupBy("object_type", "key").agg(F.min_by("new", F.struct("order", "id")).alias("new"))
    own = local.withColumn("key", canonical())
    return own.join(best, ["object_type", "key"], "left").select(
        "id", "object_type", *[F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in value], F.col("new").isNotNull().alias("from_latest")
    )


def normalise_graph_ids(edges: DataFrame) -> DataFrame:
    """Edges of any origin with both fields in camel case where they have an underscore, each once."""

    def fixed(node: Column) -> tuple[Column, Column]:
        object_type, field = names.split_node_id(node)
        return object_type, F.when(field.contains("_"), names.snake_to_camel(field)).otherwise(field)

    (so, sf), (do, df) = fixed(F.col("src")), fixed(F.col("dst"))
    named = edges.select(so.alias("so"), sf.alias("sf"), do.alias("do"), df.alias("df"), F.col("rel").alias("r"))
    out = named.select(F.col("so").alias("src_object"), F.col("sf").alias("src_field"), F.col("do").alias("dst_object"), F.col("df").alias("dst_field"), names.node_id(F.col("so"), F.col("sf")).alias("src"), names.node_id(F.col("do"), F.col("df")).alias("dst"), F.col("r").alias("rel"))
    return out.where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def exclude_relations(nodes: DataFrame, edges: DataFrame, rels: tuple[str, ...], root: str) -> tuple[DataFrame, DataFrame]:
    """The graph without edges of these kinds and without nodes that then touch no edge; the root stays."""
    kept = edges.where(~F.col("rel").isin(list(rels)))
    touched = kept.select(F.col("src").alias("id")).union(kept.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(touched, "id", "left_semi").union(nodes.where(F.col("id") == root)).distinct(), kept


