"""The registered queries of the lineage engine. Each runs on the given tables or on the catalog derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import formulas, mappings, names, rules
from .operators import diff, edges, graph, health, references, views
from .operators.loops import checkpoint, numbered, shared_folder
from .plans import recompute, stages
from .sources import catalog as cat
from .sources import derived, snapshots
from .sources.catalog import Catalog

APPS = ("sales", "finance", "stock", "hr")


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return derived.large_catalog(spark, sf_dir)


def _texts(c: Catalog) -> DataFrame:
    if "texts" not in c.read_once:
        c.read_once["texts"] = cat.views(c, cat.scan_view_definitions(c, APPS))[1]
    return c.read_once["texts"]


def _down(c: Catalog) -> DataFrame:
    return checkpoint(edges.downstream_edges(c, _texts(c)))


def _up(c: Catalog) -> DataFrame:
    return checkpoint(edges.upstream_edges(c, _texts(c)))


def _roots(c: Catalog, place: int = 0) -> DataFrame:
    """All fields whose catalog row has a place in its block: 0 those written back or plain, 2 the sums."""
    kind = {0: F.coalesce("trigger_expr", "expression", "virtual_expr").isNull(), 2: F.col("trigger_expr").contains(" + ")}[place]
    return c.fields.where(kind).select(names.node_id(F.col("object_type"), cat.canonical()).alias("id"))


def _joined(column: str | Column) -> Column:
    return F.array_join(column, ",")


# Recomputation on the star schema


def _rollups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame], dict[str, str]]:
    """The plan behind prices and numbers of lines, the tables, and their keys."""
    frames = derived.tables(spark, sf_dir)
    c = derived.rule_catalog(spark, frames)
    roots = spark.createDataFrame([("Lineitem", "lExtendedprice"), ("Lineitem", "lLinenumber")], "object string, field string")
    plan = recompute.recompute_plan(c, roots)
    return plan.where("role <> 'ROOT(manual)'"), frames, {o: k for o, (_, k) in derived.TABLES.items()}


def _recomputed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return recompute.run_plan(*_rollups(spark, sf_dir))


def _money(column: str, digits: int = 4) -> Column:
    """To the digits that prices and rates give; sums have more, and where SQL rounds them depends on its order."""
    return F.round(F.col(column).cast("double"), digits).alias(column)


def rollup_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to orders to customers to nations to regions."""
    return _recomputed(spark, sf_dir)["Region"].select("r_regionkey", "r_name", _money("nation_total"))


def rollup_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recomputed(spark, sf_dir)["Nation"].select("n_nationkey", _money("cust_total"), _money("gap_total"))


def rollup_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recomputed(spark, sf_dir)["Customer"].select("c_custkey", _money("order_total"), _money("gap"))


def rollup_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three roll-ups in one pass; orders without a matching line keep null."""
    return _recomputed(spark, sf_dir)["Orders"].select("o_orderkey", _money("item_total"), _money("taxed_total", 6), F.coalesce("item_count", F.lit(0)).alias("item_count"))


def staged_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan in stages, each written; the first two are run, then another run goes on behind them. Customers', nations' and regions' totals."""
    plan, frames, ids = _rollups(spark, sf_dir)
    plan, path = checkpoint(plan), f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    stages.run_plan_in_stages(plan, frames, ids, path, stages=2)
    done = stages.run_plan_in_stages(plan, frames, ids, path)
    told = {"Customer": ("c_custkey", "order_total"), "Nation": ("n_nationkey", "cust_total"), "Region": ("r_regionkey", "nation_total")}
    parts = [done[o].select(F.lit(o).alias("object"), F.col(k).cast("long").alias("key"), F.col(c).alias("total")).select("object", "key", _money("total")) for o, (k, c) in told.items()]
    return parts[0].union(parts[1]).union(parts[2])


def write_back_keeps_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: customers without urgent orders keep their balance."""
    t = derived.tables(spark, sf_dir)
    spec = recompute.WriteBack("c_acctbal", "max(o_totalprice)", "o_custkey", "o_orderpriority = '1-URGENT'")
    return recompute.apply_write_backs(t["Customer"], "c_custkey", t["Orders"], [spec]).select("c_custkey", _money("c_acctbal"))


def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very small and very large numbers, decimals, averages and expressions over several aggregates, rolled up to orders."""
    t = derived.tables(spark, sf_dir)
    lines = t["Lineitem"].withColumn("rate", (F.col("l_discount").cast("decimal(20,10)") / 1000).cast("decimal(28,14)"))
    rules = {
        "tiny": "sum(l_extendedprice * 1e-15)", "huge": "sum(l_extendedprice * 1e30)", "rate": "sum(t.rate)", "mean": "avg(l_quantity)", "spread": "max(l_extendedprice) - min(l_extendedprice)",
        "both": "coalesce(sum(l_quantity), 0) - sum(l_tax) * count(*)",
    }
    out = recompute.apply_write_backs(t["Orders"].select("o_orderkey"), "o_orderkey", lines, [recompute.WriteBack(c, e, "l_orderkey", "l_returnflag <> 'A'") for c, e in rules.items()])
    scaled = {"tiny": F.round(F.col("tiny") * 1e15, 2), "huge": F.round(F.col("huge") / 1e30, 2), "rate": F.col("rate").cast("string"), "mean": F.round("mean", 6), "spread": F.round("spread", 2), "both": F.round("both", 4)}
    return out.select("o_orderkey", *(c.alias(n) for n, c in scaled.items()))


#: Formulas that read other tables, as both engines read them: a value looked up, and aggregates of the rows of a key.
SUBQUERY_FORMULAS = {
    "orders": {
        "segment_price": "CASE WHEN 'BUILDING' = ( SELECT c_mktsegment FROM customer WHERE orders.o_custkey = customer.c_custkey ) THEN o_totalprice WHEN o_orderstatus = 'F' and ( SELECT c_acctbal FROM customer WHERE orders.o_custkey = customer.C_CUSTKEY ) > 0 THEN abs(o_totalprice) * 2 ELSE 0 END",
        "returned": "case when coalesce((select abs(sum(lineitem.l_quantity)) from lineitem where orders.o_orderkey=lineitem.l_orderkey and lineitem.l_returnflag='R'),0) >= 40 then 'many' when coalesce((select sum(lineitem.l_quantity) from lineitem where orders.o_orderkey=lineitem.l_orderkey and lineitem.l_returnflag='R'),0) =0 then 'none' else 'some' end",
        "lines": "(select count(*) from lineitem l where l.l_orderkey = o_orderkey and l_tax > 0.02)",
    },
    "customer": {"open_orders": "(select coalesce(max(o_totalprice), 0) - min(o_totalprice) from orders where o_custkey = c_custkey and o_orderstatus in ('O', 'P'))"},
}


def _with_subqueries(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return recompute.apply_triggers(read(table), SUBQUERY_FORMULAS[table], tables=read)


def formula_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of orders that look customers up and add lines up."""
    return _with_subqueries(spark, sf_dir, "orders").select("o_orderkey", F.round("segment_price", 2).alias("segment_price"), "returned", "lines")


def formula_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula of customers over two aggregates of their orders."""
    return _with_subqueries(spark, sf_dir, "customer").select("c_custkey", F.round("open_orders", 2).alias("open_orders"))


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose quantity a formula would change."""
    lines = derived.tables(spark, sf_dir)["Lineitem"].select("l_orderkey", "l_linenumber", "l_quantity")
    return recompute.changed_only(lines, "l_quantity", "case when l_quantity > 25 then 25 else l_quantity end").select("l_orderkey", "l_linenumber", F.col("new_value").cast("double").alias("new_value"))


def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's customer segment and nation key."""
    t = derived.tables(spark, sf_dir)
    out = recompute.parent_lookup(t["Orders"], t["Customer"], "o_custkey", "c_custkey", {"segment": "c_mktsegment", "nation": "c_nationkey"})
    return out.groupBy("segment", "nation").agg(F.count("*").alias("orders"))


def recompute_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan behind all fields without formulas."""
    c = _catalog(spark, sf_dir)
    object_type, field = names.split_node_id(F.col("id"))
    roots = _roots(c).select(object_type.alias("object"), field.alias("field"))
    return recompute.recompute_plan(c, roots).select("step", "node", "level", "role", "status", "column", "formula", *(F.col(f"rule.{k}").alias(f"rule_{k}") for k in ("source", "key", "expression", "condition")))


def recompute_plan_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sums, two levels down, with what is upstream of them."""
    c = _catalog(spark, sf_dir)
    object_type, field = names.split_node_id(F.col("id"))
    roots = _roots(c, 2).select(object_type.alias("object"), field.alias("field"))
    return recompute.recompute_plan_batch(c, roots, 2, latest=_changed(c)).select("step", "node", "level", "role", "active", "in_cycle", "formula")


# Names, formulas, rules


def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, F7-F9, F14, P1."""
    c = _catalog(spark, sf_dir)
    column = names.field_to_column(cat.canonical(), F.col("name"))
    table = names.object_to_table(F.col("object_type"), F.col("app_name"))
    return cat.scan_fields(c).select("id", cat.canonical().alias("field"), column.alias("column_name"), table.alias("table_name"), names.table_to_object(table).alias("object_name"), names.field_key(F.col("object_type"), F.col("name"), F.col("api_name")).alias("key"))


def formula_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fields in formulas, in order and sorted."""
    text = formulas.all_formulas(F.col("trigger_expr"), F.col("expression"), F.col("virtual_expr"))
    found = _catalog(spark, sf_dir).fields.select("id", formulas.extract_sequence(text).alias("s"), formulas.extract_fields(text).alias("f"))
    return found.select("id", _joined("s").alias("in_order"), _joined("f").alias("sorted"))


def formula_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all words of triggers, and whether one of them is fld_7, in any case."""
    text = F.col("trigger_expr")
    return _catalog(spark, sf_dir).fields.where(text.isNotNull()).select("id", _joined(formulas.extract_words(text)).alias("words"), formulas.contains_word(text, F.lit("FLD_7")).cast("int").alias("has_word"))


def referred_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the entities that fields refer to, and the first one."""
    info = F.col("refer_info")
    return _catalog(spark, sf_dir).fields.select("id", _joined(rules.refer_entities(info)).alias("entities"), rules.first_refer_entity(info).alias("first"))


def spelt_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's API name or else its name, and its name with a capital."""
    return _catalog(spark, sf_dir).fields.select("id", names.first_non_empty(F.col("api_name"), F.col("name")).alias("shown"), names.capitalize(F.col("name")).alias("capital"))


def hooked_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-hook: a formula that is a call of a user's function, with expressions as arguments."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    out = recompute.apply_trigger(lines, "shifted", "shifted(l.l_quantity, coalesce(l_tax, 0) * 2)", {"shifted": lambda value, by: value * 3 + by})
    return out.select("l_orderkey", "l_linenumber", F.round("shifted", 4).alias("shifted"))


def formula_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """formulas over columns, and rules over columns of their source."""
    return recompute.definitions(_catalog(spark, sf_dir)).where("formula IS NOT NULL OR rule IS NOT NULL").select("node", "formula", F.col("rule.expression").alias("rule_expression"))


def write_back_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as they parse."""
    rows = cat.write_backs(_catalog(spark, sf_dir))
    return rows.select("id", F.col("rule.srcObjectType").alias("source"), F.col("rule.expression").alias("expression"), rules.rule_attribute(F.col("write_back_expr"), "condition").alias("condition"))


def field_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P13."""
    f = F.col
    kinds = {"write_back": rules.is_write_back(f("write_back_expr")), "trigger": rules.is_trigger(f("trigger_expr"), f("expression")), "virtual": rules.is_virtual(f("virtual_expr"), f("trigger_expr"), f("expression")), "amount": rules.is_amount(cat.canonical(), f("biz_type")), "quantity": rules.is_quantity(cat.canonical(), f("biz_type"))}
    return _catalog(spark, sf_dir).fields.select("id", *(k.cast("int").alias(n) for n, k in kinds.items()))


def mapping_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mappings made of the events' properties; keys and values of the result."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit('{"currencyId":"'), F.col("event_type"), F.lit('","kept":'), F.get_json_object("props", "$.k"), F.lit("}"))
    out = events.select("event_id", mappings.rewrite_mapping(text).alias("m"))
    return out.select("event_id", *(F.get_json_object("m", f"$.{k}").alias(k) for k in ("currencyId", "kept", "exchangeId")))


def mapping_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, F21."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "Direction.credit").otherwise("Direction.debit")
    pair = F.concat(F.lit("'"), side, F.lit("', '{\"memo\":\"${billDeclaredAmount}\",\"n\":"), F.get_json_object("props", "$.k"), F.lit(",\"currencyId\":\"x\"}'"))
    names_pair = mappings.split_direction_pair(pair)
    out = events.select("event_id", mappings.rewrite_mapping_by_direction(*names_pair).alias("m"))
    return out.select("event_id", *(F.get_json_object("m", f"$.{k}").alias(k) for k in ("memo", "n", "currencyId", "billCreditDeclaredAmount", "creditDeclaredAmount")))


# Catalog


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, J1."""
    return cat.scan_fields(_catalog(spark, sf_dir)).select("id", "object_type", "app_name", "title")


def view_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the views of four apps."""
    return _texts(_catalog(spark, sf_dir)).select("view_name", "object_name", "sql")


def view_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1."""
    lineage, _ = views.view_column_lineage(_texts(_catalog(spark, sf_dir)))
    return lineage.select("view_name", "output", F.col("table").alias("table_name"), F.col("column").alias("column_name"))


def view_sql_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: tables and columns anywhere in the texts."""
    found = views.sql_dependencies(_texts(_catalog(spark, sf_dir)))
    return found.groupBy("view_name", F.col("table").alias("table_name")).agg(F.count("column").alias("columns"))


def view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3."""
    return views.view_dependency_stats(edges.view_edges(_texts(_catalog(spark, sf_dir)))).select("src", "targets", _joined("view_fields").alias("view_fields"))


def object_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P4, S6, S7."""
    return cat.object_details(_catalog(spark, sf_dir))


def fields_by_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields per app, of apps that hold a term."""
    found = cat.filter_apps_fuzzy(cat.scan_fields(_catalog(spark, sf_dir)), ["ST", "nan", " "])
    return found.groupBy("app_name").agg(F.count("*").alias("fields"))


def compare_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills of exactly two apps."""
    c = _catalog(spark, sf_dir)
    return cat.scan_compare_catalog(c.fields, c.objects, ["sales", "Stock"]).groupBy("object_type", "app_name").agg(F.count("*").alias("fields"))


def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 fields whose name or title holds 12."""
    return cat.search_fields(_catalog(spark, sf_dir), "12", biz="QUANT").select("object_type", "field", F.col("has_write_back").cast("int").alias("has_write_back"), F.col("has_trigger").cast("int").alias("has_trigger"), F.col("is_virtual").cast("int").alias("is_virtual"))


def object_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, T2."""
    return cat.search_objects(_catalog(spark, sf_dir), "ject 1")


def fields_per_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return cat.fields_per_object(_catalog(spark, sf_dir))


def write_back_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, P19, T1."""
    return cat.targets_by_source(_catalog(spark, sf_dir))


def write_back_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, T1."""
    return cat.sources_for_target(_catalog(spark, sf_dir))


def incoming_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Referring fields of every entity."""
    found = cat.incoming_references(_catalog(spark, sf_dir), exclude_view=True)
    return found.select("entity", "object_type", "app_name", "object_title", _joined("fields").alias("fields"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return cat.category_counts(_catalog(spark, sf_dir))


def object_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    found = health.object_health(_catalog(spark, sf_dir).fields)
    return found.select("object_type", "total", "with_formula", "referenced", "dead", "write_back", "write_back_unreferenced", _joined("dead_fields").alias("dead_fields"))


def object_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    found = health.object_profile(_catalog(spark, sf_dir))
    return found.select("object_type", "title", *(_joined(c).alias(c) for c in ("write_back", "virtual", "trigger", "base", "amount", "quantity")), "sources", "targets")


def pattern_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return health.pattern_check(_catalog(spark, sf_dir)).select("object_type", "kind", "name", F.col("present").cast("int").alias("present"))


def change_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new source for every object, for its first field."""
    c = _catalog(spark, sf_dir)
    first = c.fields.groupBy("object_type").agg(F.min_by(cat.canonical(), F.col("id").cast("long")).alias("field"))
    requests = first.select(F.col("object_type").alias("target_object"), F.lit("New").alias("new_source"), "field")
    return health.change_scope(c, edges.intra_edges(c.fields), requests)


def trigger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, G10."""
    c = _catalog(spark, sf_dir)
    return health.trigger_summary(c, edges.intra_edges(c.fields).union(edges.alias_edges(c.fields)).distinct())


def _in_order(found: DataFrame) -> DataFrame:
    """found with the place that each row has in its own order."""
    return numbered(checkpoint(found.withColumn("at", F.monotonically_increasing_id())), ("at",), "place").drop("at")


def ordered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of objects as they are listed, most fields first."""
    return _in_order(cat.targets_by_source(_catalog(spark, sf_dir)))


def ordered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, T1."""
    return _in_order(cat.sources_for_target(_catalog(spark, sf_dir)))


def ordered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By entity, app and object in any case."""
    return _in_order(cat.incoming_references(_catalog(spark, sf_dir)).select("entity", "app_name", "object_type"))


def ordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By depth, computed fields before those written back, then by name."""
    c = _catalog(spark, sf_dir)
    return _in_order(graph.fix_steps(_down(c), _roots(c), longest=False).select("depth", "object", "field"))


def _paged(found: DataFrame) -> DataFrame:
    return found.withColumn("items", _joined("items"))


def health_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the lists of fields in pages of three."""
    return _paged(health.object_health_pages(_catalog(spark, sf_dir).fields, 3))


def profile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In pages of three."""
    return _paged(health.object_profile_pages(_catalog(spark, sf_dir), 3))


def reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In pages of two."""
    return _paged(health.incoming_reference_pages(_catalog(spark, sf_dir), 2))


def view_field_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: in pages of two."""
    return _paged(health.view_dependency_pages(edges.view_edges(_texts(_catalog(spark, sf_dir))), 2))


def trigger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In pages of two."""
    c = _catalog(spark, sf_dir)
    return _paged(health.trigger_summary_pages(c, edges.intra_edges(c.fields).union(edges.alias_edges(c.fields)).distinct(), 2))


# Edges and graphs


def _plain(found: DataFrame) -> DataFrame:
    return found.select("src", "dst", "rel")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4-J7, P14, A16."""
    c = _catalog(spark, sf_dir)
    return _plain(edges.downstream_edges(c, _texts(c)))


def upstream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, J9."""
    c = _catalog(spark, sf_dir)
    return _plain(edges.upstream_edges(c, _texts(c)))


def impact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fields without formulas affect, three levels deep."""
    c = _catalog(spark, sf_dir)
    nodes, _ = graph.impact(_down(c), _roots(c), 3)
    return edges.attach_meta(nodes, c.fields).select("id", "level", "object", "field", "title")


def impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges walked over intra and write-back edges."""
    c = _catalog(spark, sf_dir)
    return _plain(graph.impact(_down(c), _roots(c), 3, rel=4)[1])


def trace_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    c = _catalog(spark, sf_dir)
    return graph.trace(_up(c), _roots(c, 2), 5)[0]


def closed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4, U2."""
    c = _catalog(spark, sf_dir)
    return _plain(graph.closed_graph(_down(c), _up(c), _roots(c, 2), 2)[1])


def explain_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths from fields without formulas, with each step's reason."""
    c = _catalog(spark, sf_dir)
    found = graph.explain(_down(c), _roots(c), c.fields, 4)
    return found.select("root", "id", "object", "field", "path_len", "path", F.array_join("steps.reason", "; ").alias("reasons"), "summary")


def object_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between objects upstream of the sums."""
    c = _catalog(spark, sf_dir)
    return graph.object_graph(*graph.trace(_up(c), _roots(c, 2), 3))[1]


def global_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from fields of apps that hold 'al' or 'oc'."""
    c = _catalog(spark, sf_dir)
    return graph.global_graph(c, edges.downstream_edges(c, _texts(c)), ("AL", "oc"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return graph.graph_stats(_down(_catalog(spark, sf_dir)).select("src", "dst").distinct())[0]


def _with_cycles(c: Catalog) -> DataFrame:
    """The edges, and one back from the end of every fourth object's second block to the start of the object three before."""
    down = _down(c).select("src", "dst")
    numbered = c.fields.select(F.substr("object_type", F.lit(4)).cast("long").alias("k"), F.col("id").cast("long").alias("ok"), names.node_id(F.col("object_type"), cat.canonical()).alias("node"))
    placed = numbered.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("ok"))).where("place <= 8")
    ends = placed.where((F.col("k") % 16 == 3) & (F.col("place") == 8)).select((F.col("k") - 3).alias("k"), F.col("node").alias("src"))
    starts = placed.where("place = 5").select("k", F.col("node").alias("dst"))
    return checkpoint(down.union(ends.join(starts, "k").select("src", "dst")).distinct())


def lineage_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return graph.cycles(_with_cycles(_catalog(spark, sf_dir)))


def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G11."""
    c = _catalog(spark, sf_dir)
    down = _down(c)
    nodes = down.select(F.col("src").alias("id")).union(down.select(F.col("dst").alias("id")))
    return graph.topological_order(nodes, down).select("id", "level", F.col("in_cycle").cast("int").alias("in_cycle"))


def deep_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9, T3."""
    return graph.deep_chains(_down(_catalog(spark, sf_dir)), 10).select("root", "length")


def longest_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12."""
    c = _catalog(spark, sf_dir)
    return graph.longest_depth(_down(c), _roots(c))


def fix_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By shortest depth."""
    c = _catalog(spark, sf_dir)
    return graph.fix_steps(_down(c), _roots(c), longest=False).select("object", "field", "depth", _joined("types").alias("types"))


def dirty_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G15."""
    c = _catalog(spark, sf_dir)
    return graph.dirty_set(_up(c), _roots(c, 2))


def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and relations of the nodes of an impact without view edges."""
    c = _catalog(spark, sf_dir)
    roots = _roots(c)
    nodes, walked = graph.impact(_down(c), roots, 2)
    walked = walked.where("rel <> 'view'")
    report = graph.impact_report(graph.explain(walked, roots, c.fields, 2), walked, c.fields, roots)
    return report.select("object", "field", "title", "role", "relations", "path", "trigger_expr", "expression", "virtual_expr")


def graph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges spelt in snake case come back in canonical form."""
    c = _catalog(spark, sf_dir)
    spelt = edges.intra_edges(c.fields).select(F.concat("src_object", F.lit("."), names.camel_to_snake(F.col("src_field"))).alias("src"), "dst", "rel")
    return _plain(edges.normalise_graph_ids(spelt.withColumn("src", F.regexp_replace("src", r"\.fld", ".fld_"))))


def trigger_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog rows that each field's value triggers."""
    c = _catalog(spark, sf_dir)
    used = edges.intra_edges(c.fields).union(edges.alias_edges(c.fields)).distinct()
    return graph.trigger_fields(used, c.fields).select("src", "id", "name")


def direct_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources each written-back field has one step before it."""
    c = _catalog(spark, sf_dir)
    return edges.direct_upstream(edges.upstream_edges(c), intra=False).groupBy("dst").agg(F.count("*").alias("sources"))


def normalised_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field asked for by its catalog name, in snake case."""
    c = _catalog(spark, sf_dir)
    return graph.normalise_roots(c.fields.select(F.col("object_type").alias("object"), F.col("name").alias("field")), c.fields)


def excluded_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of an impact that still touch an edge without the intra ones."""
    c = _catalog(spark, sf_dir)
    nodes, walked = graph.impact(_down(c), _roots(c), 3)
    return edges.exclude_relations(nodes, walked, ("intra",), "none")[0]


def thread_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a field of one name, in any case, and where they write back to."""
    c = _catalog(spark, sf_dir)
    return health.thread_chain(c, "FLD28")


def why_no_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text searches for one field over the whole catalog."""
    return health.why_no_relation(_catalog(spark, sf_dir), "Obj1", "fld_")


def metadata_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1."""
    return references.metadata_graph(_catalog(spark, sf_dir))


def reference_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: what every bill refers to within three steps."""
    c = _catalog(spark, sf_dir)
    starts = c.objects.where("type = 'bill' AND name NOT LIKE '%View'").select(F.col("name").alias("id"))
    return references.reference_paths(references.metadata_graph(c), starts, 3).select("start", "target", "hops")


# Snapshots and differences


def _changed(c: Catalog) -> DataFrame:
    """The catalog with every 97th field renamed, dropped or changed."""
    place = F.col("id").cast("long") % 97
    name = F.when(place == 1, F.concat("name", F.lit("_new"))).otherwise(F.col("name"))
    trigger = F.when(place == 2, F.lit("changed_a + 1")).otherwise(F.col("trigger_expr"))
    title = F.when(place == 3, F.lit(None)).otherwise(F.col("title"))
    return c.fields.where(place != 0).withColumns({"name": name, "trigger_expr": trigger, "title": title})


def catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, A7, U3, W1."""
    c = _catalog(spark, sf_dir)
    return diff.diff_catalogs(c.fields, _changed(c))


def latest_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas after the changed catalog is laid over."""
    c = _catalog(spark, sf_dir)
    out = edges.overlay_definitions(c.fields, _changed(c))
    return out.select("id", "trigger_expr", "title", F.col("from_latest").cast("int").alias("from_latest"))

# Scans, lookups and tables that other queries don't show


def write_back_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    return cat.scan_write_back_candidates(_catalog(spark, sf_dir)).select("id", "object_type", "app_name")


def app_of_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The app of one object."""
    return cat.app_name_of(_catalog(spark, sf_dir), "Obj1")


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog and its changed form are written as snapshots; the newest one is listed and read."""
    c = _catalog(spark, sf_dir)
    path = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    for minute, fields in enumerate((c.fields, _changed(c))):
        snapshots.write_snapshot(Catalog(fields, c.objects), path, datetime(2024, 1, 1, 0, minute))
    newest = snapshots.list_snapshots(spark, path).head()[0]
    return snapshots.load_snapshot(spark, path, newest).select("snapshot_id", "id", "name", "app_name")


def verify_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mappings of two systems."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("event_type").alias("verify_system_id"), F.col("props").alias("mappings"))
    return cat.scan_verify_mappings(events, ["signup", "error"])


def field_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog row of an object's first field."""
    c = _catalog(spark, sf_dir)
    return cat.field_info(c, "Obj1", cat.fields_of(c, "Obj1").head()[0]).select("id", "object_type", "app_name", "name")


def object_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of one object."""
    return cat.field_details_of(_catalog(spark, sf_dir), "Obj1").select("id", "field", "title", "app_name")


def exact_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of bills of exactly two apps."""
    return cat.filter_apps_exact(_catalog(spark, sf_dir), ["sales", "Stock"]).select("id", "app_name")


def formula_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names in formulas, as they are spelt and in camel case."""
    text = formulas.all_formulas(F.col("trigger_expr"), F.col("expression"), F.col("virtual_expr"))
    return _catalog(spark, sf_dir).fields.select("id", _joined(formulas.formula_refs(text)).alias("names"))


def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges between two objects."""
    return _plain(graph.object_edge_details(_up(_catalog(spark, sf_dir)), "Obj1", "Obj2", "writeBack"))


def cross_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered edges between different objects upstream of the sums."""
    c = _catalog(spark, sf_dir)
    return graph.cross_object_table(*graph.trace(_up(c), _roots(c, 2), 3))


def object_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: objects of a graph with their number of fields."""
    c = _catalog(spark, sf_dir)
    return graph.object_graph(*graph.trace(_up(c), _roots(c, 2), 3))[0]


def closed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a closed graph, with the level of those that are affected."""
    c = _catalog(spark, sf_dir)
    return graph.closed_graph(_down(c), _up(c), _roots(c, 2), 2)[0]


def chains_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with their paths, numbered from the longest."""
    found = graph.deep_chains(_down(_catalog(spark, sf_dir)), 10).withColumn("shorter", -F.col("length"))
    return numbered(found, ("shorter", "path"), "place").select("place", "root", "length", "path", F.size(F.split("path", " -> ")).alias("nodes"))


def catalog_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts around one field."""
    c = _catalog(spark, sf_dir)
    return health.catalog_probe(c, _down(c), "Obj1", cat.fields_of(c, "Obj1").head()[0]).withColumn("found", F.col("found").cast("int"))


def matching_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best objects for a keyword."""
    return references.match_objects(_catalog(spark, sf_dir), "Object 11")


def tenant_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one app."""
    return references.for_tenant(_catalog(spark, sf_dir).objects, "sales", "app_name").select("name", "app_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rollup_regions, rollup_nations, rollup_customers, rollup_orders, staged_rollups, write_back_keeps_old, exact_sums, formula_lookups, formula_aggregates, changed_rows, parent_lookup, recompute_plan, recompute_plan_batch,
        field_names, formula_fields, formula_words, referred_entities, spelt_names, hooked_formula, formula_columns, write_back_rules, field_kinds, mapping_rewrite, mapping_direction,
        catalog_scan, view_definitions, view_lineage, view_sql_dependencies, view_stats, object_details, fields_by_app, compare_catalog, field_search, object_search,
        fields_per_object, write_back_targets, write_back_sources, incoming_references, category_counts, object_health, object_profile, pattern_check, change_scope, trigger_summary,
        health_pages, profile_pages, reference_pages, view_field_pages, trigger_pages, ordered_targets, ordered_sources, ordered_references, ordered_steps,
        lineage_edges, upstream_edges, impact_nodes, impact_edges, trace_nodes, closed_graph, explain_paths, object_graph, global_graph, graph_stats,
        lineage_cycles, topological_order, deep_chains, longest_depths, fix_steps, dirty_fields, impact_report, graph_ids, catalog_diff, latest_definitions,
        trigger_fields, direct_upstream, normalised_roots, excluded_relations, thread_chain, why_no_relation, metadata_graph, reference_paths,
        write_back_candidates, app_of_object, snapshot_rows, verify_mappings, field_information, object_fields, exact_apps, formula_references, object_edges, cross_objects, object_nodes, closed_nodes,
        chains_by_length, catalog_probe, matching_objects, tenant_objects,
    )
}
