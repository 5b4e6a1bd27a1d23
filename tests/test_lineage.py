"""Edges, audits, differences and plans on a catalog small enough to work out by hand."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tributary.operators import diff, edges, graph, health, loops, views
from tributary.plans import recompute
from tributary.sources import catalog as cat
from tributary.sources import derived, snapshots
from tributary.sources.catalog import FIELD_COLUMNS, Catalog

SCHEMA = ", ".join(f"{c} string" for c in FIELD_COLUMNS)


def field(i, object_type, name, **more):
    return tuple({"id": str(i), "object_type": object_type, "name": name, **more}.get(c) for c in FIELD_COLUMNS)


@pytest.fixture(scope="module")
def catalog(spark):
    rule = lambda **k: json.dumps(k)
    rows = [
        field(1, "O", "a_x"), field(2, "O", "b_x"), field(3, "O", "m", trigger_expr="a_x + b_x"), field(4, "O", "q_sum", expression="(a_x + b_x) * rate_z"), field(5, "O", "r", expression="b_x + a_x"),
        field(6, "P", "amount", biz_type="Currency", write_back_expr=rule(srcObjectType="O", idField="pId", expression="sum(q_sum)", condition="srcItemObjectType='Q'")),
        field(7, "P", "unused", title="Un Used"), field(8, "P", "self", trigger_expr="self + 1"), field(9, "P", "v", virtual_expr="amount * 2"), field(10, "P", None),
        field(11, "Q", "base_qty", refer_info='{"referEntities":[{"referEntityName":"P"}]}'), field(12, "Q", "broken", write_back_expr="oops"),
    ]
    objects = [("O", "Ob", "bill", "Sales"), ("P", None, "bill", "finance"), ("Q", "Qu", "other", "stock"), ("ViewOne", None, "bill", "sales"), ("ViewTwo", None, "bill", "sales")]
    view = {"name": "ViewOne", "fields": [{"name": "out"}], "viewDef": [{"objectName": "O", "sql": "select ${SystemFields}, t.a_x as out_a, coalesce(b, 1) x, \"p\".amount, z.* from app_o t left join app_p p on t.id = p.o_id"}, {"objectName": "P", "sql": "select amount from app_p union select 1"}]}
    metadata = [("ViewOne", json.dumps(view), False, "MetaType.entity"), ("ViewTwo", "{broken", False, "MetaType.entity"), ("ViewOne", "{}", True, "MetaType.entity")]
    return Catalog(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(objects, "name string, title string, type string, app_name string"), spark.createDataFrame(metadata, "name string, content string, is_deleted boolean, type_id string"))


def arrows(frame):
    return {(r["src"], r["dst"], r["rel"]) for r in frame.collect()}


def test_edges(catalog):
    direct = arrows(edges.intra_edges(catalog.fields))
    assert direct == {("O.aX", "O.m", "intra"), ("O.bX", "O.m", "intra"), ("O.aX", "O.qSum", "intra"), ("O.bX", "O.qSum", "intra"), ("O.rateZ", "O.qSum", "intra"), ("O.aX", "O.r", "intra"), ("O.bX", "O.r", "intra"), ("P.amount", "P.v", "intra")}
    assert arrows(edges.alias_edges(catalog.fields)) == {("O.m", "O.qSum", "intra")}
    assert arrows(edges.write_back_edges(catalog)) == {("O.qSum", "P.amount", "writeBack"), ("Q.qSum", "P.amount", "writeBack")}
    assert arrows(edges.write_back_sources(catalog)) == {("O.qSum", "P.amount", "writeBack")}
    _, texts, rejects = cat.views(catalog, cat.scan_view_definitions(catalog, ["SALES"]))
    assert {r["reason"] for r in rejects.collect()} == {"unreadable"}
    assert arrows(edges.view_edges(texts)) == {("O.aX", "ViewOne.outA", "view"), ("P.amount", "ViewOne.amount", "view")}
    assert [r["reason"] for r in views.view_column_lineage(texts)[1].collect()] == ["union"]


def test_scans(catalog):
    assert {r["name"] for r in cat.object_types(catalog).collect()} == {"O", "P"}
    assert {(r["name"], r["title"]) for r in cat.object_details(catalog).collect()} == {("O", "Ob"), ("P", "P")}
    assert [r["field"] for r in cat.fields_of(catalog, "P").collect()] == ["amount", "self", "unused", "v"]
    assert [r["id"] for r in cat.search_fields(catalog, "USED").collect()] == ["7"]
    assert cat.filter_apps_fuzzy(cat.scan_fields(catalog), ["SAL", " "]).count() == 5 and cat.filter_apps_fuzzy(cat.scan_fields(catalog), [" "]).count() == 12
    assert [r["id"] for r in cat.scan_referencing_fields(catalog, "P").collect()] == ["11"]
    assert [r["id"] for r in cat.field_info(catalog, "O", "aX").collect()] == ["1"]
    assert [(r["source_object"], r["target_object"], r["fields"]) for r in cat.targets_by_source(catalog).collect()] == [("O", "P", 1)]
    only_others = Catalog(catalog.fields.where("object_type = 'Q'"), catalog.objects)
    assert [r["name"] for r in cat.object_types(only_others).collect()] == ["Q"]


def test_health(catalog):
    p = health.object_health(catalog.fields).where("object_type = 'P'").head()
    assert (p["total"], p["with_formula"], p["referenced"], p["dead"], p["write_back"], p["write_back_unreferenced"], p["dead_fields"]) == (5, 3, 2, 1, 1, 0, ["unused"])
    profile = {r["object_type"]: r for r in health.object_profile(catalog).collect()}
    assert profile["P"]["write_back"] == ["amount"] and profile["P"]["virtual"] == ["v"] and profile["P"]["sources"] == 1 and profile["O"]["targets"] == 1 and profile["Q"]["quantity"] == ["baseQty"]
    checks = {(r["kind"], r["name"]): r["present"] for r in health.pattern_check(catalog).where("object_type = 'P'").collect()}
    assert checks["amount", "amount"] and not checks["amount", "originAmount"] and checks["coverage", "amount"]
    scope = {(r["action"], r["affected"]) for r in health.change_scope(catalog, edges.intra_edges(catalog.fields), catalog.fields.sparkSession.createDataFrame([("P", "N", "amount"), ("P", "N", "other"), ("P", "N", "unused")], "target_object string, new_source string, field string")).collect()}
    assert scope == {("ADD_WRITE_BACK_SOURCE", "P.amount"), ("ADD_FIELD", "P.other"), ("ADD_WRITE_BACK_DEFINITION", "P.unused"), ("CHECK_TRIGGER", "P.v")}
    assert {(r["check"], r["id"]) for r in health.why_no_relation(catalog, "O", "q_sum").collect()} == {("same_name", "4"), ("write_back_holds_both", "6")}
    assert health.catalog_probe(catalog, edges.downstream_edges(catalog), "O", "aX").head().asDict() == {"fields": 12, "objects": 3, "object_fields": 5, "found": True, "nodes": 5, "edges": 5}
    assert {(r["source_object"], r["target_object"]) for r in health.thread_chain(catalog, "QSUM").collect()} == {("O", "P")}


def test_diff(catalog):
    changed = catalog.fields.where("id <> '1'").withColumn("title", F.when(F.col("id") == "2", "T").otherwise(F.col("title"))).withColumn("name", F.when(F.col("id") == "3", "mm").otherwise(F.col("name")))
    got = {(r["kind"], r["name"], r["property"], r["old_value"], r["new_value"]) for r in diff.diff_catalogs(catalog.fields, changed).collect()}
    assert got == {("removed", "a_x", None, None, None), ("added", "mm", None, None, None), ("removed", "m", None, None, None), ("modified", "b_x", "title", None, "T")}


def test_snapshots(catalog, spark, tmp_path):
    path = f"{tmp_path}/s"
    first = snapshots.write_snapshot(catalog, path, datetime(2024, 1, 2, 3, 4, 5))
    second = snapshots.write_snapshot(catalog, path, datetime(2024, 1, 2, 3, 4, 6))
    assert [r[0] for r in snapshots.list_snapshots(spark, path).collect()] == [second, first] and first == "snapshot_20240102_030405.json"
    assert snapshots.load_snapshot(spark, path, first).count() == 12
    with pytest.raises(ValueError):
        snapshots.load_snapshot(spark, path, "none")
    # Listing opens no data file, loading no other snapshot's.
    for file in tmp_path.glob(f"s/snapshot_id={first}/*.parquet"):
        file.write_bytes(b"broken")
    assert snapshots.list_snapshots(spark, path).count() == 2 and snapshots.load_snapshot(spark, path, second).count() == 12
    assert snapshots.list_snapshots(spark, f"{tmp_path}/none").isEmpty()


def test_large_reports_are_split(spark, tmp_path):
    report = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "Big").when(F.col("id") % 40 == 0, None).otherwise("Small").alias("object"), F.col("id").cast("string").alias("field"))
    snapshots.write_impact_report(report, f"{tmp_path}/r", "parquet", rows=500)
    files = [(p.parent.name, spark.read.parquet(str(p)).count()) for p in tmp_path.glob("r/*/*.parquet")]
    assert sum(n for _, n in files) == 4000 and max(n for _, n in files) <= 1000 and sum(o == "object=Big" for o, _ in files) >= 3


def test_runs_meet_on_their_rarest_field(spark):
    """Runs that share a first field, which all formulas use: candidates are those that use the rarer second one."""
    rows = [field(k, "O", f"t_{k}", trigger_expr=f"all_x + own_{k % 30}") for k in range(120)] + [field(1000 + k, "O", f"u_{k}", expression=f"(all_x + own_{k}) * all_x") for k in range(30)]
    fields = spark.createDataFrame(rows, SCHEMA)
    got = {(r["src"], r["dst"]) for r in edges.alias_edges(fields).collect()}
    same = {(f"O.t{a}", f"O.t{b}") for a in range(120) for b in range(120) if a != b and a % 30 == b % 30}
    assert got == same | {(f"O.t{k}", f"O.u{k % 30}") for k in range(120)}


def test_report(catalog, spark, tmp_path):
    down = edges.downstream_edges(catalog)
    roots = spark.createDataFrame([("O.aX",)], "id string")
    nodes, walked = graph.impact(down, roots, 3)
    report = graph.impact_report(graph.explain(walked, roots, catalog.fields, 3), walked, catalog.fields, roots)
    rows = {f"{r['object']}.{r['field']}": r for r in report.collect()}
    assert rows["O.aX"]["role"] == "root" and rows["P.amount"]["role"] == "affected" and rows["P.amount"]["path"] == "O.aX --[intra]--> O.qSum → O.qSum --[writeBack]--> P.amount"
    snapshots.write_impact_report(report, f"{tmp_path}/r")
    snapshots.write_graph(nodes, walked, f"{tmp_path}/g")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == len(rows) and spark.read.parquet(f"{tmp_path}/g/edges").count() == walked.count()


def test_write_back_rules(spark):
    target = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, None)], "id long, total double")
    source = spark.createDataFrame([(1, 2.5, False, "x"), (1, 0.1, True, "x"), (2, 9.0, True, "y"), (None, 1.0, False, "z"), (3, None, False, "w")], "fk long, v double, gone boolean, s string")
    out = recompute.apply_write_backs(target, "id", source, [recompute.WriteBack("total", "sum(v)", "fk", "gone = 'f'"), recompute.WriteBack("n", "count(*)", "fk", "gone = 'f'")])
    assert {(r["id"], float(r["total"]) if r["total"] is not None else None, r["n"]) for r in out.collect()} == {(1, 2.5, 1), (2, 6.0, None), (3, 0.0, 1)}
    with pytest.raises(TypeError):
        recompute.apply_write_backs(target, "id", source, [recompute.WriteBack("total", "sum(s)", "fk")])
    with pytest.raises(ValueError):
        recompute.apply_write_backs(target, "id", source, [recompute.WriteBack("total", "median(v)", "fk")])


def test_formulas(spark):
    df = spark.createDataFrame([(7, 2, True, "a")], "x int, y int, b boolean, s string")
    value = lambda f, **k: df.select(recompute.compile_formula(f, df.schema, k)).head()[0]
    assert value("x / y") == 3 and value("case when b = 't' then 1 else 0 end") == 1 and value("'[\"p\",\"q\"]'::JSONB") == ["p", "q"]
    assert value("twice(x, concat(s, ','))", twice=lambda a, b: a * 2) == 14
    assert recompute.apply_triggers(df, {"x": "y", "y": "x"}).head().asDict()["x"] == 2
    assert recompute.changed_only(df, "x", "x + 0").isEmpty()


def test_plan(spark):
    frames = derived.tables(spark, "/root/testdata/sf0.001")
    catalog = derived.rule_catalog(spark, frames)
    plan = recompute.recompute_plan(catalog, spark.createDataFrame([("Lineitem", "l_extendedprice")], "object string, field string")).orderBy("step").collect()
    assert [r["node"] for r in plan] == ["Lineitem.lExtendedprice", "Lineitem.net", "Lineitem.taxed", "Orders.itemTotal", "Customer.orderTotal", "Orders.taxedTotal", "Customer.gap", "Nation.custTotal", "Nation.gapTotal", "Region.nationTotal"]
    assert [r["step"] for r in plan] == list(range(1, 11)) and plan[3]["rule"]["expression"] == "sum(net)" and plan[0]["status"] == "no formula"
    steps = [r.asDict(recursive=True) for r in plan if r["status"] == "run"]
    assert [[s["column"] for s in g] for g in recompute.fuse_updates(steps)][:2] == [["net"], ["taxed"]]


def test_rules_that_read_what_another_sets_stay_apart(spark):
    rule = lambda column, source, expression, condition=None: {"object": "T", "column": column, "formula": None, "rule": {"source": source, "key": "up", "expression": expression, "condition": condition}}
    groups = lambda *steps: [[s["column"] for s in g] for g in recompute.fuse_updates(steps)]
    assert groups(rule("a", "T", "sum(x)"), rule("b", "T", "sum(a)")) == [["a"], ["b"]]
    assert groups(rule("a", "T", "sum(x)"), rule("b", "T", "sum(y)", "a > 1")) == [["a"], ["b"]]
    assert groups(rule("a", "T", "sum(x)"), rule("b", "T", "sum(y)")) == [["a", "b"]]
    assert groups(rule("a", "S", "sum(x)"), rule("b", "S", "sum(a)")) == [["a", "b"]]


@pytest.mark.parametrize("last", [0, 10_000])
def test_levels_with_and_without_the_last_task(spark, monkeypatch, last):
    monkeypatch.setattr(loops, "LAST_EDGES", last)
    edges_ = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxyzsq"], "id string")
    levels, rest = loops.peel(nodes, edges_)
    assert {r["id"]: r["level"] for r in levels.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "q": 0} and {r["id"] for r in rest.collect()} == set("xyzs")
    roots = spark.createDataFrame([("a",), ("q",), ("x",)], "id string")
    assert {r["id"]: r["level"] for r in loops.bfs(edges_, roots).collect()} == {"a": 0, "q": 0, "x": 0, "b": 1, "c": 1, "y": 1, "d": 2, "z": 2}
    assert {r["id"]: r["level"] for r in loops.bfs(edges_, roots, 1, reverse=True).collect()} == {"a": 0, "q": 0, "x": 0, "y": 1}
    assert {(r["id"], r["component"]) for r in graph.cycles(edges_).collect()} == {("x", "x"), ("y", "x"), ("s", "s")}
