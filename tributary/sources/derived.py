"""Catalogs over the star schema: rules for its own tables, and a large catalog derived from its orders.

The large catalog has an object for each customer and a field for each order, so it grows with the tables. Within an object, fields come in blocks
of four by order key: one written back from the same block of the customer before, and three computed from those before them.
The statements are plain SQL that other engines read too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import FIELD_COLUMNS, Catalog

#: Object, its table and its key.
TABLES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Orders": ("orders", "o_orderkey"), "Lineitem": ("lineitem", "l_linenumber")}

#: Derived fields: object, name, trigger, rule (source, key, expression, condition).
RULES = (
    ("Lineitem", "net", "l_extendedprice * (1 - l_discount)", None),
    ("Lineitem", "taxed", "net * (1 + l_tax)", None),
    ("Orders", "item_total", None, ("Lineitem", "l_orderkey", "sum(net)", "l_returnflag <> 'R'")),
    ("Orders", "taxed_total", None, ("Lineitem", "l_orderkey", "sum(taxed)", "l_returnflag <> 'R'")),
    ("Orders", "item_count", None, ("Lineitem", "l_orderkey", "count(l_linenumber)", "l_returnflag <> 'R'")),
    ("Customer", "order_total", None, ("Orders", "o_custkey", "sum(item_total)", None)),
    ("Customer", "gap", "order_total - c_acctbal", None),
    ("Nation", "cust_total", None, ("Customer", "c_nationkey", "sum(order_total)", None)),
    ("Nation", "gap_total", None, ("Customer", "c_nationkey", "sum(gap)", None)),
    ("Region", "nation_total", None, ("Nation", "n_regionkey", "sum(cust_total)", None)),
)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {o: spark.read.parquet(f"{sf_dir}/{t}.parquet") for o, (t, _) in TABLES.items()}


def rule_catalog(spark: SparkSession, frames: dict[str, DataFrame]) -> Catalog:
    """The tables' own columns as plain fields, and RULES."""
    import json

    rows = []
    for o, df in frames.items():
        rows += [(f"{o}.{c}", o, c, None, None, None, None, None, None, None, None, None) for c in df.columns]
    for o, name, trigger, rule in RULES:
        text = json.dumps(dict(zip(("srcObjectType", "idField", "expression", "condition"), rule, strict=True))) if rule else None
        rows.append((f"{o}.{name}", o, name, None, None, None, None, None, trigger, None, text, None))
    fields = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FIELD_COLUMNS))
    objects = spark.createDataFrame([(o, o, "bill", "sales") for o in frames], "name string, title string, type string, app_name string")
    return Catalog(fields, objects)


def _name(key: str) -> str:
    return f"('fld_' || {key} || CASE {key} % 13 WHEN 0 THEN '_amount' WHEN 1 THEN '_base_qty' ELSE '' END)"


def _camel(key: str) -> str:
    return f"('fld' || {key} || CASE {key} % 13 WHEN 0 THEN 'Amount' WHEN 1 THEN 'BaseQty' ELSE '' END)"


#: k: customer, ok: order, r: its place among the customer's, p1..p3: the orders before it, s: the order at place r + 3 of customer k - 1.
BASE = """
numbered AS (
  SELECT o_orderkey AS ok, o_custkey AS k, row_number() OVER w - 1 AS r, lag(o_orderkey, 1) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2, lag(o_orderkey, 3) OVER w AS p3
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
base AS (
  SELECT b.ok, b.k, b.r, b.p1, b.p2, b.p3, s.ok AS s
  FROM numbered b LEFT JOIN (SELECT ok, k + 1 AS k, r - 3 AS r FROM numbered) s ON b.k = s.k AND b.r = s.r)
"""

FIELDS = f"""
SELECT CAST(ok AS STRING) AS id, 'Obj' || k AS object_type, {_name('ok')} AS name,
  CASE ok % 5 WHEN 0 THEN {_camel('ok')} WHEN 1 THEN '' END AS api_name,
  CASE WHEN ok % 9 > 0 THEN 'Title ' || ok END AS title, 'decimal' AS type,
  CASE ok % 7 WHEN 0 THEN 'Currency' WHEN 1 THEN 'Order Quantity' WHEN 2 THEN 'text' END AS biz_type,
  CASE WHEN r % 4 = 3 AND ok % 2 = 0 THEN '(' || {_name('p2')} || ' + ' || {_name('p3')} || ') * ''fld_9''' END AS expression,
  CASE r % 4 WHEN 1 THEN 'case when abs(t.' || {_name('p1')} || ') > 0 then ''fld_7'' else null end' WHEN 2 THEN {_name('p1')} || ' + ' || {_camel('p2')} END AS trigger_expr,
  CASE WHEN r % 4 = 3 AND ok % 2 = 1 THEN {_name('p1')} || ' * 2' END AS virtual_expr,
  CASE WHEN r % 4 = 0 AND k % 4 > 0 AND s IS NOT NULL THEN
    CASE WHEN k % 8 = 5 THEN '[{{"expression":"q"}},' ELSE '' END || CASE WHEN k % 8 = 3 THEN '{{"SRCOBJECTTYPE":"Obj' ELSE '{{"srcObjectType":"Obj' END || (k - 1)
    || CASE WHEN k % 8 = 3 THEN '","IdField":"parent_id","Expression":"sum(' ELSE '","idField":"parent_id","expression":"sum(' END || {_name('s')} || ')","condition":"srcItemObjectType=''Obj' || (k - 2) || '''"}}'
    || CASE WHEN k % 8 = 5 THEN ']' ELSE '' END END AS write_back_expr,
  CASE WHEN ok % 6 = 0 THEN '{{"referEntities":[{{"referEntityName":"Obj' || (k - 1) || '"}},{{"referEntityName":"Other"}}]}}' END AS refer_info
FROM base
"""

_APP = "CASE k % 4 WHEN 0 THEN 'sales' WHEN 1 THEN 'finance' WHEN 2 THEN 'Stock' ELSE 'hr' END"
OBJECTS = f"""
SELECT 'Obj' || k AS name, CASE WHEN k % 5 > 0 THEN 'Object ' || k END AS title, CASE WHEN k % 10 = 9 THEN 'other' ELSE 'bill' END AS type, {_APP} AS app_name
FROM (SELECT DISTINCT k FROM base) AS keys
UNION ALL SELECT 'Obj' || k || 'View', 'View ' || k, 'bill', {_APP} FROM (SELECT DISTINCT k FROM base WHERE k % 8 = 0) AS views
"""

def _view_sql() -> str:
    """A view's text: plain and computed columns, a subselect with the alias of a table outside, and a quoted name; every other one without SELECT."""
    a, b, quote = _name("a.ok"), _name("b.ok"), "chr(92) || chr(34)"
    items = (
        f"CASE WHEN a.k % 16 = 0 THEN 'SELECT ' ELSE '' END || 'a.' || {a} || ' AS v_' || a.ok || ', b.' || {b} || ' w_' || b.ok || ', a.*'",
        f"', coalesce(b.' || {b} || ', 0) * 2 AS c_' || b.ok",
        f"', case when a.' || {a} || ' = 1 then abs(a.' || {a} || ') else b.' || {b} || ' end k_' || a.ok",
        f"', (select sum(s.' || {b} || ') total from app_obj' || b.k || ' s where s.id = a.id) s_' || b.ok",
        f"', a.' || {a} || ' - 1 AS ' || {quote} || 'q ' || a.ok || {quote} || ', count(*), cast(a.' || {a} || ' as decimal(10, 2)) d_' || a.ok",
        "' FROM app_obj' || a.k || ' a LEFT JOIN app_obj' || b.k || ' AS b ON a.id = b.parent_id WHERE a.is_deleted = false'",
    )
    return " || ".join(items)


METADATA = f"""
SELECT 'Obj' || a.k || 'View' AS name,
  '{{"name":"Obj' || a.k || 'View","fields":[{{"name":"v_' || a.ok || '","type":"decimal"}}],"viewDef":[{{"objectName":"Obj' || a.k || '","sql":"' || {_view_sql()} || '"}}]}}' AS content,
  a.k % 24 = 16 AS is_deleted, 'MetaType.entity' AS type_id
FROM base a JOIN base b ON b.k = a.k + 1 AND a.r = 0 AND b.r = 0 WHERE a.k % 8 = 0
"""


def large_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    base = BASE.replace("FROM orders", "FROM {orders}")
    escaped = lambda sql: sql.replace("{", "{{").replace("}", "}}")
    frame = lambda body: spark.sql(f"WITH {base} {escaped(body)}", orders=orders)
    return Catalog(frame(FIELDS), frame(OBJECTS), frame(METADATA))
