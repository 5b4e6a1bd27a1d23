"""SQL for the registered lineage queries.

Lineage edges are written here from how the derived catalog is made, not by reading its formulas again, so they test the tokeniser too.
"""

from __future__ import annotations

from .queries import SUBQUERY_FORMULAS
from .sources.derived import BASE, FIELDS, METADATA, OBJECTS, _camel, _name


def _node(k: str, key: str) -> str:
    return f"('Obj' || {k} || '.' || {_camel(key)})"


_FIELDS = f"fields AS ({FIELDS})"
_OBJECTS = f"objects_c AS ({OBJECTS})"
#: Canonical names of catalog rows are those of their keys.
_C = _camel("CAST(id AS BIGINT)")
_SEQ = f"""
seqs AS (
  SELECT ok, k, {_camel('ok')} AS field,
    CASE WHEN r % 4 = 1 THEN {_camel('p1')} WHEN r % 4 = 2 THEN {_camel('p1')} || ',' || {_camel('p2')}
      WHEN r % 4 = 3 AND ok % 2 = 0 THEN {_camel('p2')} || ',' || {_camel('p3')} WHEN r % 4 = 3 THEN {_camel('p1')} ELSE '' END AS in_order
  FROM base)"""
_PAIRS = """
direct AS (
  SELECT k, p1 AS a, ok AS b FROM base WHERE r % 4 IN (1, 2) OR (r % 4 = 3 AND ok % 2 = 1)
  UNION SELECT k, p2, ok FROM base WHERE r % 4 = 2 OR (r % 4 = 3 AND ok % 2 = 0)
  UNION SELECT k, p3, ok FROM base WHERE r % 4 = 3 AND ok % 2 = 0),
same_run AS (SELECT k, p1 AS a, ok AS b FROM base WHERE r % 4 = 3 AND ok % 2 = 0),
backs AS (SELECT k, s, ok FROM base WHERE r % 4 = 0 AND k % 4 > 0 AND s IS NOT NULL)"""
_VIEW_ROWS = """
shown AS (
  SELECT a.k AS k, a.ok AS a, b.ok AS b FROM base a JOIN base b ON b.k = a.k + 1 AND a.r = 0 AND b.r = 0 WHERE a.k % 8 = 0 AND a.k % 24 <> 16)"""
_INTRA = f"SELECT {_node('k', 'a')} AS src, {_node('k', 'b')} AS dst, 'intra' AS rel FROM direct"
_ALIAS = f"SELECT {_node('k', 'a')} AS src, {_node('k', 'b')} AS dst, 'intra' AS rel FROM same_run"
_BACK = f"SELECT {_node('(k - 1)', 's')} AS src, {_node('k', 'ok')} AS dst, 'writeBack' AS rel FROM backs"
_BACK_2 = f"SELECT {_node('(k - 2)', 's')} AS src, {_node('k', 'ok')} AS dst, 'writeBack' AS rel FROM backs"
#: What each view shows: output, and the object (0 the view's own, 1 the next one) and column that it comes from.
_SHOWN = f"""
  SELECT k, 'v_' || a AS output, 'v' || a AS field, k AS o, {_name('a')} AS column_name, {_camel('a')} AS source FROM shown
  UNION ALL SELECT k, 'w_' || b, 'w' || b, k + 1, {_name('b')}, {_camel('b')} FROM shown
  UNION ALL SELECT k, 'c_' || b, 'c' || b, k + 1, {_name('b')}, {_camel('b')} FROM shown
  UNION ALL SELECT k, 'k_' || a, 'k' || a, k, {_name('a')}, {_camel('a')} FROM shown
  UNION ALL SELECT k, 'k_' || a, 'k' || a, k + 1, {_name('b')}, {_camel('b')} FROM shown
  UNION ALL SELECT k, 's_' || b, 's' || b, k + 1, {_name('b')}, {_camel('b')} FROM shown
  UNION ALL SELECT k, 's_' || b, 's' || b, k + 1, 'id', 'id' FROM shown
  UNION ALL SELECT k, 's_' || b, 's' || b, k, 'id', 'id' FROM shown
  UNION ALL SELECT k, 'q ' || a, 'q ' || a, k, {_name('a')}, {_camel('a')} FROM shown
  UNION ALL SELECT k, 'd_' || a, 'd' || a, k, {_name('a')}, {_camel('a')} FROM shown"""
_VIEW = f"SELECT 'Obj' || o || '.' || source AS src, 'Obj' || k || 'View.' || field AS dst, 'view' AS rel FROM ({_SHOWN}) AS all_shown"
_DOWN = f"edges AS ({_INTRA} UNION {_ALIAS} UNION {_BACK} UNION {_BACK_2} UNION {_VIEW})"
_UP = f"up_edges AS ({_INTRA} UNION {_BACK} UNION {_VIEW})"
_EDGES = f"{BASE}, {_PAIRS}, {_VIEW_ROWS}, {_DOWN}, {_UP}"


def _roots(place: int) -> str:
    # Rows without a formula are those at place 0 of their block; sums are at place 2.
    return f"roots AS (SELECT {_node('k', 'ok')} AS id FROM base WHERE r % 4 = {place})"


def _walk(edges: str, depth: int, reverse: bool = False, name: str = "walk", start: str = "roots") -> str:
    near, far = ("dst", "src") if reverse else ("src", "dst")
    return f"""{name}_all(id, level) AS (SELECT id, 0 FROM {start} UNION SELECT e.{far}, w.level + 1 FROM {name}_all w JOIN {edges} e ON e.{near} = w.id WHERE w.level < {depth}),
{name} AS (SELECT id, CAST(min(level) AS INTEGER) AS level FROM {name}_all GROUP BY id)"""


#: Longer than any path in the derived catalog.
_FAR = 24

#: Sums of doubles with what each step rounds off added back.
_ROLLUP = """WITH per_order AS (
  SELECT l_orderkey, fsum(l_extendedprice * (1 - l_discount)) AS item_total, fsum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS taxed_total, count(l_linenumber) AS item_count
  FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey),
per_customer AS (
  SELECT o_custkey, coalesce(fsum(item_total), 0) AS order_total FROM orders LEFT JOIN per_order ON l_orderkey = o_orderkey GROUP BY o_custkey),
customers AS (SELECT c.*, order_total, order_total - c_acctbal AS gap FROM customer c LEFT JOIN per_customer ON o_custkey = c_custkey),
nations AS (
  SELECT n_nationkey, n_regionkey, cust_total, gap_total FROM nation LEFT JOIN (
    SELECT c_nationkey, coalesce(fsum(order_total), 0) AS cust_total, coalesce(fsum(gap), 0) AS gap_total FROM customers GROUP BY c_nationkey) AS t ON c_nationkey = n_nationkey)
"""


def _double(column: str, digits: int = 4) -> str:
    return f"round({column}, {digits}) AS {column}"


_HAS_BACK = "(r % 4 = 0 AND k % 4 > 0 AND s IS NOT NULL)"
_TRIGGER, _VIRTUAL = "(r % 4 IN (1, 2) OR (r % 4 = 3 AND ok % 2 = 0))", "(r % 4 = 3 AND ok % 2 = 1)"
_AMOUNT = "(ok % 13 = 0 OR ok % 7 = 0)"
_QUANTITY = "(ok % 13 = 1 OR ok % 7 = 1)"
_APP = "CASE k % 4 WHEN 0 THEN 'sales' WHEN 1 THEN 'finance' WHEN 2 THEN 'Stock' ELSE 'hr' END"


def _pages(rows: str, keys: str, size: int) -> str:
    """Rows (keys.., item) in pages of so many items."""
    return f"""SELECT {keys}, page, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT {keys}, item, CAST((row_number() OVER (PARTITION BY {keys} ORDER BY item) - 1) // {size} AS BIGINT) AS page FROM ({rows}) AS listed) AS placed GROUP BY {keys}, page"""


def _list(value: str, condition: str) -> str:
    return f"coalesce(string_agg({value}, ',' ORDER BY {value}) FILTER (WHERE {condition}), '')"


def _longest(edges: str, start: str) -> str:
    """All lengths of paths from the start, but for those that come back to it; the greatest counts."""
    return f"""onward AS (SELECT DISTINCT src, dst FROM {edges} WHERE dst NOT IN (SELECT id FROM {start})),
long_all(id, level) AS (SELECT id, 0 FROM {start} UNION SELECT e.dst, w.level + 1 FROM long_all w JOIN onward e ON e.src = w.id WHERE w.level < {_FAR}),
longest AS (SELECT id, CAST(max(level) AS INTEGER) AS depth FROM long_all GROUP BY id)"""


def _paths(edges: str, depth: int) -> str:
    """paths (root, id, level, path, reasons): of the shortest ones those through the least (parent, rel)."""
    return f"""walk_all(root, id, level) AS (SELECT id, id, 0 FROM roots UNION SELECT w.root, e.dst, w.level + 1 FROM walk_all w JOIN {edges} e ON e.src = w.id WHERE w.level < {depth}),
best AS (SELECT root, id, CAST(min(level) AS INTEGER) AS level FROM walk_all GROUP BY root, id),
told AS (
  SELECT {_node('k', 'ok')} AS dst, coalesce(f.trigger_expr, f.expression, f.virtual_expr) AS formula, 'written back from Obj' || (k - 1) || ' as sum(' || {_name('s')} || ')' AS back
  FROM base JOIN fields f ON f.id = CAST(ok AS STRING)),
parents AS (
  SELECT b.root, b.id, p.id AS parent, e.rel, row_number() OVER (PARTITION BY b.root, b.id ORDER BY p.id, e.rel) AS place
  FROM best b JOIN {edges} e ON e.dst = b.id JOIN best p ON p.root = b.root AND p.id = e.src AND p.level = b.level - 1),
paths(root, id, level, path, reasons) AS (
  SELECT id, id, 0, '', '' FROM roots
  UNION ALL SELECT c.root, p.id, c.level + 1, c.path || CASE WHEN c.level > 0 THEN ' → ' ELSE '' END || c.id || ' --[' || p.rel || ']--> ' || p.id,
    c.reasons || CASE WHEN c.level > 0 THEN '; ' ELSE '' END
      || CASE p.rel WHEN 'intra' THEN 'computed as ' || t.formula || ', contains ' || split_part(c.id, '.', 2) WHEN 'writeBack' THEN t.back ELSE c.id || ' -> ' || p.id END
  FROM paths c JOIN parents p ON p.root = c.root AND p.parent = c.id AND p.place = 1 LEFT JOIN told t ON t.dst = p.id)"""


#: Formulas over columns: a sum's second field is spelt in camel case in the catalog.
_COMPILED = f"CASE WHEN r % 4 = 2 THEN {_name('p1')} || ' + ' || {_name('p2')} ELSE coalesce(f.trigger_expr, f.expression) END"
_STEP = "CAST(row_number() OVER (ORDER BY coalesce(level, 2147483647), role = 'WRITE_BACK', node) AS BIGINT) AS step"
_TYPES = "types AS (SELECT dst AS id, string_agg(DISTINCT rel, ',' ORDER BY rel) AS types FROM edges GROUP BY dst)"
_ENDS = "ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"
_CHANGED = f"""
changed AS (
  SELECT id, object_type, CASE WHEN CAST(id AS BIGINT) % 97 = 1 THEN name || '_new' ELSE name END AS name, api_name,
    CASE WHEN CAST(id AS BIGINT) % 97 = 3 THEN NULL ELSE title END AS title, CASE WHEN CAST(id AS BIGINT) % 97 = 2 THEN 'changed_a + 1' ELSE trigger_expr END AS trigger_expr
  FROM fields WHERE CAST(id AS BIGINT) % 97 <> 0)"""

ORACLE_SQL: dict[str, str] = {
    "rollup_regions": f"""{_ROLLUP} SELECT r_regionkey, r_name, {_double('nation_total')} FROM region LEFT JOIN (
  SELECT n_regionkey, coalesce(fsum(cust_total), 0) AS nation_total FROM nations GROUP BY n_regionkey) AS t ON n_regionkey = r_regionkey""",
    "rollup_nations": f"{_ROLLUP} SELECT n_nationkey, {_double('cust_total')}, {_double('gap_total')} FROM nations",
    "rollup_customers": f"{_ROLLUP} SELECT c_custkey, {_double('order_total')}, {_double('gap')} FROM customers",
    "rollup_orders": f"{_ROLLUP} SELECT o_orderkey, {_double('item_total')}, {_double('taxed_total', 6)}, coalesce(item_count, 0) AS item_count FROM orders LEFT JOIN per_order ON l_orderkey = o_orderkey",
    "staged_rollups": f"""{_ROLLUP} SELECT 'Customer' AS object, CAST(c_custkey AS BIGINT) AS key, round(order_total, 4) AS total FROM customers
UNION ALL SELECT 'Nation', n_nationkey, round(cust_total, 4) FROM nations
UNION ALL SELECT 'Region', r_regionkey, round(nation_total, 4) FROM region LEFT JOIN (
  SELECT n_regionkey, coalesce(fsum(cust_total), 0) AS nation_total FROM nations GROUP BY n_regionkey) AS t ON n_regionkey = r_regionkey""",
    "write_back_keeps_old": """SELECT c_custkey, round(coalesce(m, c_acctbal), 4) AS c_acctbal FROM customer LEFT JOIN (
  SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) AS t ON o_custkey = c_custkey""",
    "exact_sums": """SELECT o_orderkey, round(tiny, 2) AS tiny, round(huge, 2) AS huge, CAST(rate AS VARCHAR) AS rate, round(mean, 6) AS mean, round(spread, 2) AS spread, round("both", 4) AS "both" FROM orders LEFT JOIN (
  SELECT l_orderkey, fsum(l_extendedprice * 1e-15) * 1e15 AS tiny, fsum(l_extendedprice * 1e30) / 1e30 AS huge, sum(CAST(CAST(l_discount AS DECIMAL(20, 10)) * 0.001 AS DECIMAL(38, 14))) AS rate, fsum(l_quantity) / count(*) AS mean,
    max(l_extendedprice) - min(l_extendedprice) AS spread, fsum(l_quantity) - fsum(l_tax) * count(*) AS "both"
  FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey) AS t ON l_orderkey = o_orderkey""",
    "formula_lookups": f"""SELECT o_orderkey, round({SUBQUERY_FORMULAS['orders']['segment_price']}, 2) AS segment_price, {SUBQUERY_FORMULAS['orders']['returned']} AS returned, {SUBQUERY_FORMULAS['orders']['lines']} AS lines FROM orders""",
    "formula_aggregates": f"SELECT c_custkey, round({SUBQUERY_FORMULAS['customer']['open_orders']}, 2) AS open_orders FROM customer",
    "changed_rows": "SELECT l_orderkey, l_linenumber, CAST(25 AS DOUBLE) AS new_value FROM lineitem WHERE l_quantity > 25",
    "parent_lookup": "SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "recompute_plan": f"""WITH RECURSIVE {_EDGES}, {_FIELDS}, {_roots(0)}, own_edges AS (SELECT * FROM edges WHERE rel <> 'view'), {_longest('own_edges', 'roots')}, {_TYPES},
known AS (
  SELECT {_node('k', 'ok')} AS id, {_HAS_BACK} AS back, {_TRIGGER} AS trig, {_VIRTUAL} AS virt, f.name AS "column", {_COMPILED} AS formula, CASE WHEN {_HAS_BACK} THEN 'Obj' || (k - 1) END AS rule_source,
    CASE WHEN {_HAS_BACK} THEN 'parent_id' END AS rule_key, CASE WHEN {_HAS_BACK} THEN 'sum(' || {_name('s')} || ')' END AS rule_expression, CASE WHEN {_HAS_BACK} THEN 'srcItemObjectType=''Obj' || (k - 2) || '''' END AS rule_condition
  FROM base JOIN fields f ON f.id = CAST(ok AS STRING)),
steps AS (
  SELECT l.id AS node, depth AS level, CASE WHEN depth = 0 THEN 'ROOT(manual)' WHEN types LIKE '%intra%' THEN 'INTRA' ELSE 'WRITE_BACK' END AS role,
    CASE WHEN k.id IS NULL THEN 'unknown field' WHEN back OR trig THEN 'run' WHEN virt THEN 'virtual, no column' ELSE 'no formula' END AS status, "column", formula, rule_source, rule_key, rule_expression, rule_condition
  FROM longest l LEFT JOIN types t ON t.id = l.id LEFT JOIN known k ON k.id = l.id)
SELECT {_STEP}, * FROM steps""",
    # The latest definitions rename some fields, found by their API names, and give every 97th field another trigger: its old one's edges go, it is computed from changedA, and such fields of one object trigger each other.
    "recompute_plan_batch": f"""WITH RECURSIVE {_EDGES}, {_FIELDS}, {_roots(2)},
new_direct AS (SELECT {_node('d.k', 'd.a')} AS src, {_node('d.k', 'd.b')} AS dst FROM direct d JOIN base b ON b.ok = d.b WHERE NOT (d.b % 97 = 2 AND b.r % 4 IN (1, 2))
  UNION SELECT 'Obj' || k || '.changedA', {_node('k', 'ok')} FROM base WHERE ok % 97 = 2),
new_alias AS (SELECT {_node('k', 'a')} AS src, {_node('k', 'b')} AS dst FROM same_run WHERE a % 97 <> 2
  UNION SELECT {_node('x.k', 'x.ok')}, {_node('y.k', 'y.ok')} FROM base x JOIN base y ON x.k = y.k AND x.ok <> y.ok WHERE x.ok % 97 = 2 AND y.ok % 97 = 2),
down_edges AS (SELECT src, dst, 'intra' AS rel FROM new_direct UNION SELECT src, dst, 'intra' FROM new_alias UNION {_BACK} UNION {_BACK_2}), {_walk('down_edges', 2)},
sources AS (SELECT src, dst, 'intra' AS rel FROM new_direct UNION {_BACK}), {_walk('sources', _FAR, True, 'back', 'walk')},
graph AS (
  SELECT e.src, e.dst, e.rel FROM down_edges e JOIN walk w ON w.id = e.src AND w.level < 2
  UNION SELECT e.src, e.dst, e.rel FROM sources e JOIN back b ON b.id = e.dst),
pairs AS (SELECT DISTINCT src, dst FROM graph),
-- A path of _FAR edges goes through a cycle.
long_all(id, level) AS (SELECT id, 0 FROM back UNION SELECT g.dst, l.level + 1 FROM long_all l JOIN pairs g ON g.src = l.id WHERE l.level < {_FAR}),
levels AS (SELECT id, CAST(max(level) AS INTEGER) AS level FROM long_all GROUP BY id),
types AS (SELECT dst AS id, string_agg(DISTINCT rel, ',') AS types FROM graph GROUP BY dst),
{_walk('sources', _FAR, False, 'dirty')},
known AS (SELECT {_node('k', 'ok')} AS id, {_HAS_BACK} AS back, CASE WHEN ok % 97 = 2 THEN 'changed_a + 1' WHEN r % 4 = 2 AND p2 % 97 = 1 AND p2 % 5 = 0 THEN {_COMPILED} || '_new' ELSE {_COMPILED} END AS formula FROM base JOIN fields f ON f.id = CAST(ok AS STRING)),
steps AS (
  SELECT l.id AS node, CASE WHEN l.level < {_FAR} THEN l.level END AS level,
    CASE WHEN r.id IS NOT NULL AND k.back THEN 'ROOT(write-back)' WHEN r.id IS NOT NULL AND formula IS NOT NULL THEN 'ROOT(trigger)' WHEN r.id IS NOT NULL THEN 'ROOT(manual)' WHEN types LIKE '%intra%' THEN 'INTRA' ELSE 'WRITE_BACK' END AS role,
    d.id IS NOT NULL AS active, l.level >= {_FAR} AS in_cycle, formula
  FROM levels l LEFT JOIN roots r ON r.id = l.id LEFT JOIN types t ON t.id = l.id LEFT JOIN dirty d ON d.id = l.id LEFT JOIN known k ON k.id = l.id
  WHERE r.id IS NOT NULL OR types IS NOT NULL)
SELECT {_STEP}, * FROM steps""",
    "field_names": f"""WITH {BASE} SELECT CAST(ok AS STRING) AS id, {_camel('ok')} AS field, {_name('ok')} AS column_name, {_APP} || '_obj' || k AS table_name, 'Obj' || k AS object_name, 'Obj' || k || '.' || {_name('ok')} AS key FROM base""",
    "formula_fields": f"""WITH {BASE}, {_SEQ} SELECT CAST(ok AS STRING) AS id, in_order, array_to_string(list_sort(string_split(in_order, ',')), ',') AS sorted FROM seqs""",
    "formula_words": f"""WITH {BASE} SELECT CAST(ok AS STRING) AS id, CASE r % 4 WHEN 1 THEN 'case,when,abs,t,' || {_name('p1')} || ',0,then,fld_7,else,null,end' ELSE {_name('p1')} || ',' || {_camel('p2')} END AS words,
  CASE r % 4 WHEN 1 THEN 1 ELSE 0 END AS has_word FROM base WHERE r % 4 IN (1, 2)""",
    "referred_entities": f"""WITH {BASE} SELECT CAST(ok AS STRING) AS id, CASE WHEN ok % 6 = 0 THEN 'Obj' || (k - 1) || ',Other' END AS entities, CASE WHEN ok % 6 = 0 THEN 'Obj' || (k - 1) END AS first FROM base""",
    "spelt_names": f"""WITH {BASE} SELECT CAST(ok AS STRING) AS id, CASE WHEN ok % 5 = 0 THEN {_camel('ok')} ELSE {_name('ok')} END AS shown, 'F' || substr({_name('ok')}, 2) AS capital FROM base""",
    "hooked_formula": "SELECT l_orderkey, l_linenumber, round(l_quantity * 3 + coalesce(l_tax, 0) * 2, 4) AS shifted FROM lineitem",
    "formula_columns": f"""WITH {BASE}, {_FIELDS} SELECT 'Obj' || k || '.' || {_camel('ok')} AS node, {_COMPILED} AS formula,
  CASE WHEN {_HAS_BACK} THEN 'sum(' || {_name('s')} || ')' END AS rule_expression
FROM base JOIN fields f ON f.id = CAST(ok AS STRING) WHERE {_HAS_BACK} OR {_TRIGGER}""",
    "write_back_rules": f"""WITH {BASE} SELECT CAST(ok AS STRING) AS id, 'Obj' || (k - 1) AS source, 'sum(' || {_name('s')} || ')' AS expression,
  CASE WHEN k % 8 = 5 THEN NULL ELSE 'srcItemObjectType=''Obj' || (k - 2) || '''' END AS condition FROM base WHERE {_HAS_BACK}""",
    "field_kinds": f"""WITH {BASE} SELECT CAST(ok AS STRING) AS id, CAST({_HAS_BACK} AS INTEGER) AS write_back, CAST({_TRIGGER} AS INTEGER) AS trigger, CAST({_VIRTUAL} AS INTEGER) AS virtual,
  CAST({_AMOUNT} AS INTEGER) AS amount, CAST({_QUANTITY} AS INTEGER) AS quantity FROM base""",
    "mapping_rewrite": """SELECT event_id, '${head}.currencyId' AS "currencyId", json_extract_string(props, '$.k') AS kept, '${head}.exchangeId' AS "exchangeId" FROM events""",
    "mapping_direction": """WITH t AS (SELECT event_id, json_extract_string(props, '$.k') AS n FROM events)
SELECT event_id, '${ret}.originDeclaredAmount' AS memo, n, '${ret}.midCurrencyId' AS "currencyId",
  CASE WHEN CAST(n AS INTEGER) % 2 = 0 THEN 'null' ELSE '$null' END AS "billCreditDeclaredAmount",
  CASE WHEN CAST(n AS INTEGER) % 2 = 0 THEN '${ret}.declaredAmount' ELSE 'null' END AS "creditDeclaredAmount" FROM t""",
    "catalog_scan": f"WITH {BASE}, {_FIELDS}, {_OBJECTS} SELECT f.id, f.object_type, o.app_name, f.title FROM fields f LEFT JOIN objects_c o ON o.name = f.object_type",
    "view_definitions": f"""WITH {BASE}, metadata_c AS ({METADATA}) SELECT name AS view_name, json_extract_string(content, '$.viewDef[0].objectName') AS object_name, json_extract_string(content, '$.viewDef[0].sql') AS sql
FROM metadata_c WHERE NOT is_deleted""",
    "view_lineage": f"""WITH {BASE}, {_VIEW_ROWS} SELECT 'Obj' || k || 'View' AS view_name, output, 'app_obj' || o AS table_name, column_name FROM ({_SHOWN}) AS all_shown""",
    "view_sql_dependencies": f"""WITH {BASE}, {_VIEW_ROWS}, used AS (SELECT k, o, column_name FROM ({_SHOWN}) AS all_shown UNION SELECT k, k, 'is_deleted' FROM shown UNION SELECT k, k + 1, 'parent_id' FROM shown)
SELECT 'Obj' || k || 'View' AS view_name, 'app_obj' || o AS table_name, count(*) AS columns FROM used GROUP BY k, o""",
    "view_stats": f"WITH {BASE}, {_VIEW_ROWS}, v AS ({_VIEW}) SELECT src, count(*) AS targets, string_agg(dst, ',' ORDER BY dst) AS view_fields FROM v GROUP BY src",
    "object_details": f"WITH {BASE} SELECT DISTINCT 'Obj' || k AS name, CASE WHEN k % 5 > 0 THEN 'Object ' || k ELSE 'Obj' || k END AS title FROM base WHERE k % 10 <> 9",
    "fields_by_app": f"WITH {BASE} SELECT {_APP} AS app_name, count(*) AS fields FROM base WHERE k % 4 IN (1, 2) GROUP BY 1",
    "compare_catalog": f"WITH {BASE} SELECT 'Obj' || k AS object_type, {_APP} AS app_name, count(*) AS fields FROM base WHERE k % 4 IN (0, 2) AND k % 10 <> 9 GROUP BY k",
    "field_search": f"""WITH {BASE} SELECT 'Obj' || k AS object_type, {_camel('ok')} AS field, CAST({_HAS_BACK} AS INTEGER) AS has_write_back, CAST({_TRIGGER} AS INTEGER) AS has_trigger, CAST({_VIRTUAL} AS INTEGER) AS is_virtual
FROM base WHERE ok % 7 = 1 AND contains(CAST(ok AS STRING), '12') ORDER BY object_type, field, CAST(ok AS STRING) LIMIT 200""",
    "object_search": f"""WITH {BASE}, o AS (SELECT DISTINCT 'Obj' || k AS name, CASE WHEN k % 5 > 0 THEN 'Object ' || k ELSE 'Obj' || k END AS title FROM base WHERE k % 10 <> 9)
SELECT name, title FROM o WHERE contains(lower(name), 'ject 1') OR contains(lower(title), 'ject 1') ORDER BY name LIMIT 100""",
    "fields_per_object": "SELECT 'Obj' || o_custkey AS object_type, count(*) AS fields FROM orders GROUP BY o_custkey",
    "write_back_targets": f"WITH {BASE} SELECT 'Obj' || (k - 1) AS source_object, 'Obj' || k AS target_object, count(*) AS fields FROM base WHERE {_HAS_BACK} GROUP BY k",
    "write_back_sources": f"WITH {BASE} SELECT 'Obj' || k AS target_object, 'Obj' || (k - 1) AS source_object, count(*) AS fields FROM base WHERE {_HAS_BACK} GROUP BY k",
    "incoming_references": f"""WITH {BASE}, refs AS (
  SELECT k, CASE ok % 5 WHEN 0 THEN {_camel('ok')} WHEN 1 THEN '' ELSE {_name('ok')} END AS f FROM base WHERE ok % 6 = 0),
both_refs AS (SELECT k, f, 'Obj' || (k - 1) AS entity FROM refs UNION ALL SELECT k, f, 'Other' FROM refs)
SELECT entity, 'Obj' || k AS object_type, {_APP} AS app_name, CASE WHEN k % 5 > 0 THEN 'Object ' || k END AS object_title, string_agg(f, ',' ORDER BY f) AS fields FROM both_refs GROUP BY entity, k""",
    "category_counts": f"""WITH {BASE} SELECT 'Obj' || k AS object_type, count(*) FILTER (WHERE {_HAS_BACK}) AS write_back, count(*) FILTER (WHERE r % 4 IN (1, 2)) AS trigger,
  count(*) FILTER (WHERE r % 4 = 3 AND ok % 2 = 0) AS expression, count(*) FILTER (WHERE {_VIRTUAL}) AS virtual, count(*) FILTER (WHERE r % 4 = 0 AND NOT {_HAS_BACK}) AS plain FROM base GROUP BY k""",
    "object_health": f"""WITH {BASE}, {_PAIRS}, used AS (SELECT DISTINCT a FROM direct), t AS (SELECT b.*, u.a IS NOT NULL AS is_used, {_HAS_BACK} AS back, {_TRIGGER} OR {_VIRTUAL} OR {_HAS_BACK} AS formula FROM base b LEFT JOIN used u ON u.a = b.ok)
SELECT 'Obj' || k AS object_type, count(*) AS total, count(*) FILTER (WHERE formula) AS with_formula, count(*) FILTER (WHERE is_used) AS referenced, count(*) FILTER (WHERE NOT formula AND NOT is_used) AS dead,
  count(*) FILTER (WHERE back) AS write_back, count(*) FILTER (WHERE back AND NOT is_used) AS write_back_unreferenced, {_list(_camel('ok'), 'NOT formula AND NOT is_used')} AS dead_fields FROM t GROUP BY k""",
    "object_profile": f"""WITH {BASE}, t AS (SELECT *, {_camel('ok')} AS f, {_HAS_BACK} AS back, {_VIRTUAL} AS virt, {_TRIGGER} AS trig, {_AMOUNT} AS amt, {_QUANTITY} AS qty FROM base),
profile AS (
  SELECT k, {_list('f', 'back')} AS write_back, {_list('f', 'virt')} AS virtual, {_list('f', 'trig')} AS trigger, {_list('f', 'NOT back AND NOT virt AND NOT trig AND NOT amt AND NOT qty')} AS base,
    {_list('f', 'NOT back AND NOT virt AND amt')} AS amount, {_list('f', 'NOT back AND NOT virt AND qty AND NOT amt')} AS quantity,
    CAST(max(CASE WHEN back THEN 1 ELSE 0 END) AS BIGINT) AS sources FROM t GROUP BY k)
SELECT 'Obj' || p.k AS object_type, CASE WHEN p.k % 5 > 0 THEN 'Object ' || p.k END AS title, p.write_back, p.virtual, p.trigger, p.base, p.amount, p.quantity, p.sources, coalesce(n.sources, 0) AS targets
FROM profile p LEFT JOIN profile n ON n.k = p.k + 1""",
    "pattern_check": f"""WITH {BASE}, t AS (SELECT *, {_camel('ok')} AS f, {_HAS_BACK} AS back, {_TRIGGER} AS trig, {_AMOUNT} AS amt, {_QUANTITY} AS qty FROM base)
SELECT 'Obj' || k AS object_type, 'amount' AS kind, n AS name, CAST(max(CASE WHEN n = 'amount' AND ok % 13 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS present
  FROM t CROSS JOIN (SELECT unnest(['originAmount', 'amount', 'amountWithoutTax', 'originAmountWithoutTax']) AS n) AS a GROUP BY k, n
UNION ALL SELECT 'Obj' || k, 'quantity', n, CAST(max(CASE WHEN n = 'baseQty' AND ok % 13 = 1 THEN 1 ELSE 0 END) AS INTEGER)
  FROM t CROSS JOIN (SELECT unnest(['quantity', 'transAuxQty', 'baseQty', 'auxQty']) AS n) AS q GROUP BY k, n
UNION ALL SELECT 'Obj' || k, 'coverage', f, CAST(back AS INTEGER) FROM t WHERE (amt OR qty) AND (back OR NOT trig)""",
    "change_scope": f"""WITH {BASE}, {_PAIRS}, asked AS (SELECT k, ok, {_camel('ok')} AS f, {_HAS_BACK} AS back FROM base WHERE r = 0)
SELECT 'Obj' || k AS target_object, f AS requested, CASE WHEN back THEN 'ADD_WRITE_BACK_SOURCE' ELSE 'ADD_WRITE_BACK_DEFINITION' END AS action, 'Obj' || k || '.' || f AS affected FROM asked
UNION SELECT 'Obj' || a.k, a.f, 'CHECK_TRIGGER', {_node('d.k', 'd.b')} FROM asked a JOIN direct d ON d.a = a.ok
UNION SELECT 'Obj' || a.k, a.f, 'CHECK_TRIGGER', {_node('b.k', 'b.ok')} FROM asked a JOIN backs b ON b.k = a.k + 1
  WHERE contains(lower({_camel('b.ok')}), replace(replace(lower(a.f), 'amount', ''), 'qty', ''))""",
    "trigger_summary": f"""WITH {BASE}, {_PAIRS}, used AS (SELECT a, b FROM direct UNION SELECT a, b FROM same_run)
SELECT 'Obj' || b.k AS object_type, 'Obj' || (b.k - 1) AS source_object, {_camel('b.ok')} AS field, coalesce(string_agg({_camel('u.b')}, ', ' ORDER BY {_camel('u.b')}) FILTER (WHERE u.b IS NOT NULL), '') AS triggers
FROM backs b LEFT JOIN used u ON u.a = b.ok GROUP BY b.k, b.ok""",
    "health_pages": f"WITH {BASE}, {_PAIRS}, " + """t AS (SELECT b.*, b.ok IN (SELECT a FROM direct) AS is_used FROM base b)
""" + _pages(f"""SELECT 'Obj' || k AS object_type, 'dead_fields' AS list, {_camel('ok')} AS item FROM t WHERE r % 4 = 0 AND NOT {_HAS_BACK} AND NOT is_used
  UNION ALL SELECT 'Obj' || k, 'write_back_unreferenced_fields', {_camel('ok')} FROM t WHERE {_HAS_BACK} AND NOT is_used""", "object_type, list", 3),
    "profile_pages": f"WITH {BASE}, t AS (SELECT 'Obj' || k AS object_type, {_camel('ok')} AS item, {_HAS_BACK} AS back, {_VIRTUAL} AS virt, {_TRIGGER} AS trig, {_AMOUNT} AS amt, {_QUANTITY} AS qty FROM base) " + _pages(
        " UNION ALL ".join(f"SELECT object_type, '{name}' AS list, item FROM t WHERE {condition}" for name, condition in {
            "write_back": "back", "virtual": "virt", "trigger": "trig", "base": "NOT back AND NOT virt AND NOT trig AND NOT amt AND NOT qty", "amount": "NOT back AND NOT virt AND amt", "quantity": "NOT back AND NOT virt AND qty AND NOT amt",
        }.items()), "object_type, list", 3),
    "reference_pages": f"WITH {BASE} " + _pages(f"""SELECT e.entity, 'Obj' || k AS object_type, {_APP} AS app_name, CASE ok % 5 WHEN 0 THEN {_camel('ok')} WHEN 1 THEN '' ELSE {_name('ok')} END AS item
  FROM base, unnest(['Obj' || (k - 1), 'Other']) AS e(entity) WHERE ok % 6 = 0""", "entity, object_type, app_name", 2),
    "view_field_pages": f"WITH {BASE}, {_VIEW_ROWS} " + _pages(f"SELECT DISTINCT src, dst AS item FROM ({_VIEW}) AS v", "src", 2),
    "trigger_pages": f"WITH {BASE}, {_PAIRS} " + _pages(f"""SELECT 'Obj' || b.k AS object_type, 'Obj' || (b.k - 1) AS source_object, {_camel('b.ok')} AS field, {_camel('u.b')} AS item
  FROM backs b JOIN (SELECT a, b FROM direct UNION SELECT a, b FROM same_run) AS u ON u.a = b.ok""", "object_type, source_object, field", 2),
    "ordered_targets": f"WITH {BASE} SELECT row_number() OVER (ORDER BY fields DESC, source_object, target_object) AS place, * FROM (SELECT 'Obj' || (k - 1) AS source_object, 'Obj' || k AS target_object, count(*) AS fields FROM base WHERE {_HAS_BACK} GROUP BY k) AS t",
    "ordered_sources": f"WITH {BASE} SELECT row_number() OVER (ORDER BY fields DESC, target_object, source_object) AS place, * FROM (SELECT 'Obj' || k AS target_object, 'Obj' || (k - 1) AS source_object, count(*) AS fields FROM base WHERE {_HAS_BACK} GROUP BY k) AS t",
    "ordered_references": f"""WITH {BASE} SELECT row_number() OVER (ORDER BY entity, lower(app_name), lower(object_type)) AS place, * FROM (
  SELECT DISTINCT e.entity, 'Obj' || k AS object_type, {_APP} AS app_name FROM base, unnest(['Obj' || (k - 1), 'Other']) AS e(entity) WHERE ok % 6 = 0) AS t""",
    "ordered_steps": f"""WITH RECURSIVE {_EDGES}, {_roots(0)}, {_walk('edges', _FAR)}, {_TYPES}, steps AS (
  SELECT level AS depth, split_part(w.id, '.', 1) AS object, split_part(w.id, '.', 2) AS field, contains(types, 'intra') AS intra FROM walk w JOIN types t ON t.id = w.id WHERE level > 0)
SELECT row_number() OVER (ORDER BY depth, NOT intra, object, field) AS place, depth, object, field FROM steps""",
    "lineage_edges": f"WITH {_EDGES} SELECT src, dst, rel FROM edges",
    "upstream_edges": f"WITH {_EDGES} SELECT src, dst, rel FROM up_edges",
    "impact_nodes": f"""WITH RECURSIVE {_EDGES}, {_roots(0)}, {_walk('edges', 3)}, known AS (SELECT {_node('k', 'ok')} AS id, CASE WHEN ok % 9 > 0 THEN 'Title ' || ok END AS title FROM base)
SELECT w.id, w.level, split_part(w.id, '.', 1) AS object, split_part(w.id, '.', 2) AS field, title FROM walk w LEFT JOIN known k ON k.id = w.id""",
    "impact_edges": f"""WITH RECURSIVE {_EDGES}, {_roots(0)}, some_edges AS (SELECT * FROM edges WHERE rel <> 'view'), {_walk('some_edges', 3)}
SELECT e.src, e.dst, e.rel FROM some_edges e JOIN walk w ON w.id = e.src WHERE w.level < 3""",
    "trace_nodes": f"WITH RECURSIVE {_EDGES}, {_roots(2)}, {_walk('up_edges', 5, True)} SELECT id, level FROM walk",
    "closed_graph": f"""WITH RECURSIVE {_EDGES}, {_roots(2)}, down_edges AS (SELECT * FROM edges WHERE rel <> 'view'), {_walk('down_edges', 2)},
sources AS (SELECT * FROM up_edges WHERE rel <> 'view'), {_walk('sources', _FAR, True, 'back', 'walk')}
SELECT e.src, e.dst, e.rel FROM down_edges e JOIN walk w ON w.id = e.src WHERE w.level < 2
UNION SELECT e.src, e.dst, e.rel FROM sources e JOIN back b ON b.id = e.dst""",
    "explain_paths": f"""WITH RECURSIVE {_EDGES}, {_FIELDS}, {_roots(0)}, {_paths('edges', 4)}
SELECT root, id, split_part(id, '.', 1) AS object, split_part(id, '.', 2) AS field, level AS path_len, path, reasons, id || ' is affected by ' || root || ', path length ' || level AS summary FROM paths WHERE level > 0""",
    "object_graph": f"""WITH RECURSIVE {_EDGES}, {_roots(2)}, {_walk('up_edges', 3, True)}
SELECT split_part(e.src, '.', 1) AS src_object, e.rel, split_part(e.dst, '.', 1) AS dst_object, count(*) AS edges FROM up_edges e JOIN walk w ON w.id = e.dst WHERE w.level < 3 GROUP BY 1, 2, 3""",
    "global_graph": f"WITH {_EDGES}, starts AS (SELECT {_node('k', 'ok')} AS id FROM base WHERE k % 4 IN (0, 2)) SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM starts)",
    "graph_stats": f"""WITH {_EDGES}, pairs AS (SELECT DISTINCT src, dst FROM edges), {_ENDS}
SELECT (SELECT count(DISTINCT src) FROM pairs) AS sources, (SELECT count(*) FROM pairs) AS edges, (SELECT count(*) FROM ends) AS nodes, (SELECT count(*) FROM ends WHERE id NOT IN (SELECT dst FROM pairs)) AS roots""",
    "lineage_cycles": f"""WITH RECURSIVE {_EDGES},
extra AS (
  SELECT {_node('e.k', 'e.ok')} AS src, {_node('s.k', 's.ok')} AS dst FROM base e JOIN base s ON s.k = e.k - 3 AND s.r = 4 WHERE e.k % 16 = 3 AND e.r = 7),
all_edges AS (SELECT src, dst FROM edges UNION SELECT src, dst FROM extra),
fwd(c, id) AS (SELECT dst, dst FROM extra UNION SELECT f.c, e.dst FROM fwd f JOIN all_edges e ON e.src = f.id),
bwd(c, id) AS (SELECT dst, src FROM extra UNION SELECT b.c, e.src FROM bwd b JOIN all_edges e ON e.dst = b.id),
members AS (SELECT f.c, f.id FROM fwd f JOIN bwd b ON b.c = f.c AND b.id = f.id)
SELECT m.id AS id, n.component AS component FROM members m JOIN (SELECT c, min(id) AS component FROM members GROUP BY c) AS n ON n.c = m.c""",
    "topological_order": f"""WITH RECURSIVE {_EDGES}, {_ENDS}, firsts AS (SELECT id FROM ends WHERE id NOT IN (SELECT dst FROM edges)), {_longest('edges', 'firsts')}
SELECT id, depth AS level, 0 AS in_cycle FROM longest""",
    "deep_chains": f"""WITH RECURSIVE {_EDGES}, {_ENDS}, firsts AS (SELECT id FROM ends WHERE id NOT IN (SELECT dst FROM edges)),
chain(root, id, level) AS (SELECT id, id, 0 FROM firsts UNION SELECT c.root, e.dst, c.level + 1 FROM chain c JOIN edges e ON e.src = c.id WHERE c.level < {_FAR})
SELECT root, CAST(max(level) AS INTEGER) AS length FROM chain GROUP BY root HAVING max(level) >= 10""",
    "longest_depths": f"WITH RECURSIVE {_EDGES}, {_roots(0)}, {_longest('edges', 'roots')} SELECT id, depth FROM longest",
    "fix_steps": f"""WITH RECURSIVE {_EDGES}, {_roots(0)}, {_walk('edges', _FAR)}, {_TYPES}
SELECT split_part(w.id, '.', 1) AS object, split_part(w.id, '.', 2) AS field, level AS depth, types FROM walk w JOIN types t ON t.id = w.id WHERE level > 0""",
    "dirty_fields": f"WITH RECURSIVE {_EDGES}, {_roots(2)}, sources AS (SELECT * FROM up_edges WHERE rel <> 'view'), {_walk('sources', _FAR)} SELECT id FROM walk",
    "impact_report": f"""WITH RECURSIVE {_EDGES}, {_FIELDS}, {_roots(0)}, {_walk('edges', 2)},
some_edges AS (SELECT e.src, e.dst, e.rel FROM edges e JOIN walk w ON w.id = e.src WHERE w.level < 2 AND e.rel <> 'view'),
nodes AS (SELECT src AS id FROM some_edges UNION SELECT dst FROM some_edges UNION SELECT id FROM roots), {_paths('some_edges', 2).replace('walk_all', 'ways')},
near AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY level, root) AS place FROM paths WHERE level > 0),
labels AS (SELECT dst AS id, string_agg(DISTINCT rel, ', ' ORDER BY rel) AS types FROM some_edges GROUP BY dst),
known AS (SELECT {_node('k', 'ok')} AS id, f.title, f.trigger_expr, f.expression, f.virtual_expr FROM base JOIN fields f ON f.id = CAST(ok AS STRING))
SELECT split_part(n.id, '.', 1) AS object, split_part(n.id, '.', 2) AS field, title, CASE WHEN r.id IS NOT NULL THEN 'root' WHEN a.id IS NOT NULL THEN 'affected' ELSE 'related' END AS role, coalesce(types, '') AS relations,
  coalesce(path, '') AS path, trigger_expr, expression, virtual_expr
FROM nodes n LEFT JOIN roots r ON r.id = n.id LEFT JOIN near a ON a.id = n.id AND a.place = 1 LEFT JOIN labels t ON t.id = n.id LEFT JOIN known k ON k.id = n.id""",
    "graph_ids": f"WITH {_EDGES} SELECT src, dst, rel FROM ({_INTRA}) AS i",
    "catalog_diff": f"""WITH {BASE}, {_FIELDS}, {_CHANGED}, a AS (SELECT *, object_type || '.' || name AS key FROM fields), b AS (SELECT *, object_type || '.' || name AS key FROM changed)
SELECT 'added' AS kind, object_type, name, CAST(NULL AS STRING) AS property, CAST(NULL AS STRING) AS old_value, CAST(NULL AS STRING) AS new_value FROM b WHERE key NOT IN (SELECT key FROM a)
UNION ALL SELECT 'removed', object_type, name, NULL, NULL, NULL FROM a WHERE key NOT IN (SELECT key FROM b)
UNION ALL SELECT 'modified', a.object_type, a.name, 'triggerExpr', a.trigger_expr, b.trigger_expr FROM a JOIN b ON a.key = b.key WHERE a.trigger_expr IS DISTINCT FROM b.trigger_expr
UNION ALL SELECT 'modified', a.object_type, a.name, 'title', a.title, b.title FROM a JOIN b ON a.key = b.key WHERE a.title IS DISTINCT FROM b.title""",
    "latest_definitions": f"""WITH {BASE}, {_FIELDS}, {_CHANGED}
SELECT f.id, CASE WHEN c.id IS NOT NULL THEN c.trigger_expr ELSE f.trigger_expr END AS trigger_expr, CASE WHEN c.id IS NOT NULL THEN c.title ELSE f.title END AS title, CASE WHEN c.id IS NOT NULL THEN 1 ELSE 0 END AS from_latest
FROM fields f LEFT JOIN changed c ON c.id = f.id AND (CAST(c.id AS BIGINT) % 97 <> 1 OR c.api_name <> '')""",
    "trigger_fields": f"""WITH {BASE}, {_PAIRS}, used AS (SELECT k, a, b FROM direct UNION SELECT k, a, b FROM same_run)
SELECT {_node('k', 'a')} AS src, CAST(b AS STRING) AS id, {_name('b')} AS name FROM used""",
    "direct_upstream": f"WITH {BASE}, {_PAIRS} SELECT {_node('k', 'ok')} AS dst, CAST(1 AS BIGINT) AS sources FROM backs",
    "normalised_roots": f"WITH {BASE} SELECT 'Obj' || k AS object, {_name('ok')} AS field, {_node('k', 'ok')} AS id FROM base",
    "excluded_relations": f"""WITH RECURSIVE {_EDGES}, {_roots(0)}, {_walk('edges', 3)},
kept AS (SELECT e.src, e.dst FROM edges e JOIN walk w ON w.id = e.src WHERE w.level < 3 AND e.rel <> 'intra')
SELECT id, level FROM walk WHERE id IN (SELECT src FROM kept UNION SELECT dst FROM kept)""",
    "thread_chain": f"""WITH {BASE}, having_it AS (SELECT DISTINCT k FROM base WHERE lower({_camel('ok')}) = 'fld28')
SELECT 'Obj' || (b.k - 1) AS source_object, 'Obj' || b.k AS target_object, count(*) AS fields FROM base b JOIN having_it h ON h.k = b.k - 1 WHERE r % 4 = 0 AND b.k % 4 > 0 AND s IS NOT NULL GROUP BY b.k""",
    "why_no_relation": f"""WITH {BASE}, {_FIELDS}, t AS (SELECT *, object_type = 'Obj1' AS own, coalesce(contains(trigger_expr, 'fld_'), false) OR coalesce(contains(expression, 'fld_'), false) OR coalesce(contains(virtual_expr, 'fld_'), false) AS holds FROM fields)
SELECT 'formula_holds_text' AS "check", id FROM t WHERE own AND holds
UNION ALL SELECT 'write_back_holds_both', id FROM t WHERE contains(write_back_expr, 'Obj1') AND contains(write_back_expr, 'fld_')
UNION ALL SELECT 'same_name', id FROM t WHERE own AND (api_name = 'fld_' OR name = 'fld_')""",
    "metadata_graph": f"""WITH {BASE} SELECT 'Obj' || k AS src, {_node('k', 'ok')} AS dst, 'HAS_FIELD' AS rel, {_camel('ok')} AS field FROM base
UNION SELECT 'Obj' || k, 'Obj' || (k - 1), 'REFERS_TO', {_camel('ok')} FROM base WHERE ok % 6 = 0
UNION SELECT 'Obj' || k, 'Other', 'REFERS_TO', {_camel('ok')} FROM base WHERE ok % 6 = 0""",
    "reference_paths": f"""WITH RECURSIVE {BASE}, refers AS (SELECT DISTINCT 'Obj' || k AS a, 'Obj' || (k - 1) AS b FROM base WHERE ok % 6 = 0 UNION SELECT DISTINCT 'Obj' || k, 'Other' FROM base WHERE ok % 6 = 0),
walk(start, id, hops) AS (
  SELECT DISTINCT 'Obj' || k, 'Obj' || k, 0 FROM base WHERE k % 10 <> 9
  UNION SELECT w.start, r.b, w.hops + 1 FROM walk w JOIN refers r ON r.a = w.id WHERE w.hops < 3)
SELECT start, id AS target, CAST(min(hops) AS INTEGER) AS hops FROM walk WHERE id <> start GROUP BY start, id""",
    "write_back_candidates": f"WITH {BASE} SELECT CAST(ok AS STRING) AS id, 'Obj' || k AS object_type, {_APP} AS app_name FROM base WHERE {_HAS_BACK}",
    "app_of_object": "SELECT 'finance' AS app_name",
    "snapshot_rows": f"""WITH {BASE}, {_FIELDS}, {_CHANGED} SELECT 'snapshot_20240101_000100.json' AS snapshot_id, id, name, app_name
FROM changed JOIN (SELECT CAST(ok AS STRING) AS id, {_APP} AS app_name FROM base) AS a USING (id)""",
    "verify_mappings": "SELECT event_id AS id, event_type AS verify_system_id, props AS mappings FROM events WHERE event_type IN ('signup', 'error')",
    "field_information": f"""WITH {BASE} SELECT CAST(ok AS STRING) AS id, 'Obj1' AS object_type, {_APP} AS app_name, {_name('ok')} AS name FROM base WHERE k = 1 ORDER BY {_camel('ok')} LIMIT 1""",
    "object_fields": f"""WITH {BASE} SELECT CAST(ok AS STRING) AS id, {_camel('ok')} AS field, CASE WHEN ok % 9 > 0 THEN 'Title ' || ok END AS title, {_APP} AS app_name FROM base WHERE k = 1""",
    "exact_apps": f"WITH {BASE} SELECT CAST(ok AS STRING) AS id, {_APP} AS app_name FROM base WHERE k % 4 IN (0, 2) AND k % 10 <> 9",
    "formula_references": f"""WITH {BASE}, {_SEQ}, used AS (SELECT ok, unnest(string_split(in_order, ',')) AS field FROM seqs WHERE in_order <> ''),
spelt AS (
  SELECT ok, {_name('p1')} AS n FROM base WHERE r % 4 IN (1, 2) OR (r % 4 = 3 AND ok % 2 = 1) UNION SELECT ok, {_name('p2')} FROM base WHERE r % 4 = 3 AND ok % 2 = 0
  UNION SELECT ok, {_name('p3')} FROM base WHERE r % 4 = 3 AND ok % 2 = 0 UNION SELECT ok, field FROM used)
SELECT CAST(b.ok AS STRING) AS id, coalesce(string_agg(n, ',' ORDER BY n), '') AS names FROM base b LEFT JOIN spelt s ON s.ok = b.ok GROUP BY b.ok""",
    "object_edges": f"WITH {_EDGES} SELECT src, dst, rel FROM up_edges WHERE rel = 'writeBack' AND src LIKE 'Obj1.%' AND dst LIKE 'Obj2.%'",
    "cross_objects": f"""WITH RECURSIVE {_EDGES}, {_roots(2)}, {_walk('up_edges', 3, True)}, between_ AS (
  SELECT split_part(e.src, '.', 1) AS src_object, e.rel, split_part(e.dst, '.', 1) AS dst_object, count(*) AS edges FROM up_edges e JOIN walk w ON w.id = e.dst WHERE w.level < 3 GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (ORDER BY edges DESC, src_object, rel, dst_object) AS row FROM between_ WHERE src_object <> dst_object""",
    "object_nodes": f"WITH RECURSIVE {_EDGES}, {_roots(2)}, {_walk('up_edges', 3, True)} SELECT split_part(id, '.', 1) AS object, count(*) AS fields FROM walk GROUP BY 1",
    "closed_nodes": f"""WITH RECURSIVE {_EDGES}, {_roots(2)}, down_edges AS (SELECT * FROM edges WHERE rel <> 'view'), {_walk('down_edges', 2)},
sources AS (SELECT * FROM up_edges WHERE rel <> 'view'), {_walk('sources', _FAR, True, 'back', 'walk')} SELECT b.id AS id, w.level AS level FROM back b LEFT JOIN walk w ON w.id = b.id""",
    "catalog_probe": f"""WITH RECURSIVE {_EDGES}, roots AS (SELECT {_node('k', 'ok')} AS id FROM base WHERE k = 1 ORDER BY {_camel('ok')} LIMIT 1), {_walk('edges', 2)}
SELECT (SELECT count(*) FROM base) AS fields, (SELECT count(DISTINCT k) FROM base) AS objects, (SELECT count(*) FROM base WHERE k = 1) AS object_fields, CAST(1 AS INTEGER) AS found,
  (SELECT count(*) FROM walk) AS nodes, (SELECT count(*) FROM edges e JOIN walk w ON w.id = e.src WHERE w.level < 2) AS edges""",
    "matching_objects": f"""WITH {BASE}, {_OBJECTS}, named AS (SELECT name, min(title) AS title FROM objects_c GROUP BY name),
scored AS (
  SELECT name, title, CASE WHEN lower(title) = 'object 11' THEN CAST(1.0 AS DOUBLE)
    WHEN contains(lower(title), 'object 11') OR contains('object 11', lower(title)) OR contains(lower(name), 'object 11') OR contains('object 11', lower(name)) THEN 0.8 END AS score FROM named)
SELECT name, title, CAST(score AS DOUBLE) AS score FROM scored WHERE score IS NOT NULL ORDER BY score DESC, name LIMIT 10""",
    "tenant_objects": f"WITH {BASE}, {_OBJECTS} SELECT name, app_name FROM objects_c WHERE app_name = 'sales'",
    "chains_by_length": f"""WITH RECURSIVE {_EDGES}, {_ENDS}, pairs AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges), lasts AS (SELECT id FROM ends WHERE id NOT IN (SELECT src FROM pairs)),
height_all(id, level) AS (SELECT id, 0 FROM lasts UNION SELECT p.src, h.level + 1 FROM height_all h JOIN pairs p ON p.dst = h.id WHERE h.level < {_FAR}),
heights AS MATERIALIZED (SELECT id, CAST(max(level) AS INTEGER) AS level FROM height_all GROUP BY id),
onward AS MATERIALIZED (SELECT p.src, min(p.dst) AS next FROM pairs p JOIN heights a ON a.id = p.src JOIN heights b ON b.id = p.dst AND b.level = a.level - 1 GROUP BY p.src),
chain(root, length, here, path, nodes) AS (
  SELECT id, level, id, id, 1 FROM heights WHERE level >= 10 AND id NOT IN (SELECT dst FROM pairs)
  UNION ALL SELECT c.root, c.length, o.next, c.path || ' -> ' || o.next, c.nodes + 1 FROM chain c JOIN onward o ON o.src = c.here)
SELECT row_number() OVER (ORDER BY length DESC, path) AS place, root, length, path, nodes FROM chain WHERE nodes = length + 1""",
}
