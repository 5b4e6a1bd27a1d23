"""Plans for computing derived columns anew, and their execution on the business tables.

A plan is a frame with a row for each step, in dependency order. It is small (a row for each field behind the roots), so running it reads it on the
driver; the tables themselves are only ever transformed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, rules, sums, texts
from ..functions.formulas import extract_sequence, formula_to_columns
from ..operators.edges import downstream_edges, overlay_definitions, rel_filter, upstream_edges
from ..operators.graph import closed_graph, dirty_set, incoming_types, longest_depth, normalise_roots, topological_order
from ..operators.loops import checkpoint, counted, numbered
from ..sources.catalog import Catalog, canonical

#: Steps that the driver turns into one chain of transformations.
MOST_STEPS = 2_000
PLAN_COLUMNS = ("step", "node", "object", "field", "level", "role", "active", "in_cycle", "status", "column", "formula", "rule")


def _named(rows: DataFrame) -> DataFrame:
    """rows with own_names and source_names: of the fields that a row's formula, and its rule's texts, hold, the catalog's names, as maps.

    Fields are looked up one by one, so a row's maps are as large as its texts, however many fields its object has. Rows: object_type, field, id, formula, rule.
    """
    named = rows.groupBy("object_type", "field").agg(F.min_by("name", "id").alias("name"))
    held = lambda of, object_type, *texts: F.transform(F.array_distinct(F.concat(*map(extract_sequence, texts))), lambda used: F.struct(F.lit(of).alias("of"), object_type.alias("object"), used.alias("used")))
    rule = F.col("rule")
    both = F.concat(held("own", F.col("object_type"), F.col("formula")), held("source", rule["srcObjectType"], rule["idField"], rule["expression"], rule["condition"]))
    used = rows.where("formula IS NOT NULL OR rule IS NOT NULL").select("object_type", "field", "id", F.explode(both).alias("u")).select("object_type", "field", "id", "u.*")
    known = named.select(F.col("object_type").alias("object"), F.col("field").alias("used"), F.coalesce("name", "field").alias("name"))
    of = lambda which: F.map_from_entries(F.collect_set(F.when(F.col("of") == which, F.struct("used", "name"))))
    maps = used.join(known, ["object", "used"]).groupBy("object_type", "field", "id").agg(of("own").alias("own_names"), of("source").alias("source_names"))
    return rows.join(maps, ["object_type", "field", "id"], "left")


def definitions(catalog: Catalog) -> DataFrame:
    """node, object, field, column, formula (over columns) and rule (struct, its texts over columns of its source) of each catalog field."""
    rule = rules.parse_write_back(F.col("write_back_expr"))
    formula = F.coalesce(names.blank_to_null(F.col("trigger_expr")), names.blank_to_null(F.col("expression")))
    flags = {"virtual": rules.has_text(F.col("virtual_expr")), "has_rule": rules.has_text(F.col("write_back_expr"))}
    rows = catalog.fields.withColumns({"field": canonical(), "rule": rule, "formula": formula} | flags)
    # Written, so that rules are parsed once and joins don't carry their texts.
    rows = checkpoint(rows.select("object_type", "field", "id", "name", "formula", "rule", *flags)).where("field IS NOT NULL")
    own = _named(rows)
    over = lambda text, map_: F.coalesce(formula_to_columns(text, map_), text)
    texts = lambda c: over(F.col(f"rule.{c}"), F.col("source_names"))
    compiled = F.when(F.col("rule").isNotNull(), F.struct(F.col("rule.srcObjectType").alias("source"), texts("idField").alias("key"), texts("expression").alias("expression"), texts("condition").alias("condition")))
    return own.select(
        names.node_id(F.col("object_type"), F.col("field")).alias("node"), F.col("object_type").alias("object"), "field", names.field_to_column(F.col("field"), F.col("name")).alias("column"),
        over(F.col("formula"), F.col("own_names")).alias("formula"), compiled.alias("rule"), F.lit(True).alias("known"), "virtual", "has_rule",
    )


def step_status() -> Column:
    """What a step can do: run, or why not."""
    return (
        F.when(F.col("known").isNull(), "unknown field").when(F.col("rule").isNotNull() | F.col("formula").isNotNull(), "run")
        .when(F.col("has_rule"), "unreadable rule").when(F.col("virtual"), "virtual, no column").otherwise("no formula")
    )


def enriched(catalog: Catalog, latest: DataFrame | None) -> Catalog:
    """The catalog with the latest definitions laid over its own."""
    if latest is None:
        return catalog
    return Catalog(overlay_definitions(catalog.fields, latest).drop("from_latest"), catalog.objects, catalog.metadata)


def recompute_plan(catalog: Catalog, roots: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Steps behind single roots (object, field): by longest depth, intra before write-back; the roots themselves are manual steps at depth 0."""
    catalog = enriched(catalog, latest)
    edges = checkpoint(downstream_edges(catalog))
    ids = checkpoint(normalise_roots(roots, catalog.fields).select("id").distinct())
    depths = longest_depth(edges, ids).withColumnRenamed("id", "node").withColumnRenamed("depth", "level")
    types = incoming_types(edges).withColumnRenamed("id", "node")
    found = depths.join(types, "node", "left").join(definitions(catalog), "node", "left")
    role = F.when(F.col("level") == 0, "ROOT(manual)").when(F.array_contains("types", "intra"), "INTRA").otherwise("WRITE_BACK")
    return _numbered(found.withColumns({"role": role, "active": F.lit(True), "in_cycle": F.lit(False)}))


def recompute_plan_batch(catalog: Catalog, roots: DataFrame, depth: int = 3, rels: tuple[str, ...] = ("intra", "writeBack"), latest: DataFrame | None = None) -> DataFrame:
    """Steps for several roots: their impact with everything upstream of it, in topological order.

    A step is active if one of its sources is computed anew. Nodes in or behind a cycle come last and are marked.
    """
    catalog = enriched(catalog, latest)
    down, up = checkpoint(downstream_edges(catalog)), checkpoint(upstream_edges(catalog))
    ids = checkpoint(normalise_roots(roots, catalog.fields).select("id").distinct())
    nodes, edges = closed_graph(down, up, ids, depth)
    nodes, edges = checkpoint(nodes.select("id").distinct()), checkpoint(edges)
    order = topological_order(nodes, edges).withColumnRenamed("id", "node")
    types = incoming_types(edges).withColumnRenamed("id", "node")
    dirty = dirty_set(rel_filter(up, None, rels), ids).select(F.col("id").alias("node"), F.lit(True).alias("dirty"))
    found = order.join(types, "node", "left").join(dirty, "node", "left").join(ids.select(F.col("id").alias("node"), F.lit(True).alias("root")), "node", "left").join(checkpoint(definitions(catalog)), "node", "left")
    found = found.where("root OR types IS NOT NULL")
    role = (
        F.when(F.col("root") & F.col("has_rule"), "ROOT(write-back)").when(F.col("root") & F.col("formula").isNotNull(), "ROOT(trigger)").when(F.col("root"), "ROOT(manual)")
        .when(F.array_contains("types", "intra"), "INTRA").otherwise("WRITE_BACK")
    )
    return _numbered(found.withColumns({"role": role, "active": F.coalesce("dirty", F.lit(False))}))


def _numbered(found: DataFrame) -> DataFrame:
    """step: the place by level, intra first, then node."""
    object_type, field = names.split_node_id(F.col("node"))
    rows, n = counted(found.withColumns({"object": object_type, "field": field, "rank": F.coalesce("level", F.lit(2**31 - 1)), "late": F.col("role") == "WRITE_BACK", "status": step_status()}))
    return numbered(rows, ("rank", "late", "node"), "step", n).select(*PLAN_COLUMNS)


# ---------------------------------------------------------------------------------------------------------------------
# Running rules on tables


def compile_formula(formula: str, schema: T.StructType, functions: Mapping[str, Callable[..., Column]] | None = None) -> Column:
    """A formula over columns as a Spark expression.

    Qualifiers go, as all columns are those of one row. Texts 't' and 'f' compared with boolean columns become true and false, a quotient of two integer columns is an integer one, and JSON array
    literals become arrays. A call of one of `functions` as the whole formula is passed on with its arguments.
    """
    formula = texts.unqualified(formula, schema.names)
    for name in (f.name for f in schema if isinstance(f.dataType, T.BooleanType)):
        formula = re.sub(rf"\b{name}\s*(=|<>|!=)\s*'([tf])'", lambda m, n=name: f"{n} {m[1]} {'true' if m[2] == 't' else 'false'}", formula)
    whole = "|".join(f.name for f in schema if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)))
    if whole:
        formula = re.sub(rf"\b({whole})\s*/\s*({whole})\b", r"(\1 div \2)", formula)
    formula = re.sub(r"'(\[[^']*\])'::JSONB", r"from_json('\1', 'array<string>')", formula, flags=re.I)
    call = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", formula, re.S)
    if call and functions and call[1] in functions:
        return functions[call[1]](*(F.expr(a) for a in texts.split_at(call[2], ",")))
    return F.expr(formula)


def _rolled(source: DataFrame, keys: Mapping[str, str], calls: Mapping[str, tuple[str, Column]], hits: Mapping[str, Column]) -> DataFrame:
    """A row for each key (new name: source's column) that has no null: each call (function, value) by name, and for each hit whether it holds for any row.

    Sums and averages of doubles are exact (see functions/sums.py): each row's numbers are added up by window first, in the same pass as all the rest, and the windows of a key are put together.
    """
    known = source.where(reduce(Column.__and__, (F.col(f"`{c}`").isNotNull() for c in keys.values())))
    inputs = known.select(*(F.col(f"`{c}`").alias(n) for n, c in keys.items()), *(v.alias(n) for n, (_, v) in calls.items()), *(h.alias(n) for n, h in hits.items()))
    kind = {n: inputs.schema[n].dataType for n in calls}
    for n, (function, _) in calls.items():
        if function in ("sum", "avg") and not isinstance(kind[n], T.NumericType):
            raise TypeError(f"{kind[n].simpleString()} can't be added up")
    doubles = [n for n, (function, _) in calls.items() if function in ("sum", "avg") and isinstance(kind[n], (T.DoubleType, T.FloatType))]
    plain = {n: getattr(F, function)(n) for n, (function, _) in calls.items() if n not in doubles} | {n: F.coalesce(F.bool_or(n), F.lit(False)) for n in hits}
    if not doubles:
        return inputs.groupBy(*keys).agg(*(c.alias(n) for n, c in plain.items()))
    which, number, window, units, special, n_rows, entry = texts.unused(inputs.columns, "which", "number", "window", "units", "special", "n_rows", "entry")
    one = lambda i, v: F.struct(F.lit(i).alias(which), v.cast("double").alias(number))
    entries = F.filter(F.array(one(-1, F.lit(0.0)), *(one(i, F.col(n)) for i, n in enumerate(doubles))), lambda e: e[number].isNotNull())
    rest = [n for n in inputs.columns if n not in keys and n not in doubles]
    spread = inputs.select(*keys, *rest, F.explode(entries).alias(entry)).select(*keys, f"{entry}.*", *(F.when(F.col(f"{entry}.{which}") == -1, F.col(n)).alias(n) for n in rest))
    spread = spread.withColumn(window, sums.window_of(F.col(number)))
    added = spread.groupBy(*keys, which, window).agg(
        *(c.alias(n) for n, c in plain.items()), F.sum(sums.units_of(F.col(number), F.col(window))).alias(units), F.sum(F.when(F.col(window).isNull(), F.col(number))).alias(special), F.count(F.lit(1)).alias(n_rows)
    )
    own = lambda i, c: F.when(F.col(which) == i, c)

    def total(i: int, function: str) -> Column:
        windows = F.collect_list(F.when((F.col(which) == i) & F.col(window).isNotNull(), F.struct(F.col(window).alias("window"), F.col(units).alias("units"))))
        other, n = F.sum(own(i, F.col(special))), F.sum(own(i, F.col(n_rows)))
        out = F.when(F.isnan(other) | (F.abs(other) == float("inf")), other).otherwise(sums.put_together(windows))
        return F.when(n > 0, out / n if function == "avg" else out)

    single = {n: F.first(own(-1, F.col(n)), ignorenulls=True) for n in plain}
    return added.groupBy(*keys).agg(*(c.alias(n) for n, c in single.items()), *(total(i, calls[n][0]).alias(n) for i, n in enumerate(doubles)))


def _call(function: str, argument: str, schema: T.StructType, holds: Column | None) -> tuple[str, Column]:
    value = F.lit(1) if argument == "*" else compile_formula(argument, schema)
    return function, value if holds is None else F.when(holds, value)


@dataclass(frozen=True)
class Subquery:
    """A correlated scalar subquery of a formula: what it tells, of which table, for which equal columns (own, the table's), under which further condition."""

    tells: str
    table: str
    keys: tuple[tuple[str, str], ...]
    condition: str | None


def read_subquery(text: str, columns: Sequence[str], columns_of: Callable[[str], Sequence[str]]) -> Subquery:
    """`select value from table [alias] where own.column = table.column [and condition]`. An unqualified side is the subquery's table's column if that has one of this name."""
    parts = re.fullmatch(r"\s*select\s(.*)", text, re.I | re.S)
    value, *rest = texts.split_at(parts[1], r"\bfrom\b")
    source, *where = texts.split_at(" ".join(rest), r"\bwhere\b")
    named = re.fullmatch(r"([\w.]+)(?:\s+(?:as\s+)?(\w+))?", source, re.I)
    if len(rest) != 1 or len(where) != 1 or not named or re.search(r"\(\s*select\b", text, re.I):
        raise ValueError(f"{text} isn't a value from one table for one row")
    table = named[1].split(".")[-1]
    inside = {n.lower() for n in (table, named[2]) if n}
    there, here = {c.lower() for c in columns_of(table)}, {c.lower() for c in columns}

    def side(path: str) -> tuple[bool, str]:
        *qualifier, column = path.split(".")
        return (qualifier[-1].lower() in inside if qualifier else column.lower() in there), column

    keys, conditions = [], []
    for part in texts.split_at(where[0], r"\band\b"):
        equal = re.fullmatch(r"([\w.]+)\s*=\s*([\w.]+)", part)
        sides = [side(equal[k]) for k in (1, 2)] if equal else []
        if len(sides) == 2 and sides[0][0] != sides[1][0]:
            own, theirs = sorted(sides)
            if own[1].lower() in here and theirs[1].lower() in there:
                keys.append((own[1], theirs[1]))
                continue
        conditions.append(part)
    outside = [m[0] for c in conditions for m in re.finditer(r"'(?:[^']|'')*'|\b[A-Za-z_]\w*\.\w+", c) if not m[0].startswith("'") and m[0].split(".")[0].lower() not in inside]
    if not keys or outside:
        raise ValueError(f"{text}: its table is met by equal columns only")
    return Subquery(value, table, tuple(keys), " and ".join(conditions) or None)


def join_subqueries(df: DataFrame, formulas: Mapping[str, str], tables: Callable[[str], DataFrame]) -> tuple[DataFrame, dict[str, str], list[str]]:
    """(df with columns for what the formulas' subqueries tell, the formulas over these, the columns added).

    Subqueries on one table with one key and condition share an aggregation and a join: aggregates are rolled up by the key, single values are looked up by it, and two different rows for a value that is asked for are an error, as in
    SQL. Expressions around aggregates are worked out after the join, so that rows without any match have the value of an empty group.
    """
    split = {c: texts.split_subqueries(f) for c, f in formulas.items()}
    read = {c: [read_subquery(q, df.columns, lambda t: tables(t).columns) for q in inner] for c, (_, inner) in split.items()}
    groups: dict[tuple, dict[str, tuple[str, str]]] = {}
    told: dict[Subquery, str] = {}
    taken = list(df.columns)
    for query in dict.fromkeys(q for qs in read.values() for q in qs):
        calls = groups.setdefault((query.table.lower(), query.keys, query.condition), {})
        outer, found = texts.split_aggregates(query.tells, taken)
        if not found:
            (name,) = texts.unused(taken, "looked_up")
            outer, found = name, {name: ("", query.tells)}
        for name, call in found.items():
            same = next((n for n, c in calls.items() if c == call), None)
            outer = re.sub(rf"\b{name}\b", same, outer) if same else outer
            if not same:
                calls[name] = call
                taken.append(name)
        told[query] = f"({outer})"
    added = taken[len(df.columns) :]
    for (table, keys, condition), calls in groups.items():
        source = tables(table)
        source = source.where(compile_formula(condition, source.schema)) if condition else source
        own = dict(zip(texts.unused(taken, *(f"key{i}" for i in range(len(keys)))), (theirs for _, theirs in keys), strict=True))
        (rows,) = texts.unused([*taken, *own], "rows")
        looked_up = [n for n, (function, _) in calls.items() if not function]
        wanted = {n: _call(function or "max", argument, source.schema, None) for n, (function, argument) in calls.items()}
        rolled = _rolled(source, own, wanted | {rows: ("count", F.lit(1))}, {})
        on = reduce(Column.__and__, (df[f"`{mine}`"] == F.col(k) for (mine, _), k in zip(keys, own, strict=True)))
        df = df.join(rolled, on, "left")
        single = F.when(F.col(rows) > 1, F.raise_error(F.lit(f"more than one row of {table} for a subquery")))
        none = [n for n, (function, _) in calls.items() if function == "count"]
        df = df.withColumns({n: single.otherwise(F.col(n)) for n in looked_up} | {n: F.coalesce(n, F.lit(0)) for n in none}).drop(*own, rows)
    out = {c: "".join(a + (told[q] if q else "") for a, q in zip(around, [*read[c], None], strict=True)) for c, (around, _) in split.items()}
    return df, out, added


def apply_trigger(df: DataFrame, column: str, formula: str, functions: Mapping[str, Callable[..., Column]] | None = None, tables: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """column = formula on every row; null results are written too."""
    return apply_triggers(df, {column: formula}, functions, tables)


def apply_triggers(df: DataFrame, formulas: Mapping[str, str], functions: Mapping[str, Callable[..., Column]] | None = None, tables: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Several at once; all of them read the old row. tables: the frame of a table's name, for formulas with subqueries."""
    added: list[str] = []
    if any(texts.split_subqueries(f)[1] for f in formulas.values()):
        if tables is None:
            raise ValueError("a formula reads another table, and no tables are given")
        df, formulas, added = join_subqueries(df, formulas, tables)
    return df.withColumns({c: compile_formula(f, df.schema, functions) for c, f in formulas.items()}).drop(*added)


def changed_only(df: DataFrame, column: str, formula: str) -> DataFrame:
    """The rows whose column a formula would change, nulls equal to nulls, with the new value."""
    return df.withColumn("new_value", compile_formula(formula, df.schema)).where(~F.col(column).eqNullSafe(F.col("new_value")))


@dataclass(frozen=True)
class WriteBack:
    column: str
    expression: str  # over sum(..), min(..), max(..), avg(..) and count(..) of the source's columns
    key: str  # the source's column with the target's id
    condition: str | None = None


def apply_write_backs(target: DataFrame, target_id: str, source: DataFrame, specs: Sequence[WriteBack]) -> DataFrame:
    """Each column becomes its expression over the source rows of its target that fulfil the condition; targets without any keep the old value, as it is.

    All specs have one key, so that one aggregation and one join serve them. Sums over nothing but nulls are 0. A target without the column has null there before; else the new value is cast to the column's own type.
    Sums and averages of doubles are exact up to the last rounding, whatever the order of rows; NaN and infinities add up as in arithmetic. Sums of decimals keep their scale, and those of over 38 digits are an error.
    """
    (key,) = {s.key for s in specs}
    calls: dict[str, tuple[str, Column]] = {}
    hits, outer, taken = {}, [], [*source.columns, *target.columns]
    for s in specs:
        holds = F.coalesce(compile_formula(s.condition, source.schema), F.lit(False)) if s.condition else F.lit(True)
        around, found = texts.split_aggregates(s.expression, [*taken, *calls, *hits])
        if not found:
            raise ValueError(f"{s.expression} holds no aggregate of {', '.join(texts.AGGREGATES)}")
        calls |= {n: _call(*call, source.schema, holds) for n, call in found.items()}
        (hit,) = texts.unused([*taken, *calls, *hits], "hit")
        hits[hit] = holds
        outer.append((s.column, around, hit))
    (id_,) = texts.unused([*taken, *calls, *hits], "id")
    rolled = _rolled(source, {id_: key}, calls, hits)
    rolled = rolled.withColumns({n: F.coalesce(n, F.lit(0).cast(rolled.schema[n].dataType)) for n, (function, _) in calls.items() if function == "sum"})
    new = dict(zip(texts.unused([*taken, *rolled.columns], *(f"new{i}" for i in range(len(outer)))), outer, strict=True))
    rolled = rolled.select(id_, *hits, *(compile_formula(around, rolled.schema).alias(n) for n, (_, around, _) in new.items()))
    joined = target.join(rolled, target[f"`{target_id}`"] == F.col(id_), "left")
    out = {}
    for n, (column, _, hit) in new.items():
        kind = target.schema[column].dataType if column in target.columns else rolled.schema[n].dataType
        old = F.col(f"`{column}`") if column in target.columns else F.lit(None).cast(kind)
        out[column] = F.when(F.coalesce(hit, F.lit(False)), F.col(n).cast(kind)).otherwise(old)
    return joined.withColumns(out).drop(id_, *hits, *new).select(*(F.col(f"`{c}`") for c in target.columns), *(c for c in out if c not in target.columns))


def fuse_updates(steps: Sequence[Mapping]) -> list[list[Mapping]]:
    """Consecutive steps on one table that can be one pass: all triggers or all write-backs of one source and key, none reading or writing a column that another one sets.

    The columns that a rule reads count only where its source is the table itself; those of another table aren't set here.
    """
    groups: list[list[Mapping]] = []
    for step in steps:
        group = groups[-1] if groups else None
        same = group and group[0]["object"].lower() == step["object"].lower() and (group[0]["rule"] is None) == (step["rule"] is None)
        if same and step["rule"] is not None:
            same = all(group[0]["rule"][k] == step["rule"][k] for k in ("source", "key"))
        if same:
            texts = [step["formula"]] if step["rule"] is None else [step["rule"][k] for k in ("key", "expression", "condition")]
            text = " ".join(filter(None, texts)).lower()
            earlier = [g["column"].lower() for g in group]
            own = step["rule"] is None or step["rule"]["source"].lower() == step["object"].lower()
            same = step["column"].lower() not in earlier and not (own and any(re.search(rf"\b{re.escape(c)}\b", text) for c in earlier))
        if same:
            group.append(step)
        else:
            groups.append([step])
    return groups


def object_of(table: str, objects: Iterable[str]) -> str:
    """The object whose table this is: its name in snake case, with or without an app's in front; of several such objects the one with the longest name."""
    snake = {re.sub(r"(?<!^)(?=[A-Z])", "_", o).lower(): o for o in objects}
    found = [s for s in snake if f"_{table.lower()}".endswith(f"_{s}")]
    if not found:
        raise ValueError(f"{table} is no object's table")
    return snake[max(found, key=len)]


def runnable_steps(plan: DataFrame, objects: Sequence[str]) -> DataFrame:
    """The active steps of a plan that can run on tables of these objects."""
    return plan.where("active AND NOT in_cycle AND status = 'run'").where(F.col("object").isin(list(objects)))


def apply_group(group: Sequence[Mapping], tables: Mapping[str, DataFrame], ids: Mapping[str, str], functions: Mapping[str, Callable[..., Column]] | None = None) -> DataFrame | None:
    """The table of a group of fused steps after them; None where their source has no table."""
    name, rule = group[0]["object"], group[0]["rule"]
    if rule is None:
        return apply_triggers(tables[name], {s["column"]: s["formula"] for s in group}, functions, lambda table: tables[object_of(table, tables)])
    if rule["source"] not in tables:
        return None
    specs = [WriteBack(s["column"], s["rule"]["expression"], s["rule"]["key"], s["rule"]["condition"]) for s in group]
    return apply_write_backs(tables[name], ids[name], tables[rule["source"]], specs)


def run_plan(plan: DataFrame, tables: Mapping[str, DataFrame], ids: Mapping[str, str], functions: Mapping[str, Callable[..., Column]] | None = None) -> dict[str, DataFrame]:
    """The tables (by object) after all active steps that can run, in plan order. ids: each object's key column. A step with a rule is a roll-up, else a trigger.

    Nothing is computed until a table is read. Steps on objects without a table are left out. A plan of more than MOST_STEPS such steps is an error: `stages.run_plan_in_stages` runs those.
    """
    out = dict(tables)
    steps = [r.asDict(recursive=True) for r in runnable_steps(plan, list(out)).orderBy("step").limit(MOST_STEPS + 1).collect()]
    if len(steps) > MOST_STEPS:
        raise ValueError(f"more than {MOST_STEPS} steps in one plan: run it in stages")
    for group in fuse_updates(steps):
        after = apply_group(group, dict(out), ids, functions)
        if after is not None:
            out[group[0]["object"]] = after
    return out


def parent_lookup(child: DataFrame, parent: DataFrame, key: str, parent_id: str, columns: Mapping[str, str]) -> DataFrame:
    """child with columns (new name: parent's column) looked up by key; null without a parent."""
    wanted = parent.groupBy(F.col(parent_id).alias(key)).agg(*(F.first(c).alias(n) for n, c in columns.items()))
    return child.drop(*columns).join(wanted, key, "left")
