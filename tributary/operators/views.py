"""Columns and tables in the SQL texts of views, as a job over their tokens.

Each text becomes one row for each of its tokens. Windows over a text's tokens, in order, then say how many brackets are open, which subselect a token
is in, which clause and which item it belongs to; joins give columns the tables that their qualifiers stand for. A text's tokens are in one partition, other
texts' in others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .loops import checkpoint

# Words of SQL that are no columns unless they are quoted or qualified.
RESERVED = (
    "select distinct all from as on using join inner left right full outer cross natural lateral where and or not in is null like ilike similar escape between exists any some "
    "case when then else end group order by having limit offset fetch union intersect except with asc desc nulls over partition rows range unbounded preceding following filter within "
    "interval true false current_date current_time current_timestamp"
).split()
# Words that begin a clause of a select.
CLAUSES = "select from join on using where group having order limit offset fetch union intersect except".split()
#: Clauses whose columns are dependencies, and those where a comma may be followed by a table.
DEPENDENT, TABLES = ("select", "on", "where"), ("from", "join", "on", "using")

_NAME = r"(?:[\p{L}_][\p{L}\p{N}_$]*+|\"(?:[^\"]++|\"\")*+\"|`[^`]*+`)"
_PATH = rf"{_NAME}(?:\s*+\.\s*+(?:{_NAME}|\*))*+"
#: Texts in quotes, comments, names with their qualifiers, numbers, signs.
TOKEN = rf"(?s)'(?:[^']++|'')*+'|--[^\n]*+|/\*.*?\*/|{_PATH}|\d[\w.]*+|::|<>|<=|>=|!=|\|\||\S"

#: The scope of what is in no subselect.
ROOT = -1


def _unquoted(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"^[\"`']|[\"`']$", "")


def _parts(path: Column) -> Column:
    """The names of a path, in order, without quotes."""
    return F.transform(F.regexp_extract_all(path, F.lit(rf"{_NAME}|\*"), F.lit(0)), _unquoted)


def view_texts(texts: DataFrame) -> DataFrame:
    """Each text (view_name, sql) once, with id, written."""
    return checkpoint(texts.where("sql IS NOT NULL").select("view_name", "sql").distinct().select(F.xxhash64("view_name", "sql").alias("id"), "view_name", "sql"))


def view_tokens(known: DataFrame) -> DataFrame:
    """A row for each token of each of view_texts, which a token doesn't carry along.

    id, pos, token, low (lower-cased), scope (the place of the bracket that begins the innermost subselect, ROOT outside), clause (of the scope),
    at_base (not in further brackets), item and root_clause (of the whole text), is_table, is_alias, is_column. Placeholders of system fields go; a text that doesn't begin with SELECT or WITH is read as the rest of a SELECT.
    """
    clean = F.trim(F.regexp_replace("sql", r"\$\{SystemFields\}\s*,?", " "))
    known = known.select("id", clean.alias("text"))
    whole = F.when(F.col("text").rlike(r"(?i)^(select|with)\b"), F.col("text")).otherwise(F.concat(F.lit("SELECT "), F.col("text")))
    found = F.filter(F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("--") & ~t.startswith("/*"))
    t = known.select("id", F.posexplode(found).alias("pos", "token")).withColumn("low", F.lower("token"))
    # What a token is by itself is found out below all windows, once.
    is_path = F.col("token").rlike(r"^[\p{L}_\"`]")
    t = t.withColumn("single", F.when(is_path, ~F.col("token").rlike(rf"^{_NAME}\s*\.")))  # null for what is no path
    t = t.withColumn("word", F.coalesce("single", F.lit(False)) & ~F.col("low").isin(RESERVED))
    t = t.withColumn("named", F.col("single").isNotNull() & (~F.col("single") | F.col("word")) & ~F.col("token").endswith("*"))
    ordered = Window.partitionBy("id").orderBy("pos")
    opens, closes = F.col("token") == "(", F.col("token") == ")"
    t = t.withColumns({"prev": F.lag("low").over(ordered), "next": F.lead("low").over(ordered), "open_after": F.sum(opens.cast("int") - closes.cast("int")).over(ordered)})
    # A bracket counts as inside itself here, so a pair of brackets follow each other among those of their depth.
    t = t.withColumn("inside", F.col("open_after") + closes.cast("int"))
    depth = F.when(opens, F.col("open_after") - 1).otherwise(F.col("open_after"))
    begins = opens & F.col("next").isin("select", "with")
    t = t.withColumns({"begins": begins, "bracket": F.when(opens | closes, F.col("inside")), "depth": depth})
    of_pair = F.lag("begins").over(Window.partitionBy("id", "bracket").orderBy("pos"))
    t = t.withColumn("ends", closes & F.coalesce(of_pair, F.lit(False)))
    t = t.withColumn("selects", F.sum(F.col("begins").cast("int") - F.col("ends").cast("int")).over(ordered))
    # Of the subselects that are so deep the last one before a token is the one around it.
    nested = Window.partitionBy("id", "selects").orderBy("pos")
    last = lambda value, on, window: F.last(F.when(on, value), ignorenulls=True).over(window)
    t = t.withColumns({"scope": F.coalesce(last(F.col("pos"), F.col("begins"), nested), F.lit(ROOT)), "base": F.coalesce(last(F.col("open_after"), F.col("begins"), nested), F.lit(0))})
    # A bracket that begins a subselect has the subselect's scope, one that ends it the scope around.
    t = t.withColumn("at_base", (F.col("depth") == F.col("base")) & ~F.col("begins"))
    in_scope = Window.partitionBy("id", "scope").orderBy("pos")
    t = t.withColumn("clause", last(F.col("low"), F.col("at_base") & F.col("low").isin(CLAUSES) & ~((F.col("low") == "from") & (F.coalesce("prev", F.lit("")) == "distinct")), in_scope))
    at_root = F.col("at_base") & (F.col("scope") == ROOT)
    comma = at_root & (F.col("token") == ",") & (F.col("clause") == "select")
    t = t.withColumns({"root_clause": last(F.col("clause"), at_root, ordered), "item": F.sum(F.coalesce(comma, F.lit(False)).cast("int")).over(ordered)})
    # What follows AS in brackets of a function is a type.
    group = Window.partitionBy("id", "inside").orderBy("pos")
    t = t.withColumn("group", last(F.col("pos"), opens, group))
    cast = F.max((F.col("low") == "as").cast("int")).over(Window.partitionBy("id", "inside", "group").orderBy("pos"))
    t = t.withColumn("typed", (cast == 1) & ~F.col("at_base"))
    single, word, named = F.coalesce("single", F.lit(False)), F.col("word"), F.col("named")
    after_table = (F.col("prev").isin("from", "join") | ((F.col("prev") == ",") & F.col("clause").isin(*TABLES))) & F.col("at_base")
    nothing = F.col("next").isNull()
    t = t.withColumn("is_table", named & F.coalesce(after_table, F.lit(False)) & F.coalesce(F.col("next") != "(", F.lit(True)))
    # An alias without AS follows a whole operand.
    operand = F.col("prev").rlike(r"^[\p{L}_\"`'\d)]") & (~F.col("prev").isin(RESERVED) | F.col("prev").isin("end", "null", "true", "false")) & ~F.col("prev").endswith("*")
    closing = nothing | F.col("next").isin(",", "from", ")")
    named_as = (F.col("prev") == "as") & (word | F.col("token").startswith("'"))
    t = t.withColumn("is_alias", F.coalesce(F.col("at_base") & (F.col("clause") == "select") & closing & (named_as | (word & operand)), F.lit(False)))
    of_table = F.coalesce(F.lag("is_table").over(ordered), F.lit(False))
    type_or_function = F.coalesce(F.col("next") == "(", F.lit(False)) | F.coalesce(F.col("prev").isin("as", "::"), F.lit(False)) | F.col("typed")
    literal = single & ~F.col("token").rlike("^[\"`]") & F.coalesce(F.col("next").startswith("'") | ((F.col("next") == "from") & ~F.col("at_base")), F.lit(False))
    tables_only = F.col("clause").isin("from", "join", "using") & F.col("at_base")
    is_column = named & ~F.col("is_table") & ~F.col("is_alias") & ~of_table & ~type_or_function & ~literal & ~F.coalesce(tables_only, F.lit(True))
    t = t.withColumn("is_column", is_column)
    return t.select("id", "pos", "token", "low", "prev", "next", "begins", "ends", "scope", "at_base", "clause", "root_clause", "item", "open_after", "is_table", "is_alias", "is_column", "named")


def _ancestors(tokens: DataFrame) -> DataFrame:
    """id, scope, at, far: the scopes around each scope, itself included, with how far out they are. Folded over a text's subselects, of which only the open ones are kept."""
    events = tokens.where("begins OR ends").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "begins"))).alias("events"))
    empty = F.struct(F.array().cast("array<int>").alias("open"), F.array().cast("array<array<int>>").alias("found"))

    def step(state: Column, event: Column) -> Column:
        around = F.concat(F.array(event["pos"]), state["open"])
        left = F.slice(state["open"], 2, F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        return F.struct(F.when(event["begins"], around).otherwise(left).alias("open"), F.when(event["begins"], F.concat(state["found"], F.array(around))).otherwise(state["found"]).alias("found"))

    nested = events.select("id", F.explode(F.aggregate("events", empty, step)["found"]).alias("around"))
    nested = nested.select("id", F.col("around")[0].alias("scope"), F.posexplode(F.concat("around", F.array(F.lit(ROOT)))).alias("far", "at"))
    root = tokens.select("id").distinct().select("id", F.lit(ROOT).alias("scope"), F.lit(0).alias("far"), F.lit(ROOT).alias("at"))
    return nested.unionByName(root)


def resolved_columns(tokens: DataFrame) -> DataFrame:
    """The tokens that are columns, with table and column.

    A qualifier is an alias of its scope or of one around it, the nearest; else it stays as the table's name. A column without one belongs to its scope's only table, else to UNKNOWN. Aliases of one subselect don't
    reach another beside it.
    """
    alias = F.when(F.col("after") == "as", F.col("after_that")).when(F.col("after").rlike(r"^[\p{L}_\"`]") & ~F.col("after").isin(RESERVED) & ~F.col("after").contains("."), F.col("after"))
    ordered = Window.partitionBy("id").orderBy("pos")
    tables = tokens.withColumns({"after": F.lead("low").over(ordered), "after_that": F.lead("low", 2).over(ordered)}).where("is_table")
    tables = tables.select("id", "scope", F.element_at(_parts(F.col("token")), -1).alias("table"), _unquoted(alias).alias("alias"))
    tables = tables.select("id", F.col("scope").alias("at"), "table", F.lower(F.coalesce("alias", "table")).alias("qualifier")).groupBy("id", "at", "qualifier").agg(F.max("table").alias("table"))
    columns = tokens.where("is_column").withColumn("parts", _parts(F.col("token")))
    columns = columns.withColumns({"column": F.element_at("parts", -1), "written": F.when(F.size("parts") > 1, F.element_at("parts", -2))})
    met = columns.where("written IS NOT NULL").select("id", "pos", "scope", F.lower("written").alias("qualifier")).join(_ancestors(tokens), ["id", "scope"]).join(tables, ["id", "at", "qualifier"])
    nearest = met.groupBy("id", "pos").agg(F.min_by("table", "far").alias("of_alias"))
    only = tables.groupBy("id", F.col("at").alias("scope")).agg(F.count("*").alias("n"), F.max("table").alias("only")).where("n = 1").drop("n")
    placed = columns.join(nearest, ["id", "pos"], "left").join(only, ["id", "scope"], "left")
    table = F.when(F.col("written").isNull(), F.coalesce("only", F.lit("UNKNOWN"))).otherwise(F.coalesce("of_alias", "written"))
    return placed.withColumn("table", table)


def _judged(tokens: DataFrame) -> DataFrame:
    """id and reason, null for texts that can be read."""
    root = F.col("at_base") & (F.col("scope") == ROOT)
    whole = tokens.groupBy("id").agg(
        F.max(root & F.col("low").isin("union", "intersect", "except")).alias("several"), F.max(root & (F.col("low") == "from")).alias("reads"), F.min("open_after").alias("least"), F.max_by("open_after", "pos").alias("left"),
    )
    reason = F.when(F.col("several"), "union").when((F.col("least") < 0) | (F.col("left") != 0), "brackets").when(~F.col("reads"), "not a select")
    return whole.select("id", reason.alias("reason"))


def view_column_lineage(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lineage, rejects) of view SQL texts (view_name, sql).

    lineage: view_name, output, table, column: every column anywhere in a select item, functions, CASE, arithmetic and subselects included. An item's output is its alias, else its column's name; items that have neither are
    left out, and so are stars. Of several items with one name the last one counts. Texts of several selects (union), with brackets that don't match or without FROM are rejects.
    """
    known = view_texts(texts)
    tokens = checkpoint(view_tokens(known))
    judged = _judged(tokens)
    good = tokens.join(judged.where("reason IS NULL").select("id"), "id", "left_semi")
    items = good.where((F.col("root_clause") == "select") & ~((F.col("scope") == ROOT) & F.col("at_base") & F.col("low").isin("select", "distinct", "all", ",")))
    at_root = F.col("at_base") & (F.col("scope") == ROOT)
    told = items.groupBy("id", "item").agg(F.max_by(F.when(at_root & F.col("is_alias"), _unquoted(F.col("token"))), F.when(at_root & F.col("is_alias"), F.col("pos"))).alias("alias"), F.count("*").alias("n"), F.max(F.when(F.col("named"), F.element_at(_parts(F.col("token")), -1))).alias("own"))
    told = told.select("id", "item", F.coalesce("alias", F.when(F.col("n") == 1, F.col("own"))).alias("output")).where("output IS NOT NULL")
    told = told.groupBy("id", "output").agg(F.max("item").alias("item"))
    columns = resolved_columns(good).where("root_clause = 'select'")
    lineage = columns.join(told, ["id", "item"]).select("id", "output", "table", "column").distinct().join(known, "id").select("view_name", "output", "table", "column").distinct()
    return lineage, judged.where("reason IS NOT NULL").join(known, "id").select("view_name", "sql", "reason")


def sql_dependencies(texts: DataFrame) -> DataFrame:
    """view_name, table, column: the columns of select lists, ON and WHERE of a text and of its subselects; tables without columns have null. Texts of several selects and those with brackets that don't match have none."""
    known = view_texts(texts)
    tokens = checkpoint(view_tokens(known))
    good = tokens.join(_judged(tokens).where("coalesce(reason, 'not a select') = 'not a select'").select("id"), "id", "left_semi")
    columns = resolved_columns(good).where(F.col("clause").isin(*DEPENDENT)).select("id", "table", "column").distinct().join(known, "id").select("view_name", "table", "column").distinct()
    tables = good.where("is_table").select("id", F.element_at(_parts(F.col("token")), -1).alias("table")).distinct().join(known, "id").select("view_name", "table").distinct()
    bare = tables.join(columns, ["view_name", "table"], "left_anti").select("view_name", "table", F.lit(None).cast("string").alias("column"))
    return columns.union(bare)


def view_dependency_stats(view: DataFrame) -> DataFrame:
    """Per source how many view fields depend on it, and which."""
    return view.groupBy("src").agg(F.count("dst").alias("targets"), F.array_sort(F.collect_set("dst")).alias("view_fields"))
