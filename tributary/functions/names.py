"""Names of objects, tables, columns and fields: functions from Column to Column.

A node of the lineage graph is `Object.field` with the field in its canonical form; every frame that this package builds uses it, so one field has one id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is computed once however often f names it; also within functions of arrays, where Spark doesn't share what is repeated."""
    return F.transform(F.array(value), f)[0]


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def first_non_empty(*texts: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*map(blank_to_null, texts))


def capitalize(text: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def snake_to_camel(text: Column) -> Column:
    """Underscores at both ends go, the first part is lower-cased, later parts get a capital and keep the rest."""
    parts = F.split(F.btrim(text, F.lit("_")), "_")
    return let(parts, lambda p: F.concat(F.lower(p[0]), F.array_join(F.transform(F.slice(p, 2, F.size(p)), capitalize), "")))


def camel_to_snake(text: Column) -> Column:
    """Each capital becomes an underscore and its small letter, without the underscore at the start."""
    return F.lower(F.regexp_replace(text, "(?<!^)([A-Z])", "_$1"))


def canonical(api_name: Column, name: Column) -> Column:
    """The API name, else the name, in camel case if it has an underscore; null if neither says anything."""
    plain = blank_to_null(name)
    return F.coalesce(blank_to_null(api_name), F.when(plain.contains("_"), let(snake_to_camel(plain), lambda camel: F.nullif(camel, F.lit("")))).otherwise(plain))


def node_id(object_type: Column, field: Column) -> Column:
    return F.concat(object_type, F.lit("."), field)


def split_node_id(node: Column) -> tuple[Column, Column]:
    """Object and field, split at the first dot; nulls where there is none or it comes first."""
    at = F.locate(".", node)
    good = at > 1
    return F.when(good, F.substr(node, F.lit(1), at - 1)), F.when(good, F.substr(node, at + 1))


def table_to_object(table: Column) -> Column:
    """A table's object: without schema, without the prefix up to the first underscore unless that is the first or last character, in camel case with a capital."""
    bare = F.substring_index(F.lower(table), ".", -1)
    at = F.locate("_", bare)
    own = F.when((at > 1) & (at < F.length(bare)), F.substr(bare, at + 1)).otherwise(bare)
    return capitalize(snake_to_camel(own))


def object_to_table(object_type: Column, app_name: Column) -> Column:
    return F.concat_ws("_", blank_to_null(app_name), camel_to_snake(object_type))


def field_to_column(field: Column, name: Column) -> Column:
    """The catalog's name in snake case; a field without one in the catalog in snake case itself."""
    known = blank_to_null(name)
    return F.coalesce(F.when(known.contains("_"), known).otherwise(camel_to_snake(known)), camel_to_snake(field))


def field_key(object_type: Column, name: Column, api_name: Column) -> Column:
    """The key by which two catalogs are compared."""
    return F.concat(F.coalesce(object_type, F.lit("")), F.lit("."), F.coalesce(name, api_name, F.lit("")))
