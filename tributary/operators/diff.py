"""Differences between two catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import last_wins

PROPERTIES = {"expression": "expression", "triggerExpr": "trigger_expr", "writeBackExpr": "write_back_expr", "virtualExpr": "virtual_expr", "title": "title", "type": "type"}


def diff_catalogs(base: DataFrame, compare: DataFrame) -> DataFrame:
    """(kind, object_type, name, property, old_value, new_value): fields added and removed by key, and changed properties of those in both.

    Of rows with one key the last counts. Nulls equal nulls. One full outer join.
    """
    row = F.struct("object_type", "name", "api_name", *PROPERTIES.values())
    a = last_wins(base).select("key", row.alias("a"))
    b = last_wins(compare).select("key", row.alias("b"))
    both = a.join(b, "key", "full_outer")
    changes = F.array(*(F.struct(F.lit(p).alias("property"), F.col(f"a.{c}").alias("old_value"), F.col(f"b.{c}").alias("new_value")) for p, c in PROPERTIES.items()))
    changed = F.filter(changes, lambda s: ~s["old_value"].eqNullSafe(s["new_value"]))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("property"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    listed = both.withColumn("kind", kind).withColumn("c", F.explode(F.when(F.col("kind") == "modified", changed).otherwise(whole)))
    of = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return listed.select("kind", of("object_type").alias("object_type"), F.coalesce(of("name"), of("api_name")).alias("name"), "c.property", "c.old_value", "c.new_value")
