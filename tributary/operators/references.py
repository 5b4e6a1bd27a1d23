"""The graph of objects, their fields and what fields refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..sources.catalog import Catalog, canonical, references
from .loops import checkpoint


def metadata_graph(catalog: Catalog) -> DataFrame:
    """(src, dst, rel, field): objects have fields, refer to entities by a field, have lists, and use enumerations; the last two by the field's type."""
    has = catalog.fields.withColumn("field", canonical()).where("field IS NOT NULL").select(F.col("object_type").alias("src"), names.node_id(F.col("object_type"), F.col("field")).alias("dst"), F.lit("HAS_FIELD").alias("rel"), "field")
    kind = F.lower(F.concat_ws(" ", "type", "biz_type"))
    rel = F.when(kind.contains("enum"), "USES_ENUM").when(kind.contains("list"), "HAS_LIST").otherwise("REFERS_TO")
    refers = references(catalog).withColumn("field", canonical()).where("field IS NOT NULL").select(F.col("object_type").alias("src"), F.col("entity").alias("dst"), rel.alias("rel"), "field")
    return has.union(refers).distinct()


def reference_paths(graph: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(start, target, hops, path): for each object that starts (id) refer to within so many steps the shortest path of fields, joined by dots; of equal ones the least.

    An object reached is not reached again from the same start, so cycles end.
    """
    steps = checkpoint(graph.where("rel <> 'HAS_FIELD'").groupBy("src", "dst").agg(F.min("field").alias("field")))
    frontier = checkpoint(starts.select(F.col("id").alias("start"), F.col("id").alias("target"), F.lit("").alias("path")).distinct())
    reached = frontier.withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        met = frontier.join(steps.withColumnRenamed("src", "target"), "target")
        path = F.concat_ws(".", F.nullif("path", F.lit("")), "field")
        best = met.groupBy("start", F.col("dst").alias("target")).agg(F.min(path).alias("path"))
        frontier = checkpoint(best.join(reached.select("start", "target"), ["start", "target"], "left_anti").select("start", "target", "path"))
        if frontier.isEmpty():
            break
        reached = checkpoint(reached.select("start", "target", "path", "hops").union(frontier.withColumn("hops", F.lit(hop))))
    return reached.where("hops > 0").select("start", "target", "hops", "path")


# Words that say nothing about which object is meant.
CORE_WORDS = ("行", "明细", "信息")


def match_objects(catalog: Catalog, keyword: str, limit: int = 10) -> DataFrame:
    """(name, title, score) of the objects that a keyword may mean, best first: 1.0 for its title or name, 0.8 where one holds the other, 0.6 where that is so without words such as details."""
    bare = lambda c: F.regexp_replace(c, "|".join(CORE_WORDS), "")
    word, title, name = F.lower(F.lit(keyword)), F.lower("title"), F.lower("name")
    holds = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    score = F.when((title == word) | (name == word), 1.0).when(holds(title, word) | holds(name, word), 0.8).when(holds(bare(title), bare(word)), 0.6)
    best = catalog.objects.groupBy("name").agg(F.min("title").alias("title")).withColumn("score", score).where("score IS NOT NULL")
    return best.orderBy(F.desc("score"), "name").limit(limit)


def for_tenant(df: DataFrame, tenant: str, column: str = "tenant") -> DataFrame:
    """Rows of a tenant and those of none."""
    return df.where((F.col(column) == tenant) | F.col(column).isNull())
