"""Snapshots of a catalog, and sinks for graphs and reports."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, scan_fields


def write_snapshot(catalog: Catalog, path: str, at: datetime) -> str:
    """All catalog rows under an id of the time to the second; the id."""
    snapshot = at.strftime("snapshot_%Y%m%d_%H%M%S.json")
    scan_fields(catalog).withColumn("snapshot_id", F.lit(snapshot)).write.mode("append").partitionBy("snapshot_id").parquet(path)
    return snapshot


def _folders(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder's name of each snapshot, by id, from the file system of the path."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(there) if f.isDirectory()] if files.exists(there) else []
    return {unquote(n.removeprefix("snapshot_id=")): n for n in names if n.startswith("snapshot_id=")}


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Ids, newest first; only the names of folders are read."""
    return spark.createDataFrame([(i,) for i in _folders(spark, path)], "snapshot_id string").orderBy(F.desc("snapshot_id"))


def load_snapshot(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """One snapshot's rows; only its own folder is opened."""
    folder = _folders(spark, path).get(snapshot)
    if folder is None:
        raise ValueError(f"no snapshot {snapshot}")
    return spark.read.option("basePath", path).parquet(f"{path}/{folder}")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "parquet") -> None:
    for name, frame in (("nodes", nodes), ("edges", edges)):
        frame.write.format(kind).save(f"{path}/{name}")


#: Rows of a report that one task writes into one file.
FILE_ROWS = 100_000


def write_impact_report(report: DataFrame, path: str, kind: str = "csv", rows: int = FILE_ROWS) -> None:
    """One folder for each object, with one file for each `rows` of its rows, about: objects are counted first, and large ones are dealt to several tasks by their fields. No file has more than twice as many rows."""
    parts, part = "__parts", "__part"
    sizes = report.groupBy("object").agg(F.ceil(F.count("*") / rows).cast("int").alias(parts))
    dealt = report.join(sizes, report["object"].eqNullSafe(sizes["object"])).drop(sizes["object"]).withColumn(part, F.pmod(F.xxhash64("field"), F.col(parts)))
    writer = dealt.repartition("object", part).drop(parts, part).write.partitionBy("object").format(kind).option("maxRecordsPerFile", 2 * rows)
    (writer.option("header", True) if kind == "csv" else writer).save(path)
