"""Scans and simple queries of a field catalog.

A catalog is three frames: fields (id, object_type, name, api_name, title, type, biz_type, expression, trigger_expr, virtual_expr, write_back_expr,
refer_info), objects (name, title, type, app_name) and metadata (name, content, is_deleted, type_id).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names, rules
from ..functions.formulas import all_formulas, extract_sequence

FIELD_COLUMNS = ("id", "object_type", "name", "api_name", "title", "type", "biz_type", "expression", "trigger_expr", "virtual_expr", "write_back_expr", "refer_info")
VIEW = (
    "struct<name:string,fields:array<struct<name:string,type:string,title:string,expression:string,triggerExpr:string,virtualExpr:string,writeBackExpr:string>>,"
    "viewDef:array<struct<objectName:string,sql:string>>>"
)


@dataclass
class Catalog:
    fields: DataFrame
    objects: DataFrame
    metadata: DataFrame | None = None
    #: What was read from its texts, written once for all that ask for it.
    read_once: dict[str, Any] = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def read(spark: SparkSession, path: str) -> Catalog:
        return Catalog(*(spark.read.parquet(f"{path}/{t}") for t in ("fields", "objects", "metadata")))


def canonical(prefix: str = "") -> Column:
    return names.canonical(F.col(f"{prefix}api_name"), F.col(f"{prefix}name"))


def is_bill() -> Column:
    return F.coalesce(F.col("type"), F.lit("")) == "bill"


def scan_fields(catalog: Catalog, object_type: str | None = None) -> DataFrame:
    """All fields, or one object's, with their object's app. Catalyst broadcasts objects where statistics say that they are small."""
    fields = catalog.fields if object_type is None else catalog.fields.where(F.col("object_type") == object_type)
    apps = catalog.objects.groupBy(F.col("name").alias("object_type")).agg(F.min("app_name").alias("app_name"))
    return fields.select(*FIELD_COLUMNS).join(apps, "object_type", "left")


def scan_write_back_candidates(catalog: Catalog) -> DataFrame:
    return scan_fields(catalog).where(F.col("write_back_expr").isNotNull())


def scan_view_definitions(catalog: Catalog, apps: Sequence[str]) -> DataFrame:
    """name and content of the entity metadata of bills of these apps (in lower case) whose name holds View."""
    wanted = catalog.metadata.where(F.col("name").contains("View") & ~F.col("is_deleted") & (F.col("type_id") == "MetaType.entity"))
    bills = catalog.objects.where(is_bill() & F.lower("app_name").isin([a.lower() for a in apps])).select("name").distinct()
    return wanted.join(bills, "name").select("name", "content")


def app_name_of(catalog: Catalog, object_type: str) -> DataFrame:
    return catalog.objects.where(F.col("name") == object_type).agg(F.min("app_name").alias("app_name"))


def object_titles(catalog: Catalog) -> DataFrame:
    return catalog.objects.where(F.col("name").isNotNull() & F.col("title").isNotNull()).select("name", "title")


def bill_object_types(catalog: Catalog) -> DataFrame:
    return catalog.objects.where(is_bill()).select(names.blank_to_null(F.col("name")).alias("name")).where("name IS NOT NULL").distinct()


def scan_referencing_fields(catalog: Catalog, entity: str) -> DataFrame:
    return scan_fields(catalog).where(F.exists(rules.refer_entities(F.col("refer_info")), lambda e: e == entity))


def references(catalog: Catalog) -> DataFrame:
    """Every (entity, referring field): the join of all entities at once."""
    return scan_fields(catalog).withColumn("entity", F.explode(F.array_distinct(rules.refer_entities(F.col("refer_info"))))).where("entity IS NOT NULL")


def scan_compare_catalog(fields: DataFrame, objects: DataFrame, apps: Sequence[str]) -> DataFrame:
    """The fields of bills of exactly these apps in another catalog; on a JDBC source both filters are pushed down."""
    bills = objects.where(F.col("app_name").isin(list(apps)) & (F.col("type") == "bill")).select(F.col("name").alias("object_type"), "app_name")
    return fields.select(*FIELD_COLUMNS[:-1]).join(bills, "object_type")


def views(catalog: Catalog, definitions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(view fields, view SQL texts, rejects). Fields of views whose name is a real object's are left out; documents that don't parse or have no name are rejects."""
    parsed = definitions.select("name", "content", F.from_json("content", VIEW).alias("view"))
    good = parsed.where(names.blank_to_null(F.col("view.name")).isNotNull())
    rejects = parsed.where(names.blank_to_null(F.col("view.name")).isNull()).select("name", "content", F.when(F.col("view.viewDef").isNull(), "unreadable").otherwise("no name").alias("reason"))
    real = catalog.fields.select(F.col("object_type").alias("view_name")).distinct()
    fields = good.select(F.trim("view.name").alias("view_name"), F.explode("view.fields").alias("f")).join(real, "view_name", "left_anti")
    fields = fields.select(
        F.concat("view_name", F.lit("."), F.coalesce("f.name", F.lit(""))).alias("id"), F.col("view_name").alias("object_type"), "f.name", F.lit(None).cast("string").alias("api_name"), "f.title", "f.type",
        F.lit(None).cast("string").alias("biz_type"), "f.expression", F.col("f.triggerExpr").alias("trigger_expr"), F.col("f.virtualExpr").alias("virtual_expr"), F.col("f.writeBackExpr").alias("write_back_expr"), F.lit(None).cast("string").alias("refer_info"),
    )
    texts = good.select(F.trim("view.name").alias("view_name"), F.explode("view.viewDef").alias("d")).select("view_name", F.col("d.objectName").alias("object_name"), F.col("d.sql").alias("sql")).where("sql IS NOT NULL")
    return fields, texts, rejects


def scan_verify_mappings(mappings: DataFrame, system_ids: Sequence[str]) -> DataFrame:
    return mappings.where(F.col("verify_system_id").isin(list(system_ids))).orderBy("verify_system_id", "id")


def field_info(catalog: Catalog, object_type: str, field: str) -> DataFrame:
    """The catalog row of a field; of several the one with the smallest id."""
    return scan_fields(catalog, object_type).where(canonical() == field).orderBy("id").limit(1)


def object_types(catalog: Catalog) -> DataFrame:
    """Objects with fields that are bills; all objects with fields if none of them is."""
    there = catalog.fields.select(F.col("object_type").alias("name")).where("name IS NOT NULL").distinct()
    bills = there.join(bill_object_types(catalog), "name", "left_semi")
    any_bill = bills.limit(1).select(F.lit(True).alias("some"))
    return bills.union(there.join(any_bill, F.lit(True), "left_anti"))


def object_details(catalog: Catalog) -> DataFrame:
    titles = object_titles(catalog).groupBy("name").agg(F.min("title").alias("title"))
    return object_types(catalog).join(titles, "name", "left").select("name", F.coalesce("title", "name").alias("title"))


def fields_of(catalog: Catalog, object_type: str) -> DataFrame:
    return catalog.fields.where(F.col("object_type") == object_type).select(canonical().alias("field")).where("field IS NOT NULL").orderBy("field")


def field_details_of(catalog: Catalog, object_type: str) -> DataFrame:
    return scan_fields(catalog, object_type).withColumn("field", canonical()).orderBy("field", "id")


def filter_apps_fuzzy(fields: DataFrame, apps: Sequence[str]) -> DataFrame:
    """Fields whose app holds one of the terms, in any case; blank terms don't count, and without any there is no filter."""
    terms = [a.strip().lower() for a in apps if a and a.strip()]
    if not terms:
        return fields
    return fields.where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("app_name"), t)))


def filter_apps_exact(catalog: Catalog, apps: Sequence[str]) -> DataFrame:
    kept = scan_fields(catalog).where(F.col("app_name").isin(list(apps)))
    return kept.join(object_types(catalog).select(F.col("name").alias("object_type")), "object_type", "left_semi")


def fields_by_app(catalog: Catalog, app: str, samples: int = 20) -> tuple[DataFrame, DataFrame]:
    found = filter_apps_fuzzy(scan_fields(catalog), [app])
    return found.agg(F.count("*").alias("fields")), found.orderBy("object_type", "id").limit(samples)


def search_fields(catalog: Catalog, pattern: str = "", object_type: str | None = None, biz: str | None = None, limit: int = 200) -> DataFrame:
    """Fields whose canonical name or title holds the pattern and whose business type holds biz, in any case; up to limit (1000 at most), by object and field."""
    found = scan_fields(catalog, object_type).withColumn("field", canonical()).where("field IS NOT NULL")
    if pattern:
        found = found.where(F.contains(F.lower("field"), F.lit(pattern.lower())) | F.coalesce(F.contains(F.lower("title"), F.lit(pattern.lower())), F.lit(False)))
    if biz:
        found = found.where(F.contains(F.lower("biz_type"), F.lit(biz.lower())))
    flags = {"has_write_back": rules.is_write_back(F.col("write_back_expr")), "has_trigger": rules.is_trigger(F.col("trigger_expr"), F.col("expression")), "is_virtual": rules.is_virtual(F.col("virtual_expr"), F.col("trigger_expr"), F.col("expression"))}
    return found.withColumns(flags).orderBy("object_type", "field", "id").limit(min(limit, 1000))


def search_objects(catalog: Catalog, text: str = "", limit: int = 100) -> DataFrame:
    found = object_details(catalog)
    if text:
        found = found.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("title"), F.lit(text.lower())))
    return found.orderBy("name").limit(limit)


def write_backs(catalog: Catalog) -> DataFrame:
    """Fields with a rule that parses: scan_fields with field and rule."""
    return scan_fields(catalog).withColumns({"field": canonical(), "rule": rules.parse_write_back(F.col("write_back_expr"))}).where("rule IS NOT NULL")


def fields_from_source(catalog: Catalog, target: str | None = None, source: str | None = None) -> DataFrame:
    """Target fields written back from a source; without arguments all pairs."""
    found = write_backs(catalog).withColumn("source_object", F.col("rule.srcObjectType")).where(names.blank_to_null(F.col("source_object")).isNotNull())
    if target is not None:
        found = found.where(F.col("object_type") == target)
    return found if source is None else found.where(F.col("source_object") == source)


def fields_per_object(catalog: Catalog) -> DataFrame:
    return catalog.fields.groupBy("object_type").agg(F.count("*").alias("fields"))


def targets_by_source(catalog: Catalog, source: str | None = None) -> DataFrame:
    return fields_from_source(catalog, None, source).groupBy("source_object", F.col("object_type").alias("target_object")).agg(F.count("*").alias("fields")).orderBy(F.desc("fields"), "source_object", "target_object")


def sources_for_target(catalog: Catalog, target: str | None = None) -> DataFrame:
    return fields_from_source(catalog, target).groupBy(F.col("object_type").alias("target_object"), "source_object").agg(F.count("*").alias("fields")).orderBy(F.desc("fields"), "target_object", "source_object")


def incoming_references(catalog: Catalog, entity: str | None = None, exclude_view: bool = False) -> DataFrame:
    """Per entity and referring object: app, title and the fields that refer, API name else name; by app and object."""
    found = references(catalog)
    if entity is not None:
        found = found.where(F.col("entity") == entity)
    if exclude_view:
        found = found.where(~F.lower("object_type").contains("view"))
    titles = object_titles(catalog).groupBy(F.col("name").alias("object_type")).agg(F.min("title").alias("object_title"))
    grouped = found.groupBy("entity", "object_type", "app_name").agg(F.array_sort(F.collect_list(F.coalesce("api_name", "name"))).alias("fields"))
    return grouped.join(titles, "object_type", "left").orderBy("entity", F.lower("app_name"), F.lower("object_type"))


def category_counts(catalog: Catalog) -> DataFrame:
    """Per object how many fields are written back, triggered, computed, virtual and plain; the first that holds."""
    kind = (
        F.when(rules.has_text(F.col("write_back_expr")), "write_back").when(rules.has_text(F.col("trigger_expr")), "trigger")
        .when(rules.has_text(F.col("expression")), "expression").when(rules.has_text(F.col("virtual_expr")), "virtual").otherwise("plain")
    )
    kinds = ["write_back", "trigger", "expression", "virtual", "plain"]
    return catalog.fields.withColumn("kind", kind).groupBy("object_type").pivot("kind", kinds).count().na.fill(0)


def sequences(fields: DataFrame) -> DataFrame:
    """fields with field (canonical), seq (fields in all formulas) and trigger_seq (those in the trigger, without itself)."""
    seq = extract_sequence(all_formulas(F.col("trigger_expr"), F.col("expression"), F.col("virtual_expr")))
    own = fields.withColumn("field", canonical()).where("field IS NOT NULL").withColumn("seq", seq)
    # A trigger that is a field's only formula needn't be read again.
    in_trigger = F.when(F.col("trigger_expr").isNull(), F.array().cast("array<string>")).when(F.coalesce("expression", "virtual_expr").isNull(), F.col("seq")).otherwise(extract_sequence(F.col("trigger_expr")))
    return own.withColumn("trigger_seq", F.filter(in_trigger, lambda f: f != F.col("field")))


def last_wins(fields: DataFrame) -> DataFrame:
    """One row for each comparison key, that with the largest id."""
    key = names.field_key(F.col("object_type"), F.col("name"), F.col("api_name"))
    newest = Window.partitionBy("key").orderBy(F.desc("id"))
    return fields.withColumn("key", key).withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place")
