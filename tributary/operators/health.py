"""Audits of a catalog: use of fields, profiles, standard names, scopes of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, rules
from ..sources.catalog import Catalog, canonical, fields_from_source, object_titles, references, scan_fields, sequences, targets_by_source
from .graph import impact
from .pages import PAGE_ITEMS, pages


def _uses(fields: DataFrame) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """The fields with whether their object's formulas use them, conditions to count by, and those whose fields are listed."""
    rows = fields.withColumn("field", canonical())
    used = sequences(fields).select("object_type", F.explode("seq").alias("field")).distinct().withColumn("used", F.lit(True))
    named = F.col("field").isNotNull()
    back = named & rules.is_write_back(F.col("write_back_expr"))
    formula = back | (named & (rules.is_trigger(F.col("trigger_expr"), F.col("expression")) | rules.has_text(F.col("virtual_expr"))))
    is_used = F.coalesce("used", F.lit(False))
    dead = named & ~formula & ~is_used
    counts = {"with_formula": formula, "referenced": named & is_used, "dead": dead, "write_back": back, "write_back_unreferenced": back & ~is_used}
    lists = {"dead_fields": dead, "write_back_unreferenced_fields": back & ~is_used}
    return rows.join(used, ["object_type", "field"], "left"), counts, lists


def _listed(lists: dict[str, Column]) -> Column:
    """A row for each list that a row is in."""
    return F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in lists.items())), lambda n: n.isNotNull())).alias("list")


def object_health(fields: DataFrame) -> DataFrame:
    """Per object: fields in total, with a formula or rule, referenced in the object (by themselves too), dead (neither), written back, and written back without reference.

    Fields without a name count in the total only.
    """
    rows, counts, lists = _uses(fields)
    listed = [F.array_sort(F.collect_list(F.when(c, F.col("field")))).alias(n) for n, c in lists.items()]
    return rows.groupBy("object_type").agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in counts.items()), *listed)


def object_health_pages(fields: DataFrame, size: int = PAGE_ITEMS) -> DataFrame:
    """(object_type, list, page, items): the lists of `object_health` in pages, for objects of any number of fields."""
    rows, _, lists = _uses(fields)
    return pages(rows.select("object_type", _listed(lists), "field"), ("object_type", "list"), "field", size)


def _categories(catalog: Catalog) -> DataFrame:
    category = (
        F.when(rules.is_write_back(F.col("write_back_expr")), "write_back").when(rules.is_virtual(F.col("virtual_expr"), F.col("trigger_expr"), F.col("expression")), "virtual")
        .when(rules.is_trigger(F.col("trigger_expr"), F.col("expression")), "trigger").otherwise("base")
    )
    named = catalog.fields.withColumn("field", canonical()).where("field IS NOT NULL")
    return named.withColumns({"category": category, "amount": rules.is_amount(F.col("field"), F.col("biz_type")), "quantity": rules.is_quantity(F.col("field"), F.col("biz_type"))})


def _profile_lists() -> dict[str, Column]:
    own = F.col("category")
    measured = own.isin("trigger", "base") & (F.col("amount") | F.col("quantity"))
    return {
        "write_back": own == "write_back", "virtual": own == "virtual", "trigger": own == "trigger", "base": (own == "base") & ~measured,
        "amount": measured & F.col("amount"), "quantity": measured & ~F.col("amount") & F.col("quantity"),
    }


def object_profile_pages(catalog: Catalog, size: int = PAGE_ITEMS) -> DataFrame:
    """(object_type, list, page, items): the lists of `object_profile` in pages, for objects of any number of fields."""
    return pages(_categories(catalog).select("object_type", _listed(_profile_lists()), "field"), ("object_type", "list"), "field", size)


def object_profile(catalog: Catalog) -> DataFrame:
    """Per object its title and its fields by category, sorted: write_back, virtual, trigger, base, amount and quantity.

    Triggered amounts and quantities are in two lists; other amounts and quantities without formulas leave the base list. With the numbers of sources and targets.
    """
    rows, lists = _categories(catalog), _profile_lists()
    profile = rows.groupBy("object_type").agg(*(F.array_sort(F.collect_list(F.when(c, F.col("field")))).alias(n) for n, c in lists.items()))
    pairs = fields_from_source(catalog).select("source_object", F.col("object_type").alias("target_object")).distinct()
    inbound = pairs.groupBy(F.col("target_object").alias("object_type")).agg(F.count("*").alias("sources"))
    outbound = pairs.groupBy(F.col("source_object").alias("object_type")).agg(F.count("*").alias("targets"))
    titles = object_titles(catalog).groupBy(F.col("name").alias("object_type")).agg(F.min("title").alias("title"))
    return profile.join(titles, "object_type", "left").join(inbound, "object_type", "left").join(outbound, "object_type", "left").na.fill(0, ["sources", "targets"])


def pattern_check(catalog: Catalog) -> DataFrame:
    """(object_type, kind, name, present): per object the standard amounts and quantities, and its amounts' and quantities' write-back coverage.

    A standard name is present if a field has it or an amount (quantity) ends with it; triggered fields don't miss a write-back.
    """
    rows = _categories(catalog)
    kinds = [("amount", n) for n in rules.AMOUNT_NAMES] + [("quantity", n) for n in rules.QUANTITY_NAMES]
    standard = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for k, n in kinds)))  # eight names a row
    tried = rows.select("object_type", "field", "amount", "quantity", standard.alias("s"))
    of_kind = F.when(F.col("s.kind") == "amount", F.col("amount")).otherwise(F.col("quantity"))
    hit = (F.col("field") == F.col("s.name")) | (of_kind & rules.ends_with_standard(F.col("field"), F.col("s.name")))
    present = tried.groupBy("object_type", "s.kind", "s.name").agg(F.bool_or(hit).alias("present"))
    back = F.bool_or(rules.is_write_back(F.col("write_back_expr"))).alias("back")
    triggered = F.bool_or(rules.is_trigger(F.col("trigger_expr"), F.col("expression"))).alias("triggered")
    coverage = rows.groupBy("object_type", "field").agg(F.bool_or(F.col("amount") | F.col("quantity")).alias("measured"), back, triggered).where("measured AND (back OR NOT triggered)")
    return present.unionByName(coverage.select("object_type", F.lit("coverage").alias("kind"), F.col("field").alias("name"), F.col("back").alias("present")))


def thread_chain(catalog: Catalog, field: str) -> DataFrame:
    """(source_object, target_object, fields): the objects with a field of this name, in any case, and where each of them writes back to."""
    having = catalog.fields.where(F.lower(canonical()) == field.lower()).select(F.col("object_type").alias("source_object")).distinct()
    return targets_by_source(catalog).join(having, "source_object", "left_semi")


def change_scope(catalog: Catalog, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(target_object, requested, action, affected) for requests (target_object, new_source, field) of a new write-back source.

    The field is added, gets a rule or one more source; fields that its value triggers are checked; so are fields written back from the target whose
    name holds the requested one without the words amount and qty, all of them for a request without field.
    """
    back = F.bool_or(rules.is_write_back(F.col("write_back_expr"))).alias("back")
    spelt = F.explode(F.array_distinct(F.array(F.lower(canonical()), F.lower(F.col("api_name"))))).alias("lower_field")
    rows = scan_fields(catalog).select("object_type", "write_back_expr", spelt).where("lower_field IS NOT NULL").groupBy(F.col("object_type").alias("target_object"), "lower_field").agg(back)
    own = requests.where("field IS NOT NULL").withColumn("lower_field", F.lower("field")).join(rows, ["target_object", "lower_field"], "left")
    action = F.when(F.col("back").isNull(), "ADD_FIELD").when(F.col("back"), "ADD_WRITE_BACK_SOURCE").otherwise("ADD_WRITE_BACK_DEFINITION")
    first = own.select("target_object", F.col("field").alias("requested"), action.alias("action"), names.node_id(F.col("target_object"), F.col("field")).alias("affected"))
    intra = edges.where("rel = 'intra'").select("src", "dst")
    triggered = requests.where("field IS NOT NULL").withColumn("src", names.node_id(F.col("target_object"), F.col("field"))).join(intra, "src")
    second = triggered.select("target_object", F.col("field").alias("requested"), F.lit("CHECK_TRIGGER").alias("action"), F.col("dst").alias("affected"))
    down = fields_from_source(catalog).select(F.col("source_object").alias("target_object"), names.node_id(F.col("object_type"), F.col("field")).alias("affected"), F.lower("field").alias("lower_name"))
    stem = F.regexp_replace(F.lower(F.coalesce("field", F.lit(""))), "amount|qty", "")
    third = requests.join(down, "target_object").where(F.col("field").isNull() | F.contains("lower_name", stem))
    third = third.select("target_object", F.col("field").alias("requested"), F.lit("CHECK_TRIGGER").alias("action"), "affected")
    return first.unionByName(second).unionByName(third).distinct()


def trigger_summary(catalog: Catalog, edges: DataFrame) -> DataFrame:
    """(object_type, source_object, field, triggers): for each field written back the fields that its value triggers, joined by comma."""
    used = edges.where("rel = 'intra'").groupBy(F.col("src_object").alias("object_type"), F.col("src_field").alias("field")).agg(F.array_join(F.array_sort(F.collect_set("dst_field")), ", ").alias("triggers"))
    return fields_from_source(catalog).select("object_type", "source_object", "field").distinct().join(used, ["object_type", "field"], "left").select("object_type", "source_object", "field", F.coalesce("triggers", F.lit("")).alias("triggers"))


def trigger_summary_pages(catalog: Catalog, edges: DataFrame, size: int = PAGE_ITEMS) -> DataFrame:
    """(object_type, source_object, field, page, items): for each field written back the fields that its value triggers, in pages; fields that trigger none have no page."""
    used = edges.where("rel = 'intra'").select(F.col("src_object").alias("object_type"), F.col("src_field").alias("field"), F.col("dst_field").alias("item")).distinct()
    written = fields_from_source(catalog).select("object_type", "source_object", "field").distinct()
    return pages(written.join(used, ["object_type", "field"]), ("object_type", "source_object", "field"), size=size)


def incoming_reference_pages(catalog: Catalog, size: int = PAGE_ITEMS) -> DataFrame:
    """(entity, object_type, app_name, page, items): the fields that refer to each entity, in pages; views too."""
    return pages(references(catalog).withColumn("item", F.coalesce("api_name", "name")), ("entity", "object_type", "app_name"), size=size)


def view_dependency_pages(view: DataFrame, size: int = PAGE_ITEMS) -> DataFrame:
    """(src, page, items): the view fields that depend on each source, in pages."""
    return pages(view.select("src", F.col("dst").alias("item")).distinct(), ("src",), size=size)


def why_no_relation(catalog: Catalog, object_type: str, field: str) -> DataFrame:
    """(check, id): plain text searches: rows of the field by name, the object's formulas that hold the text, rules that hold object and field."""
    rows = scan_fields(catalog)
    holds = lambda c, t: F.coalesce(F.contains(F.col(c), F.lit(t)), F.lit(False))
    formulas = holds("trigger_expr", field) | holds("expression", field) | holds("virtual_expr", field)
    own = F.col("object_type") == object_type
    checks = {
        "field_exists": own & (canonical() == field), "formula_holds_text": own & formulas,
        "write_back_holds_both": holds("write_back_expr", object_type) & holds("write_back_expr", field), "same_name": own & ((F.col("api_name") == field) | (F.col("name") == field)),
    }
    told = F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull()))
    return rows.select(told.alias("check"), "id")


def catalog_probe(catalog: Catalog, edges: DataFrame, object_type: str, field: str) -> DataFrame:
    """One row: fields and objects in the catalog, fields of the object, whether the field is there, and how many nodes and edges it reaches in two steps."""
    root = catalog.objects.sparkSession.createDataFrame([(f"{object_type}.{field}",)], "id string")
    nodes, walked = impact(edges, root, 2)
    sizes = nodes.agg(F.count("*").alias("nodes")).join(walked.agg(F.count("*").alias("edges")), F.lit(True))
    own = F.col("object_type") == object_type
    return catalog.fields.agg(F.count("*").alias("fields"), F.countDistinct("object_type").alias("objects"), F.count_if(own).alias("object_fields"), F.coalesce(F.bool_or(own & (canonical() == field)), F.lit(False)).alias("found")).join(sizes, F.lit(True))
