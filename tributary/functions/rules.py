"""Write-back rules, reference infos and kinds of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import blank_to_null, capitalize, let

RULE_KEYS = ("srcObjectType", "idField", "expression", "condition", "executingMoment")
_LENIENT = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowComments": "true"}

# Names and business types of amounts and quantities.
AMOUNT_NAMES = ("originAmount", "amount", "amountWithoutTax", "originAmountWithoutTax")
QUANTITY_NAMES = ("quantity", "transAuxQty", "baseQty", "auxQty")
AMOUNT_TYPES, QUANTITY_TYPES = ("amount", "currency", "money"), ("qty", "quantity")


def parse_write_back(text: Column) -> Column:
    """The rule in a lenient JSON text: of an object or an array the first element with srcObjectType and expression, else null. Keys may be in any case; of equal ones the last counts."""
    clean = F.regexp_replace(F.regexp_replace(blank_to_null(text), r",\s*([}\]])", "$1"), r"(?s)^(\s*/\*.*?\*/)+", "")

    def value(rule: Column, key: str) -> Column:
        found = F.filter(F.map_entries(rule), lambda e: F.lower(e["key"]) == key.lower())
        return F.try_element_at(found, F.lit(-1))["value"]

    def parse(t: Column) -> Column:
        as_array = F.when(F.ltrim(t).startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]")))
        found = F.transform(F.from_json(as_array, "array<map<string,string>>", _LENIENT), lambda r: F.struct(*(value(r, k).alias(k) for k in RULE_KEYS)))
        return F.filter(found, lambda r: r["srcObjectType"].isNotNull() & r["expression"].isNotNull())

    first = lambda a: F.try_element_at(a, F.lit(1))
    return let(clean, lambda text: F.coalesce(first(parse(text)), first(parse(F.translate(text, "'", '"')))))


def rule_attribute(text: Column, key: str) -> Column:
    if key not in RULE_KEYS:
        raise ValueError(f"a rule has no {key}")
    return F.coalesce(F.get_json_object(text, f"$.{key}"), F.get_json_object(text, f"$[0].{key}"))


def write_back_objects(rule: Column) -> Column:
    """The objects that a rule reads: its source and those that its condition names as the source's item type."""
    named = F.regexp_extract_all(F.coalesce(rule["condition"], F.lit("")), F.lit("srcItemObjectType='([^']+)'"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(F.array(rule["srcObjectType"]), named), lambda o: o != ""))


def refer_entities(refer_info: Column) -> Column:
    """The names of the entities that a field refers to, in order."""
    info = F.from_json(refer_info, "struct<referEntities:array<struct<referEntityName:string>>>", _LENIENT)
    return F.transform(info["referEntities"], lambda e: e["referEntityName"])


def first_refer_entity(refer_info: Column) -> Column:
    names = refer_entities(refer_info)
    return F.when(F.size(names) > 0, names[0])


def has_text(text: Column) -> Column:
    return blank_to_null(text).isNotNull()


def is_write_back(write_back: Column) -> Column:
    return has_text(write_back)


def is_trigger(trigger: Column, expression: Column) -> Column:
    return has_text(trigger) | has_text(expression)


def is_virtual(virtual: Column, trigger: Column, expression: Column) -> Column:
    return has_text(virtual) & ~is_trigger(trigger, expression)


def _of_kind(name: Column, biz_type: Column, types: tuple[str, ...], names: tuple[str, ...]) -> Column:
    kind = F.lower(F.coalesce(biz_type, F.lit("")))
    found = name.isin(*names)
    for t in types:
        found = found | kind.contains(t)
    for n in names:
        found = found | name.endswith(n[0].upper() + n[1:])
    return F.coalesce(found, F.lit(False))


def is_amount(name: Column, biz_type: Column) -> Column:
    return _of_kind(name, biz_type, AMOUNT_TYPES, AMOUNT_NAMES)


def is_quantity(name: Column, biz_type: Column) -> Column:
    return _of_kind(name, biz_type, QUANTITY_TYPES, QUANTITY_NAMES)


def ends_with_standard(name: Column, standard: Column) -> Column:
    return name.endswith(capitalize(standard))


def edge_reason(rel: Column, source: Column, target: Column, formula: Column, rule: Column) -> Column:
    """Why an edge is there: its formula or rule, if known."""
    field = F.substring_index(source, ".", -1)
    intra = F.when(formula.isNotNull(), F.concat(F.lit("computed as "), formula, F.lit(", contains "), field)).otherwise(F.concat(F.lit("depends on "), field))
    back = F.when(rule["expression"].isNotNull(), F.concat(F.lit("written back from "), rule["srcObjectType"], F.lit(" as "), rule["expression"])).otherwise(F.lit("written back"))
    return F.when(rel == "intra", intra).when(rel == "writeBack", back).otherwise(F.concat(source, F.lit(" -> "), target))


def format_path(steps: Column) -> Column:
    """An array of (rel, source, target) as `a --[rel]--> b`, joined by arrows."""
    one = lambda s: F.concat(s["source"], F.lit(" --["), s["rel"], F.lit("]--> "), s["target"])
    return F.array_join(F.transform(steps, one), " → ")
