"""Rewrites of JSON mappings; values of any type stay what they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that the head object supports.
HEAD_KEYS = (
    "currencyId businessDate createdOrgId exchangeRate isSameCurrency verifyRelationId verificationTypeId exchangeId "
    "debitDeclaredAmount creditDeclaredAmount originDebitDeclaredAmount originCreditDeclaredAmount"
).split()
# Keys set anew by direction, with the value that both directions give them; None where it depends on the direction.
DIRECTED = {
    "currencyId": "midCurrencyId", "settleCurrencyId": "settleCurrencyId", "originCurrencyId": "transCurrencyId",
    "originExchangeRate": "transExchangeRate", "settleExchangeRate": "settleExchangeRate", "exchangeRate": "midExchangeRate",
    "verExchangeRate": "trans2MidExchangeRate", "settleVerExchangeRate": "settle2MidExchangeRate",
}
# Amounts as (debit key, credit key, value); the direction's own key gets the value, the other one the text null.
AMOUNTS = (
    ("originDebitDeclaredAmount", "originCreditDeclaredAmount", "originDeclaredAmount"),
    ("debitDeclaredAmount", "creditDeclaredAmount", "declaredAmount"),
    ("debitDeclaredAmountSelf", "creditDeclaredAmountSelf", "declaredAmountSelf"),
    ("midDebitDeclaredAmount", "midCreditDeclaredAmount", "midDeclaredAmount"),
)
# The bill's amount stands on the debit side in either direction; for debit, the credit side's null is spelt with a dollar sign.
BILL = ("billDebitDeclaredAmount", "billCreditDeclaredAmount", "billDeclaredAmount")
DOLLAR_NULL = "$null"


def _variants(pairs: dict[str, str]) -> Column:
    items = [x for k, v in pairs.items() for x in (F.lit(k), F.lit(v).cast("variant"))]
    return F.create_map(*items)


def _map(json: Column) -> Column:
    return F.from_json(json, "map<string,variant>")


def rewrite_mapping(json: Column) -> Column:
    """Supported keys point to the head object, exchangeId is added if missing, other entries stay; blank texts pass through."""
    entries = _map(json)
    head = lambda k, v: F.when(k.isin(HEAD_KEYS), F.concat(F.lit("${head}."), k).cast("variant")).otherwise(v)
    changed = F.transform_values(entries, head)
    added = F.when(F.map_contains_key(entries, "exchangeId"), changed).otherwise(F.map_concat(changed, _variants({"exchangeId": "${head}.exchangeId"})))
    return F.when(F.trim(json) == "", json).otherwise(F.to_json(added))


def _appended(credit: bool) -> dict[str, str]:
    out = {k: "${ret}." + v for k, v in DIRECTED.items()}
    for debit_key, credit_key, value in AMOUNTS:
        own, other = (credit_key, debit_key) if credit else (debit_key, credit_key)
        out |= {own: "${ret}." + value, other: "null"}
    return out | {BILL[0]: "${ret}." + BILL[2], BILL[1]: "null" if credit else DOLLAR_NULL}


def rewrite_mapping_by_direction(direction: Column, json: Column) -> Column:
    """Directed keys are set anew and the bill's amount in other texts points to the origin's; an error where direction names neither side."""
    gone = [*DIRECTED, *(k for a in AMOUNTS for k in a[:2]), *BILL[:2]]
    kept = F.map_filter(_map(json), lambda k, _: ~k.isin(gone))
    text = lambda v: F.schema_of_variant(v) == "STRING"
    replaced = F.transform_values(kept, lambda _, v: F.when(text(v), F.replace(v.cast("string"), F.lit("${billDeclaredAmount}"), F.lit("${ret}.originDeclaredAmount")).cast("variant")).otherwise(v))
    side = F.lower(direction)
    return (
        F.when(side.contains("credit"), F.to_json(F.map_concat(replaced, _variants(_appended(True)))))
        .when(side.contains("debit"), F.to_json(F.map_concat(replaced, _variants(_appended(False)))))
        .otherwise(F.raise_error(F.lit("direction must contain credit or debit")))
    )


def split_direction_pair(text: Column) -> tuple[Column, Column]:
    """Direction and JSON of `'dir', '{json}'`: split at the first comma, trimmed, one pair of equal quotes taken off."""
    bare = lambda t: F.regexp_replace(F.trim(t), r"(?s)^(['\"])(.*)\1$", "$2")
    at = F.locate(",", text)
    return F.when(at > 0, bare(F.substr(text, F.lit(1), at - 1))), F.when(at > 0, bare(F.substr(text, at + 1)))
