import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tributary.functions import formulas, mappings, names, rules


def apply(spark, column, *values, types=None):
    schema = ", ".join(f"c{i} {t}" for i, t in enumerate(types or ["string"] * len(values)))
    return spark.createDataFrame([values], schema).select(column(*(F.col(f"c{i}") for i in range(len(values))))).head()[0]


@pytest.mark.parametrize("formula,want", [
    ("make_invoice_amount_blue + make_invoice_amount_red + red_app_make_invoice_amount", ["makeInvoiceAmountBlue", "makeInvoiceAmountRed", "redAppMakeInvoiceAmount"]),
    ("sum(t.origin_amount)", ["originAmount"]),
    ("case when status_id='A.b' then 0 else abs(netAmt) end", ["statusId", "netAmt"]),
    ("round(amount,2) + X + Total + n", ["round", "amount"]),
    ("a.b.c_d", ["cD"]), ("_x_", ["x"]), ("date + order + myDate", ["myDate"]), ("amt.", []), ("a_x + b_x + a_x", ["aX", "bX"]), ("", []), (None, []), ("___", []),
])
def test_extract_sequence(spark, formula, want):
    assert apply(spark, formulas.extract_sequence, formula) == want


def test_names(spark):
    for text, want in {"Foo_BAR_baz": "fooBARBaz", "__a__b_": "aB", "userName": "username", "___": ""}.items():
        assert apply(spark, names.snake_to_camel, text) == want
    for text, want in {"ArContract": "ar_contract", "invoiceURL": "invoice_u_r_l"}.items():
        assert apply(spark, names.camel_to_snake, text) == want
    for text, want in {"public.arap_invoice_item": "InvoiceItem", "region": "Region", "_x": "X"}.items():
        assert apply(spark, names.table_to_object, text) == want
    for api, name, want in ((" a ", "b_c", "a"), ("", "b_c", "bC"), (None, " bC ", "bC"), (None, " ", None), (None, None, None), (None, "_", None)):
        assert apply(spark, names.canonical, api, name) == want
    assert apply(spark, lambda x: F.struct(*names.split_node_id(x)), "A.b.c") == ("A", "b.c")
    assert apply(spark, lambda x: F.struct(*names.split_node_id(x)), ".b") == (None, None)
    assert apply(spark, names.object_to_table, "ArContract", "fin") == "fin_ar_contract"
    assert apply(spark, names.object_to_table, "ArContract", " ") == "ar_contract"
    assert [apply(spark, names.field_to_column, f, n) for f, n in (("aB", "x_y"), ("aB", "cD"), ("aB", None))] == ["x_y", "c_d", "a_b"]
    assert apply(spark, names.field_key, None, None, "q") == ".q"
    assert apply(spark, lambda a, b: names.first_non_empty(a, b), " ", " z ") == "z"


def test_runs_and_words(spark):
    two = ["array<string>", "array<string>"]
    run = lambda a, b: apply(spark, formulas.contains_run, a, b, types=two)
    assert [run(["aX", "bX", "rate"], n) for n in (["aX", "bX"], ["bX", "aX"], [], ["rate"], ["rat"])] == [True, False, False, True, False]
    assert apply(spark, formulas.contains_word, "sum(Amount)", "amount") and not apply(spark, formulas.contains_word, "amounts", "amount")
    assert apply(spark, formulas.extract_words, "a-b_1 c") == ["a", "b_1", "c"]
    got = apply(spark, formulas.formula_to_columns, "amount + t.amount + amountTax * a_x", {"amount": "amt", "amountTax": None, "other": "o"}, types=["string", "map<string,string>"])
    assert got == "amt + t.amount + amount_tax * a_x"


@pytest.mark.parametrize("text,want", [
    ('{"srcObjectType":"A","expression":"sum(x_y)"}', ("A", None, "sum(x_y)", None, None)),
    ('[{"expression":"q"},{"srcObjectType":"B","expression":"p"}]', ("B", None, "p", None, None)),
    ("{'srcObjectType':'C','expression':'e',}", ("C", None, "e", None, None)),
    ('{"SRCOBJECTTYPE":"A","Expression":"e","idfield":"i"}', ("A", "i", "e", None, None)),
    ('[{"srcobjecttype":null,"expression":"q"},{"SrcObjectType":"B","EXPRESSION":"p","expression":"last","n":{"a":1},"CONDITION":7}]', ("B", None, "last", "7", None)),
    ("/* first */ [{'SRCOBJECTTYPE':'C','EXPRESSION':'e',},]", ("C", None, "e", None, None)), ("[]", None), ("[1]", None), ("null", None), ('"text"', None),
    ('{"srcObjectType":"A"}', None), (" ", None), ("oops", None), (None, None),
    ('{srcObjectType:"A", /* why */ "expression":"e","idField":"i","condition":"c","other":1}', ("A", "i", "e", "c", None)),
])
def test_parse_write_back(spark, text, want):
    got = apply(spark, rules.parse_write_back, text)
    assert (tuple(got) if got else None) == want


def test_kinds(spark):
    assert [apply(spark, rules.is_amount, n, b) for n, b in (("fooAmount", None), ("amount", ""), ("x", "Local Currency"), ("amounts", "text"), (None, None))] == [True, True, True, False, False]
    assert [apply(spark, rules.is_quantity, n, b) for n, b in (("lineBaseQty", None), ("qty", None), ("x", "QUANTITY"))] == [True, False, True]
    assert apply(spark, rules.refer_entities, '{"referEntities":[{"referEntityName":"A"},{"referEntityName":"B"}]}') == ["A", "B"]
    assert apply(spark, rules.first_refer_entity, '{"referEntities":[]}') is None
    assert apply(spark, lambda c: rules.rule_attribute(c, "condition"), '[{"condition":"x"}]') == "x"


def test_mappings(spark):
    got = json.loads(apply(spark, mappings.rewrite_mapping, '{"currencyId":"c","n":3,"deep":{"a":[1]},"s":"t"}'))
    assert got == {"currencyId": "${head}.currencyId", "n": 3, "deep": {"a": [1]}, "s": "t", "exchangeId": "${head}.exchangeId"}
    assert apply(spark, mappings.rewrite_mapping, "  ") == "  " and apply(spark, mappings.rewrite_mapping, None) is None
    text = '{"currencyId":"c","memo":"${billDeclaredAmount}!","n":1}'
    debit = json.loads(apply(spark, mappings.rewrite_mapping_by_direction, "Direction.debit", text))
    credit = json.loads(apply(spark, mappings.rewrite_mapping_by_direction, "Direction.credit", text))
    assert len(debit) == len(credit) == 20 and debit["memo"] == "${ret}.originDeclaredAmount!" and debit["n"] == 1
    assert (debit["billCreditDeclaredAmount"], credit["billCreditDeclaredAmount"]) == ("$null", "null")
    assert (debit["originDebitDeclaredAmount"], credit["originDebitDeclaredAmount"]) == ("${ret}.originDeclaredAmount", "null")
    with pytest.raises(PySparkException):
        apply(spark, mappings.rewrite_mapping_by_direction, "neither", text)
    assert apply(spark, lambda t: F.struct(*mappings.split_direction_pair(t)), "'D.debit', '{\"a\":1,\"b\":2}'") == ("D.debit", '{"a":1,"b":2}')
