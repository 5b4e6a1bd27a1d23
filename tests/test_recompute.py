"""Rules on tables: exact sums, compound aggregates, and formulas that read other tables."""

import random
from decimal import Decimal
from fractions import Fraction

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tributary.functions import sums, texts
from tributary.plans import recompute
from tributary.plans.recompute import WriteBack


def rolled(spark, values, kind="double", expression="sum(v)", target="id long", old=()):
    source = spark.createDataFrame([(1, v) for v in values], f"fk long, v {kind}").repartition(3)
    out = recompute.apply_write_backs(spark.createDataFrame([(1, *old)], target), "id", source, [WriteBack("total", expression, "fk")])
    return out.head()["total"]


def test_sums_keep_all_digits(spark):
    assert rolled(spark, [1e-7] * 10) == float(sum([Fraction(1e-7)] * 10)) and abs(rolled(spark, [1e-7] * 10) - 1e-6) < 1e-21
    assert abs(rolled(spark, [0.1234567] * 3) - 0.3703701) < 1e-15
    assert rolled(spark, [1e33, 1.0, -1e33]) == 1.0 and rolled(spark, [1e33, 2.0]) == 1e33 and rolled(spark, [1e-300, 1e300, -1e300]) == 1e-300
    assert rolled(spark, [5e-324, 5e-324]) == 1e-323 and rolled(spark, [1e308, 1e308]) == float("inf") and rolled(spark, [1.7e308]) == 1.7e308
    assert str(rolled(spark, [float("nan"), 1.0])) == "nan" and rolled(spark, [float("inf"), 1.0]) == float("inf") and str(rolled(spark, [float("inf"), float("-inf")])) == "nan"
    assert rolled(spark, [None, None]) == 0.0 and rolled(spark, [0.0, -0.0]) == 0.0 and rolled(spark, [0.5, None, 0.25]) == 0.75
    assert rolled(spark, [0.1, 0.2, None], expression="avg(v)") == float((Fraction(0.1) + Fraction(0.2)) / 2)
    assert rolled(spark, [0.5, 0.25], kind="float") == 0.75 and rolled(spark, [3, 4], kind="int") == 7


def test_random_sums(spark):
    random.seed(2)
    for _ in range(3):
        values = [random.choice([-1, 1]) * random.random() * 10.0 ** random.randint(-20, 25) for _ in range(200)]
        values += [-v for v in values[:150]]
        random.shuffle(values)
        assert rolled(spark, values) == float(sum(map(Fraction, values)))


def test_windows(spark):
    values = [1.0, 255.99999999999997, 256.0, 2.0**-1074, 1.7976931348623157e308, -3.5, 0.1]
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("w", sums.window_of(F.col("v"))).withColumn("u", sums.units_of(F.col("v"), F.col("w"))).collect()
    assert all(Fraction(r["v"]) == int(r["u"]) * Fraction(2) ** (r["w"] * sums.WINDOW - sums.BITS) for r in rows)


def test_old_values_and_types_stay(spark):
    target = spark.createDataFrame([(1, Decimal("0.0000000456")), (2, Decimal("0.0000000789")), (3, None)], "id long, total decimal(38,10)")
    source = spark.createDataFrame([(1, Decimal("0.0000000001")), (1, Decimal("0.0000000002"))], "fk long, v decimal(38,10)")
    out = recompute.apply_write_backs(target, "id", source, [WriteBack("total", "sum(v)", "fk")])
    assert out.schema["total"].dataType.simpleString() == "decimal(38,10)"
    assert {r["id"]: r["total"] for r in out.collect()} == {1: Decimal("0.0000000003"), 2: Decimal("0.0000000789"), 3: None}
    # A double's sum is put into the target's own type.
    doubles = spark.createDataFrame([(1, 0.25)], "fk long, v double")
    assert {r["id"]: r["total"] for r in recompute.apply_write_backs(target, "id", doubles, [WriteBack("total", "sum(v)", "fk")]).collect()}[2] == Decimal("0.0000000789")
    with pytest.raises(PySparkException):
        big = [(1, Decimal("9" * 38)), (1, Decimal("9" * 38))]
        recompute.apply_write_backs(target, "id", spark.createDataFrame(big, "fk long, v decimal(38,0)"), [WriteBack("total", "sum(v)", "fk")]).collect()


def test_compound_rules_and_any_names(spark):
    target = spark.createDataFrame([(1, 7, 0.0), (2, 8, 1.5)], "id long, hit0 long, agg0 double").withColumnRenamed("hit0", "__hit0")
    source = spark.createDataFrame([(1, 2.5, 4, None), (1, 0.5, 6, None), (None, 9.0, 1, 1.0)], "fk long, x double, n int, z double")
    rules = ["sum(t.x) - sum(z)", "coalesce(sum(x), 0)", "max(n) + count(*)", "abs(sum(-x)) * min(n)", "avg(n)", "sum(n) / count(n)"]
    out = recompute.apply_write_backs(target, "id", source, [WriteBack(f"c{i}", r, "fk") for i, r in enumerate(rules)] + [WriteBack("agg0", "sum(x)", "fk", "n > 5")])
    assert out.columns == ["id", "__hit0", "agg0", "c0", "c1", "c2", "c3", "c4", "c5"]
    assert {tuple(r) for r in out.collect()} == {(1, 7, 0.5, 3.0, 3.0, 8, 12.0, 5.0, 5), (2, 8, 1.5, None, None, None, None, None, None)}


def test_texts():
    assert texts.split_at("a, f(b, c), 'x, (y', d", ",") == ["a", "f(b, c)", "'x, (y'", "d"]
    assert texts.unqualified("abs(t.x) + app.t.y * 1.5 || 'p.q' + s.f + f.g(z)", ["s", "x"]) == "abs(x) + y * 1.5 || 'p.q' + s.f + f.g(z)"
    assert texts.split_aggregates("sum(x) - coalesce(SUM( x ), 'sum(y)') + count(*)", ["agg0"]) == ("_agg0 - coalesce(_agg0, 'sum(y)') + agg1", {"_agg0": ("sum", "x"), "agg1": ("count", "*")})
    assert texts.split_subqueries("a + ( select b from c where d = (e)) * '(select'") == (["a + ", " * '(select'"], ["select b from c where d = (e)"])
    assert texts.unused(["a", "_A"], "a", "b") == ["__a", "b"]


#: The two forms of correlated subqueries in sample formulas: looked up by the row's key, and added up over rows that have it.
LOOKUP = """CASE WHEN 'K1' = ( SELECT business_type FROM contract WHERE item.contract_id = contract.ID ) THEN status_str WHEN is_free = 'f' and ( dir + frame ) = 0 THEN 'none'
 WHEN is_free = 'f' and abs(abs(amount)) * ( 1 - ( SELECT rate FROM contract WHERE item.contract_id = contract.ID ) ) <= abs( ( dir + frame ) ) THEN 'all'
 WHEN is_free = 'f' and abs(amount) * ( 1 - ( SELECT rate FROM contract WHERE item.contract_id = contract.ID ) ) > abs(dir + frame) THEN 'part' ELSE 'other' END"""
ROLLED = """case when state in ('effective','submitted') then (case when coalesce((select abs(sum(tax.amount)) from tax where item.id=tax.item_id and tax.gone=false),0) >= abs(amount) then 'all'
 when coalesce((select sum(tax.amount) from tax where item.id=tax.item_id and tax.gone=false),0) =0 then 'none' else 'part' end) else 'none' end"""
COUNTED = "(select count(*) from tax where tax.item_id = item.id and amount > 1) + (select coalesce(max(amount), -1) from tax x where x.item_id = id)"


def test_subqueries_give_what_sql_gives(spark):
    random.seed(1)
    items = [(i, random.choice([1, 2, 3, 9, None]), random.random() < 0.5, random.choice([0.0, 1.0, 5.0]), random.choice([0.0, 4.0]), random.choice([-5.0, 2.0, None]), random.choice(["effective", "x"]), f"s{i}") for i in range(60)]
    contracts = [(1, "K1", 0.5), (2, "K2", 0.25), (3, None, None)]
    tax = [(random.choice([*range(0, 60, 2), None]), random.choice([-3.0, 1.0, 2.0, None]), random.random() < 0.3) for _ in range(90)]
    schemas = {"item": "id long, contract_id long, is_free boolean, dir double, frame double, amount double, state string, status_str string", "contract": "ID long, business_type string, rate double", "tax": "item_id long, amount double, gone boolean"}
    frames = {t: spark.createDataFrame(rows, schemas[t]) for t, rows in (("item", items), ("contract", contracts), ("tax", tax))}
    out = recompute.apply_triggers(frames["item"], {"a": LOOKUP, "b": ROLLED, "c": COUNTED}, tables=frames.__getitem__)
    assert out.columns == [*frames["item"].columns, "a", "b", "c"]
    got = sorted(tuple(r) for r in out.select("id", "a", "b", "c").collect())
    db = duckdb.connect()
    for t, df in frames.items():
        db.register(t, df.toPandas())
    boolean = LOOKUP.replace("is_free = 'f'", "is_free = false")
    want = db.sql(f"SELECT id, {boolean} AS a, {ROLLED} AS b, {COUNTED} AS c FROM item ORDER BY id").fetchall()
    assert got == want and len({r[1] for r in got}) > 4 and {r[2] for r in got} == {"all", "none", "part"}
    # All subqueries on one table with one key and condition are one join.
    plan = recompute.apply_triggers(frames["item"], {"a": LOOKUP, "b": ROLLED}, tables=frames.__getitem__)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


def test_subqueries_that_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "id long, k long")
    tables = {"t": spark.createDataFrame([(2, 5), (2, 6)], "k long, v long")}
    with pytest.raises(PySparkException, match="more than one row"):
        recompute.apply_trigger(df, "x", "(select v from t where t.k = d.k)", tables=tables.__getitem__).collect()
    for formula in ("(select v from t where t.k > d.k)", "(select v from t)", "(select v from t where t.k = d.k and t.v < d.id)", "(select v from t where t.k = d.k and v = (select 1 from t))"):
        with pytest.raises(ValueError):
            recompute.apply_trigger(df, "x", formula, tables=tables.__getitem__)
    with pytest.raises(ValueError):
        recompute.apply_trigger(df, "x", "(select v from t where t.k = d.k)")
    assert recompute.apply_trigger(df, "x", "abs(t.k - t.id)").head()["x"] == 1


def test_tables_of_objects():
    assert [recompute.object_of(t, ["InvoiceItem", "Item", "Tax"]) for t in ("invoice_item", "app_invoice_item", "tax", "ITEM")] == ["InvoiceItem", "InvoiceItem", "Tax", "Item"]
    with pytest.raises(ValueError):
        recompute.object_of("none", ["Tax"])
