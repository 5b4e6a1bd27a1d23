"""Long plans in stages: the same tables as in one pass, and runs that go on where they ended."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tributary.plans import recompute
from tributary.plans.recompute import run_plan
from tributary.plans.stages import run_plan_in_stages

PLAN = "step long, node string, object string, field string, level int, role string, active boolean, in_cycle boolean, status string, column string, formula string, rule struct<source: string, key: string, expression: string, condition: string>"
IDS = {"Line": "id", "Bill": "id", "Owner": "id"}


def step(n, object_type, column, formula=None, rule=None):
    return (n, f"{object_type}.{column}", object_type, column, n, "INTRA" if formula else "WRITE_BACK", True, False, "run", column, formula, rule)


def frames(spark):
    return {
        "Line": spark.createDataFrame([(i, i % 5, float(i)) for i in range(40)], "id long, bill long, v double"),
        "Bill": spark.createDataFrame([(i, i % 2, 1.5) for i in range(6)], "id long, owner long, extra double"),
        "Owner": spark.createDataFrame([(i, "x") for i in range(3)], "id long, note string"),
    }


def mixed(spark):
    rows = [
        step(1, "Line", "net", "v * 2"), step(2, "Line", "gross", "net + 1"), step(3, "Bill", "total", None, ("Line", "bill", "sum(net)", None)), step(4, "Bill", "most", None, ("Line", "bill", "max(gross)", "v > 3")),
        step(5, "Bill", "both", "total + coalesce(extra, 0)"), step(6, "Owner", "owned", None, ("Bill", "owner", "sum(both)", None)), step(7, "Line", "share", "net / (select total from bill where bill.id = line.bill)"),
        step(8, "Owner", "lost", None, ("Nobody", "owner", "sum(x)", None)), step(9, "Owner", "twice", "owned * 2"),
    ]
    return spark.createDataFrame(rows, PLAN)


def contents(tables):
    return {o: sorted(map(str, df.select(*sorted(df.columns)).collect())) for o, df in tables.items()}


def stages_of(path):
    return sorted(int(n) for n in os.listdir(f"{path}/stages"))


@pytest.mark.parametrize("steps", [1, 2, 500])
def test_stages_give_what_one_pass_gives(spark, steps):
    path = tempfile.mkdtemp(prefix="spark-")
    want = contents(run_plan(mixed(spark), frames(spark), IDS))
    assert contents(run_plan_in_stages(mixed(spark), frames(spark), IDS, path, steps=steps)) == want
    # Run again, all is there already.
    before = stages_of(path)
    assert contents(run_plan_in_stages(mixed(spark), frames(spark), IDS, path, steps=steps)) == want and stages_of(path) == before
    # Of each table only the last version is kept.
    assert all(len(os.listdir(f"{path}/tables/{o}")) == 1 for o in os.listdir(f"{path}/tables"))
    if steps == 500:
        assert before == [1, 2, 3, 4]  # lines; bills; owners; lines' share, which waits for bills, and owners' last


def test_a_run_that_failed_goes_on(spark):
    path, calls = tempfile.mkdtemp(prefix="spark-"), []

    def broken(value):
        calls.append(1)
        return F.raise_error(F.lit("lost")).cast("double") + value

    hooked = mixed(spark).withColumn("formula", F.when(F.col("step") == 9, F.lit("hook(owned)")).otherwise(F.col("formula")))
    with pytest.raises(Exception, match="lost"):
        run_plan_in_stages(hooked, frames(spark), IDS, path, {"hook": broken})
    done = stages_of(path)
    assert done and calls
    stamp = {n: os.stat(f"{path}/stages/{n}/_SUCCESS").st_mtime_ns for n in done}
    # A stage cut off while it wrote its entry isn't whole.
    os.makedirs(f"{path}/stages/{done[-1] + 1}")
    out = run_plan_in_stages(hooked, frames(spark), IDS, path, {"hook": lambda value: value * 2})
    assert contents(out) == contents(run_plan(mixed(spark), frames(spark), IDS))
    assert stamp == {n: os.stat(f"{path}/stages/{n}/_SUCCESS").st_mtime_ns for n in done}


def test_slices_and_other_plans(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    part = run_plan_in_stages(mixed(spark), frames(spark), IDS, path, stages=1)
    assert "gross" in part["Line"].columns and "total" not in part["Bill"].columns
    with pytest.raises(ValueError, match="another plan"):
        run_plan_in_stages(mixed(spark).where("step < 9"), frames(spark), IDS, path)
    assert contents(run_plan_in_stages(mixed(spark), frames(spark), IDS, path)) == contents(run_plan(mixed(spark), frames(spark), IDS))
    empty = run_plan_in_stages(mixed(spark).limit(0), frames(spark), IDS, tempfile.mkdtemp(prefix="spark-"))
    assert contents(empty) == contents(frames(spark))


def test_five_thousand_steps(spark):
    n_columns, rounds = 250, 20
    rows = [step(r * n_columns + c + 1, "T", f"c{c}", f"c{c} + {r}") for r in range(rounds) for c in range(n_columns)]
    plan = spark.createDataFrame(rows, PLAN)
    table = spark.range(3).select("id", *(F.lit(c).alias(f"c{c}") for c in range(n_columns)))
    with pytest.raises(ValueError, match="stages"):
        run_plan(plan, {"T": table}, {"T": "id"})
    path = tempfile.mkdtemp(prefix="spark-")
    out = run_plan_in_stages(plan, {"T": table}, {"T": "id"}, path)["T"]
    assert stages_of(path) == list(range(1, 11))
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(i, *(c + sum(range(rounds)) for c in range(n_columns))) for i in range(3)]
    assert recompute.MOST_STEPS < len(rows)
