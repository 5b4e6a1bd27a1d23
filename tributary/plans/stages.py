"""Long plans in stages: what a stage changes is written before the next one begins, and a run that ended early goes on behind its last whole stage.

    path/plan          the steps that can run, numbered: what the run is held to
    path/tables/O/n    object O's table as stage n left it
    path/stages/n      stage n is whole: the last step it ran, and which stage each changed table is to be read from

A stage's own entry is written last, so a stage that was cut off is done again, over what it had written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators.loops import counted, numbered
from .recompute import apply_group, fuse_updates, runnable_steps

#: Steps of a stage at most, so that the driver never holds more of a plan, and no table's transformations grow longer.
STAGE_STEPS = 500


def _files(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path has come to its end."""
    files, there = _files(spark, f"{path}/_SUCCESS")
    return files.exists(there)


def _last_stage(spark: SparkSession, path: str) -> int:
    """The last whole stage, by the names of folders; 0 if there is none."""
    files, there = _files(spark, f"{path}/stages")
    found = [f.getPath().getName() for f in files.listStatus(there)] if files.exists(there) else []
    return max((int(n) for n in found if n.isdigit() and _whole(spark, f"{path}/stages/{n}")), default=0)


def _remove(spark: SparkSession, path: str) -> None:
    files, there = _files(spark, path)
    files.delete(there, True)


def _mark(plan: DataFrame) -> tuple[int, int | None]:
    """A plan's number of steps and a hash of them all, whatever their order in files."""
    return tuple(plan.agg(F.count("*"), F.bit_xor(F.xxhash64(*sorted(plan.columns)))).head())


def _numbered_plan(plan: DataFrame, objects: Sequence[str], path: str) -> DataFrame:
    """The runnable steps with their place, from the path if they are there already; another plan's are an error."""
    spark = plan.sparkSession
    runnable, n = counted(runnable_steps(plan, objects))
    if _whole(spark, f"{path}/plan"):
        kept = spark.read.parquet(f"{path}/plan")
        if _mark(kept.drop("place")) != _mark(runnable):
            raise ValueError(f"{path} holds the stages of another plan")
        return kept
    numbered(runnable, ("step",), "place", n).write.mode("overwrite").parquet(f"{path}/plan")
    return spark.read.parquet(f"{path}/plan")


def _next_stage(groups: Sequence[Sequence[Mapping]]) -> int:
    """How many of these groups make a stage: those before the first that reads a table, other than its own, that one of them changes. So what is read more than once is written first."""
    changed: set[str] = set()
    for i, group in enumerate(groups):
        others = {o for o in changed if o.lower() != group[0]["object"].lower()}
        if group[0]["rule"] is None:
            # A formula names tables, not objects, so one with a subselect waits for all other tables.
            late = bool(others) and any(texts.split_subqueries(s["formula"])[1] for s in group)
        else:
            late = group[0]["rule"]["source"] in others
        if late:
            return i
        changed.add(group[0]["object"])
    return len(groups)


def run_plan_in_stages(
    plan: DataFrame, tables: Mapping[str, DataFrame], ids: Mapping[str, str], path: str, functions: Mapping[str, Callable[..., Column]] | None = None, steps: int = STAGE_STEPS, stages: int | None = None
) -> dict[str, DataFrame]:
    """The tables after the plan, as `run_plan` gives them, for plans of any number of steps. The changed ones are read from what the last stages wrote.

    path: a folder that all executors share, this run's own. If it holds whole stages of the same plan they aren't run again; the tables given must then be the same as before. A folder with another plan's stages is an error.
    steps: a stage's steps at most. stages: how many stages to run now, for runs in slices of time; what is given back is the state behind them. None: all.
    A stage's tables are written whole; versions that no later stage reads any more are removed once the stage that replaced them is whole. Tables without a change are given back as they came.
    """
    spark = plan.sparkSession
    numbered_plan = _numbered_plan(plan, list(tables), path)
    out, read_from, done = dict(tables), {}, 0
    stage = _last_stage(spark, path)
    if stage:
        state = spark.read.parquet(f"{path}/stages/{stage}").collect()  # a row for each changed table
        done, read_from = state[0]["done"], {r["object"]: r["stage"] for r in state}
    at = lambda o, s: f"{path}/tables/{quote(o, safe='')}/{s}"
    out |= {o: spark.read.parquet(at(o, s)) for o, s in read_from.items()}
    ran = 0
    while stages is None or ran < stages:
        batch = [r.asDict(recursive=True) for r in numbered_plan.where(F.col("place").between(done + 1, done + steps)).orderBy("place").collect()]
        if not batch:
            break
        groups = fuse_updates(batch)
        groups = groups[: _next_stage(groups)]
        stage, ran = stage + 1, ran + 1
        changed = {}
        for group in groups:
            after = apply_group(group, out | changed, ids, functions)
            if after is not None:
                changed[group[0]["object"]] = after
        for o, df in changed.items():
            df.write.mode("overwrite").parquet(at(o, stage))
        done = groups[-1][-1]["place"]
        before = {o: read_from[o] for o in changed if o in read_from}
        read_from |= dict.fromkeys(changed, stage)
        # A stage whose steps all lack their source's table changes nothing; its entry has no object.
        rows = [(o, s, done) for o, s in read_from.items()] or [(None, None, done)]
        spark.createDataFrame(rows, "object string, stage int, done long").coalesce(1).write.mode("overwrite").parquet(f"{path}/stages/{stage}")
        out |= {o: spark.read.schema(df.schema).parquet(at(o, stage)) for o, df in changed.items()}
        for o, s in before.items():
            _remove(spark, at(o, s))
    return out
