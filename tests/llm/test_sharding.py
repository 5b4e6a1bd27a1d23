import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import sharding


def by_turns(shards, slots):
    """The table by whole lists of preference."""
    order = [[(sharding._number(s, "offset") + k * (sharding._number(s, "skip") % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    assert all(sorted(o) == list(range(slots)) for o in order)
    owner, turn = {}, 0
    while len(owner) < slots:
        owner[next(x for x in order[turn % len(shards)] if x not in owner)] = turn % len(shards)
        turn += 1
    return [owner[k] for k in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 7), (3, 13), (5, 101), (7, 7)])
def test_table(n, slots):
    shards = [f"s{i}" for i in range(n)]
    assert sharding.lookup_table(shards, slots).tolist() == by_turns(shards, slots)


def test_even_and_stable():
    shards = [f"s{i}" for i in range(20)]
    full, less = sharding.lookup_table(shards, 10_007), sharding.lookup_table(shards[:-1], 10_007)
    shares = np.bincount(full)
    assert shares.max() - shares.min() <= 1
    assert ((full != less) & (full != 19)).mean() < 0.05


def test_bad_arguments():
    for shards, slots in ((["a"], 8), ([], 7), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, slots)


def test_assign(spark):
    df = spark.createDataFrame([(1, "a", "x"), (None, None, "y"), (1, "a", "z"), (None, None, "q")], "k long, shard string, slot string")
    rows = sharding.assign_shards(df, ["k"], ["p", "q", "r"], 101).collect()
    assert len(rows) == 4 and all(r["shard"] in "pqr" and 0 <= r["slot"] < 101 for r in rows)
    table = sharding.lookup_table(["p", "q", "r"], 101)
    assert all(r["shard"] == "pqr"[table[r["slot"]]] for r in rows)
    assert len({r["shard"] for r in rows if r["k"] == 1}) == 1
    assert sharding.assign_shards(df.limit(0), ["k"], ["p"], 7).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.range(3000, numPartitions=6).select((F.col("id") % 7).alias("k"), F.lit("same").alias("files"))
    placed = sharding.assign_shards(df, ["k"], ("a", "b", "c"), 101)
    sharding.write_shards(placed, f"{tmp_path}/s", rows_per_file=200)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(tuple, back.select("k", "files", "slot", "shard").collect())) == sorted(map(tuple, placed.select("k", "files", "slot", "shard").collect()))
    for shard in ("a", "b", "c"):
        rows = placed.where(F.col("shard") == shard).count()
        assert len(list((tmp_path / "s" / f"shard={shard}").glob("part-*"))) >= rows / 200 if rows else True
