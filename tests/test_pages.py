"""Lists in pages, against whole lists."""

from collections import defaultdict

from pyspark.sql import functions as F

from tributary.operators import edges, health, loops, pages
from tributary.sources import derived

ROWS = [("a", None, f"i{i % 7}") for i in range(23)] + [("b", "x", None)] + [(None, "y", f"j{i}") for i in range(4)] + [("c", "x", "only")]


def joined(found, keys):
    """Each key's pages put together, and the sizes of all pages but the last, in order of their numbers, which have no gap."""
    of = defaultdict(list)
    for r in found.collect():
        of[tuple(r[k] for k in keys)].append((r["page"], r["items"]))
    assert all([n for n, _ in sorted(v)] == list(range(len(v))) for v in of.values())
    return {k: [i for _, items in sorted(v) for i in items] for k, v in of.items()}, {k: [len(items) for _, items in sorted(v)] for k, v in of.items()}


def test_pages_are_the_list(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "page string, place string, item string").repartition(5)
    want = defaultdict(list)
    for a, b, i in ROWS:
        if i is not None:
            want[a, b].append(i)
    want = {k: sorted(v) for k, v in want.items()}
    for bound in (loops.LAST_EDGES, 0):  # few rows in one task; ranges of the order
        monkeypatch.setattr(loops, "LAST_EDGES", bound)
        for size in (1, 4, 100):
            found = pages.pages(df.toDF("p", "first", "item"), ("p", "first"), size=size)
            assert found.columns == ["p", "first", "page", "items"]
            lists, sizes = joined(found, ("p", "first"))
            assert lists == want
            assert all(n == size for s in sizes.values() for n in s[:-1]) and all(0 < s[-1] <= size for s in sizes.values())
    assert pages.pages(df.limit(0), ("place",)).collect() == []


def test_audits_in_pages(spark):
    catalog = derived.large_catalog(spark, "/root/testdata/sf0.001")
    health_lists, _ = joined(health.object_health_pages(catalog.fields, 2), ("object_type", "list"))
    whole = health.object_health(catalog.fields).collect()
    assert health_lists == {(r["object_type"], n): r[n] for r in whole for n in ("dead_fields", "write_back_unreferenced_fields") if r[n]}
    profile_lists, _ = joined(health.object_profile_pages(catalog, 2), ("object_type", "list"))
    whole = health.object_profile(catalog).collect()
    assert profile_lists == {(r["object_type"], n): r[n] for r in whole for n in ("write_back", "virtual", "trigger", "base", "amount", "quantity") if r[n]}
    used = edges.intra_edges(catalog.fields)
    triggers, _ = joined(health.trigger_summary_pages(catalog, used, 1), ("object_type", "source_object", "field"))
    whole = health.trigger_summary(catalog, used).where("triggers <> ''").collect()
    assert {k: ", ".join(v) for k, v in triggers.items()} == {(r["object_type"], r["source_object"], r["field"]): r["triggers"] for r in whole}


def test_one_object_with_most_fields(spark, monkeypatch):
    """Its pages are bounded, and no list of it is made on the way."""
    monkeypatch.setattr(loops, "LAST_EDGES", 0)
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("o"), F.col("id") % 500)).alias("object"), F.format_string("f%06d", "id").alias("item"))
    found = pages.pages(rows, ("object",)).withColumn("n", F.size("items"))
    big = {r["page"]: r["n"] for r in found.where("object = 'big'").collect()}
    assert big == dict.fromkeys(range(10), 1000) and found.agg(F.max("n"), F.sum("n")).head() == (1000, 30_000)
