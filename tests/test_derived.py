from tributary.operators.edges import downstream_edges
from tributary.sources import derived
from tributary.sources.catalog import scan_view_definitions, views

SF = "/root/testdata/sf0.001"


def test_catalog(spark):
    c = derived.large_catalog(spark, SF)
    assert c.fields.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    _, texts, rejects = views(c, scan_view_definitions(c, ["sales", "finance", "stock", "hr"]))
    rels = {r["rel"]: r["count"] for r in downstream_edges(c, texts).groupBy("rel").count().collect()}
    assert rejects.isEmpty() and set(rels) == {"intra", "writeBack", "view"}
