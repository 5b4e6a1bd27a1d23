"""Columns and tables of views' SQL texts."""

import pytest

from tributary.operators import views

LINEAGE = [
    ("select a.x as y, coalesce(b.z, 0) as w, case when a.q = 1 then a.r else b.s end k from u b join t a on a.id = b.id", {("y", "t", "x"), ("w", "u", "z"), ("k", "t", "q"), ("k", "t", "r"), ("k", "u", "s")}),
    ('select "A"."x" as "y z", `A`.`select` n from "T" as "A"', {("y z", "T", "x"), ("n", "T", "select")}),
    # Without SELECT; types, functions and parts of dates are no columns, items without a name are left out.
    ("a.x y, sum(a.v) total, count(*), cast(a.k as decimal(10, 2)) d, extract(year from a.day) yr, a.m::text m2, 'x, (y' lit, a.p + 1, a.* from public.app_o a where z = 1", {("y", "app_o", "x"), ("total", "app_o", "v"), ("d", "app_o", "k"), ("yr", "app_o", "day"), ("m2", "app_o", "m")}),
    # A column without qualifier belongs to the only table of its own select.
    ("select x, y + 1 as y from t", {("x", "t", "x"), ("y", "t", "y")}),
    ("select x from t, u", {("x", "UNKNOWN", "x")}),
    ("select q.x from t", {("x", "q", "x")}),
    # An alias of one subselect doesn't reach another; one of the select around does.
    ("select (select sum(v.x) total from w v where v.id = a.id) s, (select v.n from p where m = 1) n from app_t a", {("s", "w", "x"), ("s", "w", "id"), ("s", "app_t", "id"), ("n", "v", "n"), ("n", "p", "m")}),
    ("select d.n from (select e.n, o from f e) d", {("n", "d", "n")}),
    # The last item of a name counts.
    ("select a.x as y, a.z as y from t a", {("y", "t", "z")}),
    ("select ${SystemFields}, a.b -- why, a.c\n, /* a.c, */ a.d from t a group by a.e order by a.f", {("b", "t", "b"), ("d", "t", "d")}),
    ("SELECT DISTINCT f(g(a.x, 'it''s'), (a.y)) AS 'both' FROM t a", {("both", "t", "x"), ("both", "t", "y")}),
    ("select sum(a.x) over (partition by a.p order by a.o desc) w, -a.n m from t a", {("w", "t", "x"), ("w", "t", "p"), ("w", "t", "o"), ("m", "t", "n")}),
    ("select a.金额 as 合计 from t a", {("合计", "t", "金额")}),
]


def frame(spark, *texts):
    return spark.createDataFrame([(f"v{i}", t) for i, t in enumerate(texts)], "view_name string, sql string")


def test_lineage(spark):
    lineage, rejects = views.view_column_lineage(frame(spark, *(t for t, _ in LINEAGE)))
    got = {}
    for r in lineage.collect():
        got.setdefault(r["view_name"], []).append((r["output"], r["table"], r["column"]))
    for i, (text, want) in enumerate(LINEAGE):
        assert sorted(got.get(f"v{i}", [])) == sorted(want), text
    assert rejects.isEmpty()


def test_rejects(spark):
    texts = frame(spark, "select x from a union select y from b", "select (x from a", "select x) from a", "", "select 1", None)
    lineage, rejects = views.view_column_lineage(texts.union(texts))
    assert lineage.isEmpty() and {(r["view_name"], r["reason"]) for r in rejects.collect()} == {("v0", "union"), ("v1", "brackets"), ("v2", "brackets"), ("v3", "not a select"), ("v4", "not a select")}
    assert rejects.count() == 5


@pytest.mark.parametrize("text,want", [
    ("select x, y from t where z = 1", {("t", "x"), ("t", "y"), ("t", "z")}),
    ("select a.x from t a join u on a.id = u.id left join v b on b.k = a.k order by a.o", {("t", "x"), ("t", "id"), ("u", "id"), ("v", "k"), ("t", "k")}),
    ("select x from t where exists (select 1 from w v where v.id = t.id and q = 2) and k in (select k from z)", {("t", "x"), ("w", "id"), ("t", "id"), ("w", "q"), ("t", "k"), ("z", "k")}),
    ("select d.n from t a join (select e.n, o from f e) d on d.n = a.n, bare", {("d", "n"), ("t", "n"), ("f", "n"), ("f", "o"), ("bare", None)}),
    ("select x from a union select y from b", set()),
])
def test_dependencies(spark, text, want):
    got = views.sql_dependencies(frame(spark, text)).collect()
    assert {(r["table"], r["column"]) for r in got} == want and len(got) == len(want)


def test_deep_subselects(spark):
    """Each subselect sees the aliases around it, the nearest first."""
    text = "select x from t0 a where 1 = (select 1 from t1 b where 1 = (select 1 from t2 a where a.p = b.q and 1 = (select 1 from t3 c where a.r = 1 and c.s = 1)) and a.u = 1)"
    got = {(r["table"], r["column"]) for r in views.sql_dependencies(frame(spark, text)).collect()}
    assert got == {("t0", "x"), ("t2", "p"), ("t1", "q"), ("t2", "r"), ("t3", "s"), ("t0", "u")}
