import random
import time
from collections import defaultdict
from pathlib import Path

import pytest

from tributary.operators import graph, loops
from tributary.plans import recompute
from tributary.sources import derived


def frame(spark, edges, rel="intra"):
    return spark.createDataFrame([(a.split(".")[0], a.split(".")[-1], b.split(".")[0], b.split(".")[-1], a, b, rel) for a, b in edges], "src_object string, src_field string, dst_object string, dst_field string, src string, dst string, rel string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def pairs(edges):
    return {(r["src"], r["dst"]) for r in edges.collect()}


def levels(nodes):
    return {r["id"]: r["level"] for r in nodes.collect()}


CHAIN = [("a", "b"), ("b", "c"), ("c", "d")]
KAHN = [("1", "2"), ("1", "3"), ("2", "4"), ("3", "4"), ("4", "5"), ("a", "3"), ("b", "a"), ("x", "4"), ("4", "o"), ("o", "5")]


def test_depth_and_back_edges(spark):
    nodes, edges = graph.impact(frame(spark, CHAIN), ids(spark, "a"), 2)
    assert levels(nodes) == {"a": 0, "b": 1, "c": 2} and pairs(edges) == {("a", "b"), ("b", "c")}
    nodes, edges = graph.impact(frame(spark, [("a", "b"), ("b", "a")]), ids(spark, "a"), 2)
    assert levels(nodes) == {"a": 0, "b": 1} and len(pairs(edges)) == 2
    nodes, edges = graph.impact(frame(spark, CHAIN), ids(spark, "a", "c"), 1)
    assert set(levels(nodes)) == set("abcd") and pairs(edges) == {("a", "b"), ("c", "d")}
    nodes, edges = graph.trace(frame(spark, CHAIN), ids(spark, "d", "unknown"), 2)
    assert levels(nodes) == {"d": 0, "c": 1, "b": 2, "unknown": 0} and pairs(edges) == {("c", "d"), ("b", "c")}


def test_peel_and_order(spark):
    edges = frame(spark, KAHN)
    nodes = ids(spark, *{x for e in KAHN for x in e})
    found, rest = loops.peel(nodes, edges)
    assert levels(found) == {"1": 0, "b": 0, "x": 0, "2": 1, "a": 1, "3": 2, "4": 3, "o": 4, "5": 5} and rest.isEmpty()
    assert {r["id"]: r["depth"] for r in graph.longest_depth(edges, ids(spark, "b")).collect()} == {"b": 0, "a": 1, "3": 2, "4": 3, "o": 4, "5": 5}
    chains = {r["root"]: (r["length"], r["path"]) for r in graph.deep_chains(edges, 5).collect()}
    assert chains == {"b": (5, "b -> a -> 3 -> 4 -> o -> 5")}


def test_cycles(spark):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")])
    assert {(r["id"], r["component"]) for r in graph.cycles(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e")}
    order = {r["id"]: r["in_cycle"] for r in graph.topological_order(ids(spark, *"abcde"), edges).collect()}
    assert order == {"a": True, "b": True, "c": True, "d": True, "e": True}


def components(nodes, edges):
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in to[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    out = {}
    for n in nodes:
        own = {m for m in reach[n] if n in reach[m]}
        if len(own | {n}) > 1 or n in to[n]:
            out[n] = min(own | {n})
    return out


@pytest.mark.parametrize("seed,last", [(1, 100_000), (2, 2)])
def test_random_graphs(spark, monkeypatch, seed, last):
    monkeypatch.setattr(loops, "LAST_EDGES", last)
    random.seed(seed)
    names = [f"n{i:02d}" for i in range(24)]
    edges = list({(random.choice(names), random.choice(names)) for _ in range(30)})
    nodes = sorted({x for e in edges for x in e})
    df = frame(spark, edges)
    want = components(nodes, edges)
    assert {r["id"]: r["component"] for r in graph.cycles(df).collect()} == want
    root = edges[0][0]
    level, frontier = {root: 0}, [root]
    while frontier:
        new = {b for a, b in edges if a in frontier} - set(level)
        level |= {x: level[frontier[0]] + 1 for x in new}
        frontier = list(new)
    assert levels(loops.bfs(df, ids(spark, root))) == level
    free = [(a, b) for a, b in edges if not (want.get(a) and want.get(a) == want.get(b))]
    longest = {n: 0 for n in nodes}
    for _ in nodes:
        for a, b in free:
            longest[a] = max(longest[a], longest[b] + 1)
    starts = set(nodes) - {b for _, b in free}
    got = {r["root"]: r["length"] for r in graph.deep_chains(df, 1).collect()}
    assert got == {n: longest[n] for n in starts if longest[n] >= 1}


def test_explain(spark):
    fields = spark.createDataFrame([("1", "O", "b", None, None, None, None, None, "a + 1", None, None, None)], "id string, object_type string, name string, api_name string, title string, type string, biz_type string, expression string, trigger_expr string, virtual_expr string, write_back_expr string, refer_info string")
    edges = frame(spark, [("O.a", "O.b"), ("O.b", "O.c"), ("O.a", "O.c"), ("O.c", "O.d")])
    got = {r["id"]: r for r in graph.explain(edges, ids(spark, "O.a"), fields, 3).collect()}
    assert {k: r["path_len"] for k, r in got.items()} == {"O.b": 1, "O.c": 1, "O.d": 2}
    assert got["O.b"]["steps"][0]["reason"] == "computed as a + 1, contains a"
    assert got["O.d"]["path"] == "O.a --[intra]--> O.c → O.c --[intra]--> O.d"
    back = {r["id"]: r["path_len"] for r in graph.explain(edges, ids(spark, "O.d"), fields, 3, reverse=True).collect()}
    assert back == {"O.c": 1, "O.b": 2, "O.a": 2}


def jobs_of(spark, run):
    """What run gives, and how many jobs it took."""
    group = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A long path, short ones beside it, a branch off it, a ring and what is behind it, and a chain into a cycle."""
    monkeypatch.setattr(loops, "LAST_EDGES", 20)
    path = [(f"p{k}", f"p{k + 1}") for k in range(3000)]
    short = [(f"s{k}", f"t{k}") for k in range(200)]
    branch = [("p1000", "b0"), *((f"b{k}", f"b{k + 1}") for k in range(2500)), ("b2500", "p2000")]
    ring = [(f"r{k}", f"r{(k + 1) % 40}") for k in range(40)]
    cycle = [(f"c{k}", f"c{k + 1}") for k in range(30)] + [("c30", "c10"), ("c20", "d0"), ("d0", "d1"), ("d1", "d2")]
    all_edges = path + short + branch + ring + cycle
    edges = frame(spark, all_edges)
    nodes = ids(spark, *{x for e in all_edges for x in e})
    (found, rest), n = jobs_of(spark, lambda: tuple(x.collect() for x in loops.peel(nodes, edges)))
    want = {f"p{k}": k if k < 2000 else k + 1502 for k in range(3001)} | {f"b{k}": 1001 + k for k in range(2501)} | {f"s{k}": 0 for k in range(200)} | {f"t{k}": 1 for k in range(200)} | {f"c{k}": k for k in range(10)}
    assert {r["id"]: r["level"] for r in found} == want
    assert {r["id"] for r in rest} == {f"r{k}" for k in range(40)} | {f"c{k}" for k in range(10, 31)} | {"d0", "d1", "d2"}
    # One round would take a job for each of 4,500 levels; adaptive execution counts each of a round's exchanges as a job.
    assert n < 400


def test_random_levels_with_chains(spark, monkeypatch):
    monkeypatch.setattr(loops, "LAST_EDGES", 5)
    random.seed(11)
    edges = set()
    for _ in range(12):
        at = random.randrange(25)
        for _ in range(random.randint(1, 6)):
            on = random.randrange(200)
            edges.add((at, on))
            at = on
    # Mostly from small to large numbers, a few back.
    edges = {(min(e), max(e)) if random.random() < 0.97 else e for e in edges}
    names_ = [(f"n{a}", f"n{b}") for a, b in edges]
    nodes = {x for e in names_ for x in e}
    want, rest = {}, set(nodes)
    while free := {x for x in rest if all(a not in rest for a, b in names_ if b == x)}:
        want |= {x: max([want[a] + 1 for a, b in names_ if b == x], default=0) for x in free}
        rest -= free
    found, left = loops.peel(ids(spark, *nodes), frame(spark, names_))
    assert {r["id"]: r["level"] for r in found.collect()} == want and {r["id"] for r in left.collect()} == rest


def test_long_rings_take_few_rounds(spark, monkeypatch):
    """A ring, a cycle whose arcs are long chains, and a chain from one to the other, which is in no component."""
    monkeypatch.setattr(loops, "LAST_EDGES", 20)
    chain = lambda a, name, n, b: list(zip([a, *(f"{name}{k}" for k in range(n))], [*(f"{name}{k}" for k in range(n)), b], strict=True))
    ring = chain("r", "ring", 2000, "r")
    both = chain("u", "up", 900, "v") + chain("v", "down", 700, "u") + chain("u", "side", 300, "u")
    loose = chain("v", "loose", 500, "w") + chain("w", "x", 3, "y") + [("y", "w")]
    edges = frame(spark, ring + both + loose)
    found, n = jobs_of(spark, lambda: {r["id"]: r["component"] for r in graph.cycles(edges).collect()})
    want = {x: "r" for e in ring for x in e} | {x: "down0" for e in both for x in e} | {x: "w" for x in ("w", "x0", "x1", "x2", "y")}
    assert found == want
    assert n < 700


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in Path(d).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_the_statement(spark):
    """What is written needs its shuffle files no more, so disk doesn't grow with the number of rounds."""
    before = shuffle_files(spark)
    written, n = loops.counted(spark.range(20_000).repartition(4, "id").groupBy("id").count())
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert n == written.count() == 20_000 and spark.conf.get(loops.CLEANUP) == "false"


def test_plans_leave_no_shuffle_files(spark):
    """A plan of many written steps needs no more disk for shuffles than its largest step."""
    catalog = derived.rule_catalog(spark, derived.tables(spark, "/root/testdata/sf0.001"))
    before = shuffle_files(spark)
    plan = recompute.recompute_plan_batch(catalog, spark.createDataFrame([("Lineitem", "l_extendedprice")], "object string, field string"), 2)
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    rows = {r["node"]: (r["formula"], r["rule"] and r["rule"]["expression"]) for r in plan.collect()}
    assert rows["Lineitem.taxed"] == ("net * (1 + l_tax)", None) and rows["Orders.itemTotal"] == (None, "sum(net)")


def test_islands_take_one_task_each(spark, monkeypatch):
    """Many small graphs, with and without cycles, and one that is too large for a task."""
    monkeypatch.setattr(loops, "LAST_EDGES", 60)
    small = [(f"O{i}.p{k}", f"O{i}.p{k + 1}") for i in range(40) for k in range(25)] + [(f"O{i}.p25", f"Q{i}.q") for i in range(40)] + [(f"Q{i}.q", f"O{i}.p5") for i in range(0, 40, 4)]
    large = [(f"L{k}.f", f"M{(k + j) % 40}.f") for k in range(40) for j in range(3)] + [("M3.f", "L3.f"), ("M5.f", "M5.f"), ("M9.f", "N.f"), ("N.f", "N.g")]
    all_edges = small + large
    edges, names = frame(spark, all_edges), sorted({x for e in all_edges for x in e})
    nodes = ids(spark, *names, "alone.x")
    found, rest = (x.collect() for x in loops.peel(nodes, edges))
    want, left = {}, set(names)
    while free := {b for b in left if not any(a in left for a, c in all_edges if c == b)}:
        want |= {b: max([want[a] + 1 for a, c in all_edges if c == b], default=0) for b in free}
        left -= free
    assert {r["id"]: r["level"] for r in found} == want | {"alone.x": 0} and sorted(r["id"] for r in rest) == sorted(left)
    assert {r["id"]: r["component"] for r in graph.cycles(edges).collect()} == components(names, all_edges)
    starts = ["O1.p3", "O4.p0", "L7.f", "none.y"]
    level, frontier = dict.fromkeys(starts, 0), starts
    while frontier:
        new = {b for a, b in all_edges if a in frontier} - set(level)
        level |= dict.fromkeys(new, level[frontier[0]] + 1)
        frontier = list(new)
    assert {r["id"]: r["level"] for r in loops.bfs(edges, ids(spark, *starts)).collect()} == level


def test_depth_of_islands_takes_no_rounds(spark, monkeypatch):
    """One round for each level before: 64 edges in a row in each of 30 objects, with a branch at each node so that nothing is a chain."""
    monkeypatch.setattr(loops, "LAST_EDGES", 400)
    edges = [(f"O{i}.p{k}", f"O{i}.{side}{k + 1}") for i in range(30) for k in range(64) for side in "pb"]
    edges += [(f"O{i}.b{k}", f"O{i}.p{k + 1}") for i in range(30) for k in range(1, 64)]
    nodes = ids(spark, *{x for e in edges for x in e})
    (found, rest), n = jobs_of(spark, lambda: tuple(x.collect() for x in loops.peel(nodes, frame(spark, edges))))
    assert not rest and {r["id"]: r["level"] for r in found if r["id"].startswith("O7.p")} == {f"O7.p{k}": k for k in range(65)}
    assert n < 40
