import random
import re

import pytest

from tributary.llm import components, near_dedup


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(sets_of(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(sets_of(t)), root(i), root(i) == i) for i, t in rows)


def brute_kept(rows):
    """Of the texts that links connect the one of the least (id, digest); blank texts, and those without id, stay."""
    texts = sorted({r for r in rows if r[0] is not None and sets_of(r[1])})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [sets_of(t) for _, t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    groups = {}
    for k, r in enumerate(texts):
        groups.setdefault(root(k), []).append(r)
    return list(groups.values())


def run(docs):
    return sorted(tuple(r) for r in near_dedup.near_duplicates(docs).collect())


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
    return words


def make(n):
    return ["".join(random.choices("abcdeÉ", k=random.randint(1, 6))) for _ in range(n)]


def test_random(documents):
    random.seed(12)
    rows = []
    for _ in range(40):
        base = make(random.randint(20, 200))
        for _ in range(random.randint(1, 6)):
            rows.append(" ".join(edited(base, random.randint(0, 8))))
    base = make(150)
    rows += [" ".join(edited(base, random.randint(0, 4))) for _ in range(60)]  # a large group, many links to its origin only
    rows += [" ".join(make(40) + base[:60]) for _ in range(30)]  # a shared passage
    rows += ["a b c d", "A b  c\nd", "a b c", "", " \n", None, "a b c d e", "word " * 40, "word " * 50, " ".join(make(20_000))]
    random.shuffle(rows)
    rows = list(enumerate(rows)) + [(5, rows[5])]
    assert run(documents(rows)) == brute(rows)


def test_second_round_finds_what_the_middle_misses(documents, monkeypatch):
    random.seed(5)
    base = make(100)
    # Two families within one large group: each in reach of its own, not of the other.
    left, right = edited(base, 6), edited(base, 6)
    rows = [(k, " ".join(edited(left if k % 2 else right, 2))) for k in range(60)]
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    assert run(documents(rows)) == brute(rows)
    monkeypatch.setattr(near_dedup, "MANY_BLOCKS", 0)  # by rare shingles
    for few in (0, 25, 1000):
        monkeypatch.setattr(near_dedup, "FEW_CANDIDATES", few)
        assert run(documents(rows)) == brute(rows)
    bridge = edited(base, 3)  # in reach of some of either
    rows += [(60 + k, " ".join(edited(bridge, k % 3))) for k in range(5)]
    assert run(documents(rows)) == brute(rows)


@pytest.mark.parametrize("listed", [65_536, 20])
def test_no_task_holds_a_frequent_group(documents, monkeypatch, listed):
    random.seed(8)
    base = make(120)
    rows = [" ".join(edited(base, k % 5)) for k in range(90)]
    rows += [" ".join(make(30) + base[:50]) for _ in range(30)] + [" ".join(edited(base[20:], 2)) for _ in range(20)]
    rows += [" ".join(make(40)) for _ in range(10)]
    random.shuffle(rows)
    rows = list(enumerate(rows))
    most = max(12, near_dedup.M**2 * len(rows) // listed)
    monkeypatch.setattr(near_dedup, "LARGE", 12, raising=False)
    monkeypatch.setattr(near_dedup, "LISTED", listed, raising=False)

    def bounded(function):
        def run_bounded(table):
            keys = near_dedup.entries(table["key"].to_pylist(), "u8").tolist()
            assert not keys or max(map(keys.count, set(keys))) <= most
            return function(table)

        return run_bounded

    for name in ("_candidates", "_grouped_candidates"):
        monkeypatch.setattr(near_dedup, name, bounded(getattr(near_dedup, name, None)), raising=False)
    assert run(documents(rows)) == brute(rows)


def test_hot_copies_and_nulls(documents):
    rows = [(i, "the very same text of seven words") for i in range(50, 0, -1)]
    got = run(documents(rows))
    assert {r[2] for r in got} == {1} and sum(r[3] for r in got) == 1
    got = near_dedup.near_duplicates(documents([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in got) == [("2", 2, 2, True), ("None", 2, None, True), ("None", 2, None, True)]
    assert run(documents([])) == []


def test_repeated_ids(documents):
    random.seed(3)
    a, b, c = (" ".join(make(30)) for _ in range(3))
    assert run(documents([(3, a), (5, a), (5, b)])) == [(3, 26, 3, True), (5, 26, 3, False), (5, 26, 3, False)]
    assert {r[2] for r in run(documents([(9, a), (9, b), (7, b), (7, c), (4, c), (9, "")]))} == {4}
    texts = [a, b, c, "", "one two", "One  two", *(" ".join(make(25)) for _ in range(6))]
    texts += [" ".join(edited(t.split(), 1)) for t in texts[:3] + texts[6:]]
    rows = [(random.randint(0, 25), random.choice(texts)) for _ in range(70)]
    assert run(documents(rows)) == brute(rows)
    assert len({i for i, *_ in rows}) < len(set(rows))


def test_one_of_each(documents):
    random.seed(4)
    texts = ["", None, "one two", "One  two", *(" ".join(make(25)) for _ in range(8))]
    texts += [" ".join(edited(t.split(), 1)) for t in texts[4:]]
    rows = [(random.choice([None, *range(20)]), random.choice(texts)) for _ in range(60)]
    docs = documents(rows)
    digest = {r["text"]: r["d"] for r in docs.select("text", near_dedup.text_digest().alias("d")).collect()}
    stay = {min(group, key=lambda r: (r[0], digest[r[1]])) for group in brute_kept(rows)}
    want = [r for r in rows if r[0] is None or not sets_of(r[1]) or r in stay]
    out = near_dedup.one_of_each(docs.withColumnRenamed("lang", "digest").withColumnRenamed("source", "doc"))
    assert out.columns == ["doc_id", "text", "digest", "doc", "n_chars"]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    a, b = (" ".join(make(30)) for _ in range(2))
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.one_of_each(documents([(3, a), (5, a), (5, b)])).collect()) == sorted([(3, a), (5, b)])


@pytest.mark.parametrize("last", [0, 10_000])
@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(100, 101), (101, 102), (103, 100)], [(9, 9), (7, 8)]])
def test_components(spark, monkeypatch, edges, last):
    monkeypatch.setattr(components, "LAST_EDGES", last)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def jobs_of(spark, run):
    """How many jobs a call starts, which the driver keeps a record of task by task."""
    context = spark.sparkContext
    context.setJobGroup("counted", "")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    return len(context.statusTracker().getJobIdsForGroup("counted"))


def test_few_jobs_for_components(spark, monkeypatch):
    edges = spark.createDataFrame([(0, k) for k in range(1, 30)] + [(100, 101)], "a long, b long")
    assert 0 < jobs_of(spark, lambda: components.connected_components(edges)) <= 6
    monkeypatch.setattr(components, "LAST_EDGES", 10)
    assert 0 < jobs_of(spark, lambda: components.connected_components(edges)) <= 16


@pytest.mark.parametrize("last", [0, 10_000])
def test_components_with_further_links(spark, monkeypatch, last):
    """Links between components, from one to a new node, between new nodes, and within a component."""
    monkeypatch.setattr(components, "LAST_EDGES", last)
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    edges = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)]
    for more in ([(3, 11), (11, 21), (40, 41), (0, 31), (1, 3)], [(1, 3)], []):
        got = components.with_links(components.connected_components(frame(edges)), frame(more))
        want = components.connected_components(frame(edges + more))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_recall_at_the_threshold(documents):
    """Pairs of a similarity from 0.75 to 0.80, each of its own words: all are found."""
    random.seed(31)
    rows, close = [], 0
    while close < 300:
        base = make(random.randint(60, 120))
        other = edited(base, random.randint(1, 4))
        x, y = sets_of(" ".join(base)), sets_of(" ".join(other))
        if 75 * len(x | y) <= 100 * len(x & y) <= 80 * len(x | y):
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
            close += 1
    got = run(documents(rows))
    assert all(component == i - i % 2 for i, _, component, _ in got)
