import random
import re

import numpy as np
import pytest

from tributary.llm import decontamination as dc

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, width=10):
    """doc_id, n_words, n_hit, ids of items with a window there, longest matches."""
    split = [(i, words(t)) for i, t in items]
    out = []
    for i, t in rows:
        w, hit, ids, longest = words(t), set(), set(), set()
        for item, v in split:
            n = min(width, len(v))
            if not n:
                continue
            for p in range(len(w) - n + 1):
                for q in range(len(v) - n + 1):
                    if w[p : p + n] == v[q : q + n]:
                        hit |= set(range(p, p + n))
                        ids.add(item)
                        if p == 0 or q == 0 or w[p - 1] != v[q - 1]:
                            more = n
                            while p + more < len(w) and q + more < len(v) and w[p + more] == v[q + more]:
                                more += 1
                            longest.add((None if item is None else str(item), q, p, more))
        out.append((i, len(w), len(hit), sorted(str(x) for x in ids if x is not None), longest))
    return sorted(out, key=str)


def run(docs, items, width=10):
    found, _ = dc.find_matches(docs, items, width=width)
    out = [(r["doc_id"], r["n_words"], r["n_hit"], sorted({m["item_id"] for m in r["matches"]} - {None}), {tuple(m) for m in r["matches"]}) for r in found.collect()]
    return sorted(out, key=str)


def test_suffix_array():
    rng = np.random.default_rng(3)
    for n, kinds in ((0, 1), (1, 1), (50, 1), (400, 2), (400, 30)):
        tokens = rng.integers(1, kinds + 1, n)
        got = dc.suffix_array(tokens, 16)
        assert sorted(got) == list(range(n))
        keys = [tuple(tokens[i : i + 16]) for i in got]
        assert keys == sorted(keys)


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def planted():
    random.seed(4)
    word = lambda: "".join(random.choices("abéZ7", k=random.randint(1, 3)))
    make = lambda n: [word() for _ in range(n)]
    passages = [make(n) for n in (1, 3, 9, 10, 11, 25, 60)]
    items = [(k, " ".join(p)) for k, p in enumerate(passages)]
    items += [(20, None), (21, ""), (22, "- !"), (5, " ".join(make(12))), (23, " ".join(["so"] * 14)), (24, items[5][1]), (None, " ".join(make(11)))]
    rows = []
    for i in range(80):
        w = make(random.randint(0, 30))
        for _ in range(random.randint(0, 2)):
            p = random.choice(passages)
            a = random.randint(0, max(0, len(p) - 8))
            w += p[a : a + random.randint(5, 40)] + make(random.randint(0, 5))
        rows.append((i, "".join(x + random.choice([" ", "\n", ", ", "\x00", "_"]) for x in w)))
    rows += [(200, None), (201, ""), (202, " \n_"), (203, " ".join(["SO"] * 50)), (204, items[-1][1]), rows[5], (5, rows[7][1]), (None, rows[9][1]), (205, " ".join(make(2000) + passages[-1] + make(500)))]
    return rows, items


def test_random(documents, benchmark, monkeypatch):
    rows, items = planted()
    want = brute(rows, items)
    assert run(documents(rows), benchmark(items)) == want
    assert sum(r[2] > 0 for r in want) > 40
    # Long texts in several suffix arrays, few places at a time, items in several blocks.
    monkeypatch.setattr(dc, "SHARD_WORDS", 37)
    monkeypatch.setattr(dc, "PLACES", 5)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 150)
    assert run(documents(rows), benchmark(items)) == want


def test_affected_documents_go(documents, benchmark, spark):
    rows, items = planted()
    bad = {i for i, r in enumerate(rows) if brute([r], items)[0][2]}
    docs = documents(rows).withColumnsRenamed({"lang": "n_hit", "source": "Matches"}).withColumnRenamed("n_chars", "a.b")
    left = dc.decontaminate(docs, benchmark(items))
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted((r for i, r in enumerate(rows) if i not in bad), key=str)


def test_empty(documents, benchmark):
    assert run(documents([]), benchmark([(1, "a b")])) == []
    assert run(documents([(1, "a b")]), benchmark([(1, "c d")])) == [(1, 2, 0, [], set())]
    assert run(documents([(1, "a b")]), benchmark([])) == [(1, 2, 0, [], set())]
    assert run(documents([(1, None)]), benchmark([(1, None)])) == [(1, 0, 0, [], set())]
