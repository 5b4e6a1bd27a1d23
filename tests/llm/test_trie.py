import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tributary.llm import trie


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
            if d:
                children[ts[: d - 1]].add(ts[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    out = []
    for node, inside in members.items():
        ends = ",".join(map(str, sorted(c for c in inside if rebuilt[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")


def run(df):
    return sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str)


def planted():
    random.seed(9)
    texts = ["a", "é b", "", None, "long text"]
    rows = []
    for conv in [*range(60), *range(100, 125), *range(290, 310), 1000, 4301]:
        first = random.choice([0, 0, 5])
        for turn in range(random.randint(1, 9)):
            rows.append((conv, None if turn == 3 else first + turn, random.choice(["user", "assistant", None]) if turn > 2 else "user", random.choice(texts)))
    rows += [(7, 2, "user", "tie"), (7, 2, "user", "other"), (7, 2, "a", "tie"), (None, 0, "user", "x"), rows[3], rows[3]]
    # One conversation again and again, one with many turns, and one of which nothing is left.
    rows += [(c, t, "user", f"same {t}") for c in range(700, 790) for t in range(4)]
    rows += [(901, t, "user", f"t{t % 3}") for t in range(700)]
    rows += [(c, 0, "user", "gone") for c in range(1205, 1240)]
    random.shuffle(rows)
    return rows


def test_random(turns):
    rows = planted()
    want = brute(rows)
    assert run(turns(rows).repartition(3)) == want
    assert any(r[2] is None and r[7] != hashlib.sha256(b"").hexdigest() for r in want)


def test_small_blocks(turns, monkeypatch):
    """Prefixes over several blocks of turns, ids in several pieces, and the list contracted in rounds."""
    rows = planted()
    monkeypatch.setattr(trie, "BLOCK_TURNS", 64)
    monkeypatch.setattr(trie, "PIECE", 7)
    monkeypatch.setattr(trie, "CHUNK_ARCS", 40)
    monkeypatch.setattr(trie, "LAST_ARCS", 60)
    assert run(turns(rows)) == brute(rows)


def test_list_ranks(spark, monkeypatch):
    """A list in random order: places and sums come out whatever is contracted where."""
    monkeypatch.setattr(trie, "CHUNK_ARCS", 16)
    monkeypatch.setattr(trie, "LAST_ARCS", 100)
    rng = np.random.default_rng(5)
    order = rng.permutation(700).tolist()
    rows = [(a, b, 1, a % 2, a) for a, b in zip(order, [*order[1:], None], strict=True)]
    random.shuffle(rows)
    got = {r["arc"]: tuple(r)[1:] for r in trie.rank(spark.createDataFrame(rows, "arc long, next long, place long, leaves long, saved long").repartition(4)).collect()}
    place, sums = 0, [0, 0]
    for a in order:
        place, sums = place + 1, [sums[0] + a % 2, sums[1] + a]
        assert got[a] == (place, *sums)
    assert len(got) == 700


def test_chains():
    arc = np.array([5, 3, 9, 1, 7])
    head, ends, sums = trie._chains(arc, np.array([9, 5, 100, -1, 1]), np.ones((3, 5), np.int64))
    assert arc[head].tolist() == [3, 3, 3, 7, 7]
    assert ends.tolist() == [False, False, True, True, False]
    assert sums[0].tolist() == [2, 1, 3, 2, 1]


def test_tour_arcs_meet(spark):
    """Siblings in different ranges of the order follow each other."""
    nodes = [(0, None)] + [(n, 0) for n in range(1, 200)] + [(500 + n, 7) for n in range(50)]
    df = spark.createDataFrame([(n, p, 1, 0) for n, p in nodes], "node long, parent long, n_convs long, length long").repartition(6)
    arcs, children = trie.tour(df)
    next_ = {r["arc"]: r["next"] for r in arcs.collect()}
    at, seen = 0, []
    while at is not None:
        seen.append(at)
        at = next_[at]
    assert len(seen) == len(next_) == 2 * len(nodes) and seen[-1] == 1
    assert {r["node"]: r["n_children"] for r in children.collect()} == {0: 199, 7: 50}


def test_empty(turns):
    assert run(turns([])) == []
    assert run(turns([(None, 1, "a", "b")])) == []
    # Nothing but the root is left.
    lone = next(c for c in range(1201, 1300) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert run(turns([(lone, 0, "user", "x")])) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]

