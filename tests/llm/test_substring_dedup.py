import random
import re
from collections import Counter

import numpy as np

from tributary.llm import substring_dedup as sd


def brute(rows, width=35):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone |= set(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def run(docs, width=35):
    return sorted((tuple(r) for r in sd.remove_repeated(docs, width).collect()), key=str)


def test_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def test_random(documents):
    random.seed(8)
    word = lambda: "".join(random.choices("abé", k=random.randint(1, 6)))
    make = lambda n: [word() for _ in range(n)]
    passages = [make(n) for n in (34, 35, 36, 40, 55, 60, 90, 200)]
    rows = []
    for i in range(120):
        w = make(random.randint(0, 80))
        for _ in range(random.randint(0, 3)):
            p = random.choice(passages)
            a = random.randint(0, max(0, len(p) - 34))
            w += p[a : a + random.randint(20, 120)] + make(random.randint(0, 30))
        rows.append((i, "".join(x + random.choice([" ", "\n", "\t ", "\r\n"]) for x in w)))
    loop = make(7)
    rows += [(500, None), (501, ""), (502, " \n "), (503, " ".join(loop * 12)), (504, " ".join(["same"] * 36)), (505, " ".join(["same2"] * 35))]
    rows += [rows[3], (4, rows[9][1]), (None, rows[10][1]), (None, "x"), (600, " ".join(make(30_000) + passages[-1]))]
    got = run(documents(rows))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 500


def test_one_group_of_copies(documents):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(300)] + [(1000, "before " + text[: len(text) // 2])]
    assert run(documents(rows)) == brute(rows)


def test_empty(documents):
    assert run(documents([])) == []
    assert run(documents([(1, None)])) == [(1, 0, 0, "")]


def test_words_that_cancel_out_in_sums(documents):
    """The Thue-Morse word and its swap have equal polynomial hashes modulo powers of two, whatever the base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    before = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{before} {one}"), (2, f"{before} {one.translate(str.maketrans('ab', 'ba'))}")]
    assert run(documents(rows)) == brute(rows) and [r[2] for r in run(documents(rows))] == [0, 0]


def test_windows_are_confirmed_on_their_words(documents, monkeypatch):
    monkeypatch.setattr(sd, "window_hashes", lambda hashes, width: np.zeros(max(0, len(hashes) - width + 1), np.uint64))
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text.upper()), (3, "x " + text[: len(text) // 2] + " and 40 more " + "y " * 30)]
    got = {r[0]: r[2] for r in run(documents(rows))}
    assert got == {r[0]: r[2] for r in brute(rows)}


def test_buckets_by_size(documents, monkeypatch):
    monkeypatch.setattr(sd, "BUCKET_BYTES", 1)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text) for i in range(20)] + [(None, text), (None, text), (30, None)]
    assert run(documents(rows)) == brute(rows)
