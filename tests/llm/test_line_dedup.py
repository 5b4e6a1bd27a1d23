import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tributary.llm import common, line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_length=20, min_documents=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(lower)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= min_length and len(v) >= min_documents}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def run(docs):
    out = line_dedup.deduplicate_lines(docs, 20, 3)
    return sorted(tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256)).collect())


def test_random(documents):
    random.seed(4)
    pool = [f"{'Shared line ÉÀ'} number {i} of the pool" for i in range(30)] + ["short", "", "x" * 19, "y" * 20, "é" * 20]
    rows = []
    for i in range(150):
        lines = [random.choice(["", " ", "\t\r", "\x0b"]) + random.choice([str.upper, str.lower, str])(random.choice(pool)) + random.choice(["", "  ", "\xa0"]) for _ in range(random.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(["y" * 20] * 500)), rows[5], (7, "y" * 20)]
    assert run(documents(rows)) == brute(rows)


def test_repeated_rows_are_one_document(documents):
    rows = [(1, "the same long line, twice over"), (1, "the same long line, twice over"), (2, "the same long line, twice over")]
    assert run(documents(rows)) == brute(rows)
    assert [r[2] for r in run(documents(rows))] == [0, 0, 0]


def test_ids_and_columns(spark, documents):
    line = "a line of more than twenty letters"
    docs = documents([(None, line), (None, None), (1, line), (2, line)]).withColumn("keep", F.lit(1)).withColumn("h1", F.lit("x"))
    out = line_dedup.deduplicate_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert set(rows) == {(None, ""), (None, None), (1, ""), (2, line)}
    assert all(r["keep"] == 1 and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows.values())


def test_empty(documents):
    assert run(documents([])) == []


def test_any_names_of_columns(documents):
    line = "a line of more than twenty letters"
    docs = documents([(1, line), (2, line), (3, line), (4, None)])
    names = ("score", "__text", "__doc", "__digest", "__new", "__keep", "__kept", "__lines", "row", "doc", "digest", "keep", "kept", "h1", "h2", "pos", "first", "n", "a.b")
    for n in names:
        docs = docs.withColumn(n, F.lit(7))
    out = line_dedup.deduplicate_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == 4 and all(tuple(r)[5:-2] == (7,) * len(names) for r in rows) and {r["doc_id"]: r["n_dropped"] for r in rows} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_frequent_lines_by_broadcast(documents, monkeypatch):
    monkeypatch.setattr(common, "LEAST_OFTEN", 5)
    monkeypatch.setattr(common, "LISTED", 20)
    rows = [(i, f"this very line is in every document\nand this one in some of them {i % 40}\nand this in one document only {i}") for i in range(120)]
    assert run(documents(rows)) == brute(rows)
