"""The registered queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, lexical, line_dedup, media, near_dedup, packing, quality, sharding, substring_dedup, surrogates, topk, trie
from .common import table

#: Of the registered queries; a run on private data takes its own.
SURROGATE_KEY = "registered query"
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard."""
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SHARDS)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with surrogates for its personal data and secrets."""
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the words of windows of 35 that are found elsewhere too."""
    out = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cut at 2048 tokens, in as few sequences as best fit takes."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op5_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth id."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality score."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the lines that three or more documents share, but for the last of these."""
    docs = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a grey image and read back."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), path), path)
    spaced = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spaced, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words within windows of benchmark items, and the items."""
    found, _ = decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.filter(F.col("matches")["item_id"], lambda i: i.isNotNull())))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_maxscore_topk": op5_maxscore_topk,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_media": op8_media,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_decontamination": op11_decontamination,
    "op12_lexical_search": op12_lexical_search,
    "op13_prefix_trie": op13_prefix_trie,
}

#: A text's terms in SQL: A-Z are lower-cased first.
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
#: Words of a text in SQL.
_WORDS = "regexp_extract_all({text}, '[^' || chr(32) || chr(9) || '-' || chr(13) || ']+')"

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": f"""
WITH split AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM split),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS w FROM starts),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE w IN (SELECT w FROM repeated)) AS t),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM split),
marked AS (SELECT w.doc_id, w.word, w.p, g.p IS NULL AS stays FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p),
kept AS (
  SELECT doc_id, count(*) AS n_words, sum(CASE WHEN stays THEN 0 ELSE 1 END)::BIGINT AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE stays), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""",
    "op9_minhash_near_dedup": f"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM lowered WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r),
least AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
    "op5_maxscore_topk": """
WITH part AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding) AS x FROM embeddings WHERE embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM part WHERE x IS NULL OR isnan(x) OR isinf(x)),
ints AS (
  SELECT vec_id, place, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS v FROM part
  WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.v * c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.place = c.place AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op7_line_dedup": """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM split),
keyed AS (
  SELECT doc_id, line, pos,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
frequent AS (
  SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, (f.line_key IS NULL OR f.keeper = k.doc_id) AS stays
  FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN stays THEN 0 ELSE 1 END)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_decontamination": f"""
WITH docs AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
items AS (SELECT item_id, {_TERMS} AS ws FROM benchmark),
item_starts AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM item_starts),
doc_starts AS (
  SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows) AS lengths WHERE len(ws) >= n),
met AS (
  SELECT d.doc_id, d.p, d.n, v.item_id FROM (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w FROM doc_starts) AS d JOIN windows v ON v.n = d.n AND v.w = d.w),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM met) AS t GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM met) AS t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
""",
    "op12_lexical_search": f"""
WITH docs AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
items AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY doc_id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
postings AS (SELECT doc_id, term, count(*) AS tf FROM docs WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY term, all_docs),
parts AS (
  SELECT p.doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms))) AS part
  FROM postings p JOIN weights ON weights.term = p.term JOIN sizes ON sizes.doc_id = p.doc_id, totals),
scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM items JOIN parts ON parts.term = items.term GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
    # CRC-32 comes from its table of 256 steps, a digit of the id at a time.
    "op13_prefix_trie": """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT i, v FROM bits WHERE k = 8),
convs AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS digits FROM conversations),
crcs(conv_id, digits, place, crc) AS (
  SELECT conv_id, digits, 1, CAST(4294967295 AS BIGINT) FROM convs
  UNION ALL SELECT c.conv_id, c.digits, c.place + 1, xor(s.v, c.crc >> 8) FROM crcs c JOIN steps s ON s.i = xor(c.crc, ascii(substr(c.digits, c.place, 1))::BIGINT) & 255 WHERE c.place <= length(c.digits)),
taken AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM crcs WHERE place = length(digits) + 1),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations),
rebuilt AS (
  SELECT t.conv_id, 0 AS half, b.pos, b.role, b.text FROM taken t JOIN turns b ON b.conv_id = t.base AND b.pos <= t.h
  UNION ALL SELECT t.conv_id, 1, o.pos, o.role, o.text FROM taken t JOIN turns o ON o.conv_id = t.conv_id AND o.pos > t.h),
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS depth FROM rebuilt),
spelt AS (SELECT conv_id, depth, length(text) AS n, length(role) || ':' || length(text) || ':' || role || text AS turn FROM placed),
paths AS (SELECT conv_id, depth, n, sha256(string_agg(turn, '' ) OVER (PARTITION BY conv_id ORDER BY depth)) AS path FROM spelt UNION ALL SELECT conv_id, 0, 0, '' FROM taken),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n FROM paths GROUP BY depth, path),
last AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (SELECT p.depth, p.path, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM paths p JOIN last l ON l.conv_id = p.conv_id AND l.depth = p.depth GROUP BY 1, 2),
above AS (
  SELECT v.depth, v.path, u.depth AS up_depth, u.path AS up_path, w.conv_id AS up_conv, v.n, v.n_convs
  FROM nodes v JOIN paths u ON u.conv_id = v.conv_id AND u.depth <= v.depth JOIN nodes w ON w.depth = u.depth AND w.path = u.path),
children AS (SELECT up_depth AS depth, up_path AS path, count(*) AS n_children FROM above WHERE up_depth = depth - 1 GROUP BY 1, 2),
below AS (
  SELECT a.up_depth AS depth, a.up_path AS path, sum(CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((a.n_convs - 1) * a.n) AS saved
  FROM above a LEFT JOIN children c ON c.depth = a.depth AND c.path = a.path GROUP BY 1, 2)
SELECT v.conv_id, v.depth, p.up_conv AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v JOIN below b ON b.depth = v.depth AND b.path = v.path LEFT JOIN children c ON c.depth = v.depth AND c.path = v.path
  LEFT JOIN ends e ON e.depth = v.depth AND e.path = v.path LEFT JOIN above p ON p.depth = v.depth AND p.path = v.path AND p.up_depth = v.depth - 1
""",
}
