"""Line dedup with range-partitioned hashes; DataFrame functions only.

Every line of some length becomes a row of two 64-bit hashes, document and position, without its text. The rows are partitioned into ranges of hash and
document, so that a line which a third of all documents hold is spread over many ranges, and sorted in each by hash, document and position; a window
that streams over them marks where a document first shows a line. The marks, added up by hash, tell which lines are frequent; the frequent ones'
other places come back as bitmaps, of which only the words of 64 lines that lose something are stored. Texts move once, when they meet their
bitmaps, and not at all where adaptive execution finds the bitmaps small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, join_counted, partitions

# The characters stripped from both ends of a line, and those lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIN_LENGTH = 20
MIN_DOCUMENTS = 3


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased; other letters stay."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _identity(docs: DataFrame, *more: Column) -> DataFrame:
    """doc (null ids count as the smallest), digest and text: what tells rows of one id but different texts apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), F.col("text").cast("string").alias("text"), *more)


def keep_bitmaps(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """A row (doc, digest, keep) for each document that loses a line: keep maps position / 64 to 64 bits, 1 for lines that stay.

    Words of 64 lines that all stay aren't in the map. Lines whose key has at least min_length code points and is found in at least
    min_documents ids stay only in the largest id holding it, at all places there. Rows repeated under one id count as one document.
    """
    line = F.explode(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos"))), lambda s: F.length(s["key"]) >= min_length))
    lines = _identity(docs).select("doc", "digest", line.alias("l"))
    rows = checkpoint(lines.select("doc", "digest", F.xxhash64("l.key").alias("h1"), F.xxhash64(F.lit(1), "l.key").alias("h2"), F.col("l.pos").alias("pos")))
    # The ranges go on through the documents of a hash; the window needs the rows of one hash and document only.
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), "h1", "h2", "doc")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc").orderBy("pos")) == 1
    frequent = checkpoint(
        ranged.withColumn("first", first.cast("long"))
        .groupBy("h1", "h2").agg(F.sum("first").alias("documents"), F.max("doc").alias("keeper"), F.count("*").alias("n"))
        .where(F.col("documents") >= min_documents).select("h1", "h2", "keeper", "n")
    )
    lost = join_counted(rows, frequent, ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    bits = lost.groupBy("doc", "digest", F.shiftright("pos", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos & 63))").alias("bits"))
    return bits.groupBy("doc", "digest").agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("keep"))


def deduplicate_lines(docs: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with the lines that stay in text, n_chars set anew where docs has it, and n_lines and n_dropped; null text is one empty line and stays null.

    Other columns come back as they are, whatever their names; those named n_lines or n_dropped are replaced. No row is lost.
    """
    joined = _identity(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(keep_bitmaps(docs, min_length, min_documents), ["doc", "digest"], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def stays(_: Column, place: Column) -> Column:
        word = F.coalesce(F.try_element_at("keep", F.shiftright(place, 6)), F.lit(-1).cast("long"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)))) != 0

    out = joined.withColumn("kept", F.when(F.col("keep").isNull(), lines).otherwise(F.filter(lines, stays)))
    text = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    set_anew = {"text": text, "n_chars": F.length(text).cast("long")}
    own = [set_anew.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"))
