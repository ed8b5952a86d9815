"""Line dedup: lines that many documents hold stay in one of them only. DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: What is stripped off both ends of a line for its key, and the letters that are lower-cased (fixed values of the contract).
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _lines(docs: DataFrame) -> Column:
    return F.split(F.coalesce(docs["text"].cast("string"), F.lit("")), "\n", -1)


def _row(docs: DataFrame) -> Column:
    """Tells rows of one doc_id with different texts apart; the same in both readings of docs."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def dropped_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, row (a hash of the text) and the sorted positions (from 0) of the lines that the row loses; only rows that lose some.

    A key is known by two 64-bit hashes with different seeds. Which documents hold it is counted after dealing out by key
    and document, so that a line found everywhere meets in no task; the keys' rows are joined with what they lose to.
    """
    lines = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", _row(docs).alias("row"), F.posexplode(_lines(docs)).alias("pos", "line"))
    # A key isn't longer than its line, so short lines go before any work.
    keyed = lines.filter(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    hashed = saved(keyed.select("doc_id", "row", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")), "lines")
    common = hashed.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    # Written out, so that the join reads plain exchanges on both sides: only such a join splits a line that is everywhere.
    common = saved(common.select("a", "b", "last"), "common")
    lost = hashed.join(common, ["a", "b"]).filter(F.col("doc_id") < F.col("last"))
    return lost.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("lost"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text.

    Texts are split at newlines; a line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased.
    Lines whose key has at least min_chars code points and occurs in at least min_docs documents are dropped, but in the
    largest doc_id that holds the key. Null or empty text: one empty line. Rows with null doc_id keep all lines and don't
    count as documents; rows with the same doc_id count as one document, and each loses its own lines. Other columns of
    docs stay, but those named as the new ones; lines keep their order. An empty table gives none.
    """
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped", "kept_text", "lost", "__lines", "__row")]
    lost = dropped_positions(docs, min_chars, min_docs).select(F.col("doc_id").alias("__lost_id"), F.col("row").alias("__lost_row"), "lost")
    # Split below the join: above it, the lines are a column and not an expression that each step would evaluate again.
    split = docs.select(*rest, _lines(docs).alias("__lines"), _row(docs).alias("__row"))
    joined = split.join(lost, (split["doc_id"] == lost["__lost_id"]) & (split["__row"] == lost["__lost_row"]), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("lost"))
    text = F.when(F.col("lost").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    return joined.select(*rest, F.size("__lines").cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"), text.alias("kept_text"))
