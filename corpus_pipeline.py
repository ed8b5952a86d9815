"""A corpus from raw documents to packed token sequences: five stages, each on all that the one before it kept.

Between stages documents have the columns below; any others are left out. Rows that share a doc_id are one document for the
line and near-copy stages: they stay or go together, and each loses its own lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, language_id, line_dedup, near_copies, packing, simhash
from docloom.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on; those without letters, or that fit no language, are rejected."""
    rows = language_id.document_evidence(docs)
    return language_id.identify(rows, language_id.fit_profiles(rows)).filter("accepted").select(*COLUMNS)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters in at least 5 documents stay in one of them; documents keep their other lines."""
    kept = line_dedup.dedup_lines(docs, 40, 5)
    changed = F.col("n_dropped") > 0
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id goes on.

    Two documents link where their SimHash fingerprints differ in up to 2 bits, as in op2_simhash, and also where their
    5-word Jaccard similarity is at least 0.8, of which pairs most differ in more bits. Groups are by both kinds of links.
    """
    return near_copies.keep_one(docs, 5, 0.8, simhash.near_duplicates(docs, 3, 2)).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item are dropped."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), 10).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, "word_bpe_49k.json", 1, 4096)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_common_lines),
    ("simhash_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Neither profiles nor fingerprints nor packing can be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, one after the other, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
