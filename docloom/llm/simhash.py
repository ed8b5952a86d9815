"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, texts
from .components import components

SEED = 42
#: Fingerprints that share a block key are paired up to this many; a fuller block goes by neighbours instead.
PAIRED = 24


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle of so many words, repeated ones too; of fewer words, all of them are one. No words: none."""
    import xxhash

    found = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space parts words
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    n = max(1, len(found) - words + 1)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    stops = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)


def fingerprint(text: str, words: int = 3) -> int:
    """Bit i is set if it is in over half of the shingles' XXH64. No words: 0."""
    hashes = shingle_hashes(text, words)
    n = len(hashes)
    # In slices, so that a long text's bits don't all stand in memory at once.
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the SimHash of each whole text as a signed 64-bit number.

    A-Z are lower-cased, words are what ASCII white space parts, and shingles of so many words count as often as they
    occur; of fewer words, all of them are one shingle. Null text: an empty one, fingerprint 0. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x, words) for x in texts(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(make, f"doc_id {kind}, fp long")


def block_keys(fp: Column, bits: int) -> Column:
    """Array of (block, key): of bits + 2 blocks of the fingerprint, every two that may be equal.

    Fingerprints that differ in up to so many bits differ in no more blocks, so at least two blocks are equal.
    """
    n = bits + 2
    edges = [round(64 * i / n) for i in range(n + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = list(combinations(range(n), 2))
    return F.array(*(F.struct(F.lit(k).alias("block"), fp.bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("key")) for k, (i, j) in enumerate(pairs)))


def links(points: DataFrame, bits: int = 2, paired: int = PAIRED) -> DataFrame:
    """Links a, b between the nodes of fingerprints that differ in up to bits (0 to 2) bits, enough to join all that are joined.

    points: fp, each once, and node. Fingerprints join on blocks and their distance is verified. Where over `paired` of
    them share a block, pairing them would grow with the square of their number: these go by the fingerprints one bit off,
    as two of them are at most 2 bits apart exactly if they share such a neighbour (or are neighbours); each is linked to
    the least node with the same neighbour. So nothing is dropped and no group meets in a task.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    keyed = points.select("fp", "node", F.explode(block_keys(F.col("fp"), bits)).alias("k")).select("fp", "node", "k.block", "k.key")
    # Written out, so that the joins read plain exchanges and a key with very many fingerprints can be split.
    sizes = saved(keyed.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    small = keyed.join(sizes.filter(F.col("n") <= paired), ["block", "key"])
    left, right = (small.select("block", "key", F.col("fp").alias(f"fp_{s}"), F.col("node").alias(s)) for s in "ab")
    close = left.join(right, ["block", "key"]).filter(F.col("fp_a") < F.col("fp_b")).filter(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= bits).select("a", "b")
    crowded = keyed.join(sizes.filter(F.col("n") > paired).select("block", "key"), ["block", "key"], "left_semi").select("fp", "node").distinct()
    if bits == 0:
        return close
    flipped = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    if bits == 2:
        near = crowded.select("node", F.explode(F.concat(F.array(F.lit(0).cast("long")), flipped)).alias("flip"), "fp").select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    else:  # one bit off: two fingerprints share what is left when that bit is taken out
        near = crowded.select("node", "fp", F.explode(flipped).alias("flip")).select("node", F.struct("flip", F.col("fp").bitwiseAND(F.bitwise_not(F.col("flip")))).alias("at"))
    least = saved(near.groupBy("at").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most").select("at", "b"), "least")
    stars = near.join(least, "at").filter(F.col("node") > F.col("b")).select(F.col("node").alias("a"), "b")
    return close.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp, fingerprint (16 lower-case hex digits) and component_id (the least doc_id reachable by links), per row of docs.

    Documents link where their fingerprints differ in up to bits bits; equal fingerprints are one node, so copies are
    never paired. Texts without words have fingerprint 0 and link like any other. Rows with null doc_id have null
    component_id and link nothing; rows with one doc_id are one document with as many fingerprints. An empty table gives
    none.
    """
    marked = saved(fingerprints(docs, words), "fingerprints")
    points = marked.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node"))
    points = saved(points, "points")
    found = components(links(points, bits).unionByName(_same_document(marked, points)))
    named = points.join(found.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "node").alias("component_id"))
    out = marked.join(named, F.col("fp") == F.col("__fp"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def _same_document(marked: DataFrame, points: DataFrame) -> DataFrame:
    """Links between the nodes of one doc_id's fingerprints, where rows repeat a doc_id with another text."""
    several = marked.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high and doc_id is not null").select("doc_id")
    own = marked.join(several, "doc_id").select("doc_id", "fp").distinct().join(points, "fp").select("doc_id", "node")
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
    return own.join(least, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")


def keep_one(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """Of each component the document with the least doc_id, with the columns of docs; rows with null doc_id stay."""
    rejected = near_duplicates(docs, words, bits).filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(rejected, docs["doc_id"] == F.col("__gone"), "left_anti")
