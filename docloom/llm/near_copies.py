"""Near copies by similarity: MinHash bands give candidates, exact Jaccard of the word shingles decides, components group.

Texts that share a crowded band are first held against its least and greatest only. What that leaves in different components
is compared in a second pass, in blocks of BLOCK texts by their whole signatures: no pair is a row before its signatures
agree as far as those of a link do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, texts
from .components import components
from .simhash import shingle_hashes

#: Bands and minima of each: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 6) ** 32 = 0.9999.
BANDS, ROWS = 32, 6
#: Nodes that share a band are paired up to this many; a fuller band holds each of them against its least and its greatest node first.
PAIRED = 12
#: Nodes of a block in the second pass, and of the signature's BANDS * ROWS bytes how many agree at least in a link: at a similarity
#: of 0.8 fewer do with a probability of 2 in 100,000, less than that of sharing no band.
BLOCK, AGREEING = 128, 131
FACTORS = np.random.default_rng(42).integers(1, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.random.default_rng(43).integers(1, 1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct shingles of a whole text as sorted hashes."""
    return np.unique(shingle_hashes(text, words))


def signature(held: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of BANDS * ROWS hash functions. No shingles: all are the greatest number."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    spread = held ^ (held >> np.uint64(32))
    for i in range(0, len(spread), 1024):  # in slices, so that the products stay in the cache
        np.minimum(least, (FACTORS * spread[i : i + 1024]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of a signature."""
    mixed = (least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS) * MIX
    return np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(31)), axis=1).view(np.int64)


def short_form(least: np.ndarray) -> bytes:
    """A byte for each value of a signature."""
    return ((least ^ (least >> np.uint64(17))) * MIX[0] >> np.uint64(56)).astype(np.uint8).tobytes()


def marks(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, digest of the whole text's words, bands (none for a text without words) and the signature's short form, per row of docs. One pass, no shuffle."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            held = list(texts(batch.column(1)))
            digests = [xxh3_128_digest(b" ".join(x.encode().lower().split())) for x in held]
            sets = [shingles(x, words) for x in held]
            signed = [signature(x) for x in sets]
            bands = pa.array([band_keys(least) if len(x) else [] for x, least in zip(sets, signed)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), bands, pa.array(list(map(short_form, signed)), pa.binary())], names=["doc_id", "digest", "bands", "sign"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(make, f"doc_id {kind}, digest binary, bands array<long>, sign binary")


def candidates(points: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Pairs a < b of nodes that share a band, each once. points: node and bands."""
    keyed = points.select("node", F.posexplode("bands").alias("band", "key"))
    shared = saved(keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).filter("n > 1 and a < b"), "bands")
    two = shared.filter("n = 2").select("a", "b")
    more = keyed.join(shared.filter("n > 2"), ["band", "key"])
    small = more.filter(F.col("n") <= paired)
    left, right = (small.select("band", "key", F.col("node").alias(s)) for s in "ab")
    all_pairs = left.join(right, ["band", "key"]).filter(F.col("a") < F.col("b")).select("a", "b")
    crowded = more.filter(F.col("n") > paired)
    ends = crowded.select(F.col("a"), F.col("node").alias("b")).unionByName(crowded.select(F.col("node").alias("a"), F.col("b"))).filter(F.col("a") < F.col("b"))
    return two.unionByName(all_pairs).unionByName(ends).distinct()


def links(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs a, b whose texts have at least this Jaccard similarity of distinct shingles. Only texts of pairs are read again."""
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")), words)
    sizes = sets.select("node", "n")
    near = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    held = sets.select("node", "held")
    both = near.select("a", "b").distinct().join(held.toDF("b", "held_b"), "b").join(held.toDF("a", "held_a"), "a")
    common = F.size(F.array_intersect("held_a", "held_b"))
    return both.withColumn("n", common).filter(F.col("n") >= similarity * (F.size("held_a") + F.size("held_b") - F.col("n")) - 1e-9).select("a", "b").distinct()


def shingle_sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """node, n and held, the sorted hashes of its distinct shingles, for the nodes that are asked for; written out. Only their texts are read again."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingles(x, words).view(np.int64) for x in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in held], pa.int32()), pa.array(held, pa.list_(pa.int64()))], names=["node", "n", "held"])

    # Saved, so that its size is known: texts are shuffled only where Spark can't broadcast the nodes.
    asked = saved(asked.distinct(), "asked")
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("string").alias("text")).join(asked, "node", "left_semi")
    return saved(chosen.mapInArrow(make, f"node {kind}, n int, held array<long>"), "shingles")


def crowded_links(docs: DataFrame, points: DataFrame, component: DataFrame, words: int, similarity: float, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """The links a, b between nodes of different components that share a band of over paired nodes, each once.

    points: node, bands and sign; component: node and component of the nodes that have a link. A band's nodes are dealt into
    blocks of about so many. Blocks of nodes outside the band's largest component meet all its blocks: two nodes of the
    largest one have no link to add. Within a pair of blocks, nodes whose signatures agree enough are held against each other by their
    shingles, in the first band that they share: if that isn't crowded, it has been done already. Only links are rows.
    """
    spark = points.sparkSession
    small_batches(spark)
    keyed = points.select("node", F.posexplode("bands").alias("band", "key"))
    full = saved(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter(F.col("n") > paired), "full")
    parts = component.select(F.col("node").alias("__node"), F.col("component").alias("c"))
    held = saved(keyed.join(full, ["band", "key"]).join(parts, F.col("node") == F.col("__node"), "left").select("node", "band", "key", "n", F.coalesce("c", "node").alias("c")), "crowded")
    sizes = held.groupBy("band", "key", "c").agg(F.count("*").alias("m"))
    mixed = saved(sizes.groupBy("band", "key").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("m", "c")).alias("main")).filter("parts > 1").select("band", "key", "main"), "mixed")
    dealt = saved(held.join(mixed, ["band", "key"]).withColumn("other", F.col("c") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))), "dealt")
    # A doc_id with several texts has a row for each, on either side, and all of them meet.
    own = points.select("node", "bands", "sign").join(shingle_sets(docs, dealt.select("node"), words).select("node", "held"), "node")
    member = F.struct("node", "c", "bands", "sign", "held")
    blocks = saved(dealt.join(own, "node").groupBy("band", "key", "other", "block").agg(F.collect_list(member).alias("members")), "blocks")
    left, right = blocks.filter("other").select("band", "key", F.col("members").alias("one")), blocks.select("band", "key", F.col("members").alias("two"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                band = batch.column(0)[k].as_py()
                (ids, part, bands, signs, sets), (ids_b, part_b, bands_b, signs_b, sets_b) = (_unpacked(batch.column(i)[k].values) for i in (1, 2))
                found = []
                for i in range(len(ids)):
                    near = np.flatnonzero(((signs_b == signs[i]).sum(axis=1) >= AGREEING) & (part_b != part[i]) & ((bands_b == bands[i]).argmax(axis=1) == band))
                    for j in near.tolist():
                        x, y = sets[i], sets_b[j]
                        if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                            n = len(np.intersect1d(x, y, assume_unique=True))
                            if n >= similarity * (len(x) + len(y) - n) - 1e-9:
                                found.append((i, j))
                at, to = (pa.array([p[q] for p in found], pa.int64()) for q in (0, 1))
                yield pa.RecordBatch.from_arrays([ids.take(at), ids_b.take(to)], names=["a", "b"])

    kind = points.schema["node"].dataType.simpleString()
    found = left.join(right, ["band", "key"]).select("band", "one", "two").mapInArrow(compare, f"a {kind}, b {kind}")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unpacked(members: pa.StructArray) -> tuple:
    """Ids as they are, and components (as text), bands, signatures and shingles as arrays."""
    node, part, bands, signs, held = members.flatten()
    flat = held.values.to_numpy() if len(held) else np.zeros(0, dtype=np.int64)
    bounds = held.offsets.to_numpy()
    sets = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
    return node, np.array(part.cast(pa.string()).to_pylist()), bands.flatten().to_numpy().reshape(-1, BANDS), np.frombuffer(b"".join(signs.to_pylist()), dtype=np.uint8).reshape(len(signs), -1), sets


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, grouped: DataFrame | None = None) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable by links), per row of docs.

    Documents link where the Jaccard similarity of their distinct shingles of so many words is at least similarity; A-Z
    are lower-cased, ASCII white space parts words, and a text of fewer words is one shingle. Texts with the same words are
    one node, so copies are never paired. Rows with null doc_id have null component_id and link nothing; rows with one
    doc_id are one document with as many texts.

    grouped: doc_id and component_id (its group's least doc_id) by another method for the same docs, such as SimHash. Its
    groups are links beside the others. Texts with the same words have to be in one group.
    """
    marked = saved(marks(docs, words), "marks")
    known = marked.filter(F.col("doc_id").isNotNull())
    nodes = saved(known.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    # Written out, as it is read five times: bands and signatures are shuffled once for it.
    points = saved(known.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "bands", "sign"), "points")
    pairs = saved(candidates(points), "pairs")
    several = known.select("doc_id", F.xxhash64("digest").alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("doc_id")
    own = known.select("doc_id", "digest").join(several, "doc_id").join(nodes, "digest").select("doc_id", "node")
    same = own.join(own.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")
    first = links(docs, pairs, words, similarity).unionByName(same)
    if grouped is not None:  # a copy is in the group of its node, and the least doc_id of a group is a node
        told = saved(grouped.filter("component_id < doc_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), "grouped")
        first = first.unionByName(told.join(nodes.select(F.col("node").alias("a")), "a", "left_semi"))
    first = saved(first, "links")
    found = components(first.unionByName(crowded_links(docs, points, components(first), words, similarity)))
    named = nodes.join(found.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = marked.select("doc_id", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, grouped: DataFrame | None = None) -> DataFrame:
    """Of each component the document with the least doc_id, with the columns of docs; rows with null doc_id stay. grouped: as in near_copies."""
    rejected = near_copies(docs, words, similarity, grouped).filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(rejected, docs["doc_id"] == F.col("__gone"), "left_anti")
