"""Token ids as files: each document compressed for itself with one shared zstandard dictionary.

A store is a folder with two Parquet tables. `dictionary` has one row: the dictionary, its SHA-256, the tokenizer, the end
id and the bytes of an id. `blocks` has a row for each run of documents in ascending doc_id: their ids, their numbers of
tokens, the offsets of their frames (the index for short access) and the frames one behind the other, with the
dictionary's hash. Spark commits both, so a lost executor leaves no half-written file, and any store Spark can write to
will do. Dealing out goes by bounds of doc_id drawn in a pass over doc_id alone, so texts are encoded once and only frames
are shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import small_batches, tokenizer_path
from .word_encoder import word_encoder

#: The dictionary is trained on about so many documents, and at most twice that, of each at most so many bytes of ids, in
#: slices from all over it.
SAMPLE_DOCS = 1000
SAMPLE_BYTES, SAMPLE_SLICES = 8192, 8
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Documents of one output partition, up to so many partitions, beyond which they grow; sorting spills, so none has to fit into memory.
PARTITION_DOCS, MOST_PARTITIONS = 10_000, 8000
#: doc_ids drawn for each partition, from which its bounds are taken.
SAMPLE_IDS = 100
#: Bounds of a block.
BLOCK_DOCS = 1024
BLOCK_BYTES = 1 << 20
#: Least number of samples from which zstandard can train.
LEAST_SAMPLES = 16


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of a stored id: two where every id of the tokenizer, and end_id, fits into them."""
    from tokenizers import Tokenizer

    most = max([end_id, *Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab(with_added_tokens=True).values()])
    return 2 if most < 1 << 16 else 4


def _loaded(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, dtype="<u2").astype("<u4").tobytes()


def _shared(data: bytes):
    """zstandard's dictionary object; None for an empty one."""
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for such arrays; of too few or too uniform ones, the arrays themselves, cut to size."""
    import zstandard

    if len(samples) >= LEAST_SAMPLES:
        try:
            return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def spread_slices(data: bytes, most: int = SAMPLE_BYTES, slices: int = SAMPLE_SLICES) -> bytes:
    """data, or of longer data so many slices that lie evenly over the whole of it, of most bytes together."""
    if len(data) <= most:
        return data
    size = most // slices
    return b"".join(data[at : at + size] for at in np.linspace(0, len(data) - size, slices).astype(int).tolist())


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int, keep) -> DataFrame:
    """keep is a schema and a function whose result makes a batch of a column of doc_ids and a list of stored id arrays."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = word_encoder(tokenizer), keep[1]()
        for batch in batches:
            ids, bounds = encoder.encode(batch.column(1), end_id)
            data, at = ids.astype(f"<u{width}").tobytes(), (bounds * width).tolist()
            yield made(batch.column(0), [data[a:b] for a, b in zip(at, at[1:])])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encode, keep[0])


def part_bounds(docs: DataFrame, total: int, parts: int) -> np.ndarray:
    """Bounds of doc_id that deal documents out into about equal parts, from a sample of SAMPLE_IDS ids for each part on average.

    Only balance hangs on the sample. Rows are drawn one by one, so a doc_id with many rows is drawn as often as it weighs.
    """
    share = min(1.0, SAMPLE_IDS * parts / max(1, total))
    drawn = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (F.rand(7) < share)).toArrow().column(0).to_numpy()
    drawn = np.sort(drawn)
    return np.unique(drawn[[len(drawn) * i // parts for i in range(1, parts)]]) if len(drawn) else drawn


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, docs_per_partition: int = PARTITION_DOCS) -> str:
    """Write a store of every document's ids and end_id at path; returns path.

    docs: doc_id (a whole number, else it is an error) and text; other columns are left aside. Null text: an empty one, so
    end_id alone. Null doc_ids come first; rows with the same doc_id stay apart, shorter ones first. An empty table gives a
    store without rows. An id takes two bytes where the tokenizer's largest one allows it, and four otherwise.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total, width = docs.count(), id_width(tokenizer, end_id)
    share = min(1.0, SAMPLE_DOCS / max(1, total))

    def samples():
        return lambda _, arrays: pa.RecordBatch.from_arrays([pa.array(list(map(spread_slices, arrays)), pa.binary())], names=["ids"])

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    got = [bytes(r.ids) for r in _encoded(chosen, tokenizer, end_id, width, ("ids binary", samples)).limit(2 * SAMPLE_DOCS).collect()]
    dictionary = train_dictionary(sorted(got))
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), tokenizer, end_id, width)], "dictionary_sha256 string, dictionary binary, tokenizer string, end_id int, id_bytes int").coalesce(1).write.parquet(f"{path}/dictionary")

    parts = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // docs_per_partition)))
    bounds = part_bounds(docs, total, parts)

    def frames():
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(dictionary), write_content_size=True)

        def made(ids: pa.Array, arrays: list[bytes]) -> pa.RecordBatch:
            part = np.searchsorted(bounds, np.array([-(1 << 63) if x is None else x for x in ids.to_pylist()], dtype=np.int64)).astype("int32")
            return pa.RecordBatch.from_arrays([pa.array(part), ids, pa.array([len(x) // width for x in arrays], pa.int64()), pa.array([compressor.compress(x) for x in arrays], pa.binary())], names=["part", "doc_id", "n_tokens", "frame"])

        return made

    dealt = _encoded(docs, tokenizer, end_id, width, ("part int, doc_id long, n_tokens long, frame binary", frames))
    ordered = dealt.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "n_tokens", "frame")

    def block(part: int, number: int, start: int, rows: list[tuple]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *(len(r[2]) for r in rows)]).tolist()
        return pa.RecordBatch.from_pydict(
            {"part": [part], "block": [number], "start_in_part": [start], "n_tokens": [sum(r[1] for r in rows)], "first_doc_id": [rows[0][0]], "last_doc_id": [rows[-1][0]], "dictionary_sha256": [digest], "doc_ids": [[r[0] for r in rows]], "counts": [[r[1] for r in rows]], "offsets": [offsets], "frames": [b"".join(r[2] for r in rows)]},
            schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("dictionary_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())]),
        )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, held, rows = None, 0, 0, 0, []
        for batch in batches:
            for p, doc_id, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (p != part or len(rows) >= BLOCK_DOCS or held + len(frame) > BLOCK_BYTES):
                    yield block(part, number, start, rows)
                    start += sum(r[1] for r in rows)
                    number, held, rows = number + 1, 0, []
                if p != part:
                    part, number, start = p, 0, 0
                rows.append((doc_id, n, frame))
                held += len(frame)
        if rows:
            yield block(part, number, start, rows)

    ordered.mapInArrow(gather, "part int, block int, start_in_part long, n_tokens long, first_doc_id long, last_doc_id long, dictionary_sha256 string, doc_ids array<long>, counts array<long>, offsets array<long>, frames binary").write.parquet(f"{path}/blocks")
    return path


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str, int]:
    """The store's one dictionary row, checked against its hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dictionary_sha256:
        raise ValueError(f"{path}: the dictionary doesn't have the hash that its store names")
    return data, row.dictionary_sha256, row.id_bytes


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """The documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with with_ids, ids.

    doc_ids: only these; blocks without them aren't read, and of the others only their frames are decompressed. A block
    that names another dictionary is an error.
    """
    dictionary, digest, width = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts = dict(zip((p for p, _ in sums), np.cumsum([0, *(n for _, n in sums)]).tolist()))
    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        blocks = blocks.filter(F.exists("doc_ids", lambda x: x.isin(sorted(wanted))) if len(wanted) <= 100 else F.lit(True))
        if wanted:
            blocks = blocks.filter((F.col("last_doc_id") >= min(wanted)) & (F.col("first_doc_id") <= max(wanted)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        decompressor = zstandard.ZstdDecompressor(dict_data=_shared(dictionary))
        for batch in batches:
            for part, start, said, ids, counts, offsets, frames in zip(*(batch.column(c).to_pylist() for c in ("part", "start_in_part", "dictionary_sha256", "doc_ids", "counts", "offsets", "frames"))):
                if said != digest:
                    raise ValueError("a block was written with another dictionary")
                at = starts[part] + start
                rows: list[tuple] = []
                for k, (doc_id, n) in enumerate(zip(ids, counts)):
                    if wanted is None or doc_id in wanted:
                        data = _loaded(decompressor.decompress(frames[offsets[k] : offsets[k + 1]]), width)
                        rows.append((doc_id, at, len(data) // 4, zlib.crc32(data), data))
                    at += n
                if not rows:
                    continue
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]]
                if with_ids:
                    cuts = np.cumsum([0, *(r[2] for r in rows)]).astype("int32")
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(r[4] for r in rows), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    read = blocks.select("part", "start_in_part", "dictionary_sha256", "doc_ids", "counts", "offsets", "frames")
    return read.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
