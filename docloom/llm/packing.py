"""Best-fit packing: documents as token sequences of bounded length, by sums of squares.

Texts become pieces in one pass without a shuffle; only a small row for each piece is dealt out, by a number that has
nothing to do with its contents, into groups of about GROUP_PIECES pieces, and each group is packed for itself. A group
leaves one sequence unfilled, so the loss doesn't grow with the number of groups, and no group grows with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches
from .sum_of_squares import pack
from .word_encoder import word_encoder

#: Pieces that are packed together.
GROUP_PIECES = 20_000

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Each document's ids and end_id, cut into pieces of capacity ids; the last may be shorter.

    docs: doc_id and text; other columns are left aside. Null text: an empty one, so one piece with end_id alone. Null
    and repeated doc_ids: rows of their own. An empty table gives none.
    Columns: doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), and with with_ids: ids (array<int>).
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    small_batches(docs.sparkSession)
    schema = PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            ids, bounds = encoder.encode(batch.column(1), end_id)
            # Each document has end_id at least, so one piece at least.
            pieces = -(-np.diff(bounds) // capacity)
            doc = np.repeat(np.arange(len(pieces)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = bounds[doc] + piece * capacity
            length = np.minimum(begin + capacity, bounds[doc + 1]) - begin
            data = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(crcs, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, bounds[-1]), pa.int32()), pa.array(ids.astype("<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset: no sequence holds over capacity ids, and its pieces lie in it without gaps from 0.

    pieces: rows with length between 1 and capacity; other columns stay as they are. Sequence ids are any numbers, unique
    over all groups. Equal rows are packed as so many pieces. An empty table gives none.
    """
    from pyspark.sql import types as T

    numbered = saved(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_pieces))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("__row").to_numpy(), kind="stable")
        lengths = group.column("length").to_numpy()[order]
        bins, offsets, _ = pack(lengths, capacity)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        first = group.column("__group")[0].as_py() << 32
        own = group.drop_columns(["__row", "__group"])
        return own.append_column("sequence_id", pa.array(first + bins[back])).append_column("offset", pa.array(offsets[back]))

    dealt = numbered.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """token_pieces, then pack_pieces."""
    return pack_pieces(token_pieces(docs, tokenizer, end_id, capacity, with_ids), capacity, group_pieces)
