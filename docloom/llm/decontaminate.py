"""Benchmark decontamination: one Aho-Corasick automaton of the benchmark's word windows over each whole text.

The automaton reads two letters for each word, the word's number among the benchmark's words, so it has a third of the nodes
that the words' own letters would need. A benchmark beyond BLOCK_BYTES is dealt into blocks: the driver holds the items of one
block at a time, a worker one automaton, and the texts are scanned once for each block, with the hits written out between.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, texts

#: Bytes of items that go into one automaton, of about 100 bytes each; a benchmark below it is one block.
BLOCK_BYTES = 1 << 20
#: ASCII that belongs to words: digits and letters, lower-cased; the rest of ASCII parts words, and all else belongs to them.
FOLD = bytes(x if chr(x).isdigit() or 0x61 <= x <= 0x7A or x > 0x7F else x + 32 if 0x41 <= x <= 0x5A else 0x20 for x in range(256))
#: What stands for a word that no item has.
UNKNOWN = "\x01\x02"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Scanner:
    """One automaton over the windows of some items.

    A word's number is written with two letters of alphabets that share none, so a window can only match at words' starts.
    """

    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick

        cut = [(item, words_of(text)) for item, text in items]
        known = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in cut for w in words))}
        base = isqrt(len(known)) + 1
        self.written = {w: chr(0x100 + i // base) + chr(0x4000 + i % base) for w, i in known.items()}
        held: dict[str, set[str]] = {}
        for item, words in cut:
            line = "".join(map(self.written.__getitem__, words))
            for i in range(max(1, len(words) - size + 1) if words else 0):
                held.setdefault(line[2 * i : 2 * (i + size)], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, own in held.items():
            self.automaton.add_word(window, (len(window) // 2, tuple(own)))
        self.empty = not held
        if held:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs [from, to) of hit words, and the items whose windows occur."""
        if self.empty or not words:
            return [], set()
        written = self.written.get
        line = "".join([written(w, UNKNOWN) for w in words])
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (n, own) in self.automaton.iter(line):
            last = end // 2 + 1
            runs.append((last - n, last))
            items.update(own)
        return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as [from, to) in the original text's code points."""
    if not runs:
        return []
    data = text.encode()
    found = [m.span() for m in WORD.finditer(data.lower())]
    return [(len(data[: found[a][0]].decode()), len(data[: found[b - 1][1]].decode())) for a, b in runs]


#: The automaton that a worker holds, by its items.
_SCANNER: dict[str, Scanner] = {}


def _scanner(key: str, items: list[tuple[str, str]], window: int) -> Scanner:
    if key not in _SCANNER:
        _SCANNER.clear()
        _SCANNER[key] = Scanner(items, window)
    return _SCANNER[key]


RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _hits(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """For each text with hits: two hashes of it, the runs of hit words and the items."""
    key = hashlib.sha256(repr((window, items)).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, sent.value, window)
        for batch in batches:
            found = [(i, *scanner.scan(words_of(x))) for i, x in enumerate(texts(batch.column(2)))]
            found = [x for x in found if x[1]]
            at = pa.array([i for i, _, _ in found], pa.int64())
            runs = pa.array([[{"first": a, "last": b} for a, b in r] for _, r, _ in found], RUNS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), runs, pa.array([sorted(own) for _, _, own in found], pa.list_(pa.string()))], names=["a", "b", "runs", "items"])

    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), text.alias("text")).mapInArrow(scan, "a long, b long, runs array<struct<first: long, last: long>>, items array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids (sorted as strings) and leak_spans (start and end in code points).

    Words are runs of characters other than ASCII's marks, white space and control characters, A-Z lower-cased. A word is
    hit if it lies inside any occurrence of a window: window consecutive words of an item (item_id, text); an item of fewer
    words, but not none, is one window. Null and empty texts have no words; items with null item_id or text have no
    windows; items with the same id are one. Repeated rows of docs stay apart; its other columns stay, but those named as
    the new ones. Empty tables: no rows, or no hits. A benchmark of one block is scanned lazily in one pass; of more, each
    block is a job of its own. An item has to fit into a worker's memory, whatever the blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null and octet_length(coalesce(text, '')) > 0")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n")).first().n
    blocks = max(1, -(-size // block_bytes))
    new = ["n_words", "n_hit", "n_items", "item_ids", "leak_spans"]
    base = docs.select(*(c for c in docs.columns if c.lower() not in {*new, "__a", "__b", "__runs", "__items"}))
    columns = base.columns
    at = [c.lower() for c in columns].index("text")
    ours = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.string())), ("leak_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    if blocks == 1:
        held = sorted((r.item, r.text) for r in items.collect())
        key = hashlib.sha256(repr((window, held)).encode()).hexdigest()
        sent = spark.sparkContext.broadcast(held)  # block_bytes at most
        read = base
    else:
        sent, parts = None, []
        for k in range(blocks):  # one block after the other: the driver and the workers hold one at a time
            held = sorted((r.item, r.text) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect())
            parts.append(saved(_hits(base, held, window), "hits"))
        every = reduce(DataFrame.unionByName, parts)
        merged_hits = saved(every.groupBy(F.col("a").alias("__a"), F.col("b").alias("__b")).agg(F.flatten(F.collect_set("runs")).alias("__runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items")), "hits")
        text = F.col("text").cast("string")
        read = base.join(merged_hits, (F.xxhash64(text) == F.col("__a")) & (F.xxhash64(F.lit(1), text) == F.col("__b")), "left").select(*columns, "__runs", "__items")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, sent.value, window) if sent is not None else None
        for batch in batches:
            rows = []
            given = [((), ())] * batch.num_rows if scanner else zip(batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist())
            for text, (runs, own) in zip(texts(batch.column(at)), given):
                words = words_of(text)
                if scanner:
                    runs, own = scanner.scan(words)
                else:
                    runs, own = merged([(r["first"], r["last"]) for r in runs or ()]), own or ()
                rows.append({"n_words": len(words), "n_hit": sum(b - a for a, b in runs), "n_items": len(own), "item_ids": sorted(own), "leak_spans": [{"start": a, "end": b} for a, b in spans_of(text, runs)]})
            found = pa.RecordBatch.from_pylist(rows, schema=ours)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *found.columns], names=[*columns, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return read.mapInArrow(place, f"{fields}, n_words long, n_hit long, n_items long, item_ids array<string>, leak_spans array<struct<start: long, end: long>>")


def without_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents of which no word is hit, with their own columns."""
    return find_leaks(docs, benchmark, window).filter(F.col("n_hit") == 0).select(*docs.columns)
