"""Token counts by a byte-level BPE, most of them without merging.

Which of the vocabulary's strings encode alone as one token is proved beforehand, by the model itself: at the driver, once for
a tokenizer file, and handed to the workers (a few MB at most, as the vocabulary bounds it). A pre-token among these counts
one. Only the rest is merged, and each distinct one once as long as the cache holds it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, tokenizer_path
from .word_encoder import byte_letters

#: Distinct merged pre-tokens whose counts a worker keeps, in each of two halves.
KEEP = 250_000
#: Pre-tokens that the library merges in one call.
TOGETHER = 4000
#: The byte-level pre-tokenizer's pattern (a fixed value of the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """count(text): as many ids as the library's encode(text, add_special_tokens=False) gives."""

    def __init__(self, path: str, keep: int = KEEP, single: dict[str, int] | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        said = json.loads(Path(tokenizer_path(path)).read_text())
        split = said["pre_tokenizer"] or {}
        if said["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level tokenizers with the usual pattern, without normaliser or prefix space")
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in said["added_tokens"]):
            raise ValueError(f"{path}: only added tokens that match as they stand")
        self.find = regex.compile(PATTERN).findall
        special = sorted((x["content"] for x in said["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = byte_letters()
        self.model = Tokenizer.from_str(json.dumps(said | {"pre_tokenizer": None, "added_tokens": [], "post_processor": None}))
        self.single = self.prove(said["model"]["vocab"]) if single is None else single
        self.keep = keep
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def prove(self, vocab: dict[str, int]) -> dict[str, int]:
        """The texts that are one pre-token and that the model merges into one token: each counts 1."""
        back = {x: b for b, x in self.letters.items()}
        out = {}
        written = sorted(vocab)
        for letters, enc in zip(written, self.model.encode_batch(written, add_special_tokens=False)):
            if len(enc.ids) == 1:
                try:
                    text = bytes(back[x] for x in letters).decode()
                except (KeyError, UnicodeDecodeError):
                    continue  # a part of a character can't be a pre-token
                if self.find(text) == [text]:
                    out[text] = 1
        return out

    def merge(self, parts: list[str]) -> dict[str, int]:
        written = [x.encode().decode("latin-1").translate(self.letters) for x in parts]
        return {x: len(e.ids) for x, e in zip(parts, self.model.encode_batch_fast(written, add_special_tokens=False))}

    def batch(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        rest: list[list[str]] = []
        single = self.single.get
        for i, text in enumerate(texts):
            pieces = [text]
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                counts[i] = len(pieces) - 1
            left: list[str] = []
            for piece in pieces:
                found = self.find(piece)
                other = [x for x in found if single(x) is None]
                counts[i] += len(found) - len(other)
                left += other
            rest.append(left)
        young = self.young
        missing: set[str] = set()
        for x in {x for left in rest for x in left}:
            if x not in young:
                if x in self.old:
                    young[x] = self.old[x]
                else:
                    missing.add(x)
        new = list(missing)
        for i in range(0, len(new), TOGETHER):
            young.update(self.merge(new[i : i + TOGETHER]))
        for i, left in enumerate(rest):
            counts[i] += sum(map(young.__getitem__, left))
        if len(young) > self.keep:
            self.old, self.young = young, {}
        return counts


_COUNTERS: dict[str, TokenCounter] = {}


def token_counter(path: str, single: dict[str, int] | None = None) -> TokenCounter:
    """One for each file and Python process; single: what has been proved of its vocabulary, if anything has."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path, single=single)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    docs: doc_id and text; other columns are left aside. Special strings inside texts count as one token, as the library
    has it by default. Null and empty texts: no bytes and no tokens. Rows stay apart, with null or repeated doc_ids too.
    One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    proved = docs.sparkSession.sparkContext.broadcast(token_counter(tokenizer).single)  # before the job, bounded by the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer, proved.value)
        for batch in batches:
            n = counter.batch(list(texts(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    counted = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
