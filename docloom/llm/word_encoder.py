"""Ids of whole texts by a tokenizer that drops white space, with each distinct word encoded once.

Between two ASCII white-space bytes such a tokenizer's ids depend on nothing outside, so a text's ids are those of its
words in a row. Words repeat, so a batch is split and its distinct words found in Arrow, and only those that aren't in the
cache are encoded: words of Latin-1 letters, with or without closing marks, by the model's merges alone, since its
normaliser only lower-cases them and its pre-tokenizer leaves them whole; all others by the whole library. The ids of a
batch are then gathered from the cache in NumPy.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import tokenizer_path
from .merging import Merger

#: Words that are encoded in one call.
TOGETHER = 20_000
#: Words that each half of the cache keeps: some 50 MB together.
KEEP = 100_000
#: What may close a word of letters and is then a piece of its own: ASCII marks, without the apostrophe of contractions.
CLOSING = "".join(chr(x) for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27)
#: Words of Latin-1 letters, which are lower-cased one by one and compose with nothing.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: Bytes of the longest word that is merged here: each of its merges is a round. Longer ones go to the library.
LONG = 64
EMPTY = pa.array([""])
#: Normalisers and splitter for which the short way holds (fixed values of the vocabulary's format).
KNOWN = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte: itself, or the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] for each start and size, one behind the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def strings(column: pa.Array) -> list[str]:
    """A column's strings, none of them null; several times as fast as to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Words:
    """Ids of words: a number for each word, and the ids of number k at values[starts[k] : starts[k] + sizes[k]]."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.count, self.used = 0, 0
        self.starts, self.sizes, self.values = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """words that aren't held, with their ids one behind the other."""
        n, m = self.count + len(words), self.used + len(ids)
        if n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * n), np.resize(self.sizes, 2 * n)
        if m > len(self.values):
            self.values = np.resize(self.values, 2 * m)
        self.starts[self.count : n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : n] = sizes
        self.values[self.used : m] = ids
        self.numbers.update(zip(words, range(self.count, n)))
        self.count, self.used = n, m

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one behind the other, and how many each has."""
        sizes = self.sizes[numbers]
        return gathered(self.values, self.starts[numbers], sizes), sizes


class WordEncoder:
    """Ids of whole texts, equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        said = json.loads(Path(tokenizer_path(path)).read_text())
        self.library = Tokenizer.from_str(json.dumps(said))
        self.keep = keep
        self.young, self.old = Words(), Words()
        self.merger = Merger(said["model"], byte_letters()) if self._known(said) else None

    @staticmethod
    def _known(said: dict) -> bool:
        try:
            normal, split = said["normalizer"]["normalizers"], said["pre_tokenizer"]["pretokenizers"]
            found = ([x["type"] for x in normal], [x["type"] for x in split], split[0]["pattern"]["Regex"])
        except (KeyError, TypeError):
            return False
        return found == KNOWN and bool(said["model"].get("end_of_word_suffix"))

    def _by_library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64)

    def _by_merges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of lower-case words of Latin-1 letters, at most LONG bytes each."""
        column = pa.array(words, pa.string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(words) + 1)
        return self.merger.encode(np.frombuffer(column.buffers()[2], dtype=np.uint8, count=offsets[-1]), np.diff(offsets))

    def _numbers(self, words: pa.Array, encode) -> np.ndarray:
        """The cache's numbers of distinct words; those that it lacks come from its older half, or are encoded."""
        listed, held = strings(words), self.young.numbers
        found = list(map(held.get, listed))
        missing = [w for w, n in zip(listed, found) if n is None]
        if missing:
            old = self.old.numbers
            if known := [w for w in missing if w in old]:
                self.young.add(known, *self.old.ids(np.array([old[w] for w in known])))
                missing = [w for w in missing if w not in old]
            for i in range(0, len(missing), TOGETHER):
                part = missing[i : i + TOGETHER]
                self.young.add(part, *encode(part))
            found = list(map(held.__getitem__, listed))
        return np.array(found, dtype=np.int64)

    def _all_numbers(self, words: pa.Array) -> np.ndarray:
        """For each of distinct words, the numbers of its letters and of the marks that close it; one of them may be that of the empty word."""
        bases = pc.ascii_rtrim(words, characters=CLOSING)
        plain = pc.and_(pc.match_substring_regex(bases, PLAIN), pc.less_equal(pc.binary_length(bases), LONG))
        out = np.zeros((len(words), 2), dtype=np.int64)
        at, bases, own = np.flatnonzero(plain), bases.filter(plain), words.filter(plain)
        lower = pc.utf8_lower(bases).dictionary_encode()
        out[at, 0] = self._numbers(lower.dictionary, self._by_merges)[lower.indices.to_numpy()]
        # What is behind the letters is ASCII, and most words have nothing there.
        tails = pc.binary_length(own).to_numpy() - pc.binary_length(bases).to_numpy()
        closed = np.flatnonzero(tails)
        marks = pa.array([w[-n:] for w, n in zip(strings(own.take(pa.array(closed))), tails[closed].tolist())], pa.string()).dictionary_encode()
        out[at, 1] = self._numbers(EMPTY, self._by_library)[0]
        out[at[closed], 1] = self._numbers(marks.dictionary, self._by_library)[marks.indices.to_numpy()]
        others = np.flatnonzero(pc.invert(plain))
        out[others, 0] = self._numbers(words.take(pa.array(others)), self._by_library)
        out[others, 1] = self._numbers(EMPTY, self._by_library)[0]
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts one behind the other, each closed by end_id if that is given, and the bounds of each text's: one more than texts. Nulls count as empty."""
        texts = pc.fill_null(texts, "")
        if self.merger is None:
            ids, sizes = self._by_library(strings(texts))
            return self._closed(ids, np.concatenate([[0], np.cumsum(sizes)]), end_id)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if len(self.young.numbers) > self.keep:
            self.old, self.young = self.young, Words()
        numbers = self._all_numbers(coded.dictionary)[coded.indices.to_numpy()]
        ids, sizes = self.young.ids(numbers.ravel())
        at = np.concatenate([[0], np.cumsum(sizes.reshape(-1, 2).sum(axis=1))])
        return self._closed(ids, at[split.offsets.to_numpy() - split.offsets[0].as_py()], end_id)

    @staticmethod
    def _closed(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end_id is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
