"""Byte-pair merging of many words at once, in NumPy: each round takes one merge in every word that has one left."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max


class Merger:
    """The ids that a BPE model with an end-of-word suffix gives to words, each by itself.

    letters: the vocabulary's character for each of the 256 bytes. Raises ValueError for a model in which a byte has no
    token, or two merges make the same one, as the order of merges alone wouldn't settle the result there.
    """

    def __init__(self, model: dict, letters: dict[int, str]):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        try:
            self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
            self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], dtype=np.int32)
            pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
            self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        except KeyError as e:
            raise ValueError(f"the vocabulary lacks {e}") from None
        if len(np.unique(self.made)) != len(pairs):
            raise ValueError("two merges make the same token")
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] for a, _ in pairs], dtype=np.int64) * self.base + np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.ranks = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.ranks]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges; NONE for one that doesn't merge."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], np.int32(NONE))

    def encode(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes one behind the other, and how many each has (one at least): the same for their ids.

        As many rounds as the longest word has merges, each over the words that aren't done.
        """
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        ends = np.cumsum(sizes) - 1
        token = self.inner[data]
        token[ends] = self.last[data[ends]]
        rank = np.full(len(token), NONE, dtype=np.int32)
        rank[:-1] = self.rank(token[:-1], token[1:])
        rank[ends] = NONE
        done_words, done_tokens = [], []
        while len(token):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            held = np.diff(starts, append=len(word))
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                gone = np.repeat(over, held)
                done_words.append(word[gone])
                done_tokens.append(token[gone])
                token, word, rank = token[~gone], word[~gone], rank[~gone]
                held, least = held[~over], least[~over]
                if not len(token):
                    break
            # The first of the lowest pairs of each word becomes one token.
            at = np.flatnonzero(rank == np.repeat(least, held))
            at = at[np.diff(word[at], prepend=-1) != 0]
            token[at] = self.made[rank[at]]
            stays = np.ones(len(token), dtype=bool)
            stays[at + 1] = False
            token, word, rank = token[stays], word[stays], rank[stays]
            at -= np.arange(len(at))
            rank[at] = NONE
            follows = np.minimum(at + 1, len(word) - 1)
            right = at[(follows > at) & (word[follows] == word[at])]
            rank[right] = self.rank(token[right], token[right + 1])
            left = at[(at > 0) & (word[at - 1] == word[at])] - 1
            rank[left] = self.rank(token[left], token[left + 1])
        words = np.concatenate(done_words) if done_words else word
        tokens = np.concatenate(done_tokens) if done_tokens else token
        return tokens[np.argsort(words, kind="stable")].astype(np.uint32), np.bincount(words, minlength=len(sizes))
