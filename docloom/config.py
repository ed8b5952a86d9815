"""The knobs of chunking, retrieval and answering, with their defaults."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields, replace

#: Fixed values.
CHARS_PER_TOKEN = 4
MAX_SENTENCE_CHARS = 2048
MIN_SENTENCE_CHARS = 24
MIN_SOURCE_CHARS = 12
REPLY_WORDS_MIN, REPLY_WORDS_MAX = 10, 500


@dataclass(frozen=True)
class PipelineConfig:
    chunk_size_tokens: int = 512
    chunk_overlap_tokens: int = 64
    embedding_dimensions: int = 384
    vector_top_k: int = 8
    bm25_top_k: int = 8
    fuse_top_k: int = 3
    min_vector_score: float = 0.45
    min_lexical_overlap: float = 0.34
    temperature: float = 0.1
    retry_temperature: float = 0.2
    n_predict: int = 512
    chat_n_ctx: int = 2048
    embedding_n_ctx: int = 512
    hnsw_connectivity: int = 16
    hnsw_expansion_add: int = 64
    hnsw_expansion_search: int = 48
    max_reply_words: int = 500
    max_reply_sentences: int = 40


DEFAULTS = PipelineConfig()


def clamp_reply_words(words: float | None) -> int:
    """Rounded and kept between 10 and 500; the default for anything that isn't a finite number."""
    if words is None or not math.isfinite(words):
        return DEFAULTS.max_reply_words
    return int(min(REPLY_WORDS_MAX, max(REPLY_WORDS_MIN, math.floor(words + 0.5))))


def resolve(overrides: dict | None = None) -> PipelineConfig:
    """The defaults with what overrides sets; None keeps the default, unknown names are an error."""
    known = {f.name for f in fields(PipelineConfig)}
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    if odd := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
    made = replace(DEFAULTS, **given)
    return replace(made, max_reply_words=clamp_reply_words(made.max_reply_words))


def tokens_to_chars(tokens: float) -> int:
    """Characters of a token budget, at least one."""
    return max(1, math.floor(tokens * CHARS_PER_TOKEN))
