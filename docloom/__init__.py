"""Spark-native document analytics: formats, Markdown blocks, chunks, cards, retrieval and packs as DataFrame operators."""

__version__ = "0.1.0"
