"""Media columns: HTML as interleaved sequences of text and media references, payloads resolved by digest.

A media store is a table of digest and media, the stored form: a grey PNG of 192 samples a row. Sequences and payloads meet in a
join on the digest, so a picture that a third of all pages show is stored and decoded for its own sake and not for each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: Samples of a row, and what fills the last one.
WIDTH, FILL = 192, b" "
PNG = b"\x89PNG\r\n\x1a\n"
LEVEL = 6
#: The address of a payload in the store.
SCHEME = "media:sha256:"
SEQUENCE = "array<struct<position: int, kind: string, text: string, src: string, digest: string, caption: string>>"

_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("src", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SILENT = {"script", "style", "noscript", "template", "title"}
_BLOCKS = {"p", "div", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "br", "hr", "figure", "header", "footer", "nav", "main", "aside", "dl", "dt", "dd"}


def padded(data: bytes) -> bytes:
    """data filled up to a positive multiple of WIDTH."""
    return data + FILL * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes) -> bytes:
    """8-bit grey samples, WIDTH a row, without loss. Rows are stored unfiltered."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of what encode_png made; every chunk's checksum is verified."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, width, height, packed = 8, 0, 0, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey, not interlaced")
        elif kind == b"IDAT":
            packed.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Of the picture: rows, and sums for its mean, spread and edges, with a coarse histogram; whole numbers, so the same anywhere."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH).astype(np.int64)
    across = int(np.abs(np.diff(rows, axis=1)).sum())
    down = int(np.abs(np.diff(rows, axis=0)).sum())
    histogram = np.bincount(rows.ravel() >> 5, minlength=8)
    return f"{len(rows)}x{WIDTH};sum={int(rows.sum())};squares={int((rows * rows).sum())};across={across};down={down};hist={'-'.join(map(str, histogram))}"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent: list[str] = []
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})
        self.words = []

    def end_caption(self) -> None:
        """The caption belongs to the figure's media, and stays with them whatever else the page holds."""
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure:
                self.items[i]["caption"] = text or self.items[i]["caption"]
            if text and not self.figure:  # a caption of nothing is text
                self.words.append(text)
            self.caption = None

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent.append(tag)
        elif self.silent:
            return
        elif tag in _MEDIA:
            said = dict(attrs)
            if src := said.get("src"):
                if self.caption is None:
                    self.flush()
                digest = src[len(SCHEME) :].lower() if src.startswith(SCHEME) else None
                self.items.append({"kind": "media", "text": None, "src": src, "digest": digest, "caption": " ".join((said.get("alt") or "").split()) or None})
                self.figure.append(len(self.items) - 1)
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            if tag == "figure":
                self.end_caption()
                self.figure = []
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.silent:
            # What it holds ends with it, closed or not.
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
        elif tag == "figcaption":
            self.end_caption()
        elif tag in _BLOCKS:
            if tag == "figure":
                self.end_caption()
                self.flush()
                self.figure = []
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)

    def parse_html_declaration(self, i):
        # Outside foreign content a marked section is a comment up to the next >.
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


def sequence_of(html: str) -> list[dict]:
    """Text runs and media references in the order of the page.

    Broken HTML gives what can be read: marked sections are comments, an open caption ends with its figure or the page, and
    what the parser can't go on from is text. The head's title, styles and scripts are left out; text of a head is not.
    """
    parser = _Sequence()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser's own for declarations that it doesn't know
        parser.handle_data(parser.rawdata)
    parser.end_caption()
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.items)]


def interleave(pages: DataFrame) -> DataFrame:
    """pages with sequence, an array of (position from 0, kind text or media, text, src, digest, caption).

    pages: html; its other columns stay, but one named sequence. digest is set for src that begins with media:sha256:; a
    caption is the figure's figcaption, or else the alt text. Null and empty HTML: an empty sequence. One pass.
    """
    small_batches(pages.sparkSession)
    base = pages.select(*(F.col(c) for c in pages.columns if c.lower() != "sequence"))
    at = [c.lower() for c in base.columns].index("html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([sequence_of(x) for x in texts(batch.column(at))], pa.list_(_ITEM))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, "sequence"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(parse, f"{fields}, sequence {SEQUENCE}")


def write_media(payloads: DataFrame, path: str) -> str:
    """A store of payload (binary; its length a positive multiple of WIDTH) at path: digest and media. A task stores a digest once.

    Null payloads are left aside. An empty table gives an empty store.
    """
    small_batches(payloads.sparkSession)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for payload in batch.column(0).to_pylist():
                if payload is None or (digest := hashlib.sha256(payload)).digest() in seen:
                    continue
                seen.add(digest.digest())
                rows.append((digest.hexdigest(), encode_png(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.string()), pa.array([m for _, m in rows], pa.binary())], names=["digest", "media"])

    payloads.select("payload").mapInArrow(store, "digest string, media binary").write.parquet(path)
    return path


def read_media(store: DataFrame) -> DataFrame:
    """A store's rows read back, one for each digest: digest, payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256, feature.

    Payloads are decoded where they lie; only these figures are shuffled. A payload that doesn't have its digest is an error.
    """
    small_batches(store.sparkSession, 256)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload = decode_png(media)
                own = hashlib.sha256(payload).hexdigest()
                if own != digest:
                    raise ValueError(f"{digest} is stored with another payload")
                rows.append((digest, len(payload), own, zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    read_back = store.select("digest", "media").mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read_back.distinct()


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """A row for each item of sequences: position, kind, text, src, digest, caption, with the columns of media for its digest.

    sequences: sequence and other columns, which stay, but those named as the new ones; media: a row for each digest. Items
    without a digest, and digests that the store doesn't have, keep their place with nulls, so positions and captions stay
    aligned. An empty sequence gives no row.
    """
    ours = ["position", "kind", "text", "src", "digest", "caption"]
    rest = [c for c in sequences.columns if c.lower() not in {*ours, "sequence", "__digest", *(m.lower() for m in media.columns)}]
    items = sequences.select(*rest, F.explode("sequence").alias("__item")).select(*rest, *(F.col(f"__item.{c}").alias(c) for c in ours))
    held = media.withColumnRenamed("digest", "__digest")
    return items.join(held, items["digest"] == held["__digest"], "left").drop("__digest")
