"""Which converter takes what, in the order they are tried; and files to documents as a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import batch_udf
from . import converters as C
from .converters import Context, Converted, Info
from .detect import guess_formats

#: Priorities: those of a format come before those that take almost anything.
SPECIFIC, GENERIC = 0, 10
OLE = bytes.fromhex("D0CF11E0A1B11AE1")
WIKIPEDIA = re.compile(r"^https?://[a-zA-Z]{2,3}\.wikipedia\.org/")
BING = re.compile(r"^https://www\.bing\.com/search\?q=")
YOUTUBE = re.compile(r"^https?://(?:www\.)?youtube\.com/watch\?")


@dataclass(frozen=True)
class Entry:
    name: str
    accepts: Callable[[bytes, Info], bool]
    convert: Callable[[bytes, Info, Context], Converted]
    priority: int = SPECIFIC


def _of(extensions: str, mimes: tuple[str, ...] = ()) -> Callable[[bytes, Info], bool]:
    known = {f".{x}" for x in extensions.split()}
    return lambda data, info: info.ext in known or any(info.mime.startswith(m) for m in mimes)


_html = _of("html htm", ("text/html", "application/xhtml"))


def _page(address: re.Pattern) -> Callable[[bytes, Info], bool]:
    return lambda data, info: bool(address.match(info.url or "")) and _html(data, info)


def _notebook(data: bytes, info: Info) -> bool:
    return info.ext == ".ipynb" or (info.mime.startswith("application/json") and b"nbformat_minor" in data and b"nbformat" in data.replace(b"nbformat_minor", b""))


def _feed(data: bytes, info: Info) -> bool:
    if info.ext in (".rss", ".atom") or info.mime.startswith(("application/rss", "application/atom")):
        return True
    return (info.ext == ".xml" or info.mime.startswith(("text/xml", "application/xml"))) and C.feed_kind(info.text(data)) is not None


def _mail(data: bytes, info: Info) -> bool:
    """Its extension or type; its magic only where no extension says otherwise, as old spreadsheets share it."""
    return info.ext == ".msg" or info.mime.startswith("application/vnd.ms-outlook") or (data[:8] == OLE and not info.ext)


def _text(data: bytes, info: Info) -> bool:
    return info.ext in (".txt", ".text", ".md", ".markdown", ".json", ".jsonl") or info.mime.startswith(("text/", "application/json", "application/markdown")) or bool(info.charset)


OFFICE = "application/vnd.openxmlformats-officedocument."
#: Of one priority, the later ones are tried first.
REGISTRY: list[Entry] = [
    Entry("text", _text, C.plain_text, GENERIC),
    Entry("zip", _of("zip", ("application/zip",)), C.archive, GENERIC),
    Entry("html", _html, C.html_page, GENERIC),
    Entry("rss", _feed, C.feed),
    Entry("wikipedia", _page(WIKIPEDIA), C.wikipedia),
    Entry("youtube", _page(YOUTUBE), C.youtube),
    Entry("bing", _page(BING), C.bing_results),
    Entry("csv", _of("csv", ("text/csv", "application/csv")), C.csv_table),
    Entry("ipynb", _notebook, C.notebook),
    Entry("docx", _of("docx", (OFFICE + "wordprocessingml",)), C.word_document),
    Entry("xlsx", _of("xlsx", (OFFICE + "spreadsheetml",)), C.spreadsheet),
    Entry("xls", _of("xls", ("application/vnd.ms-excel", "application/excel")), C.legacy_sheet),
    Entry("pptx", _of("pptx", (OFFICE + "presentationml",)), C.presentation),
    Entry("audio", _of("wav mp3 m4a mp4", ("audio/", "video/mp4")), C.audio),
    Entry("pdf", _of("pdf", ("application/pdf", "application/x-pdf")), C.pdf),
    Entry("msg", _mail, C.mail),
    Entry("epub", _of("epub", ("application/epub",)), C.epub),
    Entry("image", _of("png jpg jpeg gif webp", ("image/",)), C.image),
]


def register(entry: Entry) -> None:
    """Add a converter; it is tried before those of its priority that were added before."""
    REGISTRY.append(entry)


def in_order(registry: list[Entry] | None = None) -> list[Entry]:
    return sorted(reversed(REGISTRY if registry is None else registry), key=lambda e: e.priority)


def convert_bytes(data: bytes, info: Info = Info(), context: Context = Context(), guesses: list[Info] | None = None) -> Converted:
    """The first success of guesses times converters; then once more with nothing known. Raises what explains the failure best."""
    failures: list[str] = []
    missing: C.MissingReader | None = None
    tried = guesses if guesses is not None else [info, *sniff(data, info)]
    for guess in [*tried, Info(filename=info.filename)]:
        for entry in in_order():
            if not entry.accepts(data, guess):
                continue
            try:
                made = entry.convert(data, guess, context)
            except C.MissingReader as e:
                missing = missing or e
                failures.append(f"{entry.name}: {e}")
            except Exception as e:  # a converter's own failure is a row's error, not the job's
                failures.append(f"{entry.name}: {type(e).__name__}: {e}")
            else:
                return Converted(normalize(made.markdown), made.title)
    if missing and len(set(failures)) == 1:
        raise missing
    if failures:
        raise C.ConversionFailed("; ".join(dict.fromkeys(failures)))
    raise C.UnsupportedFormat(f"no converter takes {info.filename or info.extension or info.mimetype or 'this content'}")


def normalize(markdown: str) -> str:
    """Lines without white space at their ends, and at most one blank line in a row."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]+(?=\n|\Z)", "", markdown))


def sniff(data: bytes, info: Info) -> list[Info]:
    """What the bytes themselves say, for entries of archives and single calls; columns go by guess_formats."""
    head = data[:8]
    low = data[:256].lstrip().lower()
    if head.startswith(b"%PDF"):
        found = Info("application/pdf", ".pdf")
    elif head[:2] == b"PK":
        names = C._archive(data).namelist() if data[:4] == b"PK\x03\x04" else []
        ext = next((e for e, p in ((".docx", "word/document.xml"), (".xlsx", "xl/workbook.xml"), (".pptx", "ppt/presentation.xml"), (".epub", "META-INF/container.xml")) if p in names), ".zip")
        found = Info(None, ext)
    elif head == b"\x89PNG\r\n\x1a\n":
        found = Info("image/png", ".png")
    elif head[:3] == b"\xff\xd8\xff":
        found = Info("image/jpeg", ".jpg")
    elif head[:6] in (b"GIF87a", b"GIF89a"):
        found = Info("image/gif", ".gif")
    elif low.startswith((b"<!doctype html", b"<html")):
        found = Info("text/html", ".html", "utf-8")
    elif head[:1] in (b"{", b"["):
        found = Info("application/json", ".json", "utf-8")
    elif data and sum(x < 9 for x in data[:4096]) < 0.01 * len(data[:4096]):
        found = Info(None, None, "utf-8")
    else:
        return []
    return [Info(found.mimetype, found.extension, found.charset, info.filename, info.local_path, info.url)]


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content and info of files, as Spark lists and reads them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return files.select("path", "content", "length", file_info(F.col("path")).alias("info"))


def file_info(path: Column) -> Column:
    """What a file's path tells."""
    from ..functions.text import basename, extname

    none = F.lit(None).cast("string")
    return F.struct(none.alias("mimetype"), F.nullif(extname(path), F.lit("")).alias("extension"), none.alias("charset"), basename(path).alias("filename"), path.alias("local_path"), none.alias("url"))


def convert_files(files: DataFrame, context: Context = Context(), strict: bool = False) -> DataFrame:
    """files (content and info, or content alone) with markdown, title and error; one bad file never fails the job.

    Formats are guessed by expressions; only the bytes and the guesses go to Python, in Arrow batches.
    """
    if "info" not in files.columns:
        none = F.lit(None).cast("string")
        files = files.withColumn("info", F.struct(*(none.alias(n) for n in ("mimetype", "extension", "charset", "filename", "local_path", "url"))))

    @batch_udf("struct<markdown: string, title: string, error: string>")
    def converted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, guesses in batches:
            rows = []
            for data, guess in zip(contents, guesses):
                infos = [Info(**{k: g[k] for k in ("mimetype", "extension", "charset", "filename", "local_path", "url")}) for g in guess]
                try:
                    made = convert_bytes(bytes(data or b""), infos[0], context, [*infos, *sniff(bytes(data or b""), infos[0])])
                    rows.append((made.markdown, made.title, None))
                except Exception as e:
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["markdown", "title", "error"])

    made = files.withColumn("__c", converted(F.col("content"), guess_formats(F.col("content"), F.col("info"), strict)))
    return made.select(*(c for c in files.columns if c != "content"), "__c.markdown", "__c.title", "__c.error")


def convert_pages(pages: DataFrame) -> DataFrame:
    """Web pages (url, html and other columns) with markdown, title and error."""
    none = F.lit(None).cast("string")
    info = F.struct(F.lit("text/html").alias("mimetype"), F.lit(".html").alias("extension"), F.lit("utf-8").alias("charset"), none.alias("filename"), none.alias("local_path"), F.col("url").alias("url"))
    return convert_files(pages.withColumn("content", F.encode(F.col("html"), "utf-8")).withColumn("info", info).drop("html")).drop("info")


def read_uris(uris: DataFrame, fetch: Callable[[str], tuple[bytes, dict]] | None = None) -> DataFrame:
    """uri with content, info and error: data: addresses are decoded, http(s): ones fetched by fetch, others are errors.

    file: addresses are for read_files, which lets Spark read them in parallel.
    """
    from ..functions.text import parse_data_uri
    from .detect import response_info

    uri = F.col("uri")
    data = parse_data_uri(F.when(uri.startswith("data:"), uri))
    none = F.lit(None).cast("string")
    inline = F.struct(data["mimetype"].alias("mimetype"), none.alias("extension"), data["charset"].alias("charset"), none.alias("filename"), none.alias("local_path"), none.alias("url"))

    @batch_udf("struct<content: binary, content_type: string, disposition: string, error: string>")
    def fetched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for address in batch:
                try:
                    body, headers = fetch(address) if address and fetch else (None, {})
                    rows.append((body, headers.get("content-type"), headers.get("content-disposition"), None))
                except Exception as e:
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["content", "content_type", "disposition", "error"])

    web = uri.rlike("^https?://")
    got = uris.withColumn("__f", fetched(F.when(web, uri)))
    told = response_info(F.col("__f.content_type"), F.col("__f.disposition"), uri)
    error = F.when(web & F.lit(fetch is None), "no fetcher for http(s) addresses").when(~web & ~uri.startswith("data:"), "only data: and http(s): addresses").otherwise(F.col("__f.error"))
    return got.select(*uris.columns, F.when(web, F.col("__f.content")).otherwise(data["content"]).alias("content"), F.when(web, told).otherwise(inline).alias("info"), error.alias("error"))
