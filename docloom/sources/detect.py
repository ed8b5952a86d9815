"""Format detection as Column expressions: magic bytes, extensions and MIME types, text and charset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a file that detection reads, and of these that tell text.
HEAD, SAMPLE = 8192, 4096
OFFICE = "application/vnd.openxmlformats-officedocument."
#: Extensions and their MIME types; of several extensions the first is a type's.
MIME_OF = {
    ".txt": "text/plain", ".text": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".html": "text/html", ".htm": "text/html", ".csv": "text/csv", ".json": "application/json",
    ".jsonl": "application/jsonl", ".ipynb": "application/json", ".pdf": "application/pdf", ".zip": "application/zip", ".docx": OFFICE + "wordprocessingml.document", ".xlsx": OFFICE + "spreadsheetml.sheet",
    ".pptx": OFFICE + "presentationml.presentation", ".epub": "application/epub+zip", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".wav": "audio/wav", ".mp3": "audio/mpeg", ".m4a": "audio/mp4",
}
#: What lies in an archive of an Office kind.
PARTS = {".docx": "word/document.xml", ".xlsx": "xl/workbook.xml", ".pptx": "ppt/presentation.xml"}

GUESS = "struct<mimetype: string, extension: string, charset: string, filename: string, local_path: string, url: string, is_text: boolean>"


def mime_from_extension(c: Column) -> Column:
    low = F.lower(c)
    dotted = F.when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in MIME_OF.items() for x in pair)), dotted)


def extension_from_mime(c: Column) -> Column:
    first: dict[str, str] = {}
    for ext, mime in MIME_OF.items():
        first.setdefault(mime, ext)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), F.lower(c))


def magic_extension(content: Column, strict: bool = False) -> Column:
    """The extension that the first bytes tell; null where none does.

    An archive is .zip; unless strict, one that names an Office part in its first 8 KiB or its last, where its directory is,
    has the Office extension.
    """
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 256), "iso-8859-1"), r"^(\xEF\xBB\xBF)?\s+", ""))
    archive = head.startswith("504B") & F.substring(head, 5, 2).isin("03", "05", "07")
    ends = F.concat(F.decode(F.substring(content, 1, HEAD), "iso-8859-1"), F.decode(F.substring(content, -HEAD, HEAD), "iso-8859-1"))
    kind = F.when(F.lit(strict), ".zip")
    for ext, part in PARTS.items():
        kind = kind.when(ends.contains(part), ext)
    return (
        F.when(head.startswith("25504446") & (F.octet_length(content) >= 5), ".pdf")
        .when(archive, kind.otherwise(".zip"))
        .when(head == "89504E470D0A1A0A", ".png")
        .when(head.startswith("FFD8FF"), ".jpg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), ".gif")
        .when(text.startswith("<!doctype html") | text.startswith("<html"), ".html")
        .when(F.substring(head, 1, 2).isin("7B", "5B"), ".json")
    )


def is_likely_text(content: Column) -> Column:
    """Fewer than 1 % of the first 4 KiB are control bytes; empty content isn't text."""
    sample = F.decode(F.substring(content, 1, SAMPLE), "iso-8859-1")
    n = F.char_length(sample)
    odd = n - F.char_length(F.regexp_replace(sample, r"[\x00-\x08]", ""))
    return F.coalesce((n > 0) & (odd / F.greatest(n, F.lit(1)) < 0.01), F.lit(False))


def detect_charset(content: Column) -> Column:
    """utf-16 and utf-8 by their marks, ascii, utf-8 where the bytes are valid, else latin1."""
    head = F.hex(F.substring(content, 1, 3))
    sample = F.decode(F.substring(content, 1, HEAD), "iso-8859-1")
    # A character may be cut at the end of the head, so the last three bytes don't count against UTF-8.
    valid = F.is_valid_utf8(F.substring(content, 1, HEAD).cast("string")) | F.is_valid_utf8(F.substring(content, 1, HEAD - 1).cast("string")) | F.is_valid_utf8(F.substring(content, 1, HEAD - 2).cast("string")) | F.is_valid_utf8(F.substring(content, 1, HEAD - 3).cast("string"))
    return F.when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").when(sample.rlike(r"^[\x00-\x7F]*$"), "ascii").when(valid, "utf-8").otherwise("latin1")


def normalize_charset(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("iso-8859-1"), F.lit("latin1"))


def merge_info(base: Column, *updates: Column) -> Column:
    """A description with the fields that updates set; null and empty ones set nothing, later ones win."""
    names = ("mimetype", "extension", "charset", "filename", "local_path", "url")
    pick = lambda n: F.coalesce(*(F.nullif(u[n], F.lit("")) for u in reversed(updates)), base[n])
    return F.struct(*(pick(n).alias(n) for n in names))


def guess_formats(content: Column, info: Column, strict: bool = False) -> Column:
    """Guesses at what content is, in the order to try: one where magic bytes and info agree, else info's and the bytes' own.

    info: a struct of mimetype, extension, charset, filename, local_path and url, all of which may be null.
    """
    ext = magic_extension(F.substring(content, 1, HEAD) if strict else content, strict)
    mime = mime_from_extension(ext)
    known = ext.isNotNull()
    is_text = F.when(known, mime.startswith("text/") | mime.contains("json") | mime.contains("xml")).otherwise(is_likely_text(content))
    found = F.when(info["charset"].isNull() & is_text, normalize_charset(detect_charset(content)))
    charset = F.coalesce(info["charset"], found)
    bare = lambda c: F.regexp_replace(F.lower(c), r"^\.", "")
    agrees = (info["mimetype"].isNull() | (info["mimetype"] == mime)) & (info["extension"].isNull() | (bare(info["extension"]) == bare(ext))) & (info["charset"].isNull() | found.isNull() | (normalize_charset(info["charset"]) == found))

    def guess(m: Column, e: Column, c: Column) -> Column:
        return F.struct(m.alias("mimetype"), e.alias("extension"), c.alias("charset"), info["filename"].alias("filename"), info["local_path"].alias("local_path"), info["url"].alias("url"), is_text.alias("is_text"))

    full_mime = F.coalesce(info["mimetype"], mime_from_extension(info["extension"]))
    full_ext = F.coalesce(info["extension"], extension_from_mime(info["mimetype"]))
    own = guess(full_mime, full_ext, charset)
    both = guess(F.coalesce(info["mimetype"], mime), F.coalesce(info["extension"], ext), charset)
    return F.when(known & agrees, F.array(both)).when(known, F.array(guess(full_mime, full_ext, info["charset"]), guess(mime, ext, charset))).otherwise(F.array(own))


def response_info(content_type: Column, disposition: Column, url: Column) -> Column:
    """What an HTTP response tells of its body: type and charset, and the name from its disposition or else its address."""
    mime = F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))
    charset = F.regexp_extract(content_type, r"(?i)charset\s*=\s*\"?([^\";\s]+)", 1)
    said = F.regexp_extract(disposition, r"(?i)filename\*?\s*=\s*(?:UTF-8'')?\"?([^\";]+)", 1)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    name = F.coalesce(F.nullif(said, F.lit("")), F.when(last.contains("."), last))
    ext = F.nullif(F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)), F.lit(""))
    return F.struct(F.nullif(mime, F.lit("")).alias("mimetype"), ext.alias("extension"), F.nullif(charset, F.lit("")).alias("charset"), name.alias("filename"), F.lit(None).cast("string").alias("local_path"), url.alias("url"))
