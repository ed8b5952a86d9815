"""Converters: bytes of one format as Markdown. Each is a pure function of the bytes and what is known of them."""

from __future__ import annotations

import base64
import csv
import io
import json
import posixpath
import re
import struct
import wave
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

from ..functions.html_markdown import html_to_markdown, parse, render, title_of
from ..functions.omml import _name, latex, parse_fragment


class UnsupportedFormat(ValueError):
    """No converter takes the content."""


class MissingReader(RuntimeError):
    """The format needs a reader that isn't registered."""


class ConversionFailed(RuntimeError):
    """Converters took the content, and all of them failed."""


@dataclass(frozen=True)
class Info:
    mimetype: str | None = None
    extension: str | None = None
    charset: str | None = None
    filename: str | None = None
    local_path: str | None = None
    url: str | None = None

    @property
    def ext(self) -> str:
        return (self.extension or "").lower()

    @property
    def mime(self) -> str:
        return (self.mimetype or "").lower()

    def text(self, data: bytes) -> str:
        """data in charset. A guess of ASCII is of a file's head alone; what follows may be UTF-8, or else Latin-1."""
        if (self.charset or "").lower() in ("ascii", "us-ascii"):
            try:
                return data.decode("utf-8")
            except UnicodeDecodeError:
                return data.decode("latin-1")
        try:
            return data.decode(self.charset or "utf-8", "replace").removeprefix("﻿")
        except LookupError:
            return data.decode("utf-8", "replace")


@dataclass(frozen=True)
class Context:
    """What converters may use: readers of formats that the standard library doesn't know, captions, transcripts, switches."""

    readers: dict[str, Callable[[bytes], object]] = field(default_factory=dict)
    describe_image: Callable[[bytes, str], str | None] | None = None
    transcript: Callable[[str], str | None] | None = None
    keep_data_uris: bool = False
    strict: bool = False
    depth: int = 3


@dataclass(frozen=True)
class Converted:
    markdown: str
    title: str | None = None


def _cell(text: str, strict: bool = False) -> str:
    return text if strict else re.sub(r"\s*\n\s*", " ", text).replace("|", "\\|")


def gfm(rows: list[list[str]], strict: bool = False) -> str:
    """Rows as a table; shorter ones are filled up and longer ones cut to the first one's width."""
    if not rows:
        return ""
    width = len(rows[0])
    line = lambda r: "| " + " | ".join([*(_cell(c, strict) for c in r[:width]), *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def plain_text(data: bytes, info: Info, context: Context) -> Converted:
    return Converted(info.text(data))


def csv_table(data: bytes, info: Info, context: Context) -> Converted:
    csv.field_size_limit(1 << 30)
    rows = [r for r in csv.reader(io.StringIO(info.text(data), newline=""), strict=False) if any(c.strip() for c in r)]
    return Converted(gfm(rows, context.strict))


def html_page(data: bytes, info: Info, context: Context) -> Converted:
    text = info.text(data)
    root = parse(text)
    return Converted(render(next(root.find(tag="body"), root)), title_of(root))


def wikipedia(data: bytes, info: Info, context: Context) -> Converted:
    root = parse(info.text(data))
    name = next((n.text().strip() for n in root.find(css="mw-page-title-main")), "") or title_of(root) or "Wikipedia"
    body = next(root.find(id="mw-content-text"), None) or next(root.find(tag="body"), root)
    return Converted(f"# {name}\n\n{render(body)}", name)


def _redirect(href: str) -> str:
    """The address that a search page's redirect stands for."""
    said = parse_qs(urlsplit(urljoin("https://www.bing.com", href)).query).get("u", [""])[0][2:].strip()
    try:
        return base64.urlsafe_b64decode(said + "=" * (-len(said) % 4)).decode() if said else href
    except ValueError:
        return href


def bing_results(data: bytes, info: Info, context: Context) -> Converted:
    root = parse(info.text(data))
    for node in list(root.find(css="algoSlug_icon")):
        node.remove()
    for node in root.find(css="tptt"):
        if text := node.text():
            node.children = [text + " "]
    found = []
    for node in root.find(css="b_algo"):
        for link in node.find(tag="a"):
            if link.attrs.get("href"):
                link.attrs["href"] = _redirect(link.attrs["href"])
        if lines := [x for x in map(str.strip, render(node).split("\n")) if x]:
            found.append("\n".join(lines))
    query = parse_qs(urlsplit(info.url or "").query).get("q", [""])[0]
    return Converted(f"## A Bing search for '{query}' found the following results:\n\n" + "\n\n".join(found), title_of(root))


def _deep(value: object, key: str) -> object:
    """The first value of key in nested JSON, in document order."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                if k == key:
                    return v
                if (found := _deep(v, key)) is not None:
                    return found
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return None


def youtube(data: bytes, info: Info, context: Context) -> Converted:
    root = parse(info.text(data))
    said: dict[str, str] = {"title": t} if (t := title_of(root)) else {}
    for node in root.find(tag="meta"):
        key = node.attrs.get("itemprop") or node.attrs.get("property") or node.attrs.get("name")
        if key and node.attrs.get("content"):
            said[key] = node.attrs["content"]
    for node in root.find(tag="script"):
        if m := re.search(r"var ytInitialData = (\{.*?\});", node.text(), re.S):
            try:
                body = _deep(json.loads(m[1]), "attributedDescriptionBodyText")
            except ValueError:
                continue
            if isinstance(body, dict) and "content" in body:
                said["description"] = str(body["content"])
    title = said.get("title") or said.get("og:title") or said.get("name")
    parts = ["# YouTube\n"]
    if title:
        parts.append(f"\n## {title}\n")
    stats = [f"- **{label}:** {said[k]}" for k, label in (("interactionCount", "Views"), ("keywords", "Keywords"), ("duration", "Runtime")) if said.get(k)]
    if stats:
        parts.append("\n### Video Metadata\n" + "\n".join(stats) + "\n")
    if told := said.get("description") or said.get("og:description"):
        parts.append(f"\n### Description\n{told}\n")
    video = parse_qs(urlsplit((info.url or "").replace("\\", "")).query).get("v", [None])[0]
    if video and context.transcript and (spoken := context.transcript(video)):
        parts.append(f"\n### Transcript\n{spoken}\n")
    return Converted("".join(parts), title)


def _tree(text: str) -> ET.Element:
    return parse_fragment(text)


def _child(node: ET.Element, *names: str) -> str:
    """The text of the first child of one of these local names."""
    for name in names:
        for x in node:
            if _name(x) == name and (text := "".join(x.itertext()).strip()):
                return text
    return ""


def feed_kind(text: str) -> str | None:
    try:
        top = next(iter(_tree(text)), None)
    except ET.ParseError:
        return None
    if top is None:
        return None
    return "rss" if _name(top) == "rss" else "atom" if _name(top) == "feed" and any(_name(x) == "entry" for x in top) else None


def feed(data: bytes, info: Info, context: Context) -> Converted:
    text = info.text(data)
    kind = feed_kind(text)
    if not kind:
        raise ValueError("not a feed")
    top = next(iter(_tree(text)))
    rss = kind == "rss"
    channel = next((x for x in top if _name(x) == "channel"), top) if rss else top
    title, about = _child(channel, "title"), _child(channel, "description" if rss else "subtitle")
    parts = [f"# {title}\n" if title or not rss else "", f"{about}\n" if about else ""]
    dated = ("pubDate", "Published on") if rss else ("updated", "Updated on")
    for item in (x for x in channel if _name(x) == ("item" if rss else "entry")):
        if name := _child(item, "title"):
            parts.append(f"\n## {name}\n")
        if when := _child(item, dated[0]):
            parts.append(f"{dated[1]}: {when}\n")
        for body in (_child(item, "description" if rss else "summary"), _child(item, "encoded" if rss else "content")):
            parts.append(html_to_markdown(body) if body else "")
    return Converted("".join(parts), title or None)


def notebook(data: bytes, info: Info, context: Context) -> Converted:
    book = json.loads(info.text(data))
    out, title = [], None
    for cell in book.get("cells") or []:
        source = cell.get("source") or ""
        source = "".join(source) if isinstance(source, list) else str(source)
        kind = cell.get("cell_type")
        if kind == "markdown":
            out.append(source)
            if title is None and (m := re.search(r"^#\s+(.+)", source, re.M)):
                title = m[1].strip()
        elif kind in ("code", "raw"):
            out.append(f"```{'python' if kind == 'code' else ''}\n{source}\n```")
    return Converted("\n\n".join(out), (book.get("metadata") or {}).get("title") or title)


def _archive(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _read(archive: zipfile.ZipFile, name: str) -> str | None:
    try:
        return archive.read(name).decode("utf-8", "replace")
    except KeyError:
        return None


def _attr(node: ET.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), "")


def _relations(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation ids of a part, and the paths they lead to."""
    folder, name = posixpath.split(part)
    text = _read(archive, f"{folder}/_rels/{name}.rels")
    out = {}
    for x in _tree(text).iter() if text else ():
        if _name(x) == "Relationship":
            target = _attr(x, "Target")
            out[_attr(x, "Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return out


def spreadsheet(data: bytes, info: Info, context: Context) -> Converted:
    """Every sheet under its name, as a table."""
    archive = _archive(data)
    strings = _read(archive, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter() if _name(t) == "t") for si in (_tree(strings).iter() if strings else ()) if _name(si) == "si"]
    book = _read(archive, "xl/workbook.xml")
    if book is None:
        raise ValueError("no workbook")
    paths = _relations(archive, "xl/workbook.xml")
    sections = []
    for sheet in (x for x in _tree(book).iter() if _name(x) == "sheet"):
        text = _read(archive, paths.get(_attr(sheet, "id"), ""))
        rows: list[list[str]] = []
        for row in (x for x in (_tree(text).iter() if text else ()) if _name(x) == "row"):
            cells: list[str] = []
            for c in (x for x in row if _name(x) == "c"):
                at = re.match("[A-Z]+", _attr(c, "r"))
                column = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(at[0]))) - 1 if at else len(cells)
                kind, value = _attr(c, "t"), _child(c, "v")
                if kind == "s" and value:
                    value = shared[int(value)] if int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _name(t) == "t")
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                cells += [""] * (column + 1 - len(cells))
                cells[column] = value
            rows.append(cells)
        width = max(map(len, rows), default=0)
        sections.append(f"## {_attr(sheet, 'name')}\n\n{gfm([r + [''] * (width - len(r)) for r in rows if any(r)])}".strip())
    return Converted("\n\n".join(sections))


def _run_marks(run: ET.Element) -> tuple[bool, bool]:
    on = {_name(x) for p in run if _name(p) == "rPr" for x in p if _attr(x, "val") not in ("0", "false", "none")}
    return "b" in on, "i" in on


def _paragraph(node: ET.Element, links: dict[str, str]) -> str:
    out = []
    for x in node:
        kind = _name(x)
        if kind == "r":
            text = "".join((t.text or "") if _name(t) == "t" else "\n" if _name(t) in ("br", "cr") else "\t" if _name(t) == "tab" else "" for t in x)
            bold, italic = _run_marks(x)
            core = text.strip()
            if core and (bold or italic):
                mark = "**" * bold + "_" * italic
                text = text.replace(core, f"{mark}{core}{mark[::-1]}", 1)
            out.append(text)
        elif kind == "oMath":
            out.append(f"${latex(x)}$")
        elif kind == "oMathPara":
            out += [f"$${latex(m)}$$" for m in x if _name(m) == "oMath"]
        elif kind == "hyperlink":
            inner, target = _paragraph(x, links), links.get(_attr(x, "id"))
            out.append(f"[{inner}]({target})" if target else inner)
        elif kind in ("ins", "smartTag", "sdt", "sdtContent"):
            out.append(_paragraph(x, links))
    return "".join(out)


def word_document(data: bytes, info: Info, context: Context) -> Converted:
    """Headings by style, lists by numbering, tables, bold and italic runs, links, and math as LaTeX."""
    archive = _archive(data)
    text = _read(archive, "word/document.xml")
    if text is None:
        raise ValueError("no document part")
    rels = _read(archive, "word/_rels/document.xml.rels")
    links = {_attr(x, "Id"): _attr(x, "Target") for x in (_tree(rels).iter() if rels else ()) if _name(x) == "Relationship" and _attr(x, "TargetMode") == "External"}
    body = next((x for x in _tree(text).iter() if _name(x) == "body"), None)
    out: list[str] = []
    listed = False
    for x in body if body is not None else ():
        if _name(x) == "tbl":
            rows = [[" ".join(filter(None, (_paragraph(p, links).strip() for p in c.iter() if _name(p) == "p"))) for c in r if _name(c) == "tc"] for r in x if _name(r) == "tr"]
            out.append(gfm([r for r in rows if r]))
            listed = False
            continue
        if _name(x) != "p" or not (said := _paragraph(x, links).strip()):
            continue
        style = next((_attr(s, "val") for p in x if _name(p) == "pPr" for s in p if _name(s) == "pStyle"), "")
        number = next((n for p in x if _name(p) == "pPr" for n in p if _name(n) == "numPr"), None)
        heading = re.fullmatch(r"(?i)(?:heading|titre|berschrift)\s*([1-6])", style) or (re.fullmatch("(?i)(title)", style))
        if heading:
            level = int(heading[1]) if heading[1].isdigit() else 1
            out.append(f"{'#' * level} {said}")
        elif number is not None or re.match("(?i)list", style):
            level = next((int(_attr(i, "val") or 0) for i in (number if number is not None else ()) if _name(i) == "ilvl"), 0)
            item = f"{'    ' * level}*   {said}"
            if listed:
                out[-1] += f"\n{item}"
            else:
                out.append(item)
            listed = True
            continue
        else:
            out.append(said)
        listed = False
    return Converted("\n\n".join(filter(None, out)))


def presentation(data: bytes, info: Info, context: Context) -> Converted:
    """Slides in the order of their numbers: text, tables, pictures, notes."""
    archive = _archive(data)
    slides = sorted((int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n, re.I)))
    sections = []
    for i, (number, path) in enumerate(slides, 1):
        tree = _tree(_read(archive, path) or "")
        tables = [t for t in tree.iter() if _name(t) == "tbl"]
        inside = {id(x) for t in tables for x in t.iter()}
        said = [t for x in tree.iter() if _name(x) == "t" and id(x) not in inside and (t := (x.text or "").strip())]
        parts = [f"<!-- Slide number: {i} -->"]
        if said:
            parts += [f"# {said[0]}", *(["\n".join(said[1:])] if said[1:] else [])]
        for t in tables:
            parts.append(gfm([[" ".join(filter(None, ((x.text or "").strip() for x in c.iter() if _name(x) == "t"))) for c in r if _name(c) == "tc"] for r in t if _name(r) == "tr"]))
        rels = _relations(archive, path)
        for x in tree.iter():
            target = rels.get(_attr(x, "embed")) if _attr(x, "embed") else None
            if target and target in archive.namelist():
                picture, name = archive.read(target), posixpath.basename(target)
                alt = re.sub(r"[\r\n\[\]]", " ", (context.describe_image and context.describe_image(picture, image_mime(name))) or name).strip()
                where = f"data:{image_mime(name)};base64,{base64.b64encode(picture).decode()}" if context.keep_data_uris else name
                parts.append(f"\n![{alt}]({where})\n")
        notes = _read(archive, f"ppt/notesSlides/notesSlide{number}.xml")
        if notes and (told := "\n".join(t for x in _tree(notes).iter() if _name(x) == "t" and (t := (x.text or "").strip()))):
            parts += ["\n\n### Notes:\n", told]
        sections.append("\n".join(parts).strip())
    return Converted("\n\n".join(sections).strip())


def epub(data: bytes, info: Info, context: Context) -> Converted:
    """Metadata lines, then the chapters in spine order."""
    archive = _archive(data)
    container = _read(archive, "META-INF/container.xml")
    root = next((_attr(x, "full-path") for x in _tree(container).iter() if _name(x) == "rootfile"), "") if container else ""
    text = _read(archive, root)
    if not root or text is None:
        raise ValueError("not an e-book: no package")
    package = _tree(text)
    said: dict[str, list[str]] = {}
    for x in package.iter():
        if _name(x) in ("title", "creator", "language", "publisher", "date", "description", "identifier") and (t := "".join(x.itertext()).strip()):
            said.setdefault(_name(x), []).append(t)
    labels = {"title": "Title", "creator": "Authors", "language": "Language", "publisher": "Publisher", "date": "Date", "description": "Description", "identifier": "Identifier"}
    lines = [f"**{label}:** {', '.join(said[k])}" for k, label in labels.items() if k in said]
    files = {_attr(x, "id"): _attr(x, "href") for x in package.iter() if _name(x) == "item"}
    chapters = []
    for x in package.iter():
        if _name(x) == "itemref" and _attr(x, "idref") in files:
            page = _read(archive, posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(files[_attr(x, "idref")]))))
            if page and (body := html_to_markdown(page).strip()):
                chapters.append(body)
    return Converted("\n\n".join([*lines, *chapters]), (said.get("title") or [None])[0])


def pdf(data: bytes, info: Info, context: Context) -> Converted:
    """By the registered reader of pages: bytes to Markdown, or to a list of pages of it."""
    if "pdf" not in context.readers:
        raise MissingReader("PDF needs a reader: Context(readers={'pdf': ...})")
    made = context.readers["pdf"](data)
    return Converted(made if isinstance(made, str) else "\n\n".join(made))


def legacy_sheet(data: bytes, info: Info, context: Context) -> Converted:
    """By the registered reader: bytes to (sheet name, rows) pairs."""
    if "xls" not in context.readers:
        raise MissingReader("XLS needs a reader: Context(readers={'xls': ...})")
    return Converted("\n\n".join(f"## {name}\n\n{gfm(rows)}".strip() for name, rows in context.readers["xls"](data)))


def mail(data: bytes, info: Info, context: Context) -> Converted:
    """By the registered reader: bytes to a mapping of subject, sender_name, sender_email, recipients and body."""
    if "msg" not in context.readers:
        raise MissingReader("MSG needs a reader: Context(readers={'msg': ...})")
    said = context.readers["msg"](data)
    name, address = said.get("sender_name"), said.get("sender_email")
    lines = ["# Email Message", ""]
    if name or address:
        lines.append(f"**From:** {f'{name} <{address}>' if name and address else name or address}")
    if said.get("recipients"):
        lines.append(f"**To:** {', '.join(said['recipients'])}")
    if said.get("subject"):
        lines.append(f"**Subject:** {said['subject']}")
    return Converted("\n".join([*lines, "", "## Content", "", said.get("body") or ""]).strip(), said.get("subject"))


def image_mime(name: str | None) -> str:
    ext = posixpath.splitext((name or "").lower())[1] or (name or "").lower()
    return {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp"}.get(ext, "image/png")


def image(data: bytes, info: Info, context: Context) -> Converted:
    mime = info.mimetype or image_mime(info.extension)
    out = f"![{info.filename or 'image'}](data:{mime};base64,{base64.b64encode(data).decode()})"
    told = context.describe_image and context.describe_image(data, mime)
    return Converted(f"{out}\n\n{told}" if told else out, info.filename)


#: Fields of audio files in the order they are told, and the ID3 frames that hold them.
ID3 = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TRCK": "track", "TDRC": "date", "TYER": "year", "COMM": "comment", "TCOM": "composer", "TSSE": "encoder"}
AUDIO_FIELDS = ["title", "artist", "album", "genre", "track", "date", "year", "comment", "composer", "encoder", "bitrate", "sampleRate", "numberOfChannels"]


def _id3(data: bytes) -> dict[str, str]:
    """Text frames of ID3v2.3 and 2.4, and the fields of ID3v1 that these don't have."""
    out: dict[str, str] = {}
    if data[:3] == b"ID3" and data[3] in (3, 4):
        size7 = lambda b: sum((x & 0x7F) << (7 * (3 - i)) for i, x in enumerate(b))
        at, end = 10, 10 + size7(data[6:10])
        while at + 10 <= end and data[at : at + 4].strip(b"\0"):
            name = data[at : at + 4].decode("latin-1")
            size = size7(data[at + 4 : at + 8]) if data[3] == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
            body = data[at + 10 : at + 10 + size]
            if name in ID3 and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                text = body[4 if name == "COMM" else 1 :].decode(coding, "replace").strip("\0")
                out.setdefault(ID3[name], text.split("\0")[-1])
            at += 10 + size
    if data[-128:-125] == b"TAG":
        tag = data[-128:]
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            if text := tag[a:b].split(b"\0")[0].decode("latin-1").strip():
                out.setdefault(name, text)
    return out


def audio(data: bytes, info: Info, context: Context) -> Converted:
    """Tag lines in a fixed order; the file's name where nothing can be read."""
    try:
        if data[:4] == b"RIFF":
            with wave.open(io.BytesIO(data)) as w:
                said = {"bitrate": str(w.getframerate() * w.getnchannels() * w.getsampwidth() * 8), "sampleRate": str(w.getframerate()), "numberOfChannels": str(w.getnchannels())}
        else:
            said = _id3(data)
            if not said:
                raise ValueError("no tags")
        lines = [f"{f}: {said[f]}" for f in AUDIO_FIELDS if said.get(f)]
    except (ValueError, EOFError, wave.Error, struct.error):
        lines = [f"filename: {info.filename or 'audio'}"]
    return Converted("\n".join(lines), info.filename)


#: What an archive's entry raises that is damaged, encrypted or packed in a way that isn't known.
DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError)


def archive(data: bytes, info: Info, context: Context) -> Converted:
    """Every entry under its name, by the converter that takes it. An entry that fails says so, or with strict fails the whole."""
    from .registry import convert_bytes

    if context.depth <= 0:
        raise ConversionFailed("archives are nested too deeply")
    sections = []
    packed = _archive(data)
    for name in packed.namelist():
        if name.endswith("/"):
            continue
        own = Info(filename=name, extension=posixpath.splitext(name)[1] or None)
        try:
            sections.append(f"## {name}\n\n{convert_bytes(packed.read(name), own, replace(context, depth=context.depth - 1)).markdown}")
        except (UnsupportedFormat, ConversionFailed, MissingReader, *DAMAGED) as e:
            if context.strict:
                raise
            sections.append(f"## {name}\n\n<!-- not converted: {e} -->")
    return Converted("\n\n".join(sections), info.filename or "archive.zip")

