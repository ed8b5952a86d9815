import base64
import json

import pytest
from pyspark.sql import functions as F

from docloom.sources import converters as C
from docloom.sources import detect as D
from docloom.sources import registry as R
from docloom.sources.converters import Context, Info

from . import office


def md(data, context=Context(), **info):
    return R.convert_bytes(data, Info(**info), context)


def test_text_and_tables():
    assert md(b"# Hello\n\nWorld", extension=".md").markdown == "# Hello\n\nWorld"
    assert md(b'name,age\r\nAlice,30\n,\n"Bo ""x"", y|z",25,more\nshort', extension=".csv").markdown == '| name | age |\n| --- | --- |\n| Alice | 30 |\n| Bo "x", y\\|z | 25 |\n| short |  |'
    assert "y|z" in md(b"a\ny|z", Context(strict=True), extension=".csv").markdown
    assert md("Zoë".encode("latin-1"), extension=".txt", charset="latin1").markdown == "Zoë"


def test_html():
    made = md(b"<html><head><title> T </title></head><body><h1>Title</h1><p>Para</p><script>x</script></body></html>", extension=".html")
    assert made == C.Converted("# Title\n\nPara", "T")


def test_notebook():
    book = {"nbformat": 4, "nbformat_minor": 5, "cells": [{"cell_type": "markdown", "source": ["# Notebook\n", "text"]}, {"cell_type": "code", "source": "print(1)"}, {"cell_type": "raw", "source": ["r"]}]}
    want = C.Converted("# Notebook\ntext\n\n```python\nprint(1)\n```\n\n```\nr\n```", "Notebook")
    assert md(json.dumps(book).encode(), extension=".ipynb") == want and md(json.dumps(book).encode(), mimetype="application/json") == want


def test_feeds():
    rss = b"<?xml version='1.0'?><rss><channel><title>Feed</title><description>About</description><item><title>Post</title><pubDate>Mon</pubDate><description>&lt;b&gt;x&lt;/b&gt;</description><content:encoded><![CDATA[<p>full</p>]]></content:encoded></item></channel></rss>"
    assert md(rss, extension=".xml") == C.Converted("# Feed\nAbout\n\n## Post\nPublished on: Mon\n**x**full", "Feed")
    atom = b"<feed xmlns='http://www.w3.org/2005/Atom'><title>F</title><subtitle>S</subtitle><entry><title>E</title><updated>2024</updated><summary>sum</summary></entry></feed>"
    assert md(atom, extension=".atom").markdown == "# F\nS\n\n## E\nUpdated on: 2024\nsum"
    assert md(b"<root><a>1</a></root>", extension=".xml", mimetype="text/xml").markdown == "<root><a>1</a></root>"


def test_wikipedia_and_search_and_video():
    page = b"<html><title>x</title><body><span class='mw-page-title-main'>Earth</span><div id='mw-content-text'><p>Third planet</p></div><p>menu</p></body></html>"
    assert md(page, extension=".html", url="https://en.wikipedia.org/wiki/Earth") == C.Converted("# Earth\n\nThird planet", "Earth")
    target = "a1" + base64.urlsafe_b64encode(b"https://example.com/?a=1").decode().rstrip("=")
    serp = f"<html><title>q - Bing</title><body><li class='b_algo'><h2><a href='https://www.bing.com/ck/a?u={target}'>One</a></h2><p>text</p></li><li class='b_algo'><a href='https://two.org'>Two</a></li><p>ads</p></body></html>".encode()
    made = md(serp, extension=".html", url="https://www.bing.com/search?q=my+query")
    assert made.markdown == "## A Bing search for 'my query' found the following results:\n\n## [One](https://example.com/?a=1)\ntext\n\n[Two](https://two.org)" and made.title == "q - Bing"
    video = b"""<html><title>Vid</title><meta name="keywords" content="a, b"><meta itemprop="interactionCount" content="5"><script>var ytInitialData = {"x": [{"attributedDescriptionBodyText": {"content": "Told"}}]};</script></html>"""
    made = md(video, Context(transcript=lambda v: f"spoken {v}"), extension=".html", url="https://www.youtube.com/watch?v=abc")
    assert made.markdown == "# YouTube\n\n## Vid\n\n### Video Metadata\n- **Views:** 5\n- **Keywords:** a, b\n\n### Description\nTold\n\n### Transcript\nspoken abc\n"


def test_office():
    assert md(office.xlsx(), extension=".xlsx").markdown == "## Results\n\n| name |  | score |\n| --- | --- | --- |\n| Alice | TRUE | 7.5 |"
    body = """<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> and </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>
    <w:p><w:pPr><w:numPr><w:ilvl w:val="0"/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>
    <w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><m:oMath><m:r><m:t>x</m:t></m:r></m:oMath></w:p>"""
    assert md(office.docx(body), extension=".docx").markdown == "## Head\n\n**bold** and [link](http://x.org)\n\n*   one\n    *   two\n\n| h |\n| --- |\n| v |\n\n$x$"
    made = md(office.pptx(), extension=".pptx").markdown
    assert made == "<!-- Slide number: 1 -->\n# Title 2\n42\n| h1 | h\\|2 |\n| --- | --- |\n| v1 | v2 |\n\n![chart.png](chart.png)\n\n### Notes:\n\nSay this\n\n<!-- Slide number: 2 -->\n# Title 10\n42"
    assert "data:image/png;base64," in md(office.pptx(), Context(keep_data_uris=True, describe_image=lambda d, m: "A [chart]"), extension=".pptx").markdown
    assert md(office.epub(), extension=".epub") == C.Converted("**Title:** Book\n\n**Authors:** Ann, Bo\n\n**Language:** en\n\n# First\n\nSecond", "Book")


def test_nameless_office_files_are_known_by_their_parts():
    assert "Results" in md(office.xlsx()).markdown and "Slide number" in md(office.pptx()).markdown


def test_archives():
    inner = office.archive(**{"c.txt": "deep"})
    data = office.archive(**{"a.csv": "x,y\n1,2", "b/": "", "b/n.zip": inner, "bad.pdf": b"%PDF-1.4"})
    made = md(data, extension=".zip", filename="all.zip")
    assert made.title == "all.zip" and made.markdown.startswith("## a.csv\n\n| x | y |") and "## b/n.zip\n\n## c.txt\n\ndeep" in made.markdown and "## bad.pdf\n\n<!-- not converted: PDF needs a reader" in made.markdown
    with pytest.raises((C.ConversionFailed, C.MissingReader)):
        md(data, Context(strict=True), extension=".zip")


def test_media_and_readers():
    assert md(office.PNG, extension=".png", filename="p.png").markdown == f"![p.png](data:image/png;base64,{base64.b64encode(office.PNG).decode()})"
    assert md(office.wav(), extension=".wav").markdown == "bitrate: 256000\nsampleRate: 8000\nnumberOfChannels: 2"
    assert md(office.mp3(), extension=".mp3").markdown == "title: Song\nartist: Band" and md(b"junk", extension=".mp3", filename="f.mp3").markdown == "filename: f.mp3"
    with pytest.raises(C.MissingReader):
        md(b"%PDF-1.4", extension=".pdf")
    assert md(b"%PDF-1.4", Context(readers={"pdf": lambda b: ["Hello PDF", "two"]})).markdown == "Hello PDF\n\ntwo"
    mail = {"subject": "S", "sender_name": "A", "sender_email": "a@x.org", "recipients": ["B", "C"], "body": "text"}
    assert md(R.OLE, Context(readers={"msg": lambda b: mail})) == C.Converted("# Email Message\n\n**From:** A <a@x.org>\n**To:** B, C\n**Subject:** S\n\n## Content\n\ntext", "S")
    assert md(R.OLE, Context(readers={"xls": lambda b: [("One", [["h"], ["v"]])]}), extension=".xls").markdown == "## One\n\n| h |\n| --- |\n| v |"


def test_dispatch():
    with pytest.raises(C.UnsupportedFormat):
        md(b"\x00\x01\x02\x03" * 10, extension=".bin")
    with pytest.raises(C.ConversionFailed):
        md(b"\x00\x01" * 50, extension=".docx", filename="x.docx")
    before = list(R.REGISTRY)
    try:
        R.register(R.Entry("mine", lambda d, i: i.ext == ".csv", lambda d, i, c: C.Converted("mine")))
        assert md(b"a,b", extension=".csv").markdown == "mine" and [e.name for e in R.in_order()][0] == "mine"
    finally:
        R.REGISTRY[:] = before
    assert [e.priority for e in R.in_order()] == sorted(e.priority for e in R.REGISTRY)


@pytest.mark.parametrize(
    ("data", "ext"),
    [(b"%PDF-", ".pdf"), (b"PK\x03\x04abc", ".zip"), (office.xlsx(), ".xlsx"), (office.pptx(), ".pptx"), (office.PNG, ".png"), (b"\xff\xd8\xff\xe0", ".jpg"), (b"GIF89a", ".gif"), (b" \n<!DOCTYPE HTML><html>", ".html"), (b"<HTML>", ".html"), (b"[1]", ".json"), (b"text", None), (b"", None)],
)
def test_magic(spark, data, ext):
    df = spark.createDataFrame([(bytearray(data),)], "c binary")
    assert df.select(D.magic_extension(F.col("c")).alias("e")).first().e == ext
    if ext in (".xlsx", ".pptx"):
        assert df.select(D.magic_extension(F.col("c"), strict=True).alias("e")).first().e == ".zip"


def test_text_and_charset(spark):
    rows = [(b"plain",), (b"",), (b"a\x00b",), ("Zoë".encode(),), ("Zoë".encode("latin-1"),), (b"\xff\xfea\0",)]
    got = spark.createDataFrame([(bytearray(r[0]),) for r in rows], "c binary").select(D.is_likely_text(F.col("c")).alias("t"), D.detect_charset(F.col("c")).alias("s")).collect()
    assert [r.t for r in got] == [True, False, False, True, True, False] and [r.s for r in got] == ["ascii", "ascii", "ascii", "utf-8", "latin1", "utf-16le"]


def test_ascii_head():
    """A guess of ASCII is of the first 8 KiB; the rest is read as UTF-8, or as Latin-1 where it isn't that."""
    for charset in ("utf-8", "latin-1"):
        assert Info(charset="ascii").text(("a" * 9000 + " Zoë").encode(charset)).endswith(" Zoë")


def test_guesses(spark):
    schema = "c binary, i struct<mimetype: string, extension: string, charset: string, filename: string, local_path: string, url: string>"
    rows = [(bytearray(b"%PDF-1"), (None, ".pdf", None, "a.pdf", None, None)), (bytearray(b"%PDF-1"), (None, ".csv", None, None, None, None)), (bytearray(b"a,b"), (None, ".csv", None, None, None, None)), (bytearray(b"x"), ("text/html", None, None, None, None, None))]
    got = spark.createDataFrame(rows, schema).select(D.guess_formats(F.col("c"), F.col("i")).alias("g")).collect()
    assert [[(g.mimetype, g.extension, g.charset) for g in r.g] for r in got] == [[("application/pdf", ".pdf", None)], [("text/csv", ".csv", None), ("application/pdf", ".pdf", None)], [("text/csv", ".csv", "ascii")], [("text/html", ".html", "ascii")]]
    merged = spark.createDataFrame([((("a", "b", None, "f", None, None)), ("", "c", "utf-8", None, None, None))], "x struct<mimetype: string, extension: string, charset: string, filename: string, local_path: string, url: string>, y struct<mimetype: string, extension: string, charset: string, filename: string, local_path: string, url: string>").select(D.merge_info(F.col("x"), F.col("y")).alias("m")).first().m
    assert tuple(merged)[:4] == ("a", "c", "utf-8", "f")
    assert spark.range(1).select(D.extension_from_mime(F.lit("TEXT/plain")).alias("e"), D.mime_from_extension(F.lit("MD")).alias("m")).first() == (".txt", "text/markdown")


def test_files_to_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# A  \n\n\n\nx")
    (tmp_path / "b.csv").write_bytes(b"h\nv")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "d.xlsx").write_bytes(office.xlsx())
    rows = {r.path.rsplit("/", 1)[1]: r for r in R.convert_files(R.read_files(spark, str(tmp_path))).collect()}
    assert rows["a.md"].markdown == "# A\n\nx" and rows["b.csv"].markdown.startswith("| h |") and "Alice" in rows["d.xlsx"].markdown
    assert rows["c.pdf"].markdown is None and "MissingReader" in rows["c.pdf"].error and rows["a.md"].error is None
    assert R.read_files(spark, str(tmp_path), "*.md").count() == 1


def test_uris(spark):
    df = spark.createDataFrame([("data:text/csv,h%0Av",), ("https://x.org/a.html",), ("ftp://x",), (None,)], "uri string")
    fetch = lambda u: (b"<html><body><p>web</p></body></html>", {"content-type": "text/html; charset=utf-8"})
    got = R.convert_files(R.read_uris(df, fetch).withColumnRenamed("error", "read_error")).collect()
    assert [(r.markdown, r.read_error) for r in got[:3]] == [("| h |\n| --- |\n| v |", None), ("web", None), (got[2].markdown, "only data: and http(s): addresses")]
    assert R.read_uris(df).collect()[1].error == "no fetcher for http(s) addresses"


def test_response_info(spark):
    got = spark.range(1).select(D.response_info(F.lit("Text/HTML; charset=utf-8"), F.lit("attachment; filename=\"r.CSV\""), F.lit("https://x.org/p/q.txt?a")).alias("a"), D.response_info(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("https://x.org/p/q.txt?a")).alias("b")).first()
    assert tuple(got.a)[:4] == ("text/html", ".csv", "utf-8", "r.CSV") and tuple(got.b)[:4] == (None, ".txt", None, "q.txt")


def test_a_damaged_entry_leaves_the_others():
    data = office.archive(**{"a.txt": "good", "b.txt": "bad " * 100, "c.txt": "fine"})
    at = data.index(b"b.txt") + 5
    broken = data[:at] + bytes(x ^ 0x55 for x in data[at : at + 8]) + data[at + 8 :]
    said = md(broken, extension=".zip", filename="x.zip").markdown
    assert "good" in said and "fine" in said and "## b.txt\n\n<!-- not converted:" in said
    with pytest.raises(C.ConversionFailed):
        md(broken, Context(strict=True), extension=".zip")
