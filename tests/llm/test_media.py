import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import media as M
from docloom.llm.common import shared_path
from docloom.llm.queries import media_pages, op10_media


def test_png_round_trip():
    for data in (b"", b"a", b"x" * 192, bytes(range(256)) * 30, "é😀".encode() * 1000):
        payload = M.padded(data)
        assert len(payload) % 192 == 0 and payload[: len(data)] == data and payload[len(data) :].strip(b" ") == b"" and payload
        media = M.encode_png(payload)
        assert M.decode_png(media) == payload
        broken = bytearray(media)
        broken[-14] ^= 1
        with pytest.raises(ValueError):
            M.decode_png(bytes(broken))


def test_sequences():
    html = "<head><title>no</title></head><h1>One</h1><p>Two <b>three</b><img src='media:sha256:AB' alt='own'>four</p><script>x</script><figure><img src='a.png'><img src='b.png' alt='alt'><figcaption>Cap &amp; tion</figcaption></figure><p>five"
    got = [(x["position"], x["kind"], x["text"] or x["src"], x["digest"], x["caption"]) for x in M.sequence_of(html)]
    assert got == [(0, "text", "One", None, None), (1, "text", "Two three", None, None), (2, "media", "media:sha256:AB", "ab", "own"), (3, "text", "four", None, None), (4, "media", "a.png", None, "Cap & tion"), (5, "media", "b.png", None, "Cap & tion"), (6, "text", "five", None, None)]
    assert M.sequence_of("") == [] and M.sequence_of("<p <<") is not None


def test_resolve_keeps_places(spark):
    payload = M.padded(b"one")
    digest = hashlib.sha256(payload).hexdigest()
    path = M.write_media(spark.createDataFrame([(bytearray(payload),), (bytearray(payload),), (None,)], "payload binary"), shared_path(spark, "m"))
    html = f"<p>a</p><img src='media:sha256:{digest}' alt='c'><img src='media:sha256:00'><p>b</p>"
    pages = spark.createDataFrame([(1, html, "k"), (2, None, "k"), (3, html, "k")], "page_id long, html string, caption string")
    rows = M.resolve(M.interleave(pages), M.read_media(spark.read.parquet(path))).orderBy("page_id", "position").collect()
    assert [(r.page_id, r.position, r.kind, r.payload_sha256 == digest) for r in rows] == [(p, i, k, d) for p in (1, 3) for i, (k, d) in enumerate([("text", False), ("media", True), ("media", False), ("text", False)])]
    assert rows[1].caption == "c" and rows[1].payload_bytes == 192


def test_wrong_digest_is_an_error(spark):
    store = spark.createDataFrame([("00", bytearray(M.encode_png(M.padded(b"x"))))], "digest string, media binary")
    with pytest.raises(Exception, match="another payload"):
        M.read_media(store).collect()


def test_query_against_brute_force(spark, tmp_path):
    rows = [(1, "Hello"), (2, None), (3, ""), (4, "é" * 96), (5, "x" * 193), (6, "Hello"), (None, "y"), (7, "long " * 60_000), (1, "Hello")]
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        data = (t or "").encode()
        p = M.padded(data)
        m = M.encode_png(p)
        want.append((d, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), M.feature(p)))
    assert sorted(map(tuple, op10_media(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert M.interleave(spark.createDataFrame([], "html string")).collect() == []
    path = M.write_media(spark.createDataFrame([], "payload binary"), shared_path(spark, "m"))
    assert M.read_media(spark.read.parquet(path)).agg(F.count("*")).first()[0] == 0


def test_heads_and_captions_without_ends():
    body = lambda html: [(x["kind"], x["text"] or x["src"], x["caption"]) for x in M.sequence_of(html)]
    assert body("<html><head><title>x</title><meta charset=u><body><p>text</p><img src=a>") == [("text", "text", None), ("media", "a", None)]
    assert body("<head><title>x</title><p>one</p>") == [("text", "one", None)]
    assert body("<figure><img src=a><figcaption>cap</figure><p>rest</p>") == [("media", "a", "cap"), ("text", "rest", None)]
    assert body("<figure><img src=a><figcaption>cap <b>goes</b> on") == [("media", "a", "cap goes on")]
    assert body("<figcaption>alone</figcaption><p>x") == [("text", "alone", None), ("text", "x", None)]
    assert body("a<![CDATA[ b ]]>c<![ x") [0][0] == "text" and body("<![zz[ y ]]>z")[-1][1].endswith("z")


def test_any_markup_can_be_read():
    r = random.Random(5)
    bits = ["<![", "<!", "<!doctype x>", "]]>", "<", ">", "</", "<p", "<img src=x>", "<figure>", "</figure>", "<figcaption>", "<title>", "</title>", "<script>", "</script>", "<head>", "<body>", "&amp;", "&#", "text ", "'", '"', "=", "<?", "--", "<!--", "-->", "[", "\0", "é"]
    for _ in range(4000):
        found = M.sequence_of("".join(r.choice(bits) for _ in range(r.randrange(20))))
        assert [x["position"] for x in found] == list(range(len(found)))


def test_pages_against_brute_force(spark, tmp_path):
    rows = [(1, "http://a.org/x", "<html><head><title>t</title></head><body><h1>One</h1><p>two</p><p>three</p></body></html>"), (2, None, "<p>no heading"), (3, "", None), (4, "u", "<h1>é</h1><img src=z.png>end")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = []
    for page, url, html in rows:
        payloads = {hashlib.sha256(p).hexdigest(): p for p in (M.padded((url or "").encode()), M.padded((html or "").encode()))}
        a, b = (hashlib.sha256(M.padded((x or "").encode())).hexdigest() for x in (url, html))
        head, _, tail = (html or "").partition("</h1>")
        figure = f"<figure><img src='media:sha256:{a}' alt='address'><img src='media:sha256:{b}' alt='source'><figcaption>Page {page}</figcaption></figure><p>behind</p>"
        for x in M.sequence_of(f"{head}</h1>{figure}{tail}"):
            p = payloads.get(x["digest"])
            want.append((page, x["position"], x["kind"], hashlib.sha256((x["text"] or "").encode()).hexdigest(), x["digest"], x["caption"], p and len(p), p and x["digest"], p and M.feature(p)))
    got = sorted(map(tuple, media_pages(spark, str(tmp_path)).collect()), key=lambda r: r[:2])
    assert got == want
    assert [(r[2], r[5]) for r in got if r[0] == 1] == [("text", None), ("media", "Page 1"), ("media", "Page 1"), ("text", None), ("text", None), ("text", None)]
