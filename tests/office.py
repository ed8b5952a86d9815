"""Small files of binary formats, built in memory."""

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 20


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def docx(body):
    return archive(**{"word/document.xml": f"<?xml version='1.0'?><w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="http://x.org" TargetMode="External"/></Relationships>'})


def xlsx():
    return archive(**{
        "xl/workbook.xml": '<workbook xmlns:r="u"><sheets><sheet name="Results" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>Ali</t><t>ce</t></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>score</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>7.5</v></c></row></sheetData></worksheet>',
    })


def pptx():
    slide = lambda n, more="": f"<p:sld {A}><a:p><a:r><a:t>Title {n}</a:t></a:r></a:p><a:p><a:r><a:t>42</a:t></a:r></a:p>{more}</p:sld>"
    table = "<a:tbl><a:tr><a:tc><a:t>h1</a:t></a:tc><a:tc><a:t>h|2</a:t></a:tc></a:tr><a:tr><a:tc><a:t>v1</a:t></a:tc><a:tc><a:t>v2</a:t></a:tc></a:tr></a:tbl>"
    return archive(**{
        "ppt/presentation.xml": "<p/>", "ppt/slides/slide10.xml": slide(10), "ppt/slides/slide2.xml": slide(2, table + '<a:blip r:embed="rId2"/>'),
        "ppt/slides/_rels/slide2.xml.rels": '<Relationships><Relationship Target="../media/chart.png" Id="rId2"/></Relationships>', "ppt/media/chart.png": PNG,
        "ppt/notesSlides/notesSlide2.xml": f"<p:notes {A}><a:t>Say this</a:t></p:notes>",
    })


def epub():
    return archive(**{
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>',
        "O/b.opf": '<package xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:creator>Ann</dc:creator><dc:creator>Bo</dc:creator><dc:language>en</dc:language></metadata><manifest><item id="b" href="two.xhtml"/><item id="a" href="one%20.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "O/one .xhtml": "<html><body><h1>First</h1></body></html>", "O/two.xhtml": "<html><body><p>Second</p></body></html>",
    })


def wav():
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 80)
    return out.getvalue()


def mp3():
    frame = lambda name, text: name + len(text).to_bytes(4, "big") + b"\0\0" + text
    body = frame(b"TIT2", b"\x03Song") + frame(b"TPE1", b"\x00Band") + b"\0" * 20
    return b"ID3\x03\x00\x00" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body
