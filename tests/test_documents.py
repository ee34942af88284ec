"""Documents from bytes: DOCX and PDF made here, bounds, and damaged input."""

import io
import zipfile
import zlib

import pytest
from marlstone.model import EngineError
from marlstone.operators import documents as d


def docx(body: str, files: dict[str, bytes] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="w"><w:body>{body}</w:body></w:document>')
        for name, raw in (files or {}).items():
            z.writestr(name, raw)
    return out.getvalue()


def para(*runs: str) -> str:
    return "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


def cell(text: str) -> str:
    return f"<w:tc>{text}</w:tc>"


def table(*rows: list[str]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in rows) + "</w:tbl>"


def pdf(pages: list[bytes], images: bool = False, packed: bool = False) -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d /Resources << /Font << /F1 5 0 R >> %s >> >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages), b"/XObject << /I1 6 0 R /I2 7 0 R >>" if images else b"")}
    objects[5] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    streams = {}
    if images:
        streams[6] = (b"/Type /XObject /Subtype /Image /Filter /DCTDecode", b"\xff\xd8jpeg")
        streams[7] = (b"/Type /XObject /Subtype /Image /Filter /FlateDecode", zlib.compress(b"raw"))
    for i, content in enumerate(pages):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        streams[11 + 2 * i] = (b"/Filter /FlateDecode", zlib.compress(content)) if i % 2 == 0 else (b"", content)
    out = b"%PDF-1.5\n"
    if packed:
        inside = {k: objects.pop(k) for k in list(objects) if k != 1}
        offsets, body = [], b""
        for k, v in inside.items():
            offsets.append(b"%d %d" % (k, len(body)))
            body += v + b" "
        head = b" ".join(offsets) + b" "
        streams[99] = (b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(inside), len(head)), zlib.compress(head + body))
    for k, v in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, v)
    for k, (head, raw) in streams.items():
        out += b"%d 0 obj\n<< %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (k, head, len(raw), raw)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_docx_sections_and_entities():
    data = docx(para("one ", "two") + "<w:p/>" + para("a &amp; b") + para(" ") + table([para("cell")]))
    assert [(s.ordinal, s.text, s.heading) for s in d.docx_sections(data)] == [(0, "one two", None), (1, "a & b", None), (2, "cell", None)]


def test_docx_tables_nest():
    inner = table([para("in")])
    data = docx(table([para("a"), para("b")], [para("c") + inner + para("d"), para("")]) + table([para("z")]))
    assert [(t.ordinal, t.rows) for t in d.docx_tables(data)] == [(0, (("a", "b"), ("cd", ""))), (1, (("in",),)), (2, (("z",),))]


def test_docx_images_and_search():
    data = docx(para("The cat"), {"word/media/b.PNG": b"2", "word/media/a.jpeg": b"1", "word/media/x.bin": b"3", "word/other.png": b"4"})
    assert [(i.ordinal, i.name, i.media_type, i.data) for i in d.docx_images(data)] == [(0, "word/media/a.jpeg", "image/jpeg", b"1"), (1, "word/media/b.PNG", "image/png", b"2"), (2, "word/media/x.bin", None, b"3")]
    both = docx(para("The cat") + table([para("cat food")]), {"word/media/cat.gif": b""})
    assert d.search(both, "CAT", 10) == [("section", 0, "The cat"), ("section", 1, "cat food"), ("table_cell", 0, "cat food"), ("image_name", 0, "word/media/cat.gif")]
    assert len(d.search(both, "cat", 2)) == 2 and d.search(both, "cat", 0) == []
    with pytest.raises(EngineError, match="query"):
        d.search(both, " ", 5)


@pytest.mark.parametrize("limits", [d.Limits(input_bytes=10), d.Limits(xml_bytes=20), d.Limits(sections=1), d.Limits(cells=1), d.Limits(images=1), d.Limits(image_bytes=2), d.Limits(all_image_bytes=4)])
def test_bounds(limits):
    data = docx(para("one") + para("two") + table([para("a"), para("b")]), {"word/media/a.png": b"123", "word/media/b.png": b"123"})
    with pytest.raises(EngineError) as e:
        d.docx_sections(data, limits), d.docx_tables(data, limits), d.docx_images(data, limits)
    assert e.value.code == "document_limit"


@pytest.mark.parametrize("data", [b"", b"PK\x03\x04 no zip", docx("<w:p>"), docx(para("x"))[:60], b"%PDF-1.4 trailer << /Encrypt 3 0 R >>"])
def test_damaged(data):
    with pytest.raises(EngineError) as e:
        d.sections(data)
    assert e.value.code == "document_format"


def test_no_document_part():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.xml", "<a/>")
    with pytest.raises(EngineError, match="word/document.xml"):
        d.docx_sections(out.getvalue())


def test_entity_declarations_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<!DOCTYPE x [<!ENTITY a "aaaa">]><w:p><w:t>&a;</w:t></w:p>')
    with pytest.raises(EngineError, match="entity"):
        d.docx_sections(out.getvalue())


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(packed):
    pages = [b"BT /F1 12 Tf 10 100 Td (Name    Price \\(net\\)) Tj 0 -14 Td [(A) -20 (pple) -400 (pie    3)] TJ T* <42616e616e61> Tj ET", b"BT /F1 9 Tf (only text) Tj ET"]
    data = pdf(pages, images=True, packed=packed)
    assert [(s.ordinal, s.text) for s in d.sections(data)] == [(1, "Name    Price (net)\nApple pie    3\nBanana\n"), (2, "only text\n")]
    assert [(t.ordinal, t.rows) for t in d.tables(data)] == [(1, (("Name", "Price (net)"), ("Apple pie", "3")))]
    assert [(i.name, i.media_type) for i in d.images(data)] == [("page-1-image-6-0", "image/jpeg"), ("page-1-image-7-0", None), ("page-2-image-6-0", "image/jpeg"), ("page-2-image-7-0", None)]
    assert d.search(data, "BANANA", 5) == [("section", 1, "Name    Price (net)\nApple pie    3\nBanana\n")]


def test_pdf_to_unicode():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    data = pdf([b"BT /F1 9 Tf <000100020003> Tj ET"]).replace(b"/BaseFont /Helvetica >>", b"/BaseFont /H /ToUnicode 77 0 R >>").replace(b"trailer", b"77 0 obj << /Length %d >>\nstream\n%s\nendstream\nendobj\ntrailer" % (len(cmap), cmap))
    assert d.sections(data)[0].text == "Hij\n"


def test_layout_cells():
    assert d.layout_cells("  a b\tc   d  ") == ("a b c", "d") and d.layout_cells("one two") is None and d.layout_cells("") is None
    assert d.media_type_for_name("x.TIFF") == "image/tiff" and d.media_type_for_name("dir.png/x") is None
