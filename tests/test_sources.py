import io
import zipfile

import pytest

from foliospark.operators import crawl
from foliospark.sources import office, sinks

W = 'xmlns:w="w"'


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    body = "<w:p><w:pPr><w:pStyle w:val='Heading2'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}))
    (tmp_path / "b.xlsx").write_bytes(archive({"xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='B2' t='inlineStr'><is><t>x</t></is></c></row></sheetData><mergeCells><mergeCell ref='B2:C3'/></mergeCells></worksheet>"}))
    (tmp_path / "c.pptx").write_bytes(archive({"ppt/slides/slide1.xml": "<p:sld xmlns:p='p' xmlns:a='a'><p:spTree><p:sp><p:ph type='title'/><a:off x='1' y='2'/><a:ext cx='3' cy='4'/><a:p><a:t>Hi</a:t></a:p></p:sp></p:spTree></p:sld>"}))
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "e.docx").write_bytes(archive({"../evil": "x"}))
    e = {(r.path[-6:], r.type, r.level, r.text, r.error) for r in office.read(spark, str(tmp_path)).collect()}
    assert ("a.docx", "heading", 2, "Title", None) in e and ("c.pptx", "heading", 1, "Hi", None) in e
    assert ("d.docx", None, None, None, "BadZipFile") in e and ("e.docx", None, None, None, "unsafe_name") in e
    c = {(r.path[-6:], r.row, r.col, r.row_span, r.col_span, r.text) for r in office.read(spark, str(tmp_path), "cells").where("error is null").collect()}
    assert c == {("a.docx", 0, 0, 1, 2, "a"), ("b.xlsx", 1, 1, 2, 2, "x")}
    kinds = {r.path[-6:]: (r.kind, r.confidence) for r in office.listing(spark, str(tmp_path)).collect()}
    assert kinds["a.docx"] == ("docx", 1.0) and kinds["d.docx"] == ("docx", pytest.approx(0.4)) and list(kinds) == sorted(kinds)


def test_model_sources_refuse():
    with pytest.raises(office.Unavailable):
        office.model_source("ocr_model")


def test_crawl(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (3, 4), (4, 5)], "src bigint, dst bigint")
    got = {(r.url, r.depth) for r in crawl.levels(spark.createDataFrame([(1,)], "url bigint"), e, 2).collect()}
    assert got == {(1, 0), (2, 1), (3, 1), (4, 2)}
    hops = spark.createDataFrame([("https://a", "https://b"), ("https://b", "https://a"), ("https://c", "http://d")], "src string, dst string")
    r = {x.url: (x.final, x.outcome) for x in crawl.redirects(spark.createDataFrame([("https://a",), ("https://c",), ("https://z",)], "url string"), hops).collect()}
    assert r == {"https://a": ("https://b", "loop"), "https://c": ("https://c", "downgrade"), "https://z": ("https://z", "ok")}


def test_markdown_and_blobs(spark, tmp_path):
    e = spark.createDataFrame([("d", 0, 0, "heading", 2, "T"), ("d", 0, 1, "image", None, None), ("d", 1, 0, "formula", None, "x")], "document_id string, page_index int, pos int, type string, level int, text string")
    assert sinks.document_markdown(e).first().markdown == "## T\n\n$$x$$\n\n<!-- 1 elements without text -->"
    stored = sinks.blobs(spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary"), str(tmp_path / "b"))
    assert stored.count() == 2 and sinks.broken_blobs(stored).count() == 0
