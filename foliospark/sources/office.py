"""Office files, tab-separated recogniser output and file listings as DataFrames.

Office formats are zip archives of XML; the standard library reads them. Files
come through Spark's binaryFile source, so that listing, splitting and retries
are Spark's, and each file is parsed in one Arrow batch of the worker.
An archive is checked before a member is read: number of members, unsafe or
colliding names, total size and compression ratio.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.quality import sniff

EXTENSIONS = ("pdf", "docx", "xlsx", "pptx", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
ELEMENTS = "path string, page_index int, pos int, type string, level int, text string, x0 double, y0 double, x1 double, y1 double, error string"
CELLS = "path string, page_index int, table_pos int, row int, col int, row_span int, col_span int, text string, error string"
MAX_MEMBERS, MAX_BYTES, MAX_RATIO, MAX_CELLS = 10_000, 512 << 20, 100, 500_000


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Supported files below a path with size, kind and hash, in order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    return files.where(ext.isin(*EXTENSIONS)).select("path", "length", F.sha2("content", 256).alias("sha256"), sniff(F.col("content"), F.col("path")).alias("s")).select("path", "length", "sha256", "s.kind", "s.confidence").orderBy("path")


class UnsafeArchive(ValueError):
    """An archive that must not be opened; its message is the reason."""


def opened(content: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    infos = z.infolist()
    names = [unicodedata.normalize("NFC", i.filename).casefold() for i in infos]
    rules = [
        (len(infos) > MAX_MEMBERS, "too_many_members"),
        (len(set(names)) < len(names), "colliding_names"),
        (any(n.startswith("/") or "\\" in n or ".." in n.split("/") or ":" in n for n in names), "unsafe_name"),
        (any(i.flag_bits & 1 for i in infos), "encrypted"),
        (sum(i.file_size for i in infos) > MAX_BYTES, "too_large"),
        (any(i.file_size > MAX_RATIO * max(1, i.compress_size) and i.file_size > 1 << 20 for i in infos), "compression_ratio"),
    ]
    for bad, reason in rules:
        if bad:
            raise UnsafeArchive(reason)
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise UnsafeArchive("doctype")
    return ElementTree.fromstring(raw)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _local(x) == name)


def _attr(e: ElementTree.Element | None, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None) if e is not None else None


def _text(e: ElementTree.Element) -> str:
    return "".join(x.text or "" if _local(x) == "t" else "\t" if _local(x) == "tab" else "\n" if _local(x) in ("br", "cr") else "" for x in e.iter())


def docx(content: bytes) -> tuple[list[dict], list[dict]]:
    """Paragraphs and tables of the body, in order, as one page."""
    body = next(_all(_xml(opened(content), "word/document.xml"), "body"))
    elements, cells, tables = [], [], 0
    for pos, e in enumerate(body):
        if _local(e) == "p" and (text := _text(e).strip()):
            style = _attr(next(_all(e, "pStyle"), None), "val") or ""
            number = re.search(r"\d+", style)
            kind = "heading" if re.match(r"(?i)heading|title", style) else "list_item" if next(_all(e, "numPr"), None) is not None or style.lower().startswith("list") else "paragraph"
            elements.append({"page_index": 0, "pos": pos, "type": kind, "level": int(number.group()) if kind == "heading" and number else 1 if kind == "heading" else None, "text": text})
        elif _local(e) == "tbl":
            elements.append({"page_index": 0, "pos": pos, "type": "table", "text": None})
            open_: dict[int, dict] = {}
            for r, row in enumerate(x for x in e if _local(x) == "tr"):
                c = 0
                for cell in (x for x in row if _local(x) == "tc"):
                    wide = int(_attr(next(_all(cell, "gridSpan"), None), "val") or 1)
                    merge = next(_all(cell, "vMerge"), None)
                    if merge is not None and _attr(merge, "val") != "restart" and c in open_:
                        open_[c]["row_span"] += 1
                    else:
                        one = {"page_index": 0, "table_pos": tables, "row": r, "col": c, "row_span": 1, "col_span": wide, "text": _text(cell).strip()}
                        cells.append(one)
                        open_[c] = one
                    c += wide
            tables += 1
    return elements, cells


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = 26 * n + ord(ch) - 64
    return n - 1


def xlsx(content: bytes) -> tuple[list[dict], list[dict]]:
    """One page per sheet; cells with values and their merged ranges, truncated beyond the cell limit."""
    z = opened(content)
    names = set(z.namelist())
    shared = [_text(si) for si in _all(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    elements, cells = [], []
    for page, name in enumerate(sheets):
        root = _xml(z, name)
        spans = {}
        for m in _all(root, "mergeCell"):
            a, _, b = (_attr(m, "ref") or "").partition(":")
            row = lambda x: int(re.search(r"\d+", x).group()) - 1
            spans[row(a), _column(a)] = (row(b or a) - row(a) + 1, _column(b or a) - _column(a) + 1)
        got = []
        for c in _all(root, "c"):
            ref, kind = _attr(c, "r") or "A1", _attr(c, "t")
            value = next(_all(c, "v"), None)
            text = _text(c) if kind == "inlineStr" else value.text if value is not None else None
            if text and kind == "s":
                text = shared[int(text)]
            if text:
                r, k = int(re.search(r"\d+", ref).group()) - 1, _column(ref)
                rs, cs = spans.get((r, k), (1, 1))
                got.append({"page_index": page, "table_pos": 0, "row": r, "col": k, "row_span": rs, "col_span": cs, "text": text})
        elements.append({"page_index": page, "pos": 0, "type": "table", "text": f"truncated to {MAX_CELLS} cells" if len(got) > MAX_CELLS else None})
        cells += got[:MAX_CELLS]
    return elements, cells


def pptx(content: bytes) -> tuple[list[dict], list[dict]]:
    """One page per slide; titles are headings, shapes have boxes in EMU."""
    z = opened(content)
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    elements, cells = [], []
    for page, name in enumerate(slides):
        tables = 0
        for pos, shape in enumerate(x for x in next(_all(_xml(z, name), "spTree")) if _local(x) in ("sp", "pic", "graphicFrame")):
            off, ext = next(_all(shape, "off"), None), next(_all(shape, "ext"), None)
            box = {}
            if off is not None and ext is not None and _attr(ext, "cx"):
                x, y = float(_attr(off, "x")), float(_attr(off, "y"))
                box = {"x0": x, "y0": y, "x1": x + float(_attr(ext, "cx")), "y1": y + float(_attr(ext, "cy"))}
            table = next(_all(shape, "tbl"), None)
            title = (_attr(next(_all(shape, "ph"), None), "type") or "") in ("title", "ctrTitle")
            kind = "table" if table is not None else "image" if _local(shape) == "pic" else "heading" if title else "paragraph"
            text = None if table is not None else "\n".join(t for p in _all(shape, "p") if (t := _text(p).strip())) or None
            if kind in ("table", "image") or text:
                elements.append({"page_index": page, "pos": pos, "type": kind, "level": 1 if title else None, "text": text, **box})
            if table is not None:
                for r, row in enumerate(_all(table, "tr")):
                    for c, cell in enumerate(x for x in row if _local(x) == "tc"):
                        if _attr(cell, "hMerge") is None and _attr(cell, "vMerge") is None:
                            cells.append({"page_index": page, "table_pos": tables, "row": r, "col": c, "row_span": int(_attr(cell, "rowSpan") or 1), "col_span": int(_attr(cell, "gridSpan") or 1), "text": _text(cell).strip()})
                tables += 1
    return elements, cells


PARSERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx}


def read(spark: SparkSession, path: str, what: str = "elements") -> DataFrame:
    """Elements or cells of all office files below a path; a file that can't be read is one row with its error."""
    schema = ELEMENTS if what == "elements" else CELLS

    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    arrow = pa.schema([(n, types[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    got = PARSERS[p.rpartition(".")[2].lower()](content)[what != "elements"]
                    rows += [{"path": p, **r} for r in got]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with one file must not stop the others
                    rows.append({"path": p, "error": str(e) if isinstance(e, UnsafeArchive) else type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx,pptx,DOCX,XLSX,PPTX}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def tsv_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of recogniser output: level 5 with text and confidence; box from left, top, width, height."""
    schema = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
    raw = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", "true").csv(path)
    words = raw.where("level = 5 and trim(text) <> '' and conf >= 0")
    return words.select(F.trim("text").alias("text"), F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"), (F.col("conf") / 100).alias("confidence"), "page_num", "line_num", "word_num")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that could not be read."""
    raw = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    text = spark.read.text(path)
    bad = text.where(F.from_json("value", schema, {"mode": "PERMISSIVE"}).isNull() | ~F.coalesce(F.col("value").rlike("\\}\\s*$"), F.lit(False)))
    return raw.where("_corrupt_record is null").drop("_corrupt_record"), bad


class Unavailable(RuntimeError):
    """A source that needs software this installation lacks."""


MODEL_SOURCES = ("pdf_text", "pdf_tables", "render", "layout_model", "ocr_model", "table_model", "document_model")


def model_source(name: str) -> None:
    """Sources backed by models or PDF software: never an empty result, always a clear refusal."""
    raise Unavailable(f"{name} is not available here" if name in MODEL_SOURCES else f"no source named {name}")
