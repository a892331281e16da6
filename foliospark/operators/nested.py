"""Nested records to related flat tables, in one tagged pass.

A depth-first visitor walks each record once and emits one row per node:
its tag (document, page, element, table, study_table, cell, region), its own key, its parent's key,
its position and all its attributes but its children as JSON. Rows of all tags share one
schema, so the pass is a single map without a shuffle; `write_tagged` stores
it partitioned by tag, `typed` gives a tag its columns, and `flat_tables` does all
three and keeps the table of each tag.

Defined results:
* NULL, broken or incomplete JSON: no rows. A payload that is a JSON string
  holding JSON is decoded again.
* `pages` may be a list, an object keyed by page, or one page object.
* NULL pages and NULL or empty boxes emit nothing but keep their position.
* A page's index is written as a plain integer; without index the page takes
  the key it stands under, else its position.
* A record without document_id is keyed `#<record_id>`; an element or table
  without id takes its position.
* Repeated records give repeated rows; `found` makes them distinct.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGGED = "tag string, src string, record_id bigint, parent_key string, child_key string, pos int, payload string"

# What a node holds beside its children; objects as JSON, fields of other names in `rest` as JSON.
SCHEMAS = {
    "document": "document_id string, schema_version string, metadata string, assets string, labels array<string>, language string, exact double, char_recall double, order_ok boolean, tables_expected int, tables_found int, missing_strings array<string>, written_at string, rest string",
    "page": "index string, page_index int, width double, height double, page_size array<double>, dpi int, coordinate_unit string, notes array<string>, reading_order array<string>, n_regions int, n_tables int, tokens int, claims string, orphan_rate double, orphan_classes string, orphan_text string, rest string",
    "element": "id string, type string, text string, source_backend string, page_number int, parent_id string, bbox struct<x0:double,y0:double,x1:double,y1:double>, extra string, rest string",
    "table": "id string, n_rows int, n_cols int, source_backend string, rest string",
    "study_table": "n_cells int, bbox array<double>, rest string",
    "cell": "row int, col int, row_span int, col_span int, text string, is_header boolean, bbox struct<x0:double,y0:double,x1:double,y1:double>, rest string",
    "region": "label string, claimed int, bbox array<double>, rest string",
}
_KNOWN = {tag: {c.split(" ")[0] for c in cols.split(", ")} - {"rest"} for tag, cols in SCHEMAS.items()}
# Tags of the tables that are no children in the sense of `found`.
OWN = ("document", "study_table")

_ARROW = pa.schema([("tag", pa.string()), ("src", pa.string()), ("record_id", pa.int64()), ("parent_key", pa.string()), ("child_key", pa.string()), ("pos", pa.int32()), ("payload", pa.string())])


def plain(value: object) -> str | None:
    """An index or id as text; whole numbers without a fraction, NULL and blank as None."""
    if value is None:
        return None
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return str(int(value)) if float(value).is_integer() else str(value)
    text = str(value).strip()
    try:
        return str(int(float(text))) if text and float(text).is_integer() else text or None
    except (ValueError, OverflowError):
        return text or None


def children(value: object) -> Iterator[tuple[int, str | None, dict]]:
    """(position, key it stands under, object) of a list, a keyed object or a single object."""
    if isinstance(value, list):
        pairs = [(None, x) for x in value]
    elif isinstance(value, dict) and value:
        keyed = all(x is None or isinstance(x, dict) for x in value.values())
        pairs = list(value.items()) if keyed else [(None, value)]
    else:
        return
    for pos, (key, item) in enumerate(pairs):
        if isinstance(item, dict):
            yield pos, key, item


class Visitor:
    """Collects tagged rows column by column; one per batch."""

    def __init__(self, src: str):
        self.src = src
        self.cols: dict[str, list] = {n: [] for n in _ARROW.names}
        self.record_id: int | None = None

    def emit(self, tag: str, parent: str | None, key: str, pos: int, node: dict, nested: tuple[str, ...] = ()) -> None:
        # a list of pairs is a map of Arrow
        own = {k: dict(v) if isinstance(v, list) and v and isinstance(v[0], tuple) else v for k, v in node.items() if k not in nested}
        rest = {k: v for k, v in own.items() if k not in _KNOWN[tag]}
        own = {k: v for k, v in own.items() if k in _KNOWN[tag]} | ({"rest": rest} if rest else {})
        body = json.dumps(own, ensure_ascii=False, default=str)
        for name, value in zip(_ARROW.names, (tag, self.src, self.record_id, parent, key, pos, body)):
            self.cols[name].append(value)

    def document(self, record_id: int, doc: dict) -> None:
        self.record_id = record_id
        doc_key = plain(doc.get("document_id")) or f"#{record_id}"
        self.emit("document", None, doc_key, 0, doc, ("pages",))
        for pos, under, page in children(doc.get("pages")):
            index = plain(page.get("index"))
            key = f"{doc_key}/{index if index is not None else plain(under) or pos}"
            self.emit("page", doc_key, key, pos, page, ("elements", "tables"))
            for kind in ("element", "table"):
                for at, name, item in children(page.get(kind + "s")):
                    item_key = f"{key}/{plain(item.get('id')) or plain(name) or at}"
                    self.emit(kind, key, item_key, at, item, ("cells",))
                    for n, _, cell in children(item.get("cells")) if kind == "table" else ():
                        self.emit("cell", item_key, f"{item_key}/r{plain(cell.get('row'))}c{plain(cell.get('col'))}", n, cell)

    def study(self, record_id: int, document_id: str | None, pages: list | None, about: dict | None = None) -> None:
        self.record_id = record_id
        doc_key = plain(document_id) or f"#{record_id}"
        self.emit("document", None, doc_key, 0, {"document_id": document_id} | (about or {}))
        for pos, _, page in children(pages):
            index = plain(page.get("page_index"))
            key = f"{doc_key}/{index if index is not None else pos}"
            self.emit("page", doc_key, key, pos, page, ("region_bboxes", "region_labels", "region_claimed", "table_bboxes", "table_cells"))
            boxes, cells = page.get("table_bboxes") or [], page.get("table_cells") or []
            for n in range(max(len(boxes), len(cells))):
                self.emit("study_table", key, f"{key}/table{n}", n, {"n_cells": cells[n] if n < len(cells) else None, "bbox": boxes[n] if n < len(boxes) else None})
            labels, claimed = page.get("region_labels") or [], page.get("region_claimed") or []
            for n, box in enumerate(page.get("region_bboxes") or []):
                if box:
                    self.emit("region", key, f"{key}/{n}", n, {"label": labels[n] if n < len(labels) else None, "claimed": claimed[n] if n < len(claimed) else None, "bbox": box})

    def batch(self) -> pa.RecordBatch:
        try:
            return pa.RecordBatch.from_pydict(self.cols, schema=_ARROW)
        except UnicodeEncodeError:  # half a surrogate pair in an escape
            clean = lambda x: x.encode("utf-8", "replace").decode() if isinstance(x, str) else x
            return pa.RecordBatch.from_pydict({n: [clean(x) for x in c] for n, c in self.cols.items()}, schema=_ARROW)


def parsed(payload: str | None) -> dict | None:
    """The object a payload holds, however often it is wrapped in a JSON string; None if broken."""
    value: object = payload
    for _ in range(4):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value)
        except ValueError:
            return None
    return value if isinstance(value, dict) else None


def emit_documents(df: DataFrame) -> DataFrame:
    """Tagged rows of JSON documents; df has record_id and payload, other columns are ignored."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = Visitor("raw_documents")
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (doc := parsed(text)) is not None:
                    v.document(rid, doc)
            yield v.batch()

    return df.select("record_id", "payload").mapInArrow(visit, TAGGED)


def emit_studies(df: DataFrame) -> DataFrame:
    """Tagged rows of case studies; df has study_id, document_id and pages, other columns become attributes of the document."""
    more = [c for c in df.columns if c not in ("study_id", "document_id", "pages")]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = Visitor("case_studies")
            about = [dict(zip(more, x)) for x in zip(*(batch.column(3 + i).to_pylist() for i in range(len(more))))] or [{}] * batch.num_rows
            for sid, doc, pages, own in zip(*(batch.column(i).to_pylist() for i in range(3)), about):
                v.study(sid, doc, pages, own)
            yield v.batch()

    return df.select("study_id", "document_id", "pages", *more).mapInArrow(visit, TAGGED)


def found(tagged: DataFrame) -> DataFrame:
    """One distinct row per child with the link to its parent."""
    return tagged.where(~F.col("tag").isin(*OWN)).select("src", "record_id", F.col("tag").alias("kind"), "parent_key", "child_key").distinct()


def write_tagged(tagged: DataFrame, path: str) -> None:
    """Store the pass partitioned by tag: one folder per flat table."""
    tagged.write.mode("overwrite").partitionBy("tag").parquet(path)


def typed(tagged: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag: keys plus its typed columns; unparsable attributes are NULL."""
    rows = tagged.where(F.col("tag") == tag)
    return rows.select("src", "record_id", "parent_key", "child_key", "pos", F.from_json("payload", SCHEMAS[tag], {"mode": "PERMISSIVE"}).alias("_v")).select("src", "record_id", "parent_key", "child_key", "pos", "_v.*")


def flat_tables(tagged: DataFrame, path: str) -> dict[str, DataFrame]:
    """Store the pass once by tag, then read each tag's folder with its schema and keep its flat table; all lie below `path`."""
    write_tagged(tagged, f"{path}/tagged")
    read = tagged.sparkSession.read
    # with its schema given, a pass without rows reads as no rows
    stored, flat = read.schema(TAGGED).parquet(f"{path}/tagged"), {}
    for tag in SCHEMAS:
        rows = typed(stored, tag)
        rows.write.mode("overwrite").parquet(f"{path}/{tag}")
        flat[tag] = read.schema(rows.schema).parquet(f"{path}/{tag}")
    return flat


def links(flat: dict[str, DataFrame]) -> DataFrame:
    """The keys of all rows of the flat tables, with their tag."""
    parts = [rows.select(F.lit(tag).alias("tag"), "src", "record_id", "parent_key", "child_key") for tag, rows in flat.items()]
    return reduce(DataFrame.unionByName, parts)
