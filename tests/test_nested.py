import json

from foliospark.operators import nested as N


def doc(pages, **more):
    return json.dumps({"document_id": "d", "pages": pages, **more})


def rows(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "record_id bigint, payload string, tag string")
    return {(r.record_id, r.kind, r.parent_key, r.child_key) for r in N.found(N.emit_documents(df)).collect()}


def test_shapes_of_pages(spark):
    page = {"index": 2.0, "elements": [{"id": "e0"}, None], "tables": [{"id": "t", "cells": [{"row": 0, "col": 1}]}]}
    whole = {(0, "page", "d", "d/2"), (0, "element", "d/2", "d/2/e0"), (0, "table", "d/2", "d/2/t"), (0, "cell", "d/2/t", "d/2/t/r0c1")}
    assert rows(spark, [doc([page])]) == whole
    assert rows(spark, [doc(page)]) == whole
    assert rows(spark, [doc({"7": page})]) == whole
    assert rows(spark, [json.dumps(doc([page]))]) == whole


def test_missing_index_null_and_broken(spark):
    assert rows(spark, [doc([None, {"elements": None}, {"index": "4"}])]) == {(0, "page", "d", "d/1"), (0, "page", "d", "d/4")}
    assert rows(spark, [doc({"3": {"width": 1}, "5": None})]) == {(0, "page", "d", "d/3")}
    assert rows(spark, [None, "", "{", doc([{}])[:-2], "[1]", "null"]) == set()


def test_repeated_rows_lone_surrogates_and_empty(spark):
    p = doc([{"index": 0, "elements": [{"id": "\ud83d"}]}])
    assert len(rows(spark, [p])) == 2
    df = spark.createDataFrame([(1, doc([{"index": 0}]))] * 3, "record_id bigint, payload string")
    assert N.found(N.emit_documents(df)).count() == 1
    assert N.found(N.emit_documents(df.limit(0))).count() == 0


def test_studies_and_typed_tables(spark, tmp_path):
    schema = "study_id bigint, document_id string, pages array<struct<page_index:int,page_size:array<double>,n_regions:int,region_labels:array<string>,region_bboxes:array<array<double>>,region_claimed:array<int>,tokens:int,orphan_rate double,orphan_text:string>>".replace("orphan_rate double", "orphan_rate:double")
    page = (None, None, 3, ["a", "b", "c"], [[1.0, 2.0, 3.0, 4.0], None, [], [5.0, 6.0, 7.0, 8.0]], [1, 2, 3, 4], 9, 0.5, "x")
    df = spark.createDataFrame([(1, "s", [None, page])], schema)
    tagged = N.emit_studies(df)
    assert {(r.kind, r.parent_key, r.child_key) for r in N.found(tagged).collect()} == {("page", "s", "s/1"), ("region", "s/1", "s/1/0"), ("region", "s/1", "s/1/3")}
    N.write_tagged(tagged, str(tmp_path / "t"))
    regions = N.typed(spark.read.parquet(str(tmp_path / "t")), "region").orderBy("pos").collect()
    assert [(r.label, r.bbox[0]) for r in regions] == [("a", 1.0), (None, 5.0)]


def test_flat_tables_keep_every_field(spark, tmp_path):
    from foliospark.plans import records as R

    page = {"index": 0, "notes": ["n"], "reading_order": ["e"], "odd": 1, "elements": [{"id": "e", "extra": {"runs": [{"font": "f"}]}}]}
    spark.createDataFrame([(1, doc([page], schema_version="2", metadata={"route": "r"}, assets={"img0": "a"}))], "record_id bigint, payload string").write.parquet(f"{tmp_path}/raw_documents.parquet")
    schema = "study_id bigint, document_id string, language string, pages array<struct<page_index:int,page_size:array<double>,n_tables:int,table_bboxes:array<array<double>>,table_cells:array<int>,claims:map<string,bigint>,region_bboxes:array<array<double>>>>"
    spark.createDataFrame([(2, "s", "en", [(0, [5.0, 6.0], 1, [[1.0, 2.0, 3.0, 4.0]], [7], {"x": 3}, None)])], schema).write.parquet(f"{tmp_path}/case_studies.parquet")
    got = {tag: {r.src: r for r in R.QUERIES[f"p4_table_{tag}"](spark, str(tmp_path)).collect()} for tag in ("document", "page", "element", "study_table")}
    d, p, e = (got[k]["raw_documents"] for k in ("document", "page", "element"))
    assert (d.child_key, d.schema_version, json.loads(d.metadata), json.loads(d.assets)) == ("d", "2", {"route": "r"}, {"img0": "a"})
    assert (p["index"], p.notes, p.reading_order, json.loads(p.rest)) == ("0", ["n"], ["e"], {"odd": 1})
    assert json.loads(e.extra) == {"runs": [{"font": "f"}]}
    d, p, t = (got[k]["case_studies"] for k in ("document", "page", "study_table"))
    assert (d.language, p.page_size, p.n_tables, json.loads(p.claims)) == ("en", [5.0, 6.0], 1, {"x": 3})
    assert (t.parent_key, t.n_cells, t.bbox) == ("s/0", 7, [1.0, 2.0, 3.0, 4.0])
    assert {r.kind for r in R.QUERIES["p4_found"](spark, str(tmp_path)).collect()} == {"page", "element"}


def test_found_comes_from_the_stored_flat_tables(spark, tmp_path):
    from foliospark.plans import records as R

    page = {"index": 0, "width": 7, "elements": [{"id": "e", "text": "x"}], "tables": [{"id": "t", "n_rows": 1, "cells": [{"row": 0, "col": 1, "text": "y"}]}]}
    raw = "record_id bigint, payload string"
    study = "study_id bigint, document_id string, language string, pages array<struct<page_index:int,table_bboxes:array<array<double>>,region_labels:array<string>,region_bboxes:array<array<double>>>>"
    some, none = f"{tmp_path}/some", f"{tmp_path}/none"
    for path, docs, studies in ((some, [(1, doc([page]))], [(2, "s", "en", [(0, [[1.0, 2.0, 3.0, 4.0]], ["a"], [[5.0, 6.0, 7.0, 8.0]])])]), (none, [], [])):
        spark.createDataFrame(docs, raw).write.parquet(f"{path}/raw_documents.parquet")
        spark.createDataFrame(studies, study).write.parquet(f"{path}/case_studies.parquet")

    found = R.QUERIES["p4_found"](spark, some)
    # the tables of the tags that count are read, not the nested records again
    read = {f.split("/")[-2]: f.rsplit("/", 1)[0] for f in found.inputFiles()}
    assert set(read) == {"page", "element", "table", "cell", "region"}
    flat = {tag: spark.read.parquet(folder).collect() for tag, folder in read.items()}
    by_src = lambda tag: {r.src: r for r in flat[tag]}
    assert (by_src("page")["raw_documents"].width, by_src("element")["raw_documents"].text, by_src("table")["raw_documents"].n_rows) == (7.0, "x", 1)
    assert (by_src("cell")["raw_documents"].col, by_src("cell")["raw_documents"].text, by_src("region")["case_studies"].bbox) == (1, "y", [5.0, 6.0, 7.0, 8.0])
    assert {tuple(r) for r in found.collect()} == {(r.src, r.record_id, tag, r.parent_key, r.child_key) for tag, rows in flat.items() for r in rows}
    assert {(r.kind, r.parent_key, r.child_key) for r in found.collect()} == {("page", "d", "d/0"), ("element", "d/0", "d/0/e"), ("table", "d/0", "d/0/t"), ("cell", "d/0/t", "d/0/t/r0c1"), ("page", "s", "s/0"), ("region", "s/0", "s/0/0")}
    # records without children, and no records at all, give no rows
    assert R.QUERIES["p4_found"](spark, none).count() == R.QUERIES["p4_tables"](spark, none).count() == 0
