import random

from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.operators import structure as S
from foliospark.plans import structure as plans


def test_crossing_run_odd_style_and_mixed_cell(spark):
    cells = spark.createDataFrame([("t", r, c, 100.0 * c, 20.0 * r, 100.0 * c + 100, 20.0 * r + 20) for r in range(2) for c in range(3)] + [("u", 0, 0, 0.0, 0.0, 9.0, 9.0)], "t string, row int, col int, x0 double, y0 double, x1 double, y1 double")
    runs = [("t", i, 0, c, 100.0 * c + 5, 2.0, 100.0 * c + 60, 18.0, 9.0, 0) for i, c in enumerate((0, 1, 2))] + [("t", 3, 0, 2, 205.0, 2.0, 260.0, 18.0, 8.0, 1), ("t", 4, None, None, 50.0, 22.0, 150.0, 38.0, 9.0, 0), ("t", 5, None, None, None, None, None, None, 9.0, 0)]
    df = spark.createDataFrame(runs, "t string, run int, row int, col int, x0 double, y0 double, x1 double, y1 double, size double, color int")
    got = {r.t: tuple(r)[1:] for r in S.table_quality(df, cells, ["t"], "run", ["row", "col"], "size", "color").collect()}
    assert got == {"t": (1, 1, 1, "high", "r0c2, r1c0, r1c1"), "u": (0, 0, 0, "none", "")}


def test_structural_checks_find_what_is_planted(spark):
    good = [(r, c, 10.0 * c, 10.0 * r, 10.0 * c + 9, 10.0 * r + 9) for r in range(2) for c in range(2)]
    rows = [("ok", *x) for x in good] + [("dup", *x) for x in good + good[:1]] + [("far", *x) for x in good[:3]] + [("far", 7, 1, 10.0, 70.0, 19.0, 79.0)] + [("flip", 1 - r, *x) for r, *x in good] + [("bad", 0, 0, 5.0, 0.0, 1.0, 9.0), ("bad", 0, 1, None, None, None, None)]
    cells = spark.createDataFrame(rows, "t string, row int, col int, x0 double, y0 double, x1 double, y1 double")
    tables = spark.createDataFrame([(t, 2, 2, 0.0, 0.0, 30.0, 30.0) for t in ("ok", "dup", "far", "flip", "bad", "none")], "t string, n_rows int, n_cols int, x0 double, y0 double, x1 double, y1 double")
    got = {r.t: set(r.failed_checks) for r in S.structural_checks(cells, tables, ["t"]).collect()}
    assert got == {"ok": set(), "none": set(), "dup": {"no_duplicate_coordinates"}, "far": {"coords_in_declared_range", "rows_contiguous", "cells_within_table_bbox"}, "flip": {"row_order_matches_geometry"}, "bad": {"all_cell_bboxes_valid"}}


def test_union_area_against_a_raster(spark):
    r = random.Random(2)
    boxes = [(k, float(x), float(y), float(x + r.randint(0, 9)), float(y + r.randint(0, 9))) for k in range(5) for x, y in [(r.randint(0, 12), r.randint(0, 12)) for _ in range(6)]]
    got = {x.k: x.area for x in S.union_area(spark.createDataFrame(boxes, "k int, x0 double, y0 double, x1 double, y1 double"), ["k"]).collect()}
    for k in range(5):
        cells = {(x, y) for q, x0, y0, x1, y1 in boxes if q == k for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))}
        assert got.get(k, 0.0) == len(cells)


def test_region_verdicts(spark):
    truth = spark.createDataFrame([(p, 0, 0.0, 0.0, 10.0, 10.0) for p in range(6)] + [(6, 0, 0.0, 0.0, 10.0, 10.0), (6, 1, 0.0, 0.0, 10.0, 9.0)], "p int, t int, x0 double, y0 double, x1 double, y1 double")
    regions = [(0, 0, 0.0, 0.0, 10.0, 9.0), (1, 0, 0.0, 0.0, 10.0, 6.0), (2, 0, 0.0, 0.0, 4.0, 10.0), (2, 1, 5.0, 0.0, 9.0, 10.0), (3, 0, 0.0, 0.0, 3.0, 5.0), (3, 1, 5.0, 5.0, 8.0, 10.0), (4, 0, 0.0, 0.0, 2.0, 6.0), (6, 4, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(regions, "p int, r int, x0 double, y0 double, x1 double, y1 double")
    got = {(x.p, x.t): (x.verdict, x.region, x.shared) for x in S.region_matches(truth, df, ["p"], "t", "r").collect()}
    assert got == {(0, 0): ("EXACT_MATCH", 0, False), (1, 0): ("GOOD_MATCH", 0, False), (2, 0): ("MULTIPLE_MATCH", None, False), (3, 0): ("AMBIGUOUS", None, False), (4, 0): ("PARTIAL_MATCH", 0, False), (5, 0): ("NO_REGION", None, False), (6, 0): ("EXACT_MATCH", 4, True), (6, 1): ("EXACT_MATCH", 4, True)}


def test_rows_that_only_tokens_bear_out(spark):
    cells = spark.createDataFrame([("t", 0, c, 100.0 * c, 0.0, 100.0 * c + 90, 20.0) for c in range(2)], "t string, row int, col int, x0 double, y0 double, x1 double, y1 double")
    tokens = [("t", 1, "a", 5.0, 30.0, 30.0, 45.0), ("t", 2, "b", 40.0, 31.0, 60.0, 46.0), ("t", 3, "c", 110.0, 32.0, 130.0, 44.0), ("t", 4, "lone", 5.0, 90.0, 30.0, 99.0), ("t", 5, "off", 400.0, 30.0, 430.0, 45.0)]
    df = spark.createDataFrame(tokens, "t string, id int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {tuple(r) for r in S.synthesised_rows(df, cells, ["t"], "id").collect()} == {("t", 1, 0, "a b", 30.0, 46.0), ("t", 1, 1, "c", 30.0, 46.0)}
    blocks = {r.id: r.block for r in S.orphan_blocks(df, ["t"], "id").collect()}
    assert blocks[1] == blocks[2] == blocks[5] and blocks[4] != blocks[1]


def test_greedy_tables_are_taken_once(spark):
    r = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 10.0, 9.0), (1, 2, 50.0, 50.0, 60.0, 60.0)], "p int, r int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 10.0), (1, 8, 0.0, 0.0, 10.0, 4.0)], "p int, t int, x0 double, y0 double, x1 double, y1 double")
    assert {tuple(x) for x in S.greedy_tables(r, t, ["p"], "r", "t").collect()} == {(1, 0, 7), (1, 1, 8)}


def test_otsu_against_the_plain_loop(spark):
    r = random.Random(7)
    rows = [(k, min(255, max(0, int(r.gauss(m, 20))))) for k in range(4) for m in ([40, 200] if k else [90]) for _ in range(60)] + [(9, 5)] * 4 + [(8, 3), (8, 9)]
    got = {x.k: x.threshold for x in S.otsu(spark.createDataFrame(rows + [(9, None)], "k int, g int"), ["k"], "g").collect()}
    for k in got:
        h = [sum(1 for q, g in rows if q == k and g == i) for i in range(256)]
        n, total, best, at, w, s = sum(h), sum(i * x for i, x in enumerate(h)), -1.0, 128, 0, 0
        for i in range(256):
            w, s = w + h[i], s + i * h[i]
            if w and n - w:
                v = float(w) * float(n - w) * (s / w - (total - s) / (n - w)) ** 2
                if v >= best - 1e-9:
                    best, at = max(v, best), i
        assert got[k] == at


def test_box_verdicts(spark):
    rows = [(None,), ([],), ([0.0, 0.0, 1.0],), ([0.0, None, 1.0, 1.0],), ([0.0, 0.0, float("nan"), 1.0],), ([2.0, 0.0, 1.0, 1.0],), ([0.0, 0.0, 0.0, 0.0],)]
    got = [(r.v, r.s is not None) for r in spark.createDataFrame(rows, "b array<double>").select(G.verdict(F.col("b")).alias("v"), G.strict(F.col("b")).alias("s")).collect()]
    assert got == [("missing", False), ("size", False), ("size", False), ("not_finite", False), ("not_finite", False), ("unordered", False), ("ok", True)]


def test_union_of_an_array_against_the_rows(spark):
    r = random.Random(3)
    groups = [(k, [(float(x), float(y), float(x + r.randint(0, 9)), float(y + r.randint(0, 9))) for x, y in [(r.randint(0, 12), r.randint(0, 12)) for _ in range(k)]]) for k in range(9)]
    df = spark.createDataFrame(groups, "k int, b array<struct<x0: double, y0: double, x1: double, y1: double>>")
    rows = {x.k: x.area for x in S.union_area(df.select("k", F.explode("b").alias("v")).select("k", "v.*"), ["k"]).collect()}
    assert {x.k: x.area for x in df.select("k", S.union_of(F.col("b")).alias("area")).collect()} == {k: rows.get(k, 0.0) for k, _ in groups}


def test_region_matches_broadcasts_no_tiles(spark, tmp_path):
    """A small file holds many boxes, and a box many tiles; by its size Spark would send all of them to the driver."""
    d = str(tmp_path)
    box = lambda x: [x, 0.0, x + 2000.0, 2000.0]
    pages = [(i, [(0, [box(0.0), box(3000.0)], [box(0.0)])]) for i in range(200)]
    schema = "study_id bigint, pages array<struct<page_index: int, region_bboxes: array<array<double>>, table_bboxes: array<array<double>>>>"
    spark.createDataFrame(pages, schema).selectExpr("study_id", "string(study_id) document_id", "pages").write.parquet(f"{d}/case_studies.parquet")
    df = plans.region_matches(spark, d)
    assert {(x.verdict, x.region, x.shared) for x in df.collect()} == {("EXACT_MATCH", 0, False)}
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
