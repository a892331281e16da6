"""Queries on the structure of pages and tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.operators import boxes, sequences
from foliospark.operators import structure as S
from foliospark.plans.pages import _CI, _CP, _ON, _T, PAGE, _doc, _regions, _study_pages, _tokens
from foliospark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# regions of a page as the cells of a table of four columns, tokens as runs with a size and a colour
def _grid_cells(t: DataFrame) -> DataFrame:
    return _regions(t).withColumn("row", F.floor(F.col("region_pos") / 4).cast("int")).withColumn("col", F.col("region_pos") % 4)


def _runs(t: DataFrame) -> DataFrame:
    d = _doc(t).where("x0 is not null").withColumn("size", F.bround(F.col("y1") - F.col("y0"))).withColumn("color", F.length(F.coalesce("text", F.lit(""))) % 3)
    owner = boxes.best_overlap(d, _grid_cells(t), PAGE, "token_id", "region_pos", 0.5).select(F.col("a_token_id").alias("token_id"), F.col("b_row").alias("row"), F.col("b_col").alias("col"))
    return d.join(owner, "token_id", "left")


_G = f"""{_T}, c AS (SELECT *, CAST(region_pos // 4 AS INT) AS "row", region_pos % 4 AS col FROM r),
u AS (SELECT d.*, round_even(y1 - y0, 0) AS size, length(coalesce(text, '')) % 3 AS color FROM d WHERE x0 IS NOT NULL),
x AS (SELECT u.token_id, u.document_id, u.page_index, c."row", c.col, c.region_pos, greatest(0, least(u.x1, c.x1) - greatest(u.x0, c.x0)) * greatest(0, least(u.y1, c.y1) - greatest(u.y0, c.y0)) / ((u.x1 - u.x0) * (u.y1 - u.y0)) AS frac FROM u JOIN c ON u.document_id = c.document_id AND u.page_index = c.page_index WHERE u.x1 > u.x0 AND u.y1 > u.y0),
o AS (SELECT token_id, "row", col FROM (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY frac DESC, region_pos) AS n FROM x WHERE frac > 0) WHERE n = 1 AND frac >= 0.5),
p AS (SELECT u.*, o."row", o.col FROM u LEFT JOIN o USING (token_id)),
k AS (SELECT document_id, page_index, token_id, list(DISTINCT {{'row': "row", 'col': col}}) AS cells FROM x WHERE frac > 0.05 GROUP BY 1, 2, 3 HAVING count(*) > 1 AND max(frac) < 0.6),
ds AS (SELECT document_id, page_index, "row", arg_max(size, {{'n': n, 'v': -size}}) AS row_size, sum(n) AS total FROM (SELECT document_id, page_index, "row", size, count(*) AS n FROM p WHERE "row" IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
dc AS (SELECT document_id, page_index, "row", arg_max(color, {{'n': n, 'v': -color}}) AS row_color FROM (SELECT document_id, page_index, "row", color, count(*) AS n FROM p WHERE "row" IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
ol AS (SELECT p.document_id, p.page_index, p."row", p.col FROM p JOIN ds USING (document_id, page_index, "row") JOIN dc USING (document_id, page_index, "row") WHERE total >= 3 AND row_size > 0 AND abs(size - row_size) / row_size > 0.08 AND color <> row_color),
mx AS (SELECT document_id, page_index, "row", col FROM p WHERE "row" IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT {{'s': round_even(size, 1), 'c': color}}) > 1),
bd AS (SELECT document_id, page_index, list({{'row': "row", 'col': col}} ORDER BY "row", col) AS bad FROM (SELECT document_id, page_index, unnest(cells).row AS "row", unnest(cells).col AS col FROM k UNION SELECT document_id, page_index, "row", col FROM ol UNION SELECT document_id, page_index, "row", col FROM mx) GROUP BY 1, 2)"""


@query(f"""{_G}, n1 AS (SELECT document_id, page_index, count(*) AS n FROM k GROUP BY 1, 2), n2 AS (SELECT document_id, page_index, count(*) AS n FROM ol GROUP BY 1, 2), n3 AS (SELECT document_id, page_index, count(*) AS n FROM mx GROUP BY 1, 2)
SELECT q.document_id, q.page_index, coalesce(n1.n, 0) AS n_crossing, coalesce(n2.n, 0) AS n_outliers, coalesce(n3.n, 0) AS n_mixed, CASE WHEN n3.n > 0 THEN 'high' WHEN n1.n > 0 OR n2.n > 0 THEN 'medium' ELSE 'none' END AS severity,
coalesce(array_to_string(list_transform(bad[1:6], lambda b: 'r' || CAST(b.row AS VARCHAR) || 'c' || CAST(b.col AS VARCHAR)), ', ') || CASE WHEN len(bad) > 6 THEN ' (+' || CAST(len(bad) - 6 AS VARCHAR) || ' more)' ELSE '' END, '') AS affected
FROM (SELECT DISTINCT document_id, page_index FROM c) q LEFT JOIN n1 USING (document_id, page_index) LEFT JOIN n2 USING (document_id, page_index) LEFT JOIN n3 USING (document_id, page_index) LEFT JOIN bd USING (document_id, page_index)""")
def table_quality(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return S.table_quality(_runs(t), _grid_cells(t), PAGE, "token_id", ["row", "col"], "size", "color")


@query(f"""{_T}, c AS (SELECT *, CAST(region_pos // 4 AS INT) AS "row", region_pos % 4 AS col FROM r), tb AS (SELECT document_id, page_index, 5 AS n_rows, 4 AS n_cols, min(x0) + 5 AS tx0, min(y0) AS ty0, max(x1) AS tx1, max(y1) AS ty1 FROM c GROUP BY 1, 2),
g AS (SELECT document_id, page_index, count(*) AS n_cells, bool_and("row" BETWEEN 0 AND n_rows - 1 AND col BETWEEN 0 AND n_cols - 1) AS a, count(*) = count(DISTINCT {{'r': "row", 'c': col}}) AS b, count(DISTINCT "row") = max("row") + 1 AND min("row") = 0 AS cc, count(DISTINCT col) = max(col) + 1 AND min(col) = 0 AS dd, bool_and(x0 <= x1 AND y0 <= y1) AS ii, bool_and(x0 >= tx0 AND y0 >= ty0 AND x1 <= tx1 AND y1 <= ty1) AS jj FROM c JOIN tb USING (document_id, page_index) GROUP BY 1, 2),
rw AS (SELECT document_id, page_index, bool_and(n < 2 OR lo < hi) AS gg, bool_and(coalesce(before <= first, true)) AS ee FROM (SELECT *, lag(first) OVER (PARTITION BY document_id, page_index ORDER BY "row") AS before FROM (SELECT document_id, page_index, "row", count(*) AS n, max(y0) AS lo, min(y1) AS hi, min(y0) AS first FROM c GROUP BY 1, 2, 3)) GROUP BY 1, 2),
cl AS (SELECT document_id, page_index, bool_and(n < 2 OR lo < hi) AS hh, bool_and(coalesce(before <= first, true)) AS ff FROM (SELECT *, lag(first) OVER (PARTITION BY document_id, page_index ORDER BY col) AS before FROM (SELECT document_id, page_index, col, count(*) AS n, max(x0) AS lo, min(x1) AS hi, min(x0) AS first FROM c GROUP BY 1, 2, 3)) GROUP BY 1, 2),
z AS (SELECT document_id, page_index, n_cells, list_filter([CASE WHEN NOT a THEN 'coords_in_declared_range' END, CASE WHEN NOT b THEN 'no_duplicate_coordinates' END, CASE WHEN NOT cc THEN 'rows_contiguous' END, CASE WHEN NOT dd THEN 'cols_contiguous' END, CASE WHEN NOT ee THEN 'row_order_matches_geometry' END, CASE WHEN NOT ff THEN 'col_order_matches_geometry' END, CASE WHEN NOT gg THEN 'rows_vertically_coherent' END, CASE WHEN NOT hh THEN 'cols_horizontally_coherent' END, CASE WHEN NOT ii THEN 'all_cell_bboxes_valid' END, CASE WHEN NOT jj THEN 'cells_within_table_bbox' END], lambda v: v IS NOT NULL) AS f FROM g JOIN rw USING (document_id, page_index) JOIN cl USING (document_id, page_index))
SELECT document_id, page_index, n_cells, array_to_string(f, ',') AS failed_checks, len(f) = 0 AS structurally_valid FROM z""")
def structural_checks(spark: SparkSession, d: str) -> DataFrame:
    c = _grid_cells(_tokens(spark, d))
    t = c.groupBy(*PAGE).agg(F.lit(5).alias("n_rows"), F.lit(4).alias("n_cols"), (F.min("x0") + 5).alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return S.structural_checks(c, t, PAGE).withColumn("failed_checks", F.array_join("failed_checks", ","))


def _boxes_of(pages: DataFrame, column: str, name: str) -> DataFrame:
    """Well-formed boxes of the pages of studies, by study and position of the page."""
    b = pages.select("study_id", "pos", F.posexplode(column).alias(name, "b"))
    return b.select("study_id", "pos", name, G.strict(F.col("b")).alias("s")).where("s is not null").select("study_id", "pos", name, "s.*")


_ST = f"""{_CP}, rg AS (SELECT study_id, pos, region_pos, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1 FROM b WHERE len(b) = 4 AND len(list_filter(b, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND b[1] <= b[3] AND b[2] <= b[4]),
tq AS (SELECT study_id, pos, unnest(table_bboxes) AS b, generate_subscripts(table_bboxes, 1) - 1 AS table_pos FROM q), tt AS (SELECT study_id, pos, table_pos, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1 FROM tq WHERE len(b) = 4 AND len(list_filter(b, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND b[1] <= b[3] AND b[2] <= b[4])"""
_KEY = ["study_id", "pos"]
_UNION = """{n}e AS (SELECT DISTINCT {k}, unnest([x0, x1]) AS xa FROM {src} WHERE x1 > x0 AND y1 > y0), {n}s AS (SELECT *, lead(xa) OVER (PARTITION BY {k} ORDER BY xa) AS xb FROM {n}e),
{n}h AS (SELECT {k}, xa, xb, greatest(0, y1 - greatest(y0, coalesce(max(y1) OVER (PARTITION BY {k}, xa ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y0))) AS h FROM {n}s JOIN {src} USING ({k}) WHERE xb IS NOT NULL AND x0 <= xa AND x1 >= xb AND x1 > x0 AND y1 > y0), {n} AS (SELECT {k}, sum(h * (xb - xa)) AS area FROM {n}h GROUP BY ALL)"""


@query(f"""{_ST}, {_UNION.format(n="un", k="study_id, pos", src="rg")} SELECT study_id, pos, round(area, 4) AS area FROM un""")
def union_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Area that the regions of each page cover together, exactly."""
    return S.union_area(_boxes_of(_study_pages(spark, d), "region_bboxes", "region_pos"), _KEY).withColumn("area", F.round("area", 4))


_PAIR = "greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


@query(f"""{_ST}, ti AS (SELECT *, (x1 - x0) * (y1 - y0) AS ta FROM tt), i AS (SELECT t.study_id, t.pos, t.table_pos, r.region_pos, {_PAIR.format(a="t", b="r")} AS ov, ta, (r.x1 - r.x0) * (r.y1 - r.y0) AS ra, greatest(t.x0, r.x0) AS x0, greatest(t.y0, r.y0) AS y0, least(t.x1, r.x1) AS x1, least(t.y1, r.y1) AS y1 FROM ti t JOIN rg r USING (study_id, pos)),
pz AS (SELECT *, ov / (ta + ra - ov) AS iou, ov / ta AS oft, row_number() OVER (PARTITION BY study_id, pos, table_pos ORDER BY ov / ta DESC, region_pos) AS place FROM i WHERE ov > 0), cv AS (SELECT * FROM pz WHERE oft >= 0.2),
{_UNION.format(n="un", k="study_id, pos, table_pos", src="cv")},
g AS (SELECT study_id, pos, table_pos, max(CASE WHEN place = 1 THEN iou END) AS iou, max(CASE WHEN place = 1 THEN oft END) AS f, max(CASE WHEN place = 2 THEN oft END) AS s, max(CASE WHEN place = 1 THEN region_pos END) AS region, count_if(oft >= 0.2) AS nc FROM pz GROUP BY 1, 2, 3),
vz AS (SELECT ti.study_id, ti.pos, ti.table_pos, region, CASE WHEN f IS NULL THEN 'NO_REGION' WHEN nc >= 2 AND iou < 0.5 AND coalesce(area / ta, 0) >= 0.6 THEN 'MULTIPLE_MATCH' WHEN iou >= 0.75 THEN 'EXACT_MATCH' WHEN iou >= 0.5 THEN 'GOOD_MATCH' WHEN s >= 0.15 AND f < 0.5 AND f - s <= 0.15 * f THEN 'AMBIGUOUS' WHEN f >= 0.1 THEN 'PARTIAL_MATCH' ELSE 'NO_REGION' END AS verdict FROM ti LEFT JOIN g USING (study_id, pos, table_pos) LEFT JOIN un USING (study_id, pos, table_pos)),
w AS (SELECT study_id, pos, table_pos, verdict, CASE WHEN verdict IN ('EXACT_MATCH', 'GOOD_MATCH', 'PARTIAL_MATCH') THEN region END AS region FROM vz)
SELECT study_id, pos, table_pos, verdict, region, region IS NOT NULL AND count(region) OVER (PARTITION BY study_id, pos, region) > 1 AS shared FROM w""")
def region_matches(spark: SparkSession, d: str) -> DataFrame:
    p = _study_pages(spark, d)
    return S.region_matches(_boxes_of(p, "table_bboxes", "table_pos"), _boxes_of(p, "region_bboxes", "region_pos"), _KEY, "table_pos", "region_pos")


@query(f"""{_ST}, pz AS (SELECT r.study_id, r.pos, r.region_pos, t.table_pos, {_PAIR.format(a="t", b="r")} AS ov, (t.x1 - t.x0) * (t.y1 - t.y0) AS ta, (r.x1 - r.x0) * (r.y1 - r.y0) AS ra FROM rg r JOIN tt t USING (study_id, pos))
SELECT study_id, pos, region_pos, list(table_pos ORDER BY table_pos) AS candidates, arg_max(table_pos, {{'i': ov / (ta + ra - ov), 't': -table_pos}}) AS owner FROM pz WHERE ov > 0 AND ov / (ta + ra - ov) > 0.1 GROUP BY 1, 2, 3""")
def ownership_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Tables that could own each region, and the one that overlaps it most."""
    p = _study_pages(spark, d)
    r, t = _boxes_of(p, "region_bboxes", "region_pos"), _boxes_of(p, "table_bboxes", "table_pos")
    j = boxes.box_join(boxes.prefixed(r, "a_", _KEY), boxes.prefixed(t, "b_", _KEY), _KEY).withColumn("iou", G.iou(G.Box.of("a_"), G.Box.of("b_"))).where("iou > 0.1")
    return j.groupBy(*_KEY, F.col("a_region_pos").alias("region_pos")).agg(F.array_sort(F.collect_list("b_table_pos")).alias("candidates"), F.max_by("b_table_pos", F.struct("iou", -F.col("b_table_pos"))).alias("owner"))


@query()
def region_tables(spark: SparkSession, d: str) -> DataFrame:
    """Regions in their order take the best table that is left."""
    p = _study_pages(spark, d)
    return S.greedy_tables(_boxes_of(p, "region_bboxes", "region_pos"), _boxes_of(p, "table_bboxes", "table_pos"), _KEY, "region_pos", "table_pos")


@query(f"""{_ST}, lb AS (SELECT study_id, pos, unnest(region_labels) AS label, generate_subscripts(region_labels, 1) - 1 AS region_pos FROM q), x AS (SELECT rg.*, label FROM rg JOIN lb USING (study_id, pos, region_pos)),
pz AS (SELECT a.label AS la, b.label AS lb, a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 AS ab, b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 AS ba, {_PAIR.format(a="a", b="b")} AS ov, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS bb FROM x a JOIN x b ON a.study_id = b.study_id AND a.pos = b.pos AND a.region_pos < b.region_pos),
vz AS (SELECT CASE WHEN (CASE WHEN ab THEN la WHEN ba THEN lb END) = 'picture' THEN 'nested_in_picture_labelled_block' WHEN ab OR ba THEN 'legitimate_nesting' WHEN (la = 'table' OR lb = 'table') AND la <> lb THEN 'table_text_overlap' WHEN la = 'picture' OR lb = 'picture' THEN 'stamp_occlusion' WHEN la = lb AND ov / (aa + bb - ov) >= 0.5 THEN 'duplicate_region' WHEN ov / (aa + bb - ov) < 0.1 THEN 'boundary_ambiguity' ELSE 'duplicate_region' END AS class FROM pz WHERE ov > 0)
SELECT class, count(*) AS n FROM vz GROUP BY 1""")
def overlap_classes(spark: SparkSession, d: str) -> DataFrame:
    p = _study_pages(spark, d)
    labels = p.select("study_id", "pos", F.posexplode("region_labels").alias("region_pos", "label"))
    r = _boxes_of(p, "region_bboxes", "region_pos").join(labels, [*_KEY, "region_pos"])
    a, b = G.Box.of("a_"), G.Box.of("b_")
    j = boxes.box_join(boxes.prefixed(r, "a_", _KEY), boxes.prefixed(r, "b_", _KEY), _KEY, (F.col("a_region_pos") < F.col("b_region_pos")) & (G.intersection(a, b) > 0))
    return j.groupBy(S.overlap_class(F.col("a_label"), F.col("b_label"), a, b).alias("class")).agg(F.count("*").alias("n"))


_NEAR = "(d.x0 + d.x1) / 2 BETWEEN r.x0 - 3 AND r.x1 + 3 AND (d.y0 + d.y1) / 2 BETWEEN r.y0 - 3 AND r.y1 + 3"


@query(f"""{_T}, h AS (SELECT document_id, page_index, min(x0) AS hx0, min(y0) AS hy0, max(x1) AS hx1, max(y1) AS hy1 FROM r WHERE region_pos % 7 <> 3 GROUP BY 1, 2),
o AS (SELECT d.*, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, EXISTS (SELECT 1 FROM r WHERE {_ON} AND r.region_pos % 7 = 3 AND {_NEAR}) AS nt, EXISTS (SELECT 1 FROM r WHERE {_ON} AND r.region_pos % 7 <> 3 AND {_NEAR}) AS nr FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_ON} AND {_CI})),
k AS (SELECT CASE WHEN nt THEN 'table_adjacent' WHEN hx0 IS NULL THEN 'no_regions_on_page' WHEN cx BETWEEN hx0 AND hx1 AND cy BETWEEN hy0 AND hy1 THEN CASE WHEN nr THEN 'edge_adjacent' ELSE 'interior_gap' END WHEN cy BETWEEN hy0 AND hy1 THEN 'lateral_band' WHEN cx BETWEEN hx0 AND hx1 THEN CASE WHEN cy < hy0 THEN 'header_band' ELSE 'footer_band' END ELSE 'outside_corner' END AS class FROM o LEFT JOIN h USING (document_id, page_index))
SELECT class, count(*) AS n FROM k GROUP BY 1""")
def orphan_topology(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    r = _regions(t)
    doc, is_table = _doc(t), F.col("region_pos") % 7 == 3
    own = boxes.inside(doc, r, PAGE).select(F.col("a_token_id").alias("token_id"))
    orphans = doc.join(own, "token_id", "left_anti")
    grown = r.select(*PAGE, is_table.alias("is_table"), (F.col("x0") - 3).alias("x0"), (F.col("y0") - 3).alias("y0"), (F.col("x1") + 3).alias("x1"), (F.col("y1") + 3).alias("y1"))
    near = boxes.inside(orphans, grown, PAGE).groupBy(F.col("a_token_id").alias("token_id")).agg(F.bool_or("b_is_table").alias("nt"), F.bool_or(~F.col("b_is_table")).alias("nr"))
    hull = r.where(~is_table).groupBy(*PAGE).agg(F.min("x0").alias("h_x0"), F.min("y0").alias("h_y0"), F.max("x1").alias("h_x1"), F.max("y1").alias("h_y1"))
    o = orphans.join(near, "token_id", "left").join(hull, PAGE, "left").fillna(False, ["nt", "nr"])
    x, y = G.Box.of().centre()
    return o.groupBy(S.orphan_class(x, y, G.Box.of("h_"), F.col("nt"), F.col("nr")).alias("class")).agg(F.count("*").alias("n"))


@query(f"""{_T}, c AS (SELECT document_id, page_index, region_pos % 4 AS col, min(x0) AS lo, max(x1) AS hi FROM r GROUP BY 1, 2, 3), o AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_ON} AND {_CI})),
k AS (SELECT token_id, col, (least(x1, hi) - greatest(x0, lo)) / greatest(x1 - x0, 1e-6) AS frac FROM o JOIN c USING (document_id, page_index) WHERE x0 < hi AND x1 > lo), m AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY frac DESC, col) AS n FROM k)
SELECT token_id, col, round(frac, 6) AS frac FROM m WHERE n = 1 AND frac >= 0.3""")
def best_columns(spark: SparkSession, d: str) -> DataFrame:
    """Tokens outside all cells with the column that holds most of their width."""
    t = _tokens(spark, d)
    own = boxes.inside(_doc(t), _regions(t), PAGE).select(F.col("a_token_id").alias("token_id"))
    return S.best_columns(_doc(t).join(own, "token_id", "left_anti"), _grid_cells(t), PAGE, "token_id").select("token_id", "col", F.round("frac", 6).alias("frac"))


@query()
def synthesised_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of tables that only tokens bear out."""
    t = _tokens(spark, d)
    own = boxes.inside(_doc(t), _regions(t), PAGE).select(F.col("a_token_id").alias("token_id"))
    return S.synthesised_rows(_doc(t).join(own, "token_id", "left_anti"), _grid_cells(t), PAGE, "token_id")


@query()
def orphan_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of lines that no region holds."""
    t = _tokens(spark, d)
    own = boxes.inside(_doc(t), _regions(t), PAGE).select(F.col("a_token_id").alias("token_id"))
    return S.orphan_blocks(_doc(t).join(own, "token_id", "left_anti"), PAGE, "token_id")


def _band_sql(lo: str, hi: str, n: str) -> str:
    return f"""{n}b AS (SELECT study_id, pos, sum(CASE WHEN ph IS NOT NULL AND least(ph, {hi}) > greatest(pl, {lo}) THEN 0 ELSE 1 END) AS {n}_bands FROM (SELECT *, lag({hi}) OVER w AS ph, lag({lo}) OVER w AS pl FROM rg WINDOW w AS (PARTITION BY study_id, pos ORDER BY {lo}, {hi})) GROUP BY 1, 2),
{n}g AS (SELECT study_id, pos, v - lag(v) OVER (PARTITION BY study_id, pos ORDER BY v) AS gap FROM (SELECT DISTINCT study_id, pos, round_even({lo}, 0) AS v FROM rg)), {n}c AS (SELECT study_id, pos, CASE WHEN count(*) >= 3 THEN stddev_pop(gap) / avg(gap) END AS {n}_cv FROM {n}g GROUP BY 1, 2)"""


@query(f"""{_ST}, {_band_sql("y0", "y1", "row")}, {_band_sql("x0", "x1", "col")}, n AS (SELECT study_id, pos, count(*) AS n FROM rg GROUP BY 1, 2)
SELECT study_id, pos, n, row_bands, col_bands, round(row_cv, 6) AS row_cv, round(col_cv, 6) AS col_cv, CAST(row_bands >= 2 AS INT) + CAST(col_bands >= 2 AS INT) + CAST(n / row_bands >= 2 AS INT) + CAST(coalesce(row_cv < 0.5, false) AS INT) + CAST(n >= 6 AS INT) AS score FROM n JOIN rowb USING (study_id, pos) JOIN rowc USING (study_id, pos) JOIN colb USING (study_id, pos) JOIN colc USING (study_id, pos)""")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Bands and regularity of each page's regions, and how much they look like a table."""
    r = _boxes_of(_study_pages(spark, d), "region_bboxes", "region_pos")
    g = r.groupBy(*_KEY).agg(F.count("*").alias("n")).join(S.regularity(r, _KEY, "y0", "y1", "row"), _KEY).join(S.regularity(r, _KEY, "x0", "x1", "col"), _KEY)
    score = S.shape_score(F.col("row_bands"), F.col("col_bands"), F.col("n") / F.col("row_bands"), F.col("row_cv"), F.col("n"))
    return g.select(*_KEY, "n", "row_bands", "col_bands", F.round("row_cv", 6).alias("row_cv"), F.round("col_cv", 6).alias("col_cv"), score.alias("score"))


@query(f"""{_T}, g AS (SELECT document_id, CAST(floor(x0) AS INT) % 256 AS i, count(*) AS n FROM d WHERE x0 IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER o AS w, sum(i * n) OVER o AS s, sum(n) OVER a AS wa, sum(i * n) OVER a AS sa, coalesce(lead(i) OVER o - 1, 255) AS last FROM g WINDOW o AS (PARTITION BY document_id ORDER BY i), a AS (PARTITION BY document_id)),
v AS (SELECT document_id, last, CASE WHEN wa > w THEN CAST(w AS DOUBLE) * CAST(wa - w AS DOUBLE) * (s / CAST(w AS DOUBLE) - (sa - s) / CAST(wa - w AS DOUBLE)) * (s / CAST(w AS DOUBLE) - (sa - s) / CAST(wa - w AS DOUBLE)) END AS variance FROM w) SELECT document_id, coalesce(arg_max(last, CASE WHEN variance IS NOT NULL THEN {{'v': variance, 'l': last}} END), 128) AS threshold FROM v GROUP BY 1""")
def otsu_thresholds(spark: SparkSession, d: str) -> DataFrame:
    t = _doc(_tokens(spark, d)).where("x0 is not null")
    return S.otsu(t.withColumn("gray", F.floor("x0").cast("int") % 256), ["document_id"], "gray")


@query(f"""{_T}, p AS (SELECT document_id, page_index, unnest(range(CAST(floor(y0) AS INT), CAST(floor(y1) AS INT))) AS y, x1 - x0 AS w FROM d WHERE x0 IS NOT NULL), i AS (SELECT document_id, page_index, y, sum(w) / 1000 AS ink FROM p GROUP BY 1, 2, 3), n AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY document_id, page_index ORDER BY y) <= 3 THEN 0 ELSE 1 END AS new FROM i WHERE ink > 0.02),
l AS (SELECT *, sum(new) OVER (PARTITION BY document_id, page_index ORDER BY y) - 1 AS line FROM n) SELECT document_id, page_index, CAST(line AS BIGINT) AS line, min(y) AS y0, max(y) + 1 AS y1 FROM l GROUP BY 1, 2, 3""")
def ink_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a page by its horizontal projection, the boxes of words being its ink."""
    t = _doc(_tokens(spark, d)).where("x0 is not null and floor(y1) > floor(y0)")
    p = t.select(*PAGE, (F.col("x1") - F.col("x0")).alias("w"), F.explode(F.sequence(F.floor("y0").cast("int"), F.floor("y1").cast("int") - 1)).alias("y"))
    return S.ink_lines(p.groupBy(*PAGE, "y").agg((F.sum("w") / 1000).alias("ink")), PAGE, "y", "ink")


@query(f"""{_T} SELECT token_id, row_number() OVER (PARTITION BY document_id, page_index ORDER BY round_even(y0 / 20, 0), x0, token_id) - 1 AS place, 'p' || CAST(page_index AS VARCHAR) || '-e' || CAST(row_number() OVER (PARTITION BY document_id, page_index ORDER BY token_pos, token_id) - 1 AS VARCHAR) AS element_id FROM d""")
def coarse_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each token in coarse bands of lines, and its running id."""
    w = Window.partitionBy(*PAGE)
    n = F.row_number().over(w.orderBy("token_pos", "token_id")) - 1
    return _doc(_tokens(spark, d)).select("token_id", (F.row_number().over(w.orderBy(F.bround(F.col("y0") / 20), "x0", "token_id")) - 1).alias("place"), F.concat(F.lit("p"), "page_index", F.lit("-e"), n).alias("element_id"))


@query(f"""{_ST}, m AS (SELECT rg.study_id, rg.pos, region_pos, x0, y0, x1, y1, page_size[1] AS w, page_size[2] AS h FROM rg JOIN q USING (study_id, pos)) SELECT study_id, pos, region_pos, round((x1 - x0) * (y1 - y0) / nullif(w * h, 0), 6) AS area_fraction, round((x1 - x0) / nullif(y1 - y0, 0), 6) AS aspect_ratio, round(100 * x0 / nullif(w, 0), 3) AS left_percent, round(100 * (y1 - y0) / nullif(h, 0), 3) AS height_percent FROM m""")
def box_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Share of the page, shape and place in percent of each region; NULL where the page or box has no extent."""
    p = _study_pages(spark, d)
    m = _boxes_of(p, "region_bboxes", "region_pos").join(p.select(*_KEY, F.try_element_at("page_size", F.lit(1)).alias("w"), F.try_element_at("page_size", F.lit(2)).alias("h")), _KEY)
    b = G.Box.of()
    return m.select(*_KEY, "region_pos", F.round(G.area_fraction(b, F.col("w"), F.col("h")), 6).alias("area_fraction"), F.round(G.aspect(b), 6).alias("aspect_ratio"), F.round(G.percent(b.x0, F.col("w")), 3).alias("left_percent"), F.round(G.percent(b.y1 - b.y0, F.col("h")), 3).alias("height_percent"))


@query(f"""{_CP}, z AS (SELECT CASE WHEN b IS NULL THEN 'missing' WHEN len(b) <> 4 THEN 'size' WHEN len(list_filter(b, lambda v: v IS NULL OR NOT isfinite(v))) > 0 THEN 'not_finite' WHEN b[1] > b[3] OR b[2] > b[4] THEN 'unordered' ELSE 'ok' END AS verdict FROM b) SELECT verdict, count(*) AS n FROM z GROUP BY 1""")
def box_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the boxes of all regions, whatever their form."""
    b = _study_pages(spark, d).select(F.explode("region_bboxes").alias("b"))
    return b.groupBy(G.verdict(F.col("b")).alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""{_T}, i AS (SELECT d.document_id, d.page_index, d.token_id, max({_PAIR.format(a="d", b="e")} / ((d.x1 - d.x0) * (d.y1 - d.y0) + (e.x1 - e.x0) * (e.y1 - e.y0) - {_PAIR.format(a="d", b="e")})) AS best FROM d JOIN e ON d.document_id = e.document_id AND d.page_index = e.page_index AND {_PAIR.format(a="d", b="e")} > 0 GROUP BY 1, 2, 3) SELECT document_id, page_index, count(*) AS n, round(avg(best), 6) AS mean_best_iou FROM i GROUP BY 1, 2""")
def reading_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How well the boxes of one reading meet those of the other, over the tokens that meet any."""
    t = _tokens(spark, d)
    a, b = (t.where(F.col("source") == s).select(*PAGE, "token_id", "x0", "y0", "x1", "y1") for s in ("docling", "easyocr"))
    p = boxes.box_join(boxes.prefixed(a, "a_", PAGE), boxes.prefixed(b, "b_", PAGE), PAGE, G.intersection(G.Box.of("a_"), G.Box.of("b_")) > 0)
    best = p.groupBy(*PAGE, "a_token_id").agg(F.max(G.iou(G.Box.of("a_"), G.Box.of("b_"))).alias("best"))
    return best.groupBy(*PAGE).agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean_best_iou"))


@query(f"""{_T}, m AS (SELECT r.document_id, r.page_index, r.region_pos, count(d.token_id) AS n_tokens, coalesce(sum(length(d.text)), 0) AS n_chars FROM r LEFT JOIN d ON {_ON} AND {_CI} GROUP BY 1, 2, 3) SELECT * FROM m""")
def region_payload(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters of each region, empty ones too."""
    t = _tokens(spark, d)
    r = _regions(t)
    n = boxes.inside(_doc(t), r, PAGE).groupBy(*PAGE, F.col("b_region_pos").alias("region_pos")).agg(F.count("*").alias("n_tokens"), F.coalesce(F.sum(F.length("a_text")), F.lit(0)).alias("n_chars"))
    return r.select(*PAGE, "region_pos").join(n, [*PAGE, "region_pos"], "left").fillna(0, ["n_tokens", "n_chars"])
