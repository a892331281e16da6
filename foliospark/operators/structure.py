"""Structure of tables and layouts: quality of extracted tables, checks of grids, matches of regions, coverage.

All of it is joins on a grid of tiles, grouped counts and windows of one page;
only rules that consume their candidates one by one run in Python per page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import Box, containment, intersection, iou
from foliospark.operators.boxes import box_join, prefixed
from foliospark.operators.sequences import bands_of, clusters_of, per_page

INSIDE = 0.6  # share of a run that its cell holds at least
TOUCHES = 0.05  # share from which a run touches a cell
SIZE_OFF = 0.08  # how far a size is off the row's, as a share
SHOWN = 6  # affected cells that a warning names
REGION_TILE = 512.0  # regions and tables are a few hundred wide


def crossing_runs(runs: DataFrame, cells: DataFrame, keys: list[str], run: str, cell: list[str]) -> DataFrame:
    """keys, run and touched cells of runs that lie in several cells and mostly in none."""
    pairs = box_join(prefixed(runs, "a_", keys), prefixed(cells, "b_", keys), keys).withColumn("frac", containment(Box.of("a_"), Box.of("b_"))).where(F.col("frac") > TOUCHES)
    g = pairs.groupBy(*keys, F.col(f"a_{run}").alias(run)).agg(F.count("*").alias("n"), F.max("frac").alias("most"), F.collect_set(F.struct(*(F.col(f"b_{c}").alias(c) for c in cell))).alias("cells"))
    return g.where((F.col("n") > 1) & (F.col("most") < INSIDE)).drop("n", "most")


def dominant(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The most frequent value of each group, the least of ties, and the size of the group."""
    n = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("_n", (-F.col(value)).alias("v"))).alias(name), F.sum("_n").alias("_size"))


def style_outliers(runs: DataFrame, keys: list[str], row: str, size: str, color: str, least: int = 3) -> DataFrame:
    """Runs whose size and colour both differ from those dominant in their row; rows of fewer runs say nothing."""
    by = [*keys, row]
    j = runs.join(dominant(runs, by, size, "row_size"), by).join(dominant(runs, by, color, "row_color").drop("_size"), by)
    off = (F.abs(F.col(size) - F.col("row_size")) / F.col("row_size") > SIZE_OFF) & (F.col(color) != F.col("row_color"))
    return j.where((F.col("_size") >= least) & (F.col("row_size") > 0) & off).drop("_size", "row_size", "row_color")


def mixed_cells(runs: DataFrame, keys: list[str], cell: list[str], size: str, color: str) -> DataFrame:
    """Cells that hold runs of more than one style."""
    return runs.groupBy(*keys, *cell).agg(F.countDistinct(F.bround(size, 1), F.col(color)).alias("n_styles")).where("n_styles > 1")


def table_quality(runs: DataFrame, cells: DataFrame, keys: list[str], run: str, cell: list[str], size: str, color: str) -> DataFrame:
    """Per table: crossing runs, style outliers, mixed cells, severity, and the affected cells as a warning names them.

    runs have a box, their size and colour and the cell they were put in, cells a box. A table without runs is trusted.
    """
    crossing = crossing_runs(runs, cells, keys, run, cell)
    placed = runs.where(F.col(cell[0]).isNotNull())
    odd, mixed = style_outliers(placed, keys, cell[0], size, color), mixed_cells(placed, keys, cell, size, color)
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    bad = crossing.select(*keys, F.explode("cells").alias("c")).select(*keys, *(F.col(f"c.{c}").alias(c) for c in cell)).unionByName(odd.select(*keys, *cell)).unionByName(mixed.select(*keys, *cell)).distinct()
    bad = bad.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cell))).alias("bad"))
    out = cells.select(*keys).distinct()
    for df in (n(crossing, "n_crossing"), n(odd, "n_outliers"), n(mixed, "n_mixed"), bad):
        out = out.join(df, keys, "left")
    out = out.fillna(0, ["n_crossing", "n_outliers", "n_mixed"])
    severity = F.when(F.col("n_mixed") > 0, "high").when((F.col("n_crossing") > 0) | (F.col("n_outliers") > 0), "medium").otherwise("none")
    named = F.array_join(F.transform(F.slice("bad", 1, SHOWN), lambda c: F.concat(F.lit("r"), c[cell[0]], F.lit("c"), c[cell[1]])), ", ")
    more = F.when(F.size("bad") > SHOWN, F.format_string(" (+%d more)", F.size("bad") - SHOWN)).otherwise("")
    return out.select(*keys, "n_crossing", "n_outliers", "n_mixed", severity.alias("severity"), F.coalesce(F.concat(named, more), F.lit("")).alias("affected"))


CHECKS = ("coords_in_declared_range", "no_duplicate_coordinates", "rows_contiguous", "cols_contiguous", "row_order_matches_geometry", "col_order_matches_geometry", "rows_vertically_coherent", "cols_horizontally_coherent", "all_cell_bboxes_valid", "cells_within_table_bbox")


def _axis(cells: DataFrame, keys: list[str], axis: str, lo: str, hi: str) -> DataFrame:
    """Per table: do rows (columns) share a band, and do they follow each other as their first boxes do?"""
    g = cells.where("_ok").groupBy(*keys, axis).agg(F.count("*").alias("n"), F.max(lo).alias("lo"), F.min(hi).alias("hi"), F.min(lo).alias("first"))
    before = F.lag("first").over(Window.partitionBy(*keys).orderBy(axis))
    g = g.withColumn("in_order", F.coalesce(before <= F.col("first"), F.lit(True)))
    return g.groupBy(*keys).agg(F.every((F.col("n") < 2) | (F.col("lo") < F.col("hi"))).alias(f"{axis}_coherent"), F.every("in_order").alias(f"{axis}_order"))


def structural_checks(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Ten checks per table, whether all hold, and the names of those that fail.

    cells have row, col and a box, tables n_rows, n_cols and a box; a table without cells passes what speaks of cells.
    """
    ok = F.coalesce(F.col("x0").isNotNull() & F.col("y0").isNotNull() & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")), F.lit(False))
    c = cells.withColumn("_ok", ok)
    t = tables.select(*keys, "n_rows", "n_cols", *(F.col(b).alias(f"t_{b}") for b in ("x0", "y0", "x1", "y1")))
    j = c.join(t, keys)
    inside = (F.col("x0") >= F.col("t_x0")) & (F.col("y0") >= F.col("t_y0")) & (F.col("x1") <= F.col("t_x1")) & (F.col("y1") <= F.col("t_y1"))
    within = F.col("row").between(0, F.col("n_rows") - 1) & F.col("col").between(0, F.col("n_cols") - 1)
    run = lambda x: F.countDistinct(x) == F.max(x) - F.min(x) + 1
    g = j.groupBy(*keys).agg(
        F.every(F.coalesce(within, F.lit(False))).alias(CHECKS[0]), (F.count("*") == F.countDistinct("row", "col")).alias(CHECKS[1]),
        (run("row") & (F.min("row") == 0)).alias(CHECKS[2]), (run("col") & (F.min("col") == 0)).alias(CHECKS[3]),
        F.every("_ok").alias(CHECKS[8]), F.every(F.when(F.col("_ok") & F.col("t_x0").isNotNull(), inside).otherwise(True)).alias(CHECKS[9]), F.count("*").alias("n_cells"),
    )
    rows = _axis(c, keys, "row", "y0", "y1").select(*keys, F.col("row_order").alias(CHECKS[4]), F.col("row_coherent").alias(CHECKS[6]))
    cols = _axis(c, keys, "col", "x0", "x1").select(*keys, F.col("col_order").alias(CHECKS[5]), F.col("col_coherent").alias(CHECKS[7]))
    out = t.select(*keys).join(g, keys, "left").join(rows, keys, "left").join(cols, keys, "left").fillna(0, ["n_cells"])
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(True)) for c in CHECKS})
    failed = F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c)) for c in CHECKS)))
    return out.select(*keys, "n_cells", failed.alias("failed_checks"), (F.size(failed) == 0).alias("structurally_valid"))


def union_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Exact area of the union of each group's boxes: between two neighbouring x edges the covered heights are merged."""
    b = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(*keys, "x0", "y0", "x1", "y1")
    edges = b.select(*keys, F.explode(F.array("x0", "x1")).alias("xa")).distinct()
    strips = edges.withColumn("xb", F.lead("xa").over(Window.partitionBy(*keys).orderBy("xa"))).where("xb is not null")
    # a group has a few boxes (of one page), so its strips are few too
    s = strips.join(b, keys).where((F.col("x0") <= F.col("xa")) & (F.col("x1") >= F.col("xb")))
    reach = F.max("y1").over(Window.partitionBy(*keys, "xa").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("height", F.greatest(F.lit(0.0), F.col("y1") - F.greatest("y0", F.coalesce(reach, F.col("y0")))))
    return s.groupBy(*keys).agg(F.sum(F.col("height") * (F.col("xb") - F.col("xa"))).alias("area"))


def union_of(boxes: Column) -> Column:
    """Exact area of the union of an array of boxes, as `union_area` has it of a group's rows; 0 without boxes."""
    b = F.filter(boxes, lambda v: (v["x1"] > v["x0"]) & (v["y1"] > v["y0"]))
    xs = F.array_sort(F.array_distinct(F.concat(F.transform(b, lambda v: v["x0"]), F.transform(b, lambda v: v["x1"]))))
    strips = F.zip_with(xs, F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda xa, xb: F.struct(xa.alias("xa"), xb.alias("xb")))
    none = F.struct(F.lit(0.0).alias("height"), F.lit(None).cast("double").alias("reach"))

    def covered(s: Column) -> Column:
        spans = F.array_sort(F.transform(F.filter(b, lambda v: (v["x0"] <= s["xa"]) & (v["x1"] >= s["xb"])), lambda v: F.struct(v["y0"].alias("y0"), v["y1"].alias("y1"))))
        more = lambda a, v: F.greatest(F.lit(0.0), v["y1"] - F.greatest(v["y0"], F.coalesce(a["reach"], v["y0"])))
        return F.aggregate(spans, none, lambda a, v: F.struct((a["height"] + more(a, v)).alias("height"), F.greatest(a["reach"], v["y1"]).alias("reach")), lambda a: a["height"])

    return F.aggregate(F.filter(strips, lambda s: s["xb"].isNotNull()), F.lit(0.0), lambda a, s: a + covered(s) * (s["xb"] - s["xa"]))


def region_candidates(truth: DataFrame, regions: DataFrame, keys: list[str], truth_id: str, region_id: str) -> DataFrame:
    """Regions that touch each true table, best first: iou, share of the truth and share of the region.

    Spark judges the size of the exploded tiles by that of the file, far too low, and would broadcast
    them all through the driver: the sides are merged at any size.
    """
    a, b = Box.of("a_"), Box.of("b_")
    p = box_join(prefixed(truth, "a_", keys).hint("merge"), prefixed(regions, "b_", keys).hint("merge"), keys, intersection(Box.of("a_"), Box.of("b_")) > 0, REGION_TILE)
    p = p.withColumn("iou", iou(a, b)).withColumn("of_truth", containment(a, b)).withColumn("of_region", containment(b, a))
    place = F.row_number().over(Window.partitionBy(*keys, f"a_{truth_id}").orderBy(F.desc("of_truth"), f"b_{region_id}"))
    return p.withColumn("place", place)


def region_matches(truth: DataFrame, regions: DataFrame, keys: list[str], truth_id: str, region_id: str) -> DataFrame:
    """Verdict of each true table by its two best regions and by what its regions cover together."""
    p = region_candidates(truth, regions, keys, truth_id, region_id)
    clipped = F.struct(F.greatest("a_x0", "b_x0").alias("x0"), F.greatest("a_y0", "b_y0").alias("y0"), F.least("a_x1", "b_x1").alias("x1"), F.least("a_y1", "b_y1").alias("y1"))
    by = [*keys, truth_id]
    best = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    # one pass over the pairs: a table's parts stay with it instead of meeting its strips in a second join
    g = p.groupBy(*keys, F.col(f"a_{truth_id}").alias(truth_id)).agg(best(1, "iou").alias("iou"), best(1, "of_truth").alias("first"), best(2, "of_truth").alias("second"), best(1, f"b_{region_id}").alias("region"), F.collect_list(F.when(F.col("of_truth") >= 0.2, clipped)).alias("parts"))
    j = truth.select(*by, Box.of().area().alias("truth_area")).join(g.hint("merge"), by, "left")
    scattered = (F.size("parts") >= 2) & (F.col("iou") < 0.5)
    share = F.when(scattered, union_of(F.col("parts")) / F.col("truth_area"))
    verdict = (
        F.when(F.col("first").isNull(), "NO_REGION").when(F.coalesce(share >= 0.6, F.lit(False)), "MULTIPLE_MATCH")
        .when(F.col("iou") >= 0.75, "EXACT_MATCH").when(F.col("iou") >= 0.5, "GOOD_MATCH")
        .when((F.col("second") >= 0.15) & (F.col("first") < 0.5) & (F.col("first") - F.col("second") <= 0.15 * F.col("first")), "AMBIGUOUS")
        .when(F.col("first") >= 0.1, "PARTIAL_MATCH").otherwise("NO_REGION")
    )
    matched = F.when(F.col("verdict").isin("EXACT_MATCH", "GOOD_MATCH", "PARTIAL_MATCH"), F.col("region"))
    users = F.count("region").over(Window.partitionBy(*keys, "region"))
    return j.select(*by, verdict.alias("verdict"), "region").withColumn("region", matched).withColumn("shared", F.col("region").isNotNull() & (users > 1))


def overlap_class(a_label: Column, b_label: Column, a: Box, b: Box) -> Column:
    """What the overlap of two regions is; one holding the other is tested first."""
    holds = lambda o, i: (o.x0 <= i.x0) & (o.y0 <= i.y0) & (o.x1 >= i.x1) & (o.y1 >= i.y1)
    outer = F.when(holds(a, b), a_label).when(holds(b, a), b_label)
    either = lambda x: (a_label == x) | (b_label == x)
    share = iou(a, b)
    return (
        F.when(outer == "picture", "nested_in_picture_labelled_block").when(holds(a, b) | holds(b, a), "legitimate_nesting")
        .when(either("table") & (a_label != b_label), "table_text_overlap").when(either("picture"), "stamp_occlusion")
        .when((a_label == b_label) & (share >= 0.5), "duplicate_region").when(share < 0.1, "boundary_ambiguity").otherwise("duplicate_region")
    )


def orphan_class(x: Column, y: Column, hull: Box, near_table: Column, near_region: Column) -> Column:
    """Where a token that no region holds lies, seen from the hull of the page's regions."""
    in_x, in_y = x.between(hull.x0, hull.x1), y.between(hull.y0, hull.y1)
    return (
        F.when(near_table, "table_adjacent").when(hull.x0.isNull(), "no_regions_on_page").when(in_x & in_y & near_region, "edge_adjacent").when(in_x & in_y, "interior_gap")
        .when(in_y, "lateral_band").when(in_x & (y < hull.y0), "header_band").when(in_x, "footer_band").otherwise("outside_corner")
    )


def best_columns(tokens: DataFrame, cells: DataFrame, keys: list[str], token_id: str, least: float = 0.3) -> DataFrame:
    """Each token with the column whose x range holds most of its width, at least a share; the first column of ties."""
    cols = cells.where("x0 is not null").groupBy(*keys, "col").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    j = tokens.join(cols, keys).where((F.col("x0") < F.col("hi")) & (F.col("x1") > F.col("lo")))  # a table has few columns
    frac = (F.least("x1", "hi") - F.greatest("x0", "lo")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6))
    j = j.withColumn("frac", frac)
    n = F.row_number().over(Window.partitionBy(*keys, token_id).orderBy(F.desc("frac"), "col"))
    return j.withColumn("_n", n).where((F.col("_n") == 1) & (F.col("frac") >= least)).drop("_n")


def synthesised_rows(tokens: DataFrame, cells: DataFrame, keys: list[str], token_id: str, corroborating: int = 2) -> DataFrame:
    """keys, row, col, text, y0, y1 of rows that no cell has but tokens in two columns or more bear out.

    Tokens whose heights overlap make a row; rows are numbered behind the table's own, in order of their tops.
    """
    best = best_columns(tokens, cells, keys, token_id).select(*keys, token_id, "col", "text", "x0", "y0", "y1")
    last = cells.groupBy(*keys).agg(F.max("row").alias("last_row"))
    kinds = dict(best.dtypes)

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(band=clusters_of(list(zip(pdf.y0, pdf.y1))))
        out, row = [], int(pdf.last_row.iloc[0]) + 1
        for _, band in pdf.groupby("band", sort=True):
            if band.col.nunique() >= corroborating:
                for col, part in band.sort_values(["x0", token_id]).groupby("col", sort=True):
                    out.append((row, int(col), " ".join(t for t in part.text if t), band.y0.min(), band.y1.max()))
                row += 1
        got = pd.DataFrame(out, columns=["row", "col", "text", "y0", "y1"])
        for k in reversed(keys):
            got.insert(0, k, pdf[k].iloc[0])
        return got

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row int, col int, text string, y0 double, y1 double"
    return per_page(best.join(last, keys), keys, schema, rows)


def orphan_blocks(tokens: DataFrame, keys: list[str], token_id: str, gap: float = 1.5) -> DataFrame:
    """keys, token, block: lines of tokens, joined while they overlap in x and are not further apart than the taller one times a ratio."""
    kinds = dict(tokens.dtypes)

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x0", "y0", "x1", "y1"]).reset_index(drop=True)
        pdf["line"] = bands_of(list(pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)))
        lines = pdf.groupby("line").agg(x0=("x0", "min"), y0=("y0", "min"), x1=("x1", "max"), y1=("y1", "max")).sort_values(["y0", "x0"])
        block, number, last = -1, {}, None
        for line, b in lines.iterrows():
            near = last is not None and min(last.x1, b.x1) > max(last.x0, b.x0) and b.y0 - last.y1 <= gap * max(last.y1 - last.y0, b.y1 - b.y0, 1.0)
            block += not near
            number[line], last = block, b
        return pdf[[*keys, token_id]].assign(block=pdf["line"].map(number).astype("int32") if len(pdf) else pd.Series(dtype="int32"))

    return per_page(tokens, keys, ", ".join(f"{c} {kinds[c]}" for c in [*keys, token_id]) + ", block int", blocks)


def greedy_tables(regions: DataFrame, tables: DataFrame, keys: list[str], region_id: str, table_id: str, least: float = 0.1) -> DataFrame:
    """keys, region, table: regions in their order take the table that overlaps them most, each table once."""
    p = box_join(prefixed(regions, "a_", keys), prefixed(tables, "b_", keys), keys).withColumn("iou", iou(Box.of("a_"), Box.of("b_"))).where(F.col("iou") > least)
    p = p.select(*keys, F.col(f"a_{region_id}").alias("region"), F.col(f"b_{table_id}").alias("table"), "iou")
    kinds = dict(p.dtypes)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for region, part in pdf.sort_values(["region", "iou", "table"], ascending=[True, False, True]).groupby("region", sort=True):
            free = [t for t in part.table if t not in used]
            if free:
                used.add(free[0])
                out.append((region, free[0]))
        got = pd.DataFrame(out, columns=["region", "table"])
        for k in reversed(keys):
            got.insert(0, k, pdf[k].iloc[0])
        return got

    return per_page(p, keys, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "region", "table"]), take)


def regularity(df: DataFrame, keys: list[str], lo: str, hi: str, name: str) -> DataFrame:
    """Bands of boxes along an axis (a box that overlaps the one before stays in its band), and the variation of distances between distinct starts; NULL below three."""
    before = F.lag(hi).over(Window.partitionBy(*keys).orderBy(lo, hi))
    overlaps = F.least(before, F.col(hi)) > F.greatest(F.lag(lo).over(Window.partitionBy(*keys).orderBy(lo, hi)), F.col(lo))
    bands = df.withColumn("_new", F.when(before.isNotNull() & overlaps, 0).otherwise(1)).groupBy(*keys).agg(F.sum("_new").alias(f"{name}_bands"))
    starts = df.select(*keys, F.bround(F.col(lo), 0).alias("v")).distinct()
    gaps = starts.withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy(*keys).orderBy("v")))
    cv = gaps.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.try_divide(F.stddev_pop("gap"), F.avg("gap"))).alias(f"{name}_cv"))
    return bands.join(cv, keys)


def shape_score(row_bands: Column, col_bands: Column, per_band: Column, row_cv: Column, n: Column) -> Column:
    """How many of five marks of a table a group of boxes has."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in (row_bands >= 2, col_bands >= 2, per_band >= 2, row_cv < 0.5, n >= 6)), F.lit(0))


def otsu(df: DataFrame, keys: list[str], gray: str) -> DataFrame:
    """The threshold between 0 and 255 that separates the values of each group best; the last of ties, 128 without two classes."""
    h = df.where(F.col(gray).isNotNull()).groupBy(*keys, F.col(gray).cast("int").alias("i")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)  # at most 256 rows a group
    h = h.withColumn("w", F.sum("n").over(by.orderBy("i"))).withColumn("s", F.sum(F.col("i") * F.col("n")).over(by.orderBy("i"))).withColumn("w_all", F.sum("n").over(by)).withColumn("s_all", F.sum(F.col("i") * F.col("n")).over(by))
    # values between two that occur separate alike, so the last of ties is the one before the next that occurs
    h = h.withColumn("last", F.coalesce(F.lead("i").over(by.orderBy("i")) - 1, F.lit(255)))
    w, rest = F.col("w").cast("double"), (F.col("w_all") - F.col("w")).cast("double")
    mean, other = F.col("s") / w, (F.col("s_all") - F.col("s")) / rest
    h = h.withColumn("variance", F.when(rest > 0, w * rest * (mean - other) * (mean - other)))
    return h.groupBy(*keys).agg(F.coalesce(F.max_by("last", F.when(F.col("variance").isNotNull(), F.struct("variance", "last"))), F.lit(128)).alias("threshold"))


def ink_lines(profile: DataFrame, keys: list[str], y: str, ink: str, dark: float = 0.02, gap: int = 3) -> DataFrame:
    """keys, line, y0, y1: runs of dark rows of a projection profile, apart by at least a gap of light ones."""
    rows = profile.where(F.col(ink) > dark)
    order = Window.partitionBy(*keys).orderBy(y)
    new = F.coalesce(F.col(y) - F.lag(y).over(order) > gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_new", new).withColumn("line", F.sum("_new").over(order) - 1)
    return rows.groupBy(*keys, "line").agg(F.min(y).alias("y0"), (F.max(y) + 1).alias("y1"))
