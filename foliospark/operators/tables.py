"""Table grids: dense form, spans, checks, Markdown and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import html_escape


def cells(grids: DataFrame, key: str, grid: str = "grid") -> DataFrame:
    """key, row, col, text of every cell of nested grids; NULL rows have no cells."""
    rows = grids.select(key, F.posexplode(grid).alias("row", "_r"))
    return rows.select(key, "row", F.posexplode("_r").alias("col", "text"))


def slots(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Every slot that a span covers; spans below 1 count as 1."""
    cover = lambda at, n: F.sequence(F.col(at), F.col(at) + F.greatest(F.lit(1), F.coalesce(n, F.lit(1))) - 1)
    s = spans.withColumn("slot_row", F.explode(cover("row_at", F.col("row_span"))))
    return s.withColumn("slot_col", F.explode(cover("col_at", F.col("col_span")))).select(*keys, "row_at", "col_at", "slot_row", "slot_col")


def overlaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Slots that two spans or more cover."""
    return slots(spans, keys).groupBy(*keys, "slot_row", "slot_col").agg(F.count("*").alias("n")).where("n > 1")


def dense(cell_rows: DataFrame, keys: list[str], n_rows: Column, n_cols: Column) -> DataFrame:
    """One row per slot within the declared size; text repeats over spans, the later cell wins."""
    up = lambda at, n, most: F.sequence(F.col(at), F.least(F.col(at) + F.coalesce(F.col(n), F.lit(1)), most) - 1)
    inside = cell_rows.where((F.col("row") < n_rows) & (F.col("col") < n_cols))
    s = inside.withColumn("r", F.explode(up("row", "row_span", n_rows))).withColumn("c", F.explode(up("col", "col_span", n_cols)))
    return s.groupBy(*keys, "r", "c").agg(F.max(F.struct("pos", "text")).alias("_t")).select(*keys, "r", "c", F.col("_t.text").alias("text"))


def markdown(cell_rows: DataFrame, keys: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Pipe table of each grid, header rule after its first row."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(col, F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " | ")
    rows = cell_rows.groupBy(*keys, F.col(row).alias("_r")).agg(F.concat(F.lit("| "), line, F.lit(" |")).alias("line"), F.count("*").alias("n"))
    rows = rows.withColumn("line", F.when(F.row_number().over(Window.partitionBy(*keys).orderBy("_r")) == 1, F.concat("line", F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n").cast("int")))).otherwise(F.col("line")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def html(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """HTML table of each grid; spans become attributes, slots that no cell covers empty cells. NULL where cells overlap, as no table can say that."""
    size = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c), F.lit(1)))
    c = cell_rows.withColumn("row_span", size("row_span")).withColumn("col_span", size("col_span"))
    covered = slots(c.withColumnsRenamed({"row": "row_at", "col": "col_at"}), keys).groupBy(*keys, "slot_row", "slot_col").agg(F.count("*").alias("n"))
    shape = covered.groupBy(*keys).agg((F.max("slot_row") + 1).alias("n_rows"), (F.max("slot_col") + 1).alias("n_cols"), (F.max("n") > 1).alias("overlapping"))
    grid = shape.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    holes = grid.join(covered.select(*keys, F.col("slot_row").alias("row"), F.col("slot_col").alias("col")), [*keys, "row", "col"], "left_anti").select(*keys, "row", "col", F.lit("<td></td>").alias("td"))
    attr = lambda n, x: F.when(F.col(x) > 1, F.concat(F.lit(f' {n}="'), F.col(x).cast("string"), F.lit('"'))).otherwise("")
    td = F.concat(F.lit("<td"), attr("rowspan", "row_span"), attr("colspan", "col_span"), F.lit(">"), html_escape(F.coalesce("text", F.lit(""))), F.lit("</td>"))
    joined = lambda k, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v]), "")
    rows = c.select(*keys, "row", "col", td.alias("td")).unionByName(holes).groupBy(*keys, "row").agg(F.concat(F.lit("<tr>"), joined("col", "td"), F.lit("</tr>")).alias("tr"))
    tables = rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), joined("row", "tr"), F.lit("</table>")).alias("html"))
    return tables.join(shape, keys).select(*keys, F.when(~F.col("overlapping"), F.col("html")).alias("html"))


def written(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, form, text: Markdown where it can say the table, HTML where cells span or hold a bar or a line break."""
    hard = cell_rows.groupBy(*keys).agg(F.bool_or((F.coalesce("row_span", F.lit(1)) > 1) | (F.coalesce("col_span", F.lit(1)) > 1) | F.coalesce(F.col("text").rlike("[|\\r\\n]"), F.lit(False))).alias("hard"))
    j = hard.join(markdown(cell_rows, keys), keys).join(html(cell_rows, keys), keys)
    return j.select(*keys, F.when(F.col("hard"), "html").otherwise("markdown").alias("form"), F.when(F.col("hard"), F.col("html")).otherwise(F.col("markdown")).alias("text"))


def fill_features(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^\\s+|\\s+$", "")
    full = F.length(text) > 0
    return cell_rows.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.count_if(full).alias("n_filled"), F.avg(full.cast("int")).alias("fill_rate"), F.avg(F.when(full, F.length(text))).alias("mean_length"))


def score(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of two grids joined by position: matched, missing, extra and equal cells per grid."""
    j = truth.select(*keys, "row", "col", F.col("text").alias("want"), F.lit(1).alias("t")).join(pred.select(*keys, "row", "col", F.col("text").alias("got"), F.lit(1).alias("p")), [*keys, "row", "col"], "full")
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    return j.groupBy(*keys).agg(F.count_if(both).alias("matched"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("t").isNull()).alias("extra"), F.count_if(both & F.col("want").eqNullSafe(F.col("got"))).alias("equal"))


def multiset_overlap(truth: DataFrame, pred: DataFrame, keys: list[str], word: str) -> DataFrame:
    """Shared words counted as often as both sides have them."""
    n = lambda df, c: df.groupBy(*keys, word).agg(F.count("*").alias(c))
    j = n(truth, "a").join(n(pred, "b"), [*keys, word], "full").fillna(0, ["a", "b"])
    return j.groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("n_truth"), F.sum("b").alias("n_pred"))
