"""Sinks: nested JSON documents, Markdown, CSV, content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import csv_escape


def document_json(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """document_id, json: pages with their elements nested, in order."""
    e = elements.groupBy("document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("pos", "element_id", "type", "text"))).alias("elements"))
    p = pages.join(e, ["document_id", "page_index"], "left")
    nested = p.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_index").alias("index"), "elements"))).alias("pages"))
    return nested.select("document_id", F.to_json(F.struct("document_id", "pages")).alias("json"))


def document_markdown(elements: DataFrame) -> DataFrame:
    """document_id, markdown in reading order; elements without text are left out and counted in a closing note."""
    t = F.col("text")
    block = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), t)).when(F.col("type") == "list_item", F.concat(F.lit("- "), t))
        .when((F.col("type") == "formula") & ~(t.startswith("$$") & t.endswith("$$")), F.concat(F.lit("$$"), t, F.lit("$$"))).otherwise(t)
    )
    g = elements.groupBy("document_id").agg(F.array_sort(F.collect_list(F.when(F.coalesce(t, F.lit("")) != "", F.struct("page_index", "pos", block.alias("b"))))).alias("x"), F.count_if(F.coalesce(t, F.lit("")) == "").alias("left_out"))
    text = F.array_join(F.transform("x", lambda b: b["b"]), "\n\n")
    return g.select("document_id", F.when(F.col("left_out") > 0, F.concat(text, F.format_string("\n\n<!-- %d elements without text -->", "left_out"))).otherwise(text).alias("markdown"))


def csv_report(df: DataFrame, path: str) -> None:
    """CSV with formulas made harmless."""
    safe = [csv_escape(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", "true").csv(path)


def blobs(df: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Store each content once under its hash; returns the stored table for verification."""
    hashed = df.select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    hashed.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def broken_blobs(stored: DataFrame) -> DataFrame:
    return stored.where(F.sha2("content", 256) != F.col("sha256"))


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One aligned line per row; text to the left, numbers to the right."""
    kinds = dict(df.dtypes)
    cell = lambda c, w: (F.rpad if kinds[c] == "string" else F.lpad)(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ")
    return df.select(F.concat_ws("  ", *(cell(c, w) for c, w in widths.items())).alias("line"))
