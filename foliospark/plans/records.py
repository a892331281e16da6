"""Queries on nested records and drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import drift, nested
from foliospark.session import saved, scratch, table


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nested.emit_documents(table(spark, sf_dir, "raw_documents"))
    return docs.unionByName(nested.emit_studies(table(spark, sf_dir, "case_studies")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the flat tables, which are written from the tagged pass."""
    return nested.links(nested.flat_tables(_tagged(spark, sf_dir), scratch(spark, "p4")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.found(_links(spark, sf_dir))


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the tagged pass once, reads each flat table back with its schema, and reports rows, distinct children and children without parent."""
    rows = _links(spark, sf_dir).withColumnRenamed("tag", "kind")
    # a document may recur under another record, whose pages are not this record's
    parents = rows.select("src", "record_id", F.col("child_key").alias("parent_key")).distinct().withColumn("linked", F.lit(True))
    rows = rows.join(parents, ["src", "record_id", "parent_key"], "left")
    return rows.groupBy("kind", "src").agg(F.count("*").alias("n_rows"), F.countDistinct("record_id", "child_key").alias("n_children"), F.count_if(F.col("linked").isNull() & (F.col("kind") != "document")).alias("n_unlinked"))


def _flat(tag: str) -> Callable[[SparkSession, str], DataFrame]:
    def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.typed(_tagged(spark, sf_dir), tag)

    flat.__doc__ = f"The flat table of {tag}s with all its typed columns."
    return flat


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.edit_scripts(table(spark, sf_dir, "run_files"))


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of all feeds in one table with one column per setting."""
    runs = table(spark, sf_dir, "run_files")
    flat = saved(drift.flatten(runs), "leaves")
    return drift.unified(runs, *drift.projections(saved(drift.edit_scripts(runs, flat), "changes"), drift.file_schemas(flat)))


QUERIES = {"p4_found": p4_found, "p4_tables": p4_tables, "p5_found": p5_found, "p5_runs": p5_runs} | {f"p4_table_{tag}": _flat(tag) for tag in nested.SCHEMAS}
SQL: dict[str, str] = {}
