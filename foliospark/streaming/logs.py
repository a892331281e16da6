"""Logs as streams: stage profiles, windows, duplicates, budgets and job states.

Each builder takes a streaming (or batch) DataFrame and returns one, so that
the same definition runs on both; `drain` runs a stream to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.session import scratch


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, glob: str | None = None) -> DataFrame:
    r = spark.readStream.format(fmt)
    if schema is None and fmt == "parquet":
        r = r.schema(spark.read.parquet(path).schema)
    elif schema is not None:
        r = r.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def drain(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and return its result as a table of the shared folder.

    Every micro-batch is kept under its number, so that a batch run twice
    replaces itself. In update mode the newest row of each key counts, in
    complete mode the last batch.
    """
    spark = df.sparkSession
    base = scratch(spark, "stream")
    if mode == "append":
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", base + "/state").trigger(availableNow=True).start(base + "/out").awaitTermination()
        return spark.read.schema(df.schema).parquet(base + "/out")
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys whose newest rows count")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/_batch_no={n}")

    # written once before, so that a stream without data has an empty table
    spark.createDataFrame([], df.schema).write.parquet(f"{base}/out/_batch_no=-1")
    df.writeStream.outputMode(mode).option("checkpointLocation", base + "/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("_batch_no", LongType())])).option("basePath", base + "/out").parquet(f"{base}/out/_batch_no=*")
    if mode == "complete":
        last = rows.agg(F.max("_batch_no").alias("_last"))
        return rows.join(F.broadcast(last), F.col("_batch_no") == F.col("_last")).drop("_batch_no", "_last")  # one row
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), "_batch_no").alias("_v"))
    return newest.select(*(c if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns))


def profile(events: DataFrame) -> DataFrame:
    """Count, failures and runtime per stage."""
    return events.groupBy("stage").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.min("seconds").alias("fastest"), F.max("seconds").alias("slowest"))


def windows(events: DataFrame, ts: str, length: str, slide: str | None, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide or length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("session_start"), "n")


def distinct(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def budget(events: DataFrame, key: str, amount: str, most: float) -> DataFrame:
    """Rows of each key, and whether a running total has passed the budget by then."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        n = state.get[1] if state.exists else 0
        for pdf in batches:
            total += float(pdf[amount].sum())
            n += len(pdf)
        state.update((total, n))
        yield pd.DataFrame({key: [k[0]], "used": [total], "n": [n], "exceeded": [total > most]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, used double, n bigint, exceeded boolean", "total double, n bigint", "update", GroupStateTimeout.NoTimeout)
