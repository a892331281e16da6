"""Crawling over a replay table instead of a network: admission, breadth-first levels, redirects, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import checkpoint


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Upsert by reading: the latest version of each key wins."""
    return first_per(df, keys, [F.desc(c) for c in order])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, keys, "left_anti").dropDuplicates(keys))


def admission(scheme: Column, same_origin: Column, allowed: Column, denied: Column, depth: Column, most: int, seen: Column) -> Column:
    """accepted, or the first rule that rejects a discovered address."""
    return (
        F.when(~scheme.isin("http", "https"), "unsupported_scheme").when(~same_origin, "cross_origin").when(~allowed, "out_of_scope")
        .when(denied, "denied_pattern").when(depth > most, "depth_limit").when(seen, "duplicate").otherwise("accepted")
    )


def levels(seeds: DataFrame, edges: DataFrame, max_depth: int, page_limit: int | None = None) -> DataFrame:
    """url, depth of all that is reached: one join per level, the frontier cut from its lineage.

    The driver only learns whether a level is empty; max_depth bounds the loop.
    A page limit cuts a level in the order of addresses.
    """
    frontier = checkpoint(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    seen = frontier  # the union of all levels, each kept once
    for depth in range(1, max_depth + 1):
        nxt = frontier.join(edges, frontier.url == edges.src).select(edges.dst.alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth))
        if page_limit is not None:
            left = page_limit - seen.count()
            nxt = nxt.orderBy("url").limit(max(0, left))
        frontier = checkpoint(nxt)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def redirects(start: DataFrame, hops: DataFrame, most: int = 10) -> DataFrame:
    """Follow redirects a bounded number of times: final address, hops and outcome (ok, loop, limit, downgrade).

    Only open chains go into the next join, cut from their lineage; the loop
    ends with the last of them.
    """
    h = hops.select(F.col("src").alias("at"), "dst")
    now = start.select("url", F.col("url").alias("at"), F.array("url").alias("path"))
    done: DataFrame | None = None
    for _ in range(most + 1):
        j = now.join(h, "at", "left")
        ends = (
            F.when(F.col("dst").isNull(), "ok").when(F.array_contains("path", F.col("dst")), "loop")
            .when(F.col("at").startswith("https:") & F.col("dst").startswith("http:"), "downgrade").when(F.size("path") > most, "limit")
        )
        j = checkpoint(j.withColumn("outcome", ends))
        closed = j.where("outcome is not null").select("url", F.col("at").alias("final"), (F.size("path") - 1).alias("hops"), "outcome")
        done = closed if done is None else done.unionByName(closed)
        now = j.where("outcome is null").select("url", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        if now.isEmpty():
            break
    return done


def publish(blobs: DataFrame, hash_col: str, order: str, cap: int | None = None) -> DataFrame:
    """First copy of each content; with a cap, only so many distinct contents in order of first sight."""
    first = first_per(blobs, [hash_col], [order])
    return first if cap is None else first.orderBy(order).limit(cap)
