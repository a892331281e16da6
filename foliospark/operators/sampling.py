"""Deterministic samples: evenly spaced, every n-th, by hash rank, and by marginal strata."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_rank(key: Column, seed: str | None = None) -> Column:
    return F.sha2(key if seed is None else F.concat(F.lit(f"{seed}:"), key), 256)


def evenly(df: DataFrame, group: list[str], index: str, n: int) -> DataFrame:
    """Of each group the rows whose index is int(i * size / n) for i below n; all of a small group."""
    size = F.count("*").over(Window.partitionBy(*group))
    df = df.withColumn("_s", size)
    step = F.col("_s") / F.lit(n)
    i = F.ceil(F.col(index) / step)
    return df.where((F.col("_s") <= n) | ((i < n) & (F.floor(i * step) == F.col(index)))).drop("_s")


def every(df: DataFrame, index: str, step: int, offset: int = 0) -> DataFrame:
    return df.where(F.pmod(F.col(index) - offset, F.lit(step)) == 0)


def per_stratum(df: DataFrame, strata: list[str], key: Column, k: int, seed: str | None = None) -> DataFrame:
    """The k lowest hash ranks of each stratum."""
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(stable_rank(key, seed)))
    return df.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def marginal(candidates: pd.DataFrame, labels: list[str], n: int, wanted: dict[tuple[str, str], int], seed: str = "42") -> pd.DataFrame:
    """n rows, one by one the one whose labels lack most of what is wanted of them, as a share; hash rank breaks ties."""
    todo = candidates.copy()
    todo["_rank"] = [hashlib.sha256(f"{seed}:{k}".encode()).hexdigest() for k in todo["id"].astype(str)]
    have = dict.fromkeys(wanted, 0)
    picked = []
    for _ in range(min(n, len(todo))):
        lack = {k: max(0, w - have[k]) / w for k, w in wanted.items()}
        gain = sum(todo[c].map(lambda v, c=c: lack[c, v]) for c in labels)
        best = todo.loc[gain >= gain.max() - 1e-12].sort_values("_rank").index[0]
        picked.append(best)
        for c in labels:
            have[c, todo.at[best, c]] += 1
        todo = todo.drop(best)
    return candidates.loc[picked]


def marginal_sample(df: DataFrame, labels: list[str], n: int, seed: str = "42") -> DataFrame:
    """A sample of n rows whose labels are as frequent as in the whole table; df has id and the labels.

    What is wanted of each label is counted over all rows. Rows of equal labels
    differ in their hash rank only, so that of each combination of labels its n
    first ranks are all that can be picked: these, at most n a combination, and
    the counts of the labels meet in one task.
    """
    total = df.agg(F.count("*").alias("_all"))
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in labels))).alias("l")).groupBy("l.label", "l.value").agg(F.count("*").alias("m"))
    goal = F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("m") / F.col("_all")).cast("int"))
    wanted = each.join(F.broadcast(total)).select("label", "value", goal.alias("want"))  # total is one row
    cand = per_stratum(df.select("id", *labels), labels, F.col("id").cast("string"), n, seed)
    rows = cand.select(F.col("id"), *labels, F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("want"))
    both = rows.unionByName(wanted, allowMissingColumns=True).withColumn("one", F.lit(1))
    kinds = dict(df.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        need = pdf[pdf.want.notna()]
        goals = {(r.label, r.value): int(r.want) for r in need.itertuples()}
        mine = pdf[pdf.want.isna()][["id", *labels]].reset_index(drop=True)
        if kinds["id"] != "string":
            mine = mine.astype({"id": "int64"})  # not a float for the rows without id
        return marginal(mine, labels, n, goals, seed) if len(mine) else mine

    return both.groupBy("one").applyInPandas(pick, ", ".join(f"{c} {kinds[c]}" for c in ("id", *labels)))
