"""Evidence from acquisition to output: identities, losses, truth, lineage, and equality of populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import comparable
from foliospark.session import checkpoint


def fingerprint(*parts: Column) -> Column:
    """Identity of an observation by what it holds: NULL and the empty text differ, and so do 'ab','c' and 'a','bc'."""
    text = F.concat_ws(",", *(F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts))
    return F.concat(F.lit("obs-"), F.left(F.sha2(text, 256), F.lit(20)))


def duplicate_rank(payload: list[str], order: list[str]) -> Column:
    """0 for the first of equal observations, 1 for the next."""
    return F.row_number().over(Window.partitionBy(*payload).orderBy(*order)) - 1


def loss_boundary(acquired: Column, unmatched: Column, normalised: Column, exact: Column, serialised: Column, conflict: Column) -> Column:
    """Where an observation is first seen to be gone."""
    return (
        F.when(~acquired, "acquisition").when(unmatched, "reconciliation").when(~normalised & conflict, "ownership")
        .when(~normalised, "canonical_projection").when(~exact, "normalization").when(~serialised, "serialization").otherwise("preserved")
    )


def truth_classes(text: Column, truth: Column, baseline: Column, owned: Column, traced: Column, sound: Column) -> dict[str, Column]:
    """What a candidate adds: correct if it equals a true cell, a duplicate if the baseline holds it as a phrase; texts are compared without case and extra space."""
    value = F.coalesce(comparable(text), F.lit(""))
    bears = value != ""
    correct = bears & F.coalesce(F.exists(truth, lambda t: comparable(t) == value), F.lit(False))
    padded = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    duplicate = bears & F.coalesce(F.exists(baseline, lambda b: F.contains(padded(comparable(b)), padded(value))), F.lit(False))
    novel = correct & owned & traced & ~duplicate
    return {"text_bearing": bears, "correct": correct, "duplicate_baseline": duplicate, "novel": novel, "structural_only": sound & ~novel}


def text_sets(candidate: DataFrame, baseline: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct comparable texts per group that only the candidate, both, or only the baseline have."""
    own = lambda df, name: df.select(*keys, comparable(F.col(text)).alias("t")).where("t <> ''").distinct().withColumn(name, F.lit(1))
    j = own(candidate, "c").join(own(baseline, "b"), [*keys, "t"], "full")
    return j.groupBy(*keys).agg(F.count_if(F.col("b").isNull()).alias("n_novel"), F.count_if(F.col("b").isNotNull() & F.col("c").isNotNull()).alias("n_duplicate"), F.count_if(F.col("c").isNull()).alias("n_lost"))


def accounting(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: captured observations by disposition, claims by several owners, and whether the sum is right. df has disposition and n_claims."""
    of = lambda d: F.count_if(F.col("disposition") == d)
    g = observations.groupBy(*keys).agg(F.count("*").alias("captured"), of("ACCEPTED").alias("accepted"), of("UNRESOLVED").alias("unresolved"), of("EXCLUDED").alias("excluded"), F.count_if((F.col("disposition") == "UNRESOLVED") & (F.col("n_claims") > 1)).alias("misowned"))
    return g.withColumn("balanced", F.col("captured") == F.col("accepted") + F.col("unresolved") + F.col("excluded"))


def dangling(children: DataFrame, parent: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is named but nowhere known."""
    return children.where(F.col(parent).isNotNull()).join(known.select(F.col(key).alias(parent)).distinct(), parent, "left_anti")


def lineage(edges: DataFrame, most: int = 40) -> DataFrame:
    """id, root, depth: the oldest ancestor of each row and how far it is, by doubling the reach of each pointer.

    edges has id and parent (NULL for a root, one parent at most). The number of
    joins is the logarithm of the longest chain; a chain that runs in a circle or
    leads to an unknown row ends with root NULL.
    """
    now = checkpoint(edges.select("id", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"), F.when(F.col("parent").isNull(), 0).alias("depth"), F.lit(1).cast("bigint").alias("step")))
    left = None
    for _ in range(most):
        up = now.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("step").alias("step2"))
        j = now.join(up, "at", "left")
        ends = F.col("root").isNull() & F.col("root2").isNotNull()
        nxt = j.select("id", F.when(F.col("root").isNull() & F.col("root2").isNull(), F.col("at2")).alias("at"), F.when(ends, F.col("root2")).otherwise(F.col("root")).alias("root"), F.when(ends, F.col("depth2") + F.col("step")).otherwise(F.col("depth")).alias("depth"), (F.col("step") + F.coalesce("step2", F.lit(0))).alias("step"))
        now = checkpoint(nxt)
        still = now.where("root is null and at is not null").count()
        if still in (0, left):  # where none came to its root, what is left runs in circles
            break
        left = still
    return now.select("id", "root", F.col("depth").cast("bigint").alias("depth"))


def same_population(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two sides has, and whether there are none."""
    j = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    g = j.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))
    return g.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def repeated_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def coverage(expected: DataFrame, attempted: DataFrame, keys: list[str], place: str) -> DataFrame:
    """One row: expected and attempted items, missing, unexpected and repeated ones, and whether the order agrees.

    place numbers the items of each side; the order agrees where common items stand in the same sequence.
    """
    first = lambda df, name: df.groupBy(*keys).agg(F.min(place).alias(name), F.count("*").alias("n_" + name))
    j = first(expected, "e").join(first(attempted, "a"), keys, "full")
    # common items in the order of one side never step back on the other: looked at in blocks, then over the blocks
    both = j.where("e is not null and a is not null").withColumn("block", F.floor(F.col("e") / 4096))
    inside = both.withColumn("p", F.lag("a").over(Window.partitionBy("block").orderBy("e"))).agg(F.count_if(F.col("p") > F.col("a")).alias("n"))
    ends = both.groupBy("block").agg(F.min_by("a", "e").alias("first"), F.max_by("a", "e").alias("last"))
    across = ends.withColumn("p", F.lag("last").over(Window.orderBy("block"))).agg(F.count_if(F.col("p") > F.col("first")).alias("n"))  # one row a block
    descents = inside.unionByName(across).agg(F.sum("n").alias("n_descents"))
    g = j.agg(F.count("e").alias("n_expected"), F.count("a").alias("n_attempted"), F.count_if(F.col("a").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_unexpected"), F.count_if(F.col("n_a") > 1).alias("n_repeated"))
    return g.join(F.broadcast(descents)).withColumn("in_order", F.coalesce(F.col("n_descents") == 0, F.lit(True))).drop("n_descents")  # one row each
