"""Putting better evidence in place: merged readings, accepted repairs, fallbacks of pages, and what is left where nothing is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import Box, containment
from foliospark.functions.text import word_set
from foliospark.operators.boxes import box_join, prefixed

LOW, RESOLVED = 0.4, 0.7  # least mean confidence of a repair, least similarity it must reach


def merged_text(anchors: Column, fine: Column) -> Column:
    """One text of two agreeing readings, in order of their places: all fine tokens, and the anchors that hold a word which the fine ones lack.

    Both are arrays of structs of y0, x0 and text.
    """
    heard = word_set(F.array_join(F.transform(fine, lambda t: t["text"]), " "))
    extra = F.filter(anchors, lambda t: F.size(F.array_except(word_set(t["text"]), heard)) > 0)
    place = lambda t: F.struct(t["y0"].alias("y0"), t["x0"].alias("x0"), t["text"].alias("text"))
    return F.array_join(F.transform(F.array_sort(F.concat(F.transform(fine, place), F.transform(extra, place))), lambda t: t["text"]), " ")


def fused_text(decision: Column, anchors: Column, fine: Column) -> Column:
    """What a group of two readings says: merged where they agree, both where they don't, else the one there is."""
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda t: t["text"]), " ")
    return F.when(decision == "keep_both_agree", merged_text(anchors, fine)).when((F.size(anchors) > 0) & (F.size(fine) > 0), F.concat(text(anchors), F.lit(" "), text(fine))).when(F.size(anchors) > 0, text(anchors)).otherwise(text(fine))


def chosen_attempts(attempts: DataFrame, keys: list[str], similarity: str, confidence: str, plausible: Column, order: str) -> DataFrame:
    """The best plausible attempt of each region: by similarity, then confidence, then the first."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(similarity), F.desc(F.coalesce(confidence, F.lit(0.0))), order))
    return attempts.where(plausible).withColumn("_n", n).where("_n = 1").drop("_n")


def repair_verdict(similarity: Column, confidence: Column, before: Column) -> Column:
    """replaced where the best attempt comes nearer to either reading than these are to each other, and is not unsure; else why not."""
    sure = confidence.isNull() | (confidence >= LOW)
    return F.when(similarity.isNull(), "no_candidate").when(~(similarity > F.greatest(before, F.lit(RESOLVED))), "not_nearer").when(~sure, "low_confidence").otherwise("replaced")


def page_fallback(pages: DataFrame, fallback: DataFrame, keys: list[str], suspicious: str, text: str) -> DataFrame:
    """Each page with its own text, or the fallback's where it is suspicious and the fallback has any; decision says which."""
    j = pages.join(fallback.select(*keys, F.col(text).alias("_other")), keys, "left")
    bad, has = F.coalesce(F.col(suspicious), F.lit(False)), F.coalesce(F.trim("_other") != "", F.lit(False))
    decision = F.when(~bad, "kept").when(has, "replaced").otherwise("no_fallback")
    return j.withColumn("decision", decision).withColumn(text, F.when(bad & has, F.col("_other")).otherwise(F.col(text))).drop("_other")


def outside(elements: DataFrame, tables: DataFrame, keys: list[str], element: str, share: float = 0.7) -> DataFrame:
    """Elements that do not lie mostly within any table; elements without a box stay."""
    held = box_join(prefixed(elements, "a_", keys), prefixed(tables, "b_", keys), keys, containment(Box.of("a_"), Box.of("b_")) >= share)
    return elements.join(held.select(*keys, F.col(f"a_{element}").alias(element)).distinct(), [*keys, element], "left_anti")


def unmatched(extra: DataFrame, primary: DataFrame, keys: list[str], pairs: DataFrame, extra_id: str, primary_id: str, cells: str) -> DataFrame:
    """Primary items, and the extra ones that no pair uses and that are not empty, numbered behind: keys, origin, id, place.

    pairs has keys, region (the primary) and table (the extra item).
    """
    left = extra.where(F.coalesce(F.col(cells), F.lit(0)) > 0).join(pairs.select(*keys, F.col("table").alias(extra_id)), [*keys, extra_id], "left_anti")
    own = primary.select(*keys, F.lit("primary").alias("origin"), F.col(primary_id).alias("id"))
    both = own.unionByName(left.select(*keys, F.lit("extra").alias("origin"), F.col(extra_id).alias("id")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("origin"), "id")) - 1)


def recovered_blocks(tokens: DataFrame, keys: list[str], block: str) -> DataFrame:
    """keys, block, text, mean confidence and box of blocks that hold a letter or figure."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda t: t["text"]), " ")
    g = tokens.groupBy(*keys, block).agg(words.alias("text"), F.avg("confidence").alias("confidence"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return g.where(F.col("text").rlike("[\\p{L}\\p{N}]"))


def stratified_disjoint(df: DataFrame, stratum: str, group: str, key: Column, k: int) -> DataFrame:
    """Of each stratum the k lowest hash ranks of distinct groups; a group serves the stratum that comes first only.

    A row without a group stands for itself.
    """
    rank = F.sha2(key, 256)
    df = df.withColumn("_r", rank).withColumn("_g", F.coalesce(F.concat(F.lit("g:"), F.col(group)), F.concat(F.lit("r:"), F.col("_r"))))
    best = df.groupBy("_g").agg(F.min(F.struct(stratum, "_r")).alias("_b"))
    own = df.join(best, "_g").where((F.col("_b._r") == F.col("_r")) & F.col(f"_b.{stratum}").eqNullSafe(F.col(stratum)))
    n = F.row_number().over(Window.partitionBy(stratum).orderBy("_r"))
    return own.withColumn("place", n).where(F.col("place") <= k).drop("_r", "_g", "_b")


def content_scores(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and words of grids against truth by position: a word counts as often as both cells have it.

    Both have row, col and text; a cell that one side lacks is empty there.
    """
    at = [*keys, "row", "col"]
    j = truth.select(*at, F.coalesce("text", F.lit("")).alias("want")).join(pred.select(*at, F.coalesce("text", F.lit("")).alias("got")), at, "full").fillna("", ["want", "got"])
    ws = lambda c: F.filter(F.split(F.trim(c), "\\s+"), lambda w: w != "")
    a, b = ws("want"), ws("got")
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))
    full, held = F.col("want") != "", F.col("got") != ""
    g = j.withColumns({"_a": F.size(a), "_b": F.size(b), "_s": shared}).groupBy(*keys)
    return g.agg(
        F.count("*").alias("cells"), F.count_if(F.col("want") == F.col("got")).alias("exact"), F.count_if(full & held).alias("both"), F.count_if(full & ~held).alias("missing"), F.count_if(held & ~full).alias("extra"),
        F.sum("_a").alias("expected_tokens"), F.sum("_b").alias("predicted_tokens"), F.sum("_s").alias("correct_tokens"),
    )
