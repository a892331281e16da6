"""Joins of boxes within a page.

A two-axis overlap has no equi-join of its own. Both sides are laid on a grid
of square tiles; candidates meet by equality of page and tile and are tested
exactly. A pair that meets in several tiles counts in the tile of its
intersection's top left corner only, so no distinct is needed, and a page or a
region of any density is spread over its tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.geometry import Box, centre_in, containment

TILE = 128.0


def _tiles(df: DataFrame, p: str, tile: float) -> DataFrame:
    lo = lambda c: F.floor(F.col(p + c) / tile)
    df = df.withColumn("_tx", F.explode(F.sequence(lo("x0"), F.greatest(lo("x0"), lo("x1")))))
    return df.withColumn("_ty", F.explode(F.sequence(lo("y0"), F.greatest(lo("y0"), lo("y1")))))


def box_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column | None = None, tile: float = TILE) -> DataFrame:
    """Pairs of touching boxes of the same page; left has columns a_*, right b_*, boxes are a_x0.. and b_x0...

    Rows with a NULL coordinate touch nothing. The condition may use both sides.
    """
    boxed = lambda df, p: df.where(" and ".join(f"{p}{c} is not null" for c in ("x0", "y0", "x1", "y1")))
    pairs = _tiles(boxed(left, "a_"), "a_", tile).join(_tiles(boxed(right, "b_"), "b_", tile), [*keys, "_tx", "_ty"])
    touch = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    own = (F.floor(F.greatest("a_x0", "b_x0") / tile) == F.col("_tx")) & (F.floor(F.greatest("a_y0", "b_y0") / tile) == F.col("_ty"))
    pairs = pairs.where(touch & own)
    return (pairs if condition is None else pairs.where(condition)).drop("_tx", "_ty")


def prefixed(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(p + c) for c in df.columns if c not in keys))


def inside(tokens: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens with every region that holds their centre."""
    return box_join(prefixed(tokens, "a_", keys), prefixed(regions, "b_", keys), keys, centre_in(Box.of("a_"), Box.of("b_")))


def best_overlap(tokens: DataFrame, anchors: DataFrame, keys: list[str], token_id: str, order: str, least: float) -> DataFrame:
    """Each token with the anchor that holds most of it, at least a share; the first anchor of ties."""
    pairs = box_join(prefixed(tokens, "a_", keys), prefixed(anchors, "b_", keys), keys).withColumn("frac", containment(Box.of("a_"), Box.of("b_"))).where(F.col("frac") > 0)
    by = Window.partitionBy(*keys, f"a_{token_id}").orderBy(F.desc("frac"), f"b_{order}")
    return pairs.withColumn("_n", F.row_number().over(by)).where((F.col("_n") == 1) & (F.col("frac") >= least)).drop("_n")


def unique_near(tokens: DataFrame, cells: DataFrame, keys: list[str], token_id: str, margin: float) -> DataFrame:
    """Tokens whose centre lies in exactly one cell grown by a margin."""
    grown = cells.withColumns({"x0": F.col("x0") - margin, "y0": F.col("y0") - margin, "x1": F.col("x1") + margin, "y1": F.col("y1") + margin})
    n = F.count("*").over(Window.partitionBy(*keys, f"a_{token_id}"))
    return inside(tokens, grown, keys).withColumn("_n", n).where("_n = 1").drop("_n")


def region_text(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of each region joined in reading order."""
    words = F.array_sort(F.collect_list(F.struct("a_token_pos", "a_text")))
    return pairs.groupBy(*keys, "b_region_pos").agg(F.array_join(F.transform(words, lambda w: w["a_text"]), " ").alias("text"), F.count("*").alias("n_tokens"))
