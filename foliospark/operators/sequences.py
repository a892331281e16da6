"""Order on a page: bands, gutters, columns and greedy matches.

What a window can express is a window; rules that look back at a whole band or
consume their candidates run in Python per page, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_bands(df: DataFrame, keys: list[str], tie: str, close: float = 4.0) -> DataFrame:
    """Band number of each box: boxes by top and left join the band above if they overlap it or begin within `close` of its top.

    A box that starts below all before it opens a segment: a window finds these.
    Only boxes less than `close` high make a segment begin near the top of the
    band above; so bands are runs of segments, folded in order of their tops,
    a page having as many as it has lines. All of it stays in the JVM. Boxes
    without coordinates have no band.
    """
    order = Window.partitionBy(*keys).orderBy("y0", "x0", tie)
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    boxed = df.where("x0 is not null and y0 is not null and y1 is not null")
    opens = reach.isNull() | (F.col("y0") >= reach)
    seg = boxed.withColumn("_seg", F.sum(opens.cast("int")).over(order))
    tops = seg.groupBy(*keys, "_seg").agg(F.min("y0").alias("_top")).groupBy(*keys).agg(F.array_sort(F.collect_list("_top")).alias("_tops"))
    fold = F.aggregate(
        "_tops",
        F.array().cast("array<double>"),
        lambda bands, top: F.when((F.size(bands) == 0) | (top - F.try_element_at(bands, F.lit(-1)) > close), F.concat(bands, F.array(top))).otherwise(bands),
    )
    starts = tops.select(*(F.col(k).alias("_k" + str(i)) for i, k in enumerate(keys)), fold.alias("_starts"))
    same = [F.col(k).eqNullSafe(F.col("_k" + str(i))) for i, k in enumerate(keys)]
    top = F.min("y0").over(Window.partitionBy(*keys, "_seg"))
    joined = seg.withColumn("_top", top).join(starts, same).withColumn("band", F.size(F.filter("_starts", lambda b: b <= F.col("_top"))) - 1)
    return joined.drop("_seg", "_top", "_starts", *("_k" + str(i) for i in range(len(keys))))


def gutter(df: DataFrame, keys: list[str], width: str, least: float = 0.06, full: float = 0.8) -> DataFrame:
    """The widest vertical gap of each page between boxes narrower than full width; NULL where a page is one column."""
    narrow = df.where((F.col("x1") - F.col("x0")) < full * F.col(width))
    order = Window.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = narrow.withColumn("reach", reach).withColumn("gap", F.col("x0") - F.col("reach"))
    best = gaps.groupBy(*keys).agg(F.max(F.col(width)).alias("w"), F.max(F.when(F.col("gap") > 0, F.struct("gap", (-F.col("reach")).alias("r")))).alias("b"))
    return best.select(*keys, F.when(F.col("b.gap") >= least * F.col("w"), -F.col("b.r") + F.col("b.gap") / 2).alias("gutter_x"))


def split_runs(df: DataFrame, keys: list[str], pos: str, em: float = 1.2) -> DataFrame:
    """Run number of each character: a step back, a wide gap or another baseline begins a run."""
    order = Window.partitionBy(*keys).orderBy(pos)
    gap = F.col("x0") - F.lag("x1").over(order)
    cut = (gap < -0.5) | (gap > em * F.col("size")) | (F.abs(F.col("origin_y") - F.lag("origin_y").over(order)) > 0.5)
    return df.withColumn("_c", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("run", F.sum("_c").over(order)).drop("_c")


def renumbered(df: DataFrame, keys: list[str], row: str, first: str) -> DataFrame:
    """Rows numbered by their top, rows without boxes at 0, ties by first appearance."""
    tops = df.groupBy(*keys, row).agg(F.min(F.coalesce("y0", F.lit(0.0))).alias("_y"), F.min(first).alias("_f"))
    ranks = tops.withColumn("new_row", F.row_number().over(Window.partitionBy(*keys).orderBy("_y", "_f")) - 1)
    return df.join(ranks.drop("_y", "_f"), [*keys, row])


def bands_of(boxes: list[tuple[float, float, float, float]], share: float = 0.5) -> list[int]:
    """Line of each box: boxes by top and left join the first line that they overlap by a share of the shorter; lines by top."""
    lines: list[list[float]] = []
    at = [0] * len(boxes)
    for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][1], boxes[i][0])):
        _, y0, _, y1 = boxes[i]
        for n, line in enumerate(lines):
            if min(y1, line[1]) - max(y0, line[0]) >= share * max(1e-6, min(y1 - y0, line[1] - line[0])):
                line[0], line[1] = min(line[0], y0), max(line[1], y1)
                at[i] = n
                break
        else:
            at[i] = len(lines)
            lines.append([y0, y1])
    rank = {n: r for r, n in enumerate(sorted(range(len(lines)), key=lambda n: lines[n][0]))}
    return [rank[n] for n in at]


def clusters_of(spans: list[tuple[float, float]], share: float = 0.3) -> list[int]:
    """Cluster of each interval by single linkage: overlap of a share of the shorter links; sweep over starts."""
    parent = list(range(len(spans)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    open_: list[int] = []
    for i in sorted(range(len(spans)), key=lambda i: spans[i]):
        lo, hi = spans[i]
        open_ = [j for j in open_ if spans[j][1] > lo]
        for j in open_:
            if min(hi, spans[j][1]) - lo >= share * max(1e-6, min(hi - lo, spans[j][1] - spans[j][0])):
                parent[root(i)] = root(j)
        open_.append(i)
    tops: dict[int, float] = {}
    for i, (lo, _) in enumerate(spans):
        tops[root(i)] = min(lo, tops.get(root(i), lo))
    rank = {r: n for n, r in enumerate(sorted(tops, key=tops.__getitem__))}
    return [rank[root(i)] for i in range(len(spans))]


def reading_order(boxes: list[tuple | None], width: float, columns: int = 3, least: float = 0.06, full: float = 0.8, close: float = 4.0) -> list[int]:
    """Indices of boxes in reading order: full-width boxes cut the page, gutters split the rest into columns; missing boxes last."""

    def banded(items: list[int]) -> list[int]:
        out: list[list[int]] = []
        lo = hi = 0.0
        for i in sorted(items, key=lambda i: (boxes[i][1], boxes[i][0], i)):
            y0, y1 = boxes[i][1], boxes[i][3]
            if out and (y0 < hi and y1 > lo or abs(y0 - lo) <= close):
                out[-1].append(i)
                lo, hi = min(lo, y0), max(hi, y1)
            else:
                out.append([i])
                lo, hi = y0, y1
        return [i for band in out for i in sorted(band, key=lambda i: (boxes[i][0], boxes[i][1], i))]

    def cut(items: list[int]) -> float | None:
        thin = sorted((boxes[i][0], boxes[i][2]) for i in items if boxes[i][2] - boxes[i][0] < full * width)
        if len(thin) < 2:
            return None
        reach, gap, x = thin[0][1], 0.0, None
        for x0, x1 in thin[1:]:
            if x0 - reach > gap:
                gap, x = x0 - reach, (x0 + reach) / 2
            reach = max(reach, x1)
        return x if x is not None and gap >= least * width else None

    def ordered(items: list[int], depth: int) -> list[int]:
        x = cut(items) if depth > 0 and width > 0 else None
        if x is None:
            return banded(items)
        out: list[int] = []
        part: list[int] = []
        flush = lambda: (ordered([i for i in part if boxes[i][2] <= x], depth - 1) + ordered([i for i in part if boxes[i][0] >= x], depth - 1)) if part else []
        for i in sorted(items, key=lambda i: (boxes[i][1], boxes[i][0], i)):
            if boxes[i][0] < x < boxes[i][2]:
                out += flush()
                part = []
                out.append(i)
            else:
                part.append(i)
        return out + flush()

    here = [i for i, b in enumerate(boxes) if b is not None]
    return ordered(here, columns - 1) + [i for i, b in enumerate(boxes) if b is None]


def greedy_pairs(scored: list[tuple[float, int, int]], least: float) -> list[tuple[int, int, float]]:
    """One-to-one pairs by falling score, then by left and right number."""
    left: set[int] = set()
    right: set[int] = set()
    out = []
    for s, a, b in sorted(scored, key=lambda t: (-t[0], t[1], t[2])):
        if s >= least and a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b, s))
    return out


def per_page(df: DataFrame, keys: list[str], schema: str, f: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Run a function on each page; a page has a bounded number of boxes."""
    return df.groupBy(*keys).applyInPandas(f, schema)


def _boxes(pdf: pd.DataFrame) -> list[tuple | None]:
    return [None if pd.isna(r[0]) else tuple(r) for r in pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False)]


def line_bands(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x0", "y0", "x1", "y1"])
        return pdf[[*keys, item]].assign(line=bands_of(_boxes(pdf)))

    return per_page(df, keys, ", ".join(f"{c} {kinds[c]}" for c in [*keys, item]) + ", line int", f)


def row_clusters(df: DataFrame, keys: list[str], item: str, share: float = 0.3) -> DataFrame:
    kinds = dict(df.dtypes)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["y0", "y1"])
        return pdf[[*keys, item]].assign(row_cluster=clusters_of(list(zip(pdf.y0, pdf.y1)), share))

    return per_page(df, keys, ", ".join(f"{c} {kinds[c]}" for c in [*keys, item]) + ", row_cluster int", f)


def page_order(df: DataFrame, keys: list[str], item: str, width: str) -> DataFrame:
    kinds = dict(df.dtypes)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item).reset_index(drop=True)
        order = reading_order(_boxes(pdf), float(pdf[width].max()))
        return pdf.iloc[order][[*keys, item]].assign(order_index=range(len(order)))

    return per_page(df, keys, ", ".join(f"{c} {kinds[c]}" for c in [*keys, item]) + ", order_index int", f)


def greedy_match(pairs: DataFrame, keys: list[str], a: str, b: str, score: str, least: float) -> DataFrame:
    """One-to-one matches per page from candidate pairs of a box join."""
    kinds = dict(pairs.dtypes)

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        got = greedy_pairs(list(zip(pdf[score], pdf[a], pdf[b])), least)
        out = pd.DataFrame(got, columns=[a, b, score])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, a, b, score]]

    return per_page(pairs, keys, ", ".join(f"{c} {kinds[c]}" for c in [*keys, a, b, score]), f)
