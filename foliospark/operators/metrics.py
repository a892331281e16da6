"""Measures of runs, fields and tables. The six percentile rules are kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CUTS = 64  # parts of a group's value range; no task ranks more than one part


def _same(a: str, b: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _parted(counts: DataFrame, keys: list[str], value: str, cuts: DataFrame) -> DataFrame:
    """Rows with the part of their group they fall in: odd parts hold one cut value only, even ones what lies between."""
    j = counts.alias("c").join(cuts.alias("u"), _same("c", "u", keys)).select("c.*", "u._cuts")
    v = F.col(value)
    below = F.size(F.filter("_cuts", lambda c: c < v))
    return j.withColumn("_p", 2 * below + F.array_contains("_cuts", v).cast("int")).drop("_cuts")


def _cuts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), F.lit(10 * CUTS))).alias("_cuts"))


def order_statistics(df: DataFrame, keys: list[str], value: str, rules: dict[str, Column]) -> DataFrame:
    """Values at positions of the sorted group, counted from 0; a rule is an expression of its size _n. NULL values don't count.

    No group is sorted as a whole. Equal values are counted first, on the map
    side; approximate percentiles cut each group into parts; the parts' sizes
    tell which hold a wanted position, and only these are ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    parts = _parted(counts, keys, "_v", _cuts(counts, keys, "_v"))
    sizes = parts.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    by = Window.partitionBy(*keys)  # at most 2 CUTS rows a group
    sizes = sizes.withColumn("_n", F.sum("_s").over(by)).withColumn("_to", F.sum("_s").over(by.orderBy("_p")))
    spots = F.array(*(F.struct(F.lit(name).alias("name"), rule.cast("long").alias("pos")) for name, rule in rules.items()))
    sizes = sizes.withColumn("_spots", F.filter(spots, lambda x: (x["pos"] >= F.col("_to") - F.col("_s")) & (x["pos"] < F.col("_to"))))
    wanted = sizes.where(F.size("_spots") > 0)
    inside = parts.alias("a").join(wanted.alias("w"), _same("a", "w", [*keys, "_p"])).select("a.*", "w._to", "w._s", "w._spots")
    end = F.col("_to") - F.col("_s") + F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    hits = inside.withColumn("_end", end).withColumn("_hit", F.explode("_spots")).where("_hit.pos >= _end - _c and _hit.pos < _end")
    return hits.groupBy(*keys).agg(*(F.max(F.when(F.col("_hit.name") == name, F.col("_v"))).alias(name) for name in rules))


def ranks(df: DataFrame, keys: list[str], value: str, tie: str, name: str) -> DataFrame:
    """Ordinal rank of each row in its group by value, then by a numeric tie column, from 1; no task ranks a whole group.

    A part that holds a single value, however frequent, is cut again by the tie column.
    """
    rows = _parted(df, keys, value, _cuts(df, keys, value)).withColumnRenamed("_p", "_p1")
    rows = _parted(rows, keys, tie, _cuts(df, keys, tie)).withColumn("_p2", F.when(F.col("_p1") % 2 == 1, F.col("_p")).otherwise(0)).drop("_p")
    sizes = rows.groupBy(*keys, "_p1", "_p2").agg(F.count("*").alias("_s"))
    before = sizes.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p1", "_p2")) - F.col("_s"))
    local = F.row_number().over(Window.partitionBy(*keys, "_p1", "_p2").orderBy(value, tie))
    j = rows.withColumn("_r", local).alias("a").join(before.alias("b"), _same("a", "b", [*keys, "_p1", "_p2"]))
    return j.select("a.*", (F.col("a._r") + F.col("b._before")).alias(name)).drop("_p1", "_p2", "_r")


# Positions in a sorted group of _n values, counted from 0. The percentile rules are kept apart by name.
def nearest_rank(p: float) -> Column:
    return F.expr(f"greatest(0, ceil({p} * _n) - 1)")


def upper_median() -> Column:
    return F.expr("floor(_n / 2)")


def truncated(p: float) -> Column:
    return F.expr(f"least(_n - 1, floor({p} * _n))")


def floored(p: float) -> Column:
    return F.expr(f"floor({p} * (_n - 1))")


def interpolated(p: float) -> dict[str, Column]:
    """The two positions around a percentile; `between` puts them together."""
    return {"lo": F.expr(f"floor({p} * (_n - 1))"), "hi": F.expr(f"ceil({p} * (_n - 1))")}


def between(lo: Column, hi: Column, n: Column, p: float) -> Column:
    at = F.lit(p) * (n - 1)
    return lo + (hi - lo) * (at - F.floor(at))


def median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The exact median of each group, the mean of the middle two."""
    m = order_statistics(df, keys, value, interpolated(0.5))
    return m.select(*keys, ((F.col("lo") + F.col("hi")) / 2).alias(name))


def prf(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 from tp, fp and fn; a zero denominator gives 0."""
    g = df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    g = g.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def field_outcomes(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn per row of a left join of true and predicted values; a missing prediction is a fn."""
    j = truth.withColumnRenamed("value", "want").join(pred.withColumnRenamed("value", "got"), keys, "left")
    hit = F.coalesce(F.col("want") == F.col("got"), F.lit(False))
    one = lambda c: F.when(c, 1).otherwise(0)
    return j.withColumns({"tp": one(hit), "fp": one(F.col("got").isNotNull() & ~hit), "fn": one(F.col("want").isNotNull() & ~hit)})


def stage_profile(log: DataFrame, keys: list[str], ts: list[str], seconds: str, failed: Column) -> DataFrame:
    """Cold (first) and warm runtimes per group, failures, and the share of all time.

    The first record is a minimum and the warm ones are all others; the whole
    group is never brought together.
    """
    log = log.withColumn("_at", F.struct(*ts))
    g = log.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(failed).alias("failures"), F.min("_at").alias("_first"), F.min_by(seconds, "_at").alias("cold"), F.sum(seconds).alias("total"))
    warm = log.alias("l").join(g.select(*keys, "_first").alias("g"), _same("l", "g", keys)).where(F.col("l._at") != F.col("g._first")).select("l.*")
    w = warm.groupBy(*keys).agg(F.avg(seconds).alias("warm_mean"), F.min(seconds).alias("warm_min"), F.max(seconds).alias("warm_max"))
    m = median(warm, keys, seconds, "warm_median")
    g = g.alias("g").join(w.alias("w"), _same("g", "w", keys), "left").select("g.*", "w.warm_mean", "w.warm_min", "w.warm_max")
    g = g.alias("g").join(m.alias("m"), _same("g", "m", keys), "left").select("g.*", "m.warm_median").drop("_first")
    g = g.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))  # over one row per group
    load = F.col("cold") - F.col("warm_mean")
    return g.withColumn("implied_load", F.when(load >= 0, load))


def latency(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of stages: seconds of a first document (all cold) and of a later one (all warm), and their quotient."""
    g = profile.groupBy(*keys).agg(F.sum("cold").alias("first_seconds"), F.sum(F.coalesce("warm_mean", "cold")).alias("later_seconds"), F.sum("implied_load").alias("load_seconds"))
    return g.withColumn("slowdown", F.try_divide("first_seconds", "later_seconds"))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], tie: str) -> DataFrame:
    """1 - 6 sum d^2 / n(n^2-1) on ordinal ranks; NULL below three rows."""
    r = ranks(ranks(df, keys, x, tie, "_rx"), keys, y, tie, "_ry")
    g = r.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("_rx") - F.col("_ry"), F.lit(2))).alias("s"))
    return g.select(*keys, "n", F.when(F.col("n") >= 3, 1 - 6 * F.col("s") / (F.col("n") * (F.pow("n", F.lit(2)) - 1))).alias("rho"))


def exact_mean(col: str) -> Column:
    """A mean that does not depend on the order of its terms: they are summed as decimals."""
    return F.sum(F.col(col).cast("decimal(28,10)")).cast("double") / F.count(col)


def calibration(df: DataFrame, score: str, hit: str, bins: int = 5) -> DataFrame:
    """Rows, mean score and hit rate per band of the score; empty bands stay."""
    band = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    g = df.where(F.col(score).isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"), exact_mean(score).alias("mean_score"), exact_mean(hit).alias("hit_rate"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("band")).join(g, "band", "left").fillna(0, ["n"])


def key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys only one of two runs has, and whether there are none."""
    j = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    n = j.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"))
    return n.withColumn("equal", (F.col("only_first") == 0) & (F.col("only_second") == 0))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Delta per key that both runs have."""
    return a.select(*keys, F.col(value).alias("base")).join(b.select(*keys, F.col(value).alias("cand")), keys).withColumn("delta", F.col("cand") - F.col("base"))


def document_stats(elements: DataFrame, keys: list[str], page: str, text: str, confidence: str, kind: str, kinds: list[str]) -> DataFrame:
    """Pages, elements, elements of each kind, characters and mean confidence; a NULL text has no characters, a NULL confidence doesn't count."""
    of = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    return elements.groupBy(*keys).agg(F.countDistinct(page).alias("num_pages"), F.count("*").alias("num_elements"), F.sum(F.coalesce(F.length(text), F.lit(0))).alias("total_text_chars"), F.avg(confidence).alias("mean_confidence"), *of)


def paired_readings(df: DataFrame, keys: list[str], reading: str, place: str, value: str) -> DataFrame:
    """Every two readings of the same page, by position: common places and equal values. A page has a few readings."""
    a = df.select(*keys, place, F.col(reading).alias("first"), F.col(value).alias("_a"))
    b = df.select(*keys, place, F.col(reading).alias("second"), F.col(value).alias("_b"))
    j = a.join(b, [*keys, place]).where(F.col("first") < F.col("second"))
    return j.groupBy(*keys, "first", "second").agg(F.count("*").alias("n_places"), F.count_if(F.col("_a") == F.col("_b")).alias("n_equal"))


def summary(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Number, mean, median and tenth percentile by nearest rank, worst, perfect and zero scores."""
    g = df.groupBy(*keys).agg(F.count(score).alias("n"), exact_mean(score).alias("mean"), F.min(score).alias("worst"), F.count_if(F.col(score) == 1).alias("perfect"), F.count_if(F.col(score) == 0).alias("zero"))
    at = order_statistics(df, keys, score, {"p50": nearest_rank(0.5), "p10": nearest_rank(0.1)})
    return g.alias("g").join(at.alias("a"), _same("g", "a", keys)).select("g.*", "a.p50", "a.p10")


def gate(df: DataFrame, keys: list[str], truth: Column, flagged: Column) -> DataFrame:
    """Hits, false alarms and misses of a gate, with precision, recall and the share of clean cases flagged; NULL without cases."""
    g = df.groupBy(*keys).agg(F.count_if(truth & flagged).alias("tp"), F.count_if(~truth & flagged).alias("fp"), F.count_if(truth & ~flagged).alias("fn"), F.count_if(~truth).alias("clean"))
    return g.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "false_alarm": F.try_divide("fp", "clean")})


def until_budget(df: DataFrame, keys: list[str], order: list[str], amount: str, most: float) -> DataFrame:
    """Rows with the running sum of their group (used), and whether it is still within the budget (accepted); amounts are not negative."""
    used = F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used", used).withColumn("accepted", F.col("used") <= most)


def paced(df: DataFrame, host: str, ready: str, tie: str, delay: int) -> DataFrame:
    """start: when each request may begin, one delay after the one before it of its host at the earliest.

    The start of the k-th request is the latest of all ready times before it plus
    the delays since, so a running maximum of ready - k * delay gives it at once.
    k is a long, as k delays of a busy host don't fit an int; requests without a
    ready time come last.
    """
    order = Window.partitionBy(host).orderBy(F.col(ready).asc_nulls_last(), F.col(tie).asc_nulls_last())
    k = F.row_number().over(order).cast("long") - 1
    df = df.withColumn("_k", k)
    latest = F.max(F.col(ready) - F.col("_k") * delay).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("start", latest + F.col("_k") * delay).drop("_k")
