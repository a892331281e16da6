from pyspark.sql import functions as F

from foliospark.operators import recovery as R


def test_merge_keeps_what_only_one_reading_has(spark):
    tok = "array<struct<y0:double,x0:double,text:string>>"
    rows = [([(0.0, 0.0, "Section 1."), (0.0, 50.0, "Scope")], [(0.0, 10.0, "Section"), (0.0, 52.0, "Scope")], "keep_both_agree"), ([(0.0, 0.0, "a")], [(0.0, 5.0, "b")], "conflict"), ([], [(0.0, 5.0, "b")], "single_fine"), ([(0.0, 0.0, "a")], [], "single_anchor")]
    df = spark.createDataFrame(rows, f"a {tok}, b {tok}, d string")
    assert [r.t for r in df.select(R.fused_text(F.col("d"), F.col("a"), F.col("b")).alias("t")).collect()] == ["Section 1. Section Scope", "a b", "b", "a"]


def test_repairs(spark):
    a = spark.createDataFrame([(1, 0, 0.8, None, True), (1, 1, 0.8, 0.9, True), (2, 0, 0.9, 0.9, False), (3, 0, 0.75, 0.1, True), (4, 0, 0.6, 0.9, True)], "k int, n int, s double, c double, ok boolean")
    best = {r.k: r.n for r in R.chosen_attempts(a, ["k"], "s", "c", F.col("ok"), "n").collect()}
    assert best == {1: 1, 3: 0, 4: 0}
    v = spark.createDataFrame([(0.8, 0.9, 0.5), (0.8, 0.9, 0.85), (0.8, None, 0.1), (0.8, 0.2, 0.1), (None, None, 0.1), (0.65, 0.9, 0.1)], "s double, c double, b double")
    assert [r.v for r in v.select(R.repair_verdict(F.col("s"), F.col("c"), F.col("b")).alias("v")).collect()] == ["replaced", "not_nearer", "replaced", "low_confidence", "no_candidate", "not_nearer"]


def test_fallback_outside_and_extras(spark):
    p = spark.createDataFrame([(1, "bad", True), (2, "good", False), (3, "bad", True), (4, "x", None)], "p int, t string, s boolean")
    f = spark.createDataFrame([(1, "better"), (2, "other"), (3, " ")], "p int, t string")
    assert {r.p: (r.t, r.decision) for r in R.page_fallback(p, f, ["p"], "s", "t").collect()} == {1: ("better", "replaced"), 2: ("good", "kept"), 3: ("bad", "no_fallback"), 4: ("x", "kept")}
    e = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 20.0, 10.0), (1, 2, None, None, None, None)], "p int, e int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([(1, 0, 0.0, 0.0, 8.0, 10.0)], "p int, t int, x0 double, y0 double, x1 double, y1 double")
    assert {r.e for r in R.outside(e, t, ["p"], "e").collect()} == {1, 2}
    extra = spark.createDataFrame([(1, 0, 4), (1, 1, 0), (1, 2, 3)], "p int, t int, cells int")
    pairs = spark.createDataFrame([(1, 0, 0)], "p int, region int, table int")
    assert {tuple(r) for r in R.unmatched(extra, e.select("p", "e"), ["p"], pairs, "t", "e", "cells").collect()} == {(1, "primary", 0, 0), (1, "primary", 1, 1), (1, "primary", 2, 2), (1, "extra", 2, 3)}


def test_words_count_as_often_as_both_have_them(spark):
    t = spark.createDataFrame([(1, 0, 0, "a a b"), (1, 0, 1, ""), (1, 1, 0, "c"), (1, 1, 1, None)], "g int, row int, col int, text string")
    p = spark.createDataFrame([(1, 0, 0, "a b b a a"), (1, 0, 1, "x"), (1, 1, 1, "")], "g int, row int, col int, text string")
    assert tuple(R.content_scores(t, p, ["g"]).first()) == (1, 4, 1, 1, 1, 1, 4, 6, 3)


def test_no_group_serves_two_strata(spark):
    rows = [(i, "s" + str(i % 3), f"g{i % 4}" if i % 5 else None) for i in range(40)]
    got = R.stratified_disjoint(spark.createDataFrame(rows, "id int, s string, g string"), "s", "g", F.col("id").cast("string"), 2).collect()
    groups = [r.g for r in got if r.g]
    assert len(groups) == len(set(groups)) and all(sum(r.s == s for r in got) <= 2 for s in ("s0", "s1", "s2"))
