from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import integrity, metrics, routing


def test_lineage_with_unknown_parents_and_circles(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99), (7, 8), (8, 7), (9, 6)], "id int, parent int")
    got = {r.id: (r.root, r.depth) for r in integrity.lineage(e).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 4), 6: (None, None), 7: (None, None), 8: (None, None), 9: (None, None)}


def test_fingerprints_tell_null_from_empty(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "c"), ("", "c"), ("a", "bc")]
    got = [r.f for r in spark.createDataFrame(rows, "x string, y string").select(integrity.fingerprint(F.col("x"), F.col("y")).alias("f")).collect()]
    assert len(set(got)) == 4 and got[0] == got[4] and all(len(f) == 24 for f in got)


def test_coverage_and_order(spark):
    of = lambda ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "k string, place int")
    row = lambda e, a: tuple(integrity.coverage(of(e), of(a), ["k"], "place").first())
    assert row("abcd", "abcd") == (4, 4, 0, 0, 0, True)
    assert row("abcd", "acbxb") == (4, 4, 1, 1, 1, False)
    assert row("", "") == (0, 0, 0, 0, 0, True)
    big = [f"k{i}" for i in range(9000)]
    assert row(big, big)[-1] and not row(big, big[5000:] + big[:5000])[-1]


def test_truth_classes(spark):
    df = spark.createDataFrame([(" Total　Sum ", ["total sum"], ["x"]), ("b", ["b"], ["a b c"]), ("b", ["b"], ["abc"]), ("", ["x"], None), (None, None, None)], "t string, truth array<string>, base array<string>")
    yes = F.lit(True)
    k = integrity.truth_classes(F.col("t"), F.col("truth"), F.col("base"), yes, yes, yes)
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in k.items())).collect()]
    assert got == [(True, True, False, True, False), (True, True, True, False, True), (True, True, False, True, False), (False, False, False, False, True), (False, False, False, False, True)]


def test_loss_boundaries_in_order(spark):
    df = spark.createDataFrame([(False, True, True, True, True, True), (True, True, True, True, True, True), (True, False, False, False, True, True), (True, False, False, False, True, False), (True, False, True, False, True, False), (True, False, True, True, False, False), (True, False, True, True, True, True)], "a boolean, u boolean, n boolean, e boolean, s boolean, c boolean")
    got = [r.b for r in df.select(integrity.loss_boundary(F.col("a"), F.col("u"), F.col("n"), F.col("e"), F.col("s"), F.col("c")).alias("b")).collect()]
    assert got == ["acquisition", "reconciliation", "ownership", "canonical_projection", "normalization", "serialization", "preserved"]


def test_failures_keep_the_worst_and_spare_the_sound(spark):
    df = spark.createDataFrame([(1, ["encoding", "merged_cells"], 0.4, True, False), (2, ["encoding"], 1.0, False, True), (3, None, 0.0, False, True), (4, ["merged_cells"], 0.7, False, False)], "id int, labels array<string>, recall double, hallucinated boolean, tables_ok boolean")
    got = {(r.id, r.type, r.severity) for r in routing.failures(df, ["id"]).collect()}
    assert got == {(1, "encoding", "critical"), (1, "merged_cells", "high"), (3, "other", "critical"), (4, "merged_cells", "high")}


def test_routes_and_selection(spark):
    df = spark.createDataFrame([("HAN ",), ("Latin",), ("",), (None,)], "s string").select(routing.language_route(F.col("s")).alias("r"))
    assert [tuple(x.r) for x in df.collect()] == [("ch_sim+en", "han"), ("en+vi", "non_han"), ("en+vi", "unavailable"), ("en+vi", "unavailable")]
    kinds = spark.createDataFrame([("$$x$$",), ("$x$",), ("\\[x\\]",), ("$",), ("x$",)], "t string").select(routing.latex_wrapped(F.col("t")).alias("w"))
    assert [r.w for r in kinds.collect()] == [True, True, True, False, False]
    k = spark.createDataFrame([("failed", "Timed out"), ("completed", None), ("failed", "oom")], "s string, m string").select(routing.failure_kind(F.col("s"), F.col("m")).alias("k"))
    assert [r.k for r in k.collect()] == ["timeout", "completed", "failure"]


def test_pacing_against_the_plain_loop(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.randint(0, 50)) for i in range(60)]
    got = {x.id: x.start for x in metrics.paced(spark.createDataFrame(rows, "id int, host string, ready long"), "host", "ready", "id", 7).collect()}
    free = {}
    for i, host, ready in sorted(rows, key=lambda x: (x[2], x[0])):
        start = max(ready, free.get(host, ready))
        free[host] = start + 7
        assert got[i] == start


def test_pacing_of_a_busy_host_exceeds_an_int(spark):
    df = spark.range(3000).select("id", F.lit("a").alias("host"), F.lit(5).cast("long").alias("ready"))
    got = {x.id: x.start for x in metrics.paced(df, "host", "ready", "id", 1_000_000).collect()}
    assert got == {i: 5 + i * 1_000_000 for i in range(3000)}


def test_pacing_without_a_ready_time_comes_last(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 100), (3, "a", 101)], "id int, host string, ready long")
    assert {x.id: x.start for x in metrics.paced(df, "host", "ready", "id", 7).collect()} == {2: 100, 3: 107, 1: 114}


def test_text_helpers(spark):
    df = spark.createDataFrame([("/r/x/doc.pdf_3.png",), ("/r/page-01234567-89ab-cdef-0123-456789abcdef.png",), ("/q/plain.png",), (None,)], "p string")
    got = [tuple(x) for x in df.select(T.source_group(F.col("p")), T.portable_path(F.col("p"), "/r")).collect()]
    assert got == [("doc", "x/doc.pdf_3.png"), (None, "page-01234567-89ab-cdef-0123-456789abcdef.png"), (None, "plain.png"), (None, None)]
    d = spark.createDataFrame([("a​b\x07" + "c" * 3000,)], "t string").select(T.diagnostic(F.col("t")).alias("d")).first().d
    assert d.startswith("a?b?ccc") and d.endswith("... (truncated)") and len(d) == 2015


def test_funnel_and_rest(spark):
    df = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    assert [tuple(r) for r in routing.funnel(df, {"a": F.col("a"), "b": F.col("b")}).collect()] == [("a", 0, 2, 2 / 3), ("b", 1, 1, 1 / 3)]
    words = spark.createDataFrame([(w,) for w in "aaabbcd"] + [(None,)], "w string")
    assert {tuple(r) for r in routing.top_and_rest(words, "w", 2).select("w", "n", "n_values").collect()} == {("a", 3, 1), ("b", 2, 1), (None, 2, 2)}
