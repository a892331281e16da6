import itertools
import random

from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.functions import url as U
from foliospark.operators import boxes, quality, sequences, tables


def random_boxes(r, n, lim=600):
    out = []
    for i in range(n):
        x, y = r.uniform(-50, lim), r.uniform(-50, lim)
        out.append(("d", i, x, y, x + r.choice([0, 5, 40, 400]), y + r.choice([0, 5, 30, 300])))
    return out


def test_box_join_is_complete_and_distinct(spark):
    r = random.Random(1)
    a, b = random_boxes(r, 80), random_boxes(r, 60)
    frame = lambda rows, p: spark.createDataFrame([*rows, ("d", 999, None, 0.0, 1.0, 1.0)], f"doc string, {p}id int, {p}x0 double, {p}y0 double, {p}x1 double, {p}y1 double")
    got = sorted((x.a_id, x.b_id) for x in boxes.box_join(frame(a, "a_"), frame(b, "b_"), ["doc"]).collect())
    want = sorted((p[1], q[1]) for p, q in itertools.product(a, b) if p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
    assert got == want and len(set(got)) == len(got)


def test_single_linkage_against_brute_force():
    r = random.Random(2)
    for _ in range(40):
        spans = [(x := r.uniform(0, 100), x + r.uniform(0.1, 20)) for _ in range(12)]
        got = sequences.clusters_of(spans)
        link = lambda p, q: min(p[1], q[1]) - max(p[0], q[0]) >= 0.3 * max(1e-6, min(p[1] - p[0], q[1] - q[0])) and min(p[1], q[1]) > max(p[0], q[0])
        part = list(range(12))
        for _ in range(12):
            for i, j in itertools.combinations(range(12), 2):
                if link(spans[i], spans[j]):
                    part[i] = part[j] = min(part[i], part[j])
        assert all((got[i] == got[j]) == (part[i] == part[j]) for i, j in itertools.combinations(range(12), 2))


def test_reading_order_columns_and_missing_boxes():
    left, right = [(0, y, 40, y + 9) for y in (20, 40)], [(60, y, 100, y + 9) for y in (20, 40)]
    order = sequences.reading_order([(0, 0, 100, 10), right[0], left[0], None, left[1], right[1], (0, 60, 100, 70)], 100.0)
    assert order == [0, 2, 4, 1, 5, 6, 3]
    assert sequences.reading_order([], 100.0) == []


def test_greedy_pairs_take_the_best_first():
    assert sequences.greedy_pairs([(0.9, 0, 1), (0.95, 1, 1), (0.6, 0, 0), (0.4, 2, 2)], 0.5) == [(1, 1, 0.95), (0, 0, 0.6)]


def test_line_bands_join_first_overlapping_line():
    assert sequences.bands_of([(50, 1, 60, 11), (0, 0, 10, 10), (0, 20, 10, 30)]) == [0, 0, 1]


def test_text_quality(spark):
    words = "Điểm này được kiểm tra tại phòng mười hai. "
    df = spark.createDataFrame([(1, words * 8), (2, "аbc dеf gһi " * 30), (3, ""), (4, None), (5, "x�" * 200)], "id int, text string")
    got = {r.id: r for r in quality.signals(df).collect()}
    assert not got[1].suspicious and got[1].reasons == [] and got[1].unexpected_script_ratio == 0
    assert got[2].suspicious and got[2].reasons[0] == "mixed_script_words"
    assert got[3].reasons == got[4].reasons == ["insufficient_text"] and got[4].n_chars == 0
    assert got[5].replacement_ratio == 0.5 and "replacement_chars" in got[5].reasons


def test_text_columns(spark):
    df = spark.createDataFrame([("a b", "b a", "Kế toán!"), ("", "", "---"), (None, None, None)], "a string, b string, c string")
    r = df.select(T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b"))).alias("j"), T.slug(F.col("c")).alias("s"), T.csv_escape(F.lit(" =1+1")).alias("f")).collect()
    assert [x.j for x in r[:2]] == [1.0, 1.0] and [x.s for x in r] == ["K-to-n", "file", "file"] and r[0].f == "' =1+1"
    assert T.order_share(["a", "b", "c"], ["c", "a", "b"]) == 2 / 3


def test_edit_kinds_take_the_first_rule_that_holds(spark):
    pairs = [("a", "a"), (" ", "\t"), ("a b", "ab"), ("a", ""), ("", "a"), ("e\u0301", "\u00e9"), ("A", "a"), ("số", "so"), ("l", "1"), ("12", "1O2"), (".", ","), ("a.", "a"), ("x", "y"), (None, "x")]
    want = ["identical", "whitespace", "substitution", "deletion", "insertion", "unicode_norm", "case", "diacritic", "digit_letter", "digit_letter", "punctuation", "substitution", "substitution", None]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", T.edit_kinds("a", "b").alias("k")).orderBy("i").collect()
    assert [r.k for r in rows] == want


def test_urls():
    c = U.canonical_url
    assert c("HTTP://Example.COM:80/a/./b/../c#x") == "http://example.com/a/c"
    assert c("../y?q=%7e", "https://e.org/a/b/c") == "https://e.org/a/y?q=~"
    assert c("https://e.org//a//b") == "https://e.org//a//b"
    for bad, code in (("ftp://e.org", "unsupported_scheme"), ("http://u:p@e.org", "userinfo_forbidden"), ("http://e.org/%zz", "invalid_percent_encoding"), ("http://0x7f.1/", "noncanonical_ip"), ("http://e.org/a%2fb", "ambiguous_path_separator")):
        try:
            c(bad)
            raise AssertionError(bad)
        except U.AddressError as e:
            assert str(e) == code
    once = c("http://e.org/ä b")
    assert c(once) == once


def test_html():
    html = "<table><tr><th rowspan=2>a</th><td>b</td></tr><tr><td colspan='2'> c  d </td></tr></table><a href='/x'>x</a><link rel=canonical href='/c'>"
    cells = U.table_cells(html)
    assert [(c["row"], c["col"], c["text"]) for c in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c d")]
    assert U.links(html) == ([("a", "/x")], False, "/c")


def test_span_overlap_and_dense_grid(spark):
    s = spark.createDataFrame([(1, 0, 0, 2, 2), (1, 1, 1, 1, 1), (2, 0, 0, None, 0)], "g int, row_at int, col_at int, row_span int, col_span int")
    assert [tuple(r) for r in tables.overlaps(s, ["g"]).collect()] == [(1, 1, 1, 2)]
    c = spark.createDataFrame([(1, 0, 0, 0, 2, 1, "a"), (1, 1, 1, 0, 1, 9, "b")], "g int, pos int, row int, col int, row_span int, col_span int, text string")
    got = {(r.r, r.c): r.text for r in tables.dense(c, ["g"], F.lit(2), F.lit(2)).collect()}
    assert got == {(0, 0): "a", (1, 0): "b", (1, 1): "b"}


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0, 1.0, 1.0, 3.0, 3.0)], "a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    a, b = G.Box.of("a_"), G.Box.of("b_")
    r = df.select(G.iou(a, b).alias("iou"), G.containment(a, b).alias("c"), G.centre_in(a, b).alias("i"), G.y_overlap(a, b).alias("y"), G.polygon_box(G.polygon(a)).alias("p")).first()
    assert abs(r.iou - 1 / 7) < 1e-12 and r.c == 0.25 and r.i and r.y == 0.5 and tuple(r.p) == (0.0, 0.0, 2.0, 2.0)


def test_quality_reports_of_all_documents(spark, tmp_path):
    from foliospark.plans import pages as P

    spark.createDataFrame([(1, "abc def", "web"), (2, "abc", None), (2, "abc", None)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in P.QUERIES["text_quality_report"](spark, str(tmp_path)).collect()} == {1, 2}
    assert {(r.source, r.n_docs) for r in P.QUERIES["text_quality_by_source"](spark, str(tmp_path)).collect()} == {("web", 1), (None, 1)}
