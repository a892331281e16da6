"""Queries on merged readings, repairs and scores of grids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import boxes, recovery
from foliospark.operators import structure as S
from foliospark.plans.pages import _CELLS, _CI, _FR, _ON, _T, _WS, PAGE, _cells, _doc, _regions, _study_pages, _tokens
from foliospark.plans.structure import _KEY, _boxes_of
from foliospark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = "{{'y0': y0, 'x0': x0, 'text': text}}"


@query(f"""{_T}, two AS (SELECT document_id, page_index FROM t GROUP BY 1, 2 HAVING count(DISTINCT source) = 2), d2 AS (SELECT d.* FROM d JOIN two USING (document_id, page_index)), e2 AS (SELECT e.* FROM e JOIN two USING (document_id, page_index)),
f AS (SELECT d.document_id, d.page_index, d.token_id AS fine, r.token_id AS anchor, {_FR} AS frac FROM e2 d JOIN d2 r ON {_ON} WHERE d.x1 > d.x0 AND d.y1 > d.y0), k AS (SELECT fine, anchor FROM (SELECT *, row_number() OVER (PARTITION BY fine ORDER BY frac DESC, anchor) AS n FROM f WHERE frac > 0) WHERE n = 1 AND frac >= 0.4),
h AS (SELECT k.anchor, list({_TOK.format()} ORDER BY y0, x0, text) AS fine, string_agg(text, ' ' ORDER BY y0, x0, text) AS ft FROM k JOIN e2 ON k.fine = e2.token_id GROUP BY 1),
g AS (SELECT d2.token_id, d2.text, d2.y0, d2.x0, h.fine, h.ft, {_WS.format("d2.text")} AS wa, {_WS.format("h.ft")} AS wf FROM d2 JOIN h ON h.anchor = d2.token_id),
s AS (SELECT *, CASE WHEN len(list_concat(wa, wf)) = 0 THEN 1.0 ELSE len(list_intersect(wa, wf)) / len(list_distinct(list_concat(wa, wf))) END AS sim FROM g)
SELECT token_id, CASE WHEN sim >= 0.7 THEN array_to_string(list_transform(list_sort(CASE WHEN len(list_filter(wa, lambda w: NOT list_contains(wf, w))) > 0 THEN list_append(fine, {{'y0': y0, 'x0': x0, 'text': text}}) ELSE fine END), lambda z: z.text), ' ') ELSE text || ' ' || ft END AS text FROM s""")
def fused_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of each anchor with what the other reading holds at its place."""
    t = _tokens(spark, d)
    both = t.groupBy(*PAGE).agg(F.countDistinct("source").alias("n")).where("n = 2").select(*PAGE)
    t = t.join(both, PAGE, "left_semi")
    a, b = t.where("source = 'docling'").drop("source"), t.where("source = 'easyocr'").drop("source")
    owned = boxes.best_overlap(b, a, PAGE, "token_id", "token_id", 0.4)
    one = lambda p: F.struct(F.col(p + "y0").alias("y0"), F.col(p + "x0").alias("x0"), F.col(p + "text").alias("text"))
    g = owned.groupBy(F.col("b_token_id").alias("token_id")).agg(F.array_sort(F.collect_list(one("a_"))).alias("fine"), F.array(F.first(one("b_"))).alias("anchors"))
    said = lambda c: T.word_set(F.array_join(F.transform(c, lambda x: x["text"]), " "))
    agree = T.jaccard(said("anchors"), said("fine")) >= 0.7
    return g.select("token_id", recovery.fused_text(F.when(agree, "keep_both_agree").otherwise("conflict"), F.col("anchors"), F.col("fine")).alias("text"))


@query("""WITH a AS (SELECT study_id, 0 AS n, exact AS sim, char_recall AS conf FROM (SELECT DISTINCT study_id, exact, char_recall FROM case_studies) UNION ALL SELECT study_id, 1, char_recall, exact FROM (SELECT DISTINCT study_id, exact, char_recall FROM case_studies)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY sim DESC NULLS LAST, coalesce(conf, 0) DESC, n) AS p FROM a WHERE sim IS NOT NULL AND study_id % 9 <> 4) WHERE p = 1), s AS (SELECT DISTINCT study_id FROM case_studies)
SELECT CASE WHEN sim IS NULL THEN 'no_candidate' WHEN NOT sim > greatest((study_id % 10) / 10.0, 0.7) THEN 'not_nearer' WHEN conf < 0.4 THEN 'low_confidence' ELSE 'replaced' END AS verdict, count(*) AS n FROM s LEFT JOIN k USING (study_id) GROUP BY 1""")
def repair_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Two attempts a study; the better plausible one is taken if it comes nearer."""
    c = table(spark, d, "case_studies").select("study_id", "exact", "char_recall").distinct()
    a = c.select("study_id", F.lit(0).alias("n"), F.col("exact").alias("sim"), F.col("char_recall").alias("conf")).unionByName(c.select("study_id", F.lit(1).alias("n"), F.col("char_recall").alias("sim"), F.col("exact").alias("conf")))
    k = recovery.chosen_attempts(a, ["study_id"], "sim", "conf", F.col("sim").isNotNull() & (F.col("study_id") % 9 != 4), "n")
    j = c.select("study_id").distinct().join(k, "study_id", "left")
    return j.groupBy(recovery.repair_verdict(F.col("sim"), F.col("conf"), (F.col("study_id") % 10) / 10).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT page_input_id, document_id, page_index, text FROM page_inputs), q AS (SELECT document_id, page_index, bool_or(suspicious) AS bad FROM quality_results GROUP BY 1, 2), o AS (SELECT DISTINCT document_id, page_index, CASE WHEN page_input_id % 3 = 0 THEN ' ' ELSE 'again ' || CAST(page_input_id AS VARCHAR) END AS other FROM page_inputs WHERE page_input_id % 5 <> 0),
j AS (SELECT p.*, coalesce(q.bad, false) AS bad, o.other FROM p LEFT JOIN q USING (document_id, page_index) LEFT JOIN o USING (document_id, page_index)) SELECT page_input_id, CASE WHEN NOT bad THEN 'kept' WHEN coalesce(trim(other) <> '', false) THEN 'replaced' ELSE 'no_fallback' END AS decision, length(CASE WHEN bad AND coalesce(trim(other) <> '', false) THEN other ELSE text END) AS n_chars FROM j""")
def page_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Suspicious pages take the text of another reading, where it has any."""
    i = F.col("page_input_id")
    p = table(spark, d, "page_inputs").select("page_input_id", *PAGE, "text").distinct()
    q = table(spark, d, "quality_results").groupBy(*PAGE).agg(F.bool_or("suspicious").alias("bad"))
    other = p.where(i % 5 != 0).select(*PAGE, F.when(i % 3 == 0, " ").otherwise(F.concat(F.lit("again "), i.cast("string"))).alias("text")).distinct()
    return recovery.page_fallback(p.join(q, PAGE, "left"), other, PAGE, "bad", "text").select("page_input_id", "decision", F.length("text").alias("n_chars"))


@query(f"""{_T}, tb AS (SELECT * FROM r WHERE region_pos % 3 = 0) SELECT d.token_id FROM d WHERE NOT EXISTS (SELECT 1 FROM tb r WHERE {_ON} AND d.x1 > d.x0 AND d.y1 > d.y0 AND {_FR} >= 0.7)""")
def elements_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return recovery.outside(_doc(t), _regions(t).where("region_pos % 3 = 0"), PAGE, "token_id").select("token_id")


@query()
def tables_with_extras(spark: SparkSession, d: str) -> DataFrame:
    """Regions of a page and the tables that none of them takes."""
    p = _study_pages(spark, d)
    r, t = _boxes_of(p, "region_bboxes", "region_pos"), _boxes_of(p, "table_bboxes", "table_pos")
    n = p.select(*_KEY, F.posexplode("table_cells").alias("table_pos", "cells"))
    return recovery.unmatched(t.join(n, [*_KEY, "table_pos"], "left"), r, _KEY, S.greedy_tables(r, t, _KEY, "region_pos", "table_pos"), "table_pos", "region_pos", "cells")


@query(f"""{_T}, o AS (SELECT d.*, floor(y0 / 100) AS block FROM d WHERE x0 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE {_ON} AND {_CI})), g AS (SELECT document_id, page_index, CAST(block AS BIGINT) AS block, string_agg(text, ' ' ORDER BY y0, x0, text) AS text, round(avg(confidence), 6) AS confidence, min(x0) AS x0, max(y1) AS y1 FROM o GROUP BY 1, 2, 3) SELECT * FROM g WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')""")
def recovered_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that no region holds as elements, by strips of the page."""
    t = _tokens(spark, d)
    own = boxes.inside(_doc(t), _regions(t), PAGE).select(F.col("a_token_id").alias("token_id"))
    o = _doc(t).where("x0 is not null").join(own, "token_id", "left_anti").withColumn("block", F.floor(F.col("y0") / 100).cast("bigint"))
    return recovery.recovered_blocks(o, PAGE, "block").select(*PAGE, "block", "text", F.round("confidence", 6).alias("confidence"), "x0", "y1")


@query("""WITH h AS (SELECT DISTINCT hard_case_id, case_id, document_type, failure_mode AS g FROM hard_cases), r AS (SELECT *, sha256(case_id) AS k, coalesce('g:' || g, 'r:' || sha256(case_id)) AS gg FROM h), b AS (SELECT gg, min({'s': document_type, 'k': k}) AS b FROM r GROUP BY 1), o AS (SELECT r.* FROM r JOIN b USING (gg) WHERE b.k = k AND b.s IS NOT DISTINCT FROM document_type)
SELECT hard_case_id, document_type, place FROM (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY k) AS place FROM o) WHERE place <= 3""")
def disjoint_strata(spark: SparkSession, d: str) -> DataFrame:
    """Up to three cases of each document type, no failure mode twice."""
    h = table(spark, d, "hard_cases").select("hard_case_id", "case_id", "document_type", "failure_mode").distinct()
    return recovery.stratified_disjoint(h, "document_type", "failure_mode", F.col("case_id"), 3).select("hard_case_id", "document_type", "place")


_W = "list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> '')"


@query(f"""{_CELLS}, p AS (SELECT grid_id, "row", col, CASE WHEN (grid_id + "row") % 5 = 0 THEN text || ' ' || text ELSE text END AS text FROM c WHERE (grid_id + col) % 17 <> 0), j AS (SELECT coalesce(c.grid_id, p.grid_id) AS grid_id, coalesce(c.text, '') AS a, coalesce(p.text, '') AS b FROM c FULL JOIN p ON c.grid_id = p.grid_id AND c."row" = p."row" AND c.col = p.col),
k AS (SELECT *, {_W.format("a")} AS wa, {_W.format("b")} AS wb FROM j)
SELECT grid_id, count(*) AS cells, count_if(a = b) AS exact, count_if(a <> '' AND b <> '') AS both, count_if(a <> '' AND b = '') AS missing, count_if(a = '' AND b <> '') AS extra, CAST(sum(len(wa)) AS BIGINT) AS expected_tokens, CAST(sum(len(wb)) AS BIGINT) AS predicted_tokens, CAST(sum(coalesce(list_sum(list_transform(list_distinct(wa), lambda w: least(len(list_filter(wa, lambda x: x = w)), len(list_filter(wb, lambda x: x = w))))), 0)) AS BIGINT) AS correct_tokens FROM k GROUP BY 1""")
def content_scores(spark: SparkSession, d: str) -> DataFrame:
    """Grids against a spoilt copy: cells and words that are right, a repeated word once."""
    c = _cells(spark, d)
    p = c.where((F.col("grid_id") + F.col("col")) % 17 != 0).withColumn("text", F.when((F.col("grid_id") + F.col("row")) % 5 == 0, F.concat("text", F.lit(" "), "text")).otherwise(F.col("text")))
    return recovery.content_scores(c, p, ["grid_id"])


@query(f"""{_T}, k AS (SELECT document_id, page_index, source, text AS w, 'token' AS kind FROM t UNION ALL SELECT document_id, page_index, 'docling', NULL, 'region' FROM r UNION ALL SELECT DISTINCT document_id, page_index, NULL, label, 'grid' FROM annotated_grids) SELECT kind, count(*) AS n, count(w) AS n_text, count(DISTINCT document_id) AS n_documents FROM k GROUP BY 1""")
def acquired_kinds(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of acquired evidence in one table, columns that a kind lacks being NULL."""
    t = _tokens(spark, d)
    k = t.select(*PAGE, "source", "text", F.lit("token").alias("kind")).unionByName(_regions(t).select(*PAGE, F.lit("docling").alias("source"), F.lit("region").alias("kind")), allowMissingColumns=True)
    g = table(spark, d, "annotated_grids").select(*PAGE, F.col("label").alias("text"), F.lit("grid").alias("kind")).distinct()
    return k.unionByName(g, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.countDistinct("document_id").alias("n_documents"))


@query("""WITH d AS (SELECT DISTINCT document_id FROM quality_results), f AS (SELECT DISTINCT document_id FROM page_inputs WHERE text IS NOT NULL AND text <> '') SELECT document_id FROM d ANTI JOIN f USING (document_id)""")
def documents_without_text(spark: SparkSession, d: str) -> DataFrame:
    """Assessed documents of which no page has any text."""
    f = table(spark, d, "page_inputs").where("text is not null and text <> ''").select("document_id")
    return table(spark, d, "quality_results").select("document_id").distinct().join(f, "document_id", "left_anti")


@query("""WITH q AS (SELECT DISTINCT document_id, page_index, reasons FROM quality_results), r AS (SELECT document_id, unnest(reasons) AS reason FROM q), k AS (SELECT document_id, list(DISTINCT reason) AS rs FROM r WHERE reason IS NOT NULL GROUP BY 1) SELECT document_id, array_to_string(list_sort(list_filter(rs, lambda x: x <> 'insufficient_text')), ',') AS warnings, len(rs) AS n_reasons FROM k""")
def promoted_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of pages as warnings of their document, each once, without the one that only informs."""
    r = table(spark, d, "quality_results").select("document_id", F.explode("reasons").alias("reason")).where("reason is not null")
    k = r.groupBy("document_id").agg(F.array_sort(F.collect_set("reason")).alias("rs"))
    return k.select("document_id", F.array_join(F.filter("rs", lambda x: x != "insufficient_text"), ",").alias("warnings"), F.size("rs").alias("n_reasons"))
