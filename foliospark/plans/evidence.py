"""Queries on evidence, routing, validation and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import boxes, evidence, integrity, metrics, routing
from foliospark.plans.pages import _CI, _CP, _ON, _T, PAGE, _doc, _regions, _study_pages, _tokens
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


_OBS = "SELECT DISTINCT token_id, source, document_id, page_index, text, CAST(round(x0) AS BIGINT) AS x, CAST(round(y0) AS BIGINT) AS y FROM ocr_tokens"
_PART = "coalesce(CAST(length(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


@query(f"""WITH o AS ({_OBS}), r AS (SELECT *, row_number() OVER (PARTITION BY source, document_id, text ORDER BY token_id) - 1 AS duplicate_rank FROM o)
SELECT token_id, duplicate_rank, 'obs-' || left(sha256({" || ',' || ".join(_PART.format(c) for c in ("source", "document_id", "text", "duplicate_rank"))}), 20) AS observation_id FROM r""")
def observation_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identity of each token by source, document, text and its rank among equal ones."""
    o = table(spark, d, "ocr_tokens").select("token_id", "source", "document_id", "text").distinct()
    o = o.withColumn("duplicate_rank", integrity.duplicate_rank(["source", "document_id", "text"], ["token_id"]))
    return o.select("token_id", "duplicate_rank", integrity.fingerprint(*(F.col(c) for c in ("source", "document_id", "text", "duplicate_rank"))).alias("observation_id"))


@query(f"""{_T}, c AS (SELECT d.document_id, d.token_id, count(r.region_pos) AS n FROM d LEFT JOIN r ON {_ON} AND {_CI} GROUP BY 1, 2)
SELECT document_id, count(*) AS captured, count_if(n = 1) AS accepted, count_if(n > 1) AS unresolved, count_if(n = 0) AS excluded, count_if(n > 1) AS misowned, true AS balanced FROM c GROUP BY 1""")
def evidence_accounting(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    n = boxes.inside(_doc(t), _regions(t), PAGE).groupBy(F.col("a_token_id").alias("token_id")).agg(F.count("*").alias("k"))
    o = _doc(t).join(n, "token_id", "left").withColumn("n_claims", F.coalesce("k", F.lit(0)))
    return integrity.accounting(o.withColumn("disposition", evidence.disposition(F.col("n_claims"), F.lit(False))), ["document_id"])


_CMP = "lower(upper(trim(regexp_replace({0}, '[\\s\\p{{Z}}\\x{{85}}]+', ' ', 'g'))))"


@query(f"""{_T}, a AS (SELECT DISTINCT document_id, {_CMP.format("text")} AS w FROM e WHERE {_CMP.format("text")} <> ''), b AS (SELECT DISTINCT document_id, {_CMP.format("text")} AS w FROM d WHERE {_CMP.format("text")} <> '')
SELECT coalesce(a.document_id, b.document_id) AS document_id, count_if(b.w IS NULL) AS n_novel, count_if(a.w IS NOT NULL AND b.w IS NOT NULL) AS n_duplicate, count_if(a.w IS NULL) AS n_lost FROM a FULL JOIN b ON a.document_id = b.document_id AND a.w = b.w GROUP BY 1""")
def text_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Texts that one reading adds to the other, shares with it or lacks."""
    t = _tokens(spark, d)
    return integrity.text_sets(t.where("source = 'easyocr'"), t.where("source = 'docling'"), ["document_id"], "text")


@query(f"""{_T}, j AS (SELECT d.text AS a, e.text AS b, d.token_id % 11 = 0 AS conflict FROM d LEFT JOIN e USING (document_id, page_index, token_pos))
SELECT CASE WHEN a IS NULL THEN 'acquisition' WHEN b IS NULL THEN 'reconciliation' WHEN {_CMP.format("a")} <> {_CMP.format("b")} AND conflict THEN 'ownership' WHEN {_CMP.format("a")} <> {_CMP.format("b")} THEN 'canonical_projection' WHEN a <> b THEN 'normalization' WHEN contains(a, '|') THEN 'serialization' ELSE 'preserved' END AS boundary, count(*) AS n FROM j GROUP BY 1""")
def loss_boundaries(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    a, b = (t.where(F.col("source") == s).select(*PAGE, "token_pos", "token_id", F.col("text").alias(n)) for s, n in (("docling", "a"), ("easyocr", "b")))
    j = a.join(b.drop("token_id"), [*PAGE, "token_pos"], "left")
    same = F.coalesce(T.comparable(F.col("a")) == T.comparable(F.col("b")), F.lit(False))
    kind = integrity.loss_boundary(F.col("a").isNotNull(), F.col("b").isNull(), same, F.col("a") == F.col("b"), ~F.contains("a", F.lit("|")), F.col("token_id") % 11 == 0)
    return j.groupBy(kind.alias("boundary")).agg(F.count("*").alias("n"))


@query(f"""WITH u AS (SELECT DISTINCT unbundle_id, must_contain, docling.text AS dt, easyocr.text AS et FROM ocr_unbundle), c AS (SELECT unbundle_id, must_contain, et, unnest(string_split(dt, chr(10))) AS line FROM u),
v AS (SELECT unbundle_id, {_CMP.format("coalesce(line, '')")} AS v, list_transform(must_contain, lambda x: {_CMP.format("x")}) AS truth, {_CMP.format("et")} AS base FROM c),
f AS (SELECT unbundle_id, v <> '' AS bears, v <> '' AND coalesce(list_contains(truth, v), false) AS correct, v <> '' AND coalesce(contains(' ' || base || ' ', ' ' || v || ' '), false) AS dup FROM v)
SELECT unbundle_id, count_if(bears) AS n_text, count_if(correct) AS n_correct, count_if(dup) AS n_duplicate, count_if(correct AND NOT dup) AS n_novel FROM f GROUP BY 1""")
def truth_classes(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one reading against the required strings and the other reading."""
    u = table(spark, d, "ocr_unbundle").select("unbundle_id", "must_contain", F.col("docling.text").alias("dt"), F.col("easyocr.text").alias("et")).distinct()
    c = u.select("unbundle_id", "must_contain", "et", F.explode(F.split("dt", "\n")).alias("line"))
    yes = F.lit(True)
    k = integrity.truth_classes(F.col("line"), F.col("must_contain"), F.when(F.col("et").isNotNull(), F.array("et")), yes, yes, yes)
    return c.withColumns(k).groupBy("unbundle_id").agg(F.count_if("text_bearing").alias("n_text"), F.count_if("correct").alias("n_correct"), F.count_if("duplicate_baseline").alias("n_duplicate"), F.count_if("novel").alias("n_novel"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END AS parent FROM supplier), r AS (SELECT id, id AS root, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.id, r.root, r.depth + 1 FROM e JOIN r ON e.parent = r.id) SELECT id, root, CAST(depth AS BIGINT) AS depth FROM r""")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of suppliers, each derived from the one of half its number."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") > 1, F.expr("s_suppkey div 2")).alias("parent"))
    return integrity.lineage(s)


@query("""WITH p AS (SELECT DISTINCT document_id, page_index FROM quality_results), k AS (SELECT DISTINCT document_id, page_index FROM page_inputs WHERE page_input_id % 9 <> 0) SELECT document_id, count(*) AS n FROM p ANTI JOIN k USING (document_id, page_index) GROUP BY 1""")
def dangling_references(spark: SparkSession, d: str) -> DataFrame:
    """Assessed pages whose input is not there, per document."""
    key = F.struct("document_id", "page_index")
    q = table(spark, d, "quality_results").select("document_id", key.alias("page")).distinct()
    known = table(spark, d, "page_inputs").where("page_input_id % 9 <> 0").select(key.alias("page"))
    return integrity.dangling(q, "page", known, "page").groupBy("document_id").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT document_id || '/' || CAST(page_index AS VARCHAR) AS k, min(page_input_id) AS e FROM page_inputs GROUP BY 1), r AS (SELECT document_id || '/' || CAST(page_index AS VARCHAR) AS k, min(n) AS a, count(*) AS na FROM (SELECT document_id, page_index, row_number() OVER (ORDER BY document_id, page_index, assessed_at, file) AS n FROM quality_results) GROUP BY 1), j AS (SELECT * FROM e FULL JOIN r USING (k)),
o AS (SELECT count_if(p > a) AS d FROM (SELECT a, lag(a) OVER (ORDER BY e) AS p FROM j WHERE e IS NOT NULL AND a IS NOT NULL))
SELECT count(e) AS n_expected, count(a) AS n_attempted, count_if(a IS NULL) AS n_missing, count_if(e IS NULL) AS n_unexpected, count_if(na > 1) AS n_repeated, any_value(d) = 0 AS in_order FROM j, o""")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    """Pages that came in against pages that were assessed."""
    key = F.concat("document_id", F.lit("/"), F.col("page_index").cast("string")).alias("k")
    e = table(spark, d, "page_inputs").select(key, F.col("page_input_id").alias("place"))
    a = table(spark, d, "quality_results").select(key, F.row_number().over(Window.orderBy("document_id", "page_index", "assessed_at", "file")).cast("bigint").alias("place"))
    return integrity.coverage(e, a, ["k"], "place")


@query("""WITH p AS (SELECT DISTINCT document_id, page_index FROM page_inputs), q AS (SELECT DISTINCT document_id, page_index FROM quality_results) SELECT count_if(q.document_id IS NULL) AS only_first, count_if(p.document_id IS NULL) AS only_second, count_if(q.document_id IS NULL OR p.document_id IS NULL) = 0 AS equal FROM p FULL JOIN q ON p.document_id = q.document_id AND p.page_index = q.page_index""")
def population_equality(spark: SparkSession, d: str) -> DataFrame:
    return integrity.same_population(table(spark, d, "page_inputs"), table(spark, d, "quality_results"), PAGE)


@query("""SELECT grid_id, count(*) AS n FROM annotated_grids GROUP BY 1 HAVING count(*) > 1""")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Grids delivered more than once."""
    return integrity.repeated_ids(table(spark, d, "annotated_grids"), ["grid_id"])


@query("""WITH s AS (SELECT doc_id, CASE lang WHEN 'zh' THEN ' Han ' WHEN 'mixed' THEN '' ELSE lang END AS script FROM documents) SELECT CASE WHEN lower(trim(script)) = 'han' THEN 'ch_sim+en' ELSE 'en+vi' END AS languages, CASE WHEN script IS NULL OR script = '' THEN 'unavailable' WHEN lower(trim(script)) = 'han' THEN 'han' ELSE 'non_han' END AS reason, count(*) AS n FROM s GROUP BY 1, 2""")
def language_routes(spark: SparkSession, d: str) -> DataFrame:
    script = F.when(F.col("lang") == "zh", " Han ").when(F.col("lang") == "mixed", "").otherwise(F.col("lang"))
    return table(spark, d, "documents").select(routing.language_route(script).alias("r")).groupBy("r.languages", "r.reason").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT DISTINCT unbundle_id, docling.text AS base, CASE WHEN unbundle_id % 7 = 0 THEN left(docling.text, 30) WHEN unbundle_id % 5 = 0 THEN '  ' ELSE easyocr.text END AS cand, CASE WHEN unbundle_id % 13 = 0 THEN 'x' END AS err FROM ocr_unbundle)
SELECT unbundle_id, CASE WHEN err IS NOT NULL THEN 'error' WHEN cand IS NULL THEN 'missing' WHEN unbundle_id % 17 = 0 THEN 'invalid' WHEN trim(cand) = '' THEN 'empty' WHEN unbundle_id % 19 = 0 THEN 'empty_for_regions' WHEN length(regexp_replace(base, '\\s', '', 'g')) >= 40 AND length(regexp_replace(cand, '\\s', '', 'g')) < 0.5 * length(regexp_replace(base, '\\s', '', 'g')) THEN 'collapsed' END AS reason FROM u""")
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    """Why the second reading is not taken, in the order of the rules; some are spoilt by their number."""
    i = F.col("unbundle_id")
    u = table(spark, d, "ocr_unbundle").select("unbundle_id", F.col("docling.text").alias("base"), F.col("easyocr.text").alias("e")).distinct()
    cand = F.when(i % 7 == 0, F.left("base", F.lit(30))).when(i % 5 == 0, "  ").otherwise(F.col("e"))
    return u.select("unbundle_id", routing.fallback_reason(cand, F.col("base"), F.when(i % 13 == 0, "x"), i % 17 != 0, i % 19 == 0).alias("reason"))


_STATS = """s AS (SELECT document_id, page_index, source, count(*) AS n_tokens, CAST(sum(coalesce(length(regexp_replace(text, '\\s', '', 'g')), 0)) AS BIGINT) AS n_chars, bool_and(text IS NOT NULL AND coalesce(isfinite(x0) AND isfinite(y0) AND isfinite(x1) AND isfinite(y1) AND x0 <= x1 AND y0 <= y1, false) AND (confidence IS NULL OR isfinite(confidence))) AS valid, CAST(sum(coalesce(len(regexp_extract_all(text, '\\x{FFFD}')), 0)) AS BIGINT) AS n_replaced, bool_or(coalesce(regexp_matches(text, '[\\p{L}\\p{N}]'), false)) AS has_alnum FROM t GROUP BY 1, 2, 3)"""


@query(f"""{_T}, {_STATS} SELECT * FROM s""")
def token_streams(spark: SparkSession, d: str) -> DataFrame:
    return routing.token_stats(_tokens(spark, d), [*PAGE, "source"])


@query(f"""{_T}, {_STATS}, b AS (SELECT * FROM s WHERE source = 'docling'), c AS (SELECT * FROM s WHERE source = 'easyocr')
SELECT b.document_id, b.page_index, CASE WHEN c.n_tokens IS NULL THEN 'BASELINE_ONLY' WHEN NOT c.valid THEN 'SPECIALIZED_MALFORMED' WHEN c.n_chars = 0 THEN 'SPECIALIZED_EMPTY' WHEN c.n_replaced > 0.02 * c.n_chars OR NOT c.has_alnum THEN 'SPECIALIZED_SUSPICIOUS' ELSE 'SPECIALIZED_OK' END AS outcome FROM b LEFT JOIN c ON b.document_id = c.document_id AND b.page_index = c.page_index""")
def routed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    s = routing.token_stats(_tokens(spark, d), [*PAGE, "source"])
    b, c = s.where("source = 'docling'").select(*PAGE), s.where("source = 'easyocr'").drop("source")
    j = b.join(c, PAGE, "left")
    return j.select(*PAGE, routing.routed_outcome(F.col("n_tokens").isNotNull(), F.col("valid"), F.col("n_chars"), F.col("n_replaced"), F.col("has_alnum")).alias("outcome"))


@query(f"""{_T}, g AS (SELECT document_id, page_index, avg(CASE WHEN source = 'easyocr' THEN confidence END) AS ac, avg(CASE WHEN source = 'docling' THEN confidence END) AS bc, sum(len(regexp_extract_all(text, '[ăâđêôơưĂÂĐÊÔƠƯ\\x{{1EA0}}-\\x{{1EF9}}]'))) / nullif(sum(len(regexp_extract_all(text, '\\p{{L}}'))), 0) AS vi FROM t GROUP BY 1, 2),
f AS (SELECT *, coalesce(ac < 0.6, false) AS la, coalesce(bc < 0.8, false) AS lb, coalesce(vi, 0) >= 0.05 AS v FROM g)
SELECT policy, choice, count(*) AS n FROM (SELECT unnest([{{'p': 'a_always', 'c': 'a'}}, {{'p': 'b_always', 'c': 'b'}}, {{'p': 'b_if_low_confidence', 'c': CASE WHEN la THEN 'b' ELSE 'a' END}}, {{'p': 'b_if_vietnamese', 'c': CASE WHEN v THEN 'b' ELSE 'a' END}}, {{'p': 'fusion_if_apart', 'c': 'a'}}, {{'p': 'b_first_then_fusion', 'c': CASE WHEN lb THEN 'fusion' ELSE 'b' END}}, {{'p': 'b_first_then_a', 'c': CASE WHEN lb THEN 'a' ELSE 'b' END}}]) AS x FROM f) , LATERAL (SELECT x.p AS policy, x.c AS choice) GROUP BY 1, 2""")
def routing_policies(spark: SparkSession, d: str) -> DataFrame:
    """What each policy would take, over all pages; the readings' agreement is unknown here."""
    conf = lambda s: F.avg(F.when(F.col("source") == s, F.col("confidence")))
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    g = _tokens(spark, d).groupBy(*PAGE).agg(conf("easyocr").alias("ac"), conf("docling").alias("bc"), F.try_divide(n(f"[{T.VIETNAMESE}]"), n("\\p{L}")).alias("vi"))
    p = routing.policies(F.col("ac"), F.col("bc"), F.col("vi"), F.lit(None).cast("double"))
    return routing.unpivoted(g, PAGE, p, "policy", "choice").groupBy("policy", "choice").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT study_id, any_value(labels) AS labels, any_value(char_recall) AS recall, len(coalesce(any_value(missing_strings), [])) > 2 AS hall, coalesce(any_value(tables_found) = any_value(tables_expected), true) AS ok FROM case_studies GROUP BY 1), l AS (SELECT *, coalesce(labels, []) AS ls FROM c), m AS (SELECT *, list_filter(ls, lambda x: x NOT IN ('table_detection', 'table_structure', 'merged_cells', 'borderless_table')) AS tx, list_filter(ls, lambda x: x IN ('table_detection', 'table_structure', 'merged_cells', 'borderless_table')) AS tb FROM l),
r AS (SELECT study_id, CASE WHEN list_contains(ls, 'encoding') THEN 'encoding' ELSE 'other' END AS type, 0 AS level FROM m WHERE hall UNION ALL SELECT study_id, unnest(CASE WHEN len(tx) > 0 THEN tx WHEN len(ls) > 0 THEN ls ELSE ['other'] END), CASE WHEN recall = 0 THEN 0 WHEN recall < 0.5 THEN 1 ELSE 2 END FROM m WHERE recall < 1 UNION ALL SELECT study_id, unnest(CASE WHEN len(tb) > 0 THEN tb ELSE ['table_detection'] END), 1 FROM m WHERE NOT ok),
w AS (SELECT study_id, type, min(level) AS level FROM r GROUP BY 1, 2) SELECT type, ['critical', 'high', 'medium'][level + 1] AS severity, count(*) AS n FROM w GROUP BY 1, 2""")
def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """Failures by type and severity, each document's worst per type."""
    c = table(spark, d, "case_studies").dropDuplicates(["study_id"])
    f = c.select("study_id", "labels", F.col("char_recall").alias("recall"), (F.size(F.coalesce("missing_strings", F.array().cast("array<string>"))) > 2).alias("hallucinated"), F.coalesce(F.col("tables_found") == F.col("tables_expected"), F.lit(True)).alias("tables_ok"))
    return routing.failures(f, ["study_id"]).groupBy("type", "severity").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT study_id, coalesce(exact >= 0.9, false) AS a, coalesce(char_recall >= 0.9, false) AS b FROM case_studies) SELECT CASE WHEN a AND b THEN 'both_right' WHEN a THEN 'first_only' WHEN b THEN 'second_only' ELSE 'both_wrong' END AS outcome, count(*) AS n FROM c GROUP BY 1""")
def outcome_table(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "case_studies").select("study_id", F.coalesce(F.col("exact") >= 0.9, F.lit(False)).alias("a"), F.coalesce(F.col("char_recall") >= 0.9, F.lit(False)).alias("b")).distinct()
    kind = F.when(F.col("a") & F.col("b"), "both_right").when(F.col("a"), "first_only").when(F.col("b"), "second_only").otherwise("both_wrong")
    return c.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""{_CP} SELECT count(*) AS n_pages, count_if(coalesce(n_regions, 0) > 0 AND coalesce(tokens, 0) = 0) AS regions_without_tokens, count_if(coalesce(n_regions, 0) = 0 AND coalesce(tokens, 0) > 0) AS tokens_without_regions, count_if(coalesce(n_tables, 0) > 0 AND coalesce(len(table_cells), 0) = 0) AS tables_without_cells, count_if(coalesce(orphan_rate, 0) > 0.5) AS mostly_orphans FROM q""")
def trace_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of loss over all pages of the studies."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    p = _study_pages(spark, d)
    n = lambda c, name: F.count_if(c).alias(name)
    return p.agg(F.count("*").alias("n_pages"), n((z("n_regions") > 0) & (z("tokens") == 0), "regions_without_tokens"), n((z("n_regions") == 0) & (z("tokens") > 0), "tokens_without_regions"), n((z("n_tables") > 0) & (F.coalesce(F.size("table_cells"), F.lit(0)) <= 0), "tables_without_cells"), n(z("orphan_rate") > 0.5, "mostly_orphans"))


@query(f"""{_T}, g AS (SELECT document_id, page_index, source, sum(coalesce(length(text), 0)) AS chars, count(*) AS n FROM t GROUP BY 1, 2, 3) SELECT document_id, page_index, source, round(chars / n, 6) AS density FROM g WHERE chars / n < 4.5 OR chars / n > 4000""")
def density_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Pages with very few or very many characters an element."""
    g = _tokens(spark, d).groupBy(*PAGE, "source").agg((F.sum(F.coalesce(F.length("text"), F.lit(0))) / F.count("*")).alias("density"))
    return g.where("density < 4.5 or density > 4000").withColumn("density", F.round("density", 6))


@query(f"""{_CP}, fn AS (SELECT tokens > 0 AS a, n_regions > 0 AS b, n_tables > 0 AS c, len(table_cells) > 0 AS e, orphan_rate < 0.5 AS f FROM q), nn AS (SELECT count(*) AS total, count_if(coalesce(a, false)) AS n0, count_if(coalesce(a AND b, false)) AS n1, count_if(coalesce(a AND b AND c, false)) AS n2, count_if(coalesce(a AND b AND c AND e, false)) AS n3, count_if(coalesce(a AND b AND c AND e AND f, false)) AS n4 FROM fn)
SELECT unnest(['read', 'laid_out', 'tables', 'cells', 'owned']) AS stage, unnest([0, 1, 2, 3, 4]) AS place, unnest([n0, n1, n2, n3, n4]) AS n, unnest([n0, n1, n2, n3, n4]) / total AS fraction FROM nn""")
def page_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How far pages come through the stages."""
    return routing.funnel(_study_pages(spark, d), {"read": F.col("tokens") > 0, "laid_out": F.col("n_regions") > 0, "tables": F.col("n_tables") > 0, "cells": F.size("table_cells") > 0, "owned": F.col("orphan_rate") < 0.5})


@query("""WITH a AS (SELECT DISTINCT document_id, page_index, n_chars, n_words, suspicious, alpha_ratio, file FROM quality_results), b AS (SELECT document_id, page_index, CASE WHEN page_index % 3 = 1 THEN n_chars + 1 ELSE n_chars END AS n_chars, n_words, CASE WHEN page_index % 4 = 2 THEN NULL ELSE suspicious END AS suspicious FROM a),
j AS (SELECT a.document_id, a.page_index, list_filter([CASE WHEN a.n_chars IS DISTINCT FROM b.n_chars THEN 'n_chars' END, CASE WHEN a.n_words IS DISTINCT FROM b.n_words THEN 'n_words' END, CASE WHEN a.suspicious IS DISTINCT FROM b.suspicious THEN 'suspicious' END, CASE WHEN a.page_index % 7 = 6 THEN 'errors' END], lambda v: v IS NOT NULL) AS f FROM a JOIN b USING (document_id, page_index))
SELECT array_to_string(f, ',') AS differs, count(*) AS n FROM j GROUP BY 1""")
def metric_comparability(spark: SparkSession, d: str) -> DataFrame:
    """Fields in which two runs of the same pages differ; they compare only where none does."""
    a = table(spark, d, "quality_results").select(*PAGE, "n_chars", "n_words", "suspicious", "alpha_ratio", "file").distinct()
    i = F.col("page_index")
    b = a.select(*PAGE, F.when(i % 3 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("b_chars"), F.col("n_words").alias("b_words"), F.when(i % 4 != 2, F.col("suspicious")).alias("b_suspicious"))
    names = routing.comparable_metrics([("n_chars", F.col("n_chars"), F.col("b_chars")), ("n_words", F.col("n_words"), F.col("b_words")), ("suspicious", F.col("suspicious"), F.col("b_suspicious"))], F.when(i % 7 == 6, 1).otherwise(0))
    return a.join(b, PAGE).groupBy(F.array_join(names, ",").alias("differs")).agg(F.count("*").alias("n"))


@query(f"""{_T}, g AS (SELECT document_id, count(DISTINCT page_index) AS num_pages, count(*) AS num_elements, sum(coalesce(length(text), 0)) AS total_text_chars, round(avg(confidence), 6) AS mean_confidence, count_if(source = 'docling') AS n_docling, count_if(source = 'easyocr') AS n_easyocr FROM t GROUP BY 1) SELECT * FROM g""")
def document_stats(spark: SparkSession, d: str) -> DataFrame:
    """Pages, elements by source, characters and mean confidence of each document; NULL confidences don't count."""
    return metrics.document_stats(_tokens(spark, d), ["document_id"], "page_index", "text", "confidence", "source", ["docling", "easyocr"]).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(f"""{_T} SELECT a.document_id, a.page_index, a.source AS first, b.source AS second, count(*) AS n_places, count_if(a.text = b.text) AS n_equal FROM t a JOIN t b ON a.document_id = b.document_id AND a.page_index = b.page_index AND a.token_pos = b.token_pos AND a.source < b.source GROUP BY 1, 2, 3, 4""")
def reading_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of readings of a page, by position."""
    return metrics.paired_readings(_tokens(spark, d), PAGE, "source", "token_pos", "text")


@query("""WITH c AS (SELECT DISTINCT study_id, language, char_recall FROM case_studies WHERE char_recall IS NOT NULL), v AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY char_recall) - 1 AS i, count(*) OVER (PARTITION BY language) AS n FROM c)
SELECT language, any_value(n) AS n, CAST(sum(CAST(char_recall AS DECIMAL(28, 10))) AS DOUBLE) / any_value(n) AS mean, max(CASE WHEN i = greatest(0, CAST(ceil(0.5 * n) AS INT) - 1) THEN char_recall END) AS p50, max(CASE WHEN i = greatest(0, CAST(ceil(0.1 * n) AS INT) - 1) THEN char_recall END) AS p10, min(char_recall) AS worst, count_if(char_recall = 1) AS perfect, count_if(char_recall = 0) AS zero FROM v GROUP BY 1""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "case_studies").select("study_id", "language", "char_recall").distinct().where("char_recall is not null")
    return metrics.summary(c, ["language"], "char_recall")


@query("""WITH c AS (SELECT DISTINCT study_id, language, tables_expected AS e, tables_found AS f FROM case_studies WHERE tables_expected IS NOT NULL AND tables_found IS NOT NULL), k AS (SELECT language, count_if(e > 0 AND f > 0) AS tp, count_if(e = 0 AND f > 0) AS fp, count_if(e > 0 AND f = 0) AS fn, count_if(e = 0) AS clean FROM c GROUP BY 1)
SELECT language, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN clean > 0 THEN fp / clean END, 6) AS false_alarm FROM k""")
def table_gate_report(spark: SparkSession, d: str) -> DataFrame:
    """How well the presence of tables is told, per language."""
    c = table(spark, d, "case_studies").select("study_id", "language", "tables_expected", "tables_found").distinct().dropna(subset=["tables_expected", "tables_found"])
    g = metrics.gate(c, ["language"], F.col("tables_expected") > 0, F.col("tables_found") > 0)
    return g.select("language", "tp", "fp", "fn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "false_alarm")))


@query(f"""{_T}, g AS (SELECT source, count(*) AS tokens, sum(coalesce(length(text), 0)) AS chars, count(DISTINCT document_id) AS documents FROM t GROUP BY 1), u AS (SELECT source, unnest(['tokens', 'chars', 'documents']) AS metric, unnest([tokens, chars, documents]) AS v FROM g)
SELECT metric, CAST(max(CASE WHEN source = 'docling' THEN v END) AS BIGINT) AS docling, CAST(max(CASE WHEN source = 'easyocr' THEN v END) AS BIGINT) AS easyocr FROM u GROUP BY 1""")
def comparison_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Metrics down, readings across."""
    g = _tokens(spark, d).groupBy("source").agg(F.count("*").alias("tokens"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.countDistinct("document_id").alias("documents"))
    u = routing.unpivoted(g, ["source"], {c: F.col(c) for c in ("tokens", "chars", "documents")}, "metric", "v")
    return u.groupBy("metric").pivot("source", ["docling", "easyocr"]).agg(F.max("v"))


@query(f"""{_CP}, l AS (SELECT unnest(region_labels) AS label FROM q), n AS (SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS i FROM n) SELECT label, n, 1 AS n_values FROM k WHERE i <= 4 UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), count(*) FROM k WHERE i > 4 HAVING count(*) > 0""")
def frequent_labels(spark: SparkSession, d: str) -> DataFrame:
    """The four most frequent labels, and the rest as one row."""
    return routing.top_and_rest(_study_pages(spark, d).select(F.explode("region_labels").alias("label")), "label", 4)


@query("""SELECT DISTINCT l_partkey, o_orderstatus, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def artifact_origins(spark: SparkSession, d: str) -> DataFrame:
    """Distinct artifacts with what their acquisition and its resource say: three tables joined, only the needed columns read."""
    l, o, c = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).select("l_partkey", "o_orderstatus", "c_mktsegment").distinct()


@query(f"""{_T}, g AS (SELECT document_id, CAST(round_even(y1 - y0, 0) AS BIGINT) AS size, sum(length(text)) AS n FROM t WHERE text IS NOT NULL AND y1 IS NOT NULL GROUP BY 1, 2) SELECT document_id, arg_max(size, {{'n': n, 's': -size}}) AS body_size FROM g GROUP BY 1""")
def body_font_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The size in which most characters of a document are set."""
    t = _tokens(spark, d).where("text is not null and y1 is not null")
    g = t.groupBy("document_id", F.bround(F.col("y1") - F.col("y0")).cast("bigint").alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return g.groupBy("document_id").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("body_size"))


@query("""WITH p AS (SELECT DISTINCT page_input_id, coalesce(text, '') AS t FROM page_inputs), h AS (SELECT page_input_id, unnest(['Latin', 'Cyrillic', 'Greek', 'Han']) AS script, unnest([len(regexp_extract_all(t, '\\p{Latin}')), len(regexp_extract_all(t, '\\p{Cyrillic}')), len(regexp_extract_all(t, '\\p{Greek}')), len(regexp_extract_all(t, '\\p{Han}'))]) AS n FROM p) SELECT script, CAST(sum(n) AS BIGINT) AS n_chars, count_if(n > 0) AS n_pages FROM h GROUP BY 1""")
def script_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Letters of each script over all pages."""
    p = table(spark, d, "page_inputs").select("page_input_id", F.coalesce("text", F.lit("")).alias("t")).distinct()
    u = routing.unpivoted(p, ["page_input_id"], {s: F.regexp_count("t", F.lit(f"\\p{{Is{s}}}")) for s in ("Latin", "Cyrillic", "Greek", "Han")}, "script", "n")
    return u.groupBy("script").agg(F.sum("n").alias("n_chars"), F.count_if(F.col("n") > 0).alias("n_pages"))


@query(f"""{_CP}, l AS (SELECT unnest(region_labels) AS label FROM q) SELECT CASE lower(trim(label)) WHEN 'title' THEN 'heading' WHEN 'section-header' THEN 'heading' WHEN 'section_header' THEN 'heading' WHEN 'text' THEN 'text' WHEN 'paragraph' THEN 'paragraph' WHEN 'list-item' THEN 'list_item' WHEN 'list_item' THEN 'list_item' WHEN 'table' THEN 'table' WHEN 'picture' THEN 'image' WHEN 'figure' THEN 'image' WHEN 'formula' THEN 'formula' WHEN 'caption' THEN 'text' WHEN 'footnote' THEN 'text' ELSE 'other' END AS type, count(*) AS n FROM l GROUP BY 1""")
def element_types(spark: SparkSession, d: str) -> DataFrame:
    x = _study_pages(spark, d).select(F.explode("region_labels").alias("label"))
    return x.groupBy(routing.looked_up(F.col("label"), routing.ELEMENT_TYPES, "other").alias("type")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT page_input_id, regexp_replace(regexp_extract(image_path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM page_inputs) SELECT page_input_id, CASE WHEN regexp_replace(stem, '(\\.pdf|_page)?[_-][0-9]+$', '', 'i') <> stem THEN regexp_replace(stem, '(\\.pdf|_page)?[_-][0-9]+$', '', 'i') END AS source_group FROM p""")
def source_groups(spark: SparkSession, d: str) -> DataFrame:
    """The document an image's name points to; NULL where it names no page."""
    p = table(spark, d, "page_inputs").select("page_input_id", "image_path").distinct()
    return p.select("page_input_id", T.source_group(F.col("image_path")).alias("source_group"))


@query("""WITH h AS (SELECT document_id, page_index, suspicious, n_chars, alpha_ratio FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(alpha_ratio, -1) DESC, coalesce(n_chars, -1) DESC, page_index) AS n FROM quality_results) WHERE n = 1) SELECT document_id, CAST(page_index AS BIGINT) AS page_index, alpha_ratio FROM h""")
def best_pages(spark: SparkSession, d: str) -> DataFrame:
    """Of each document the best attempt, by ratio, then size, then the first."""
    q = table(spark, d, "quality_results")
    best = F.max_by(F.struct("page_index", "alpha_ratio"), F.struct(F.coalesce("alpha_ratio", F.lit(-1.0)).alias("a"), F.coalesce("n_chars", F.lit(-1)).alias("n"), (-F.col("page_index")).alias("p")))
    return q.groupBy("document_id").agg(best.alias("b")).select("document_id", F.col("b.page_index").cast("bigint").alias("page_index"), "b.alpha_ratio")


@query("""SELECT user_id, count(*) AS n, count_if(accepted) AS n_accepted, round(coalesce(max(CASE WHEN accepted THEN used END), 0), 4) AS used FROM (SELECT *, used <= 1000.0 AS accepted FROM (SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events WHERE value IS NOT NULL)) GROUP BY 1""")
def budget_stop(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user until their running sum passes a budget: nothing is accepted after."""
    return metrics.until_budget(table(spark, d, "events").where("value is not null"), ["user_id"], ["ts", "event_id"], "value", 1000.0).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.round(F.coalesce(F.max(F.when(F.col("accepted"), F.col("used"))), F.lit(0.0)), 4).alias("used"))


@query("""WITH e AS (SELECT event_id, user_id % 5 AS host, epoch_us(ts) // 1000 AS ready FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ready, event_id) - 1 AS k FROM e) SELECT event_id, max(ready - k * 90000) OVER (PARTITION BY host ORDER BY k ROWS UNBOUNDED PRECEDING) + k * 90000 AS start_ms FROM k""")
def host_pacing(spark: SparkSession, d: str) -> DataFrame:
    """When each request of a host may start, with 90 seconds between starts."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ready"))
    return metrics.paced(e, "host", "ready", "event_id", 90_000).select("event_id", F.col("start").alias("start_ms"))
