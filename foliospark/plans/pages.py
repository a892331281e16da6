"""Queries on text, boxes, readings and tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import text as T
from foliospark.operators import boxes, evidence, quality, sequences, tables
from foliospark.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAGE = ["document_id", "page_index"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_tokens").select("token_id", *PAGE, "source", "token_pos", "text", "x0", "y0", "x1", "y1", "confidence").distinct()


def _regions(t: DataFrame) -> DataFrame:
    """Boxes around runs of twelve tokens of one reading; every fifth run has none."""
    t = t.where("source = 'docling'").withColumn("region_pos", F.floor(F.col("token_pos") / 12).cast("int")).where("region_pos % 5 <> 4")
    return t.groupBy(*PAGE, "region_pos").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _doc(t: DataFrame) -> DataFrame:
    return t.where("source = 'docling'").drop("source")


_T = """WITH t AS (SELECT DISTINCT token_id, document_id, page_index, source, token_pos, text, x0, y0, x1, y1, confidence FROM ocr_tokens),
r AS (SELECT document_id, page_index, CAST(token_pos // 12 AS INT) AS region_pos, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM t WHERE source = 'docling' AND (token_pos // 12) % 5 <> 4 GROUP BY 1, 2, 3),
d AS (SELECT * FROM t WHERE source = 'docling'), e AS (SELECT * FROM t WHERE source = 'easyocr')"""
_CI = "(d.x0 + d.x1) / 2 BETWEEN r.x0 AND r.x1 AND (d.y0 + d.y1) / 2 BETWEEN r.y0 AND r.y1"
_ON = "d.document_id = r.document_id AND d.page_index = r.page_index"
_SIG = """w AS (SELECT *, list_filter(string_split_regex(t, '\\s+'), lambda x: length(x) >= 3) AS ws FROM b),
s AS (SELECT *, length(t) AS n_chars, len(regexp_extract_all(t, '\\p{L}')) AS n_alpha, len(regexp_extract_all(regexp_replace(t, '[^\\p{L}]', '', 'g'), '\\p{Latin}')) AS n_latin, len(regexp_extract_all(t, '\\x{FFFD}')) AS n_replacement, len(ws) AS n_words,
len(list_filter(ws, lambda x: (CASE WHEN regexp_matches(x, '\\p{Latin}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '\\p{Cyrillic}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '\\p{Greek}') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '\\p{Han}') THEN 1 ELSE 0 END) > 1)) AS n_mixed FROM w)"""
_L = "CASE WHEN n_alpha > 0 THEN round((n_alpha - n_latin) / n_alpha, 6) ELSE 0.0 END"


@query(f"""WITH b AS (SELECT DISTINCT doc_id, source, coalesce(text, '') AS t FROM documents), {_SIG}
SELECT doc_id, n_chars, n_alpha, n_words, n_replacement, CASE WHEN n_chars > 0 THEN round(n_alpha / n_chars, 6) ELSE 0.0 END AS alpha_ratio, {_L} AS unexpected_script_ratio FROM s""")
def text_quality_report(spark: SparkSession, d: str) -> DataFrame:
    q = quality.signals(table(spark, d, "documents").select("doc_id", "text").distinct(), normalise=False)
    return q.select("doc_id", F.col("n_chars"), "n_alpha", "n_words", "n_replacement", F.round("alpha_ratio", 6).alias("alpha_ratio"), F.round("unexpected_script_ratio", 6).alias("unexpected_script_ratio"))


@query(f"""WITH b AS (SELECT DISTINCT doc_id, source, coalesce(text, '') AS t FROM documents), {_SIG}
SELECT source, count(*) AS n_docs, sum(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END) AS n_short, sum(n_chars) AS n_chars, round(avg(CASE WHEN n_chars > 0 THEN n_alpha / n_chars ELSE 0.0 END), 6) AS alpha_ratio FROM s GROUP BY source""")
def text_quality_by_source(spark: SparkSession, d: str) -> DataFrame:
    """No source is a group of its own."""
    q = quality.signals(table(spark, d, "documents").select("doc_id", "source", "text").distinct(), normalise=False)
    return q.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_chars") < 200).alias("n_short"), F.sum("n_chars").alias("n_chars"), F.round(F.avg("alpha_ratio"), 6).alias("alpha_ratio"))


@query()
def text_quality_pages(spark: SparkSession, d: str) -> DataFrame:
    """All signals after normalisation, with reasons and verdict."""
    return quality.signals(table(spark, d, "page_inputs").select("page_input_id", "text").distinct()).drop("text")


@query("""WITH q AS (SELECT DISTINCT document_id, page_index, n_chars, suspicious, reasons FROM quality_results)
SELECT CASE WHEN suspicious IS NULL THEN NULL WHEN n_chars = 0 OR reasons = ['insufficient_text'] THEN NULL WHEN suspicious THEN 'suspicious' ELSE 'trusted' END AS verdict, count(*) AS n FROM q GROUP BY 1""")
def verification_summary(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quality_results").select(*PAGE, "n_chars", "suspicious", "reasons").distinct()
    v = F.when(F.col("suspicious").isNotNull(), quality.text_verdict(F.col("suspicious"), F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("n_chars", F.lit(-1))))
    return q.select(v.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT DISTINCT document_id, page_index, n_chars, suspicious FROM quality_results), f AS (SELECT document_id, avg(CASE WHEN n_chars >= 200 THEN 1.0 ELSE 0.0 END) AS tr, avg(CASE WHEN suspicious THEN 1.0 ELSE 0.0 END) AS sr FROM q GROUP BY 1)
SELECT document_id, round(tr, 6) AS text_page_ratio, round(sr, 6) AS suspicious_page_ratio, CASE WHEN tr < 0.6 THEN 'scanned_pdf' WHEN sr > 0.34 THEN 'scanned_pdf' ELSE 'digital_pdf' END AS route FROM f""")
def document_routes(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "quality_results").select(*PAGE, "n_chars", "suspicious").distinct()
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    f = q.groupBy("document_id").agg(flag(F.col("n_chars") >= 200).alias("tr"), flag(F.col("suspicious")).alias("sr"))
    return f.select("document_id", F.round("tr", 6).alias("text_page_ratio"), F.round("sr", 6).alias("suspicious_page_ratio"), quality.route(F.lit("pdf"), F.col("tr"), F.col("sr")).alias("route"))


@query(f"""{_T}, p AS (SELECT document_id, page_index, source, list_distinct(list_filter(string_split_regex(lower(string_agg(text, ' ' ORDER BY token_pos, token_id)), '[^0-9a-z\\x{{E0}}-\\x{{1EF9}}]+'), lambda x: x <> '')) AS ws FROM t GROUP BY 1, 2, 3)
SELECT a.document_id, a.page_index, len(a.ws) AS n_docling, len(b.ws) AS n_easyocr, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 6) AS agreement FROM p a JOIN p b ON a.document_id = b.document_id AND a.page_index = b.page_index AND a.source = 'docling' AND b.source = 'easyocr'""")
def reading_agreement(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_sort(F.collect_list(F.struct("token_pos", "token_id", "text")))
    p = _tokens(spark, d).groupBy(*PAGE, "source").agg(T.word_set(F.array_join(F.transform(words, lambda w: w["text"]), " ")).alias("ws"))
    a, b = (p.where(F.col("source") == s).select(*PAGE, F.col("ws").alias(s)) for s in ("docling", "easyocr"))
    return a.join(b, PAGE).select(*PAGE, F.size("docling").alias("n_docling"), F.size("easyocr").alias("n_easyocr"), F.round(T.jaccard(F.col("docling"), F.col("easyocr")), 6).alias("agreement"))


@query()
def reading_order_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Share of words in the same order, and similarity by matching blocks, of two readings."""
    words = F.array_sort(F.collect_list(F.struct("token_pos", "token_id", "text")))
    p = _tokens(spark, d).groupBy(*PAGE, "source").agg(F.transform(words, lambda w: F.lower(w["text"])).alias("ws"))
    a, b = (p.where(F.col("source") == s).select(*PAGE, F.col("ws").alias(s)) for s in ("docling", "easyocr"))
    return a.join(b, PAGE).select(*PAGE, T.order_consistency("docling", "easyocr").alias("order_share"), T.sequence_ratio(F.array_join("docling", " "), F.array_join("easyocr", " ")).alias("ratio"))


@query(f"""{_T}, p AS (SELECT d.text AS a, e.text AS b FROM d JOIN e USING (document_id, page_index, token_pos)),
k AS (SELECT CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN 'identical' WHEN regexp_full_match(a, '\\s*') AND regexp_full_match(b, '\\s*') THEN 'whitespace' WHEN b = '' THEN 'deletion' WHEN a = '' THEN 'insertion' WHEN nfc_normalize(a) = nfc_normalize(b) THEN 'unicode_norm' WHEN lower(upper(a)) = lower(upper(b)) THEN 'case' WHEN lower(strip_accents(a)) = lower(strip_accents(b)) THEN 'diacritic'
WHEN regexp_matches(a, '\\p{{Nd}}') AND NOT regexp_matches(a, '\\p{{L}}') AND regexp_matches(b, '\\p{{L}}') OR regexp_matches(b, '\\p{{Nd}}') AND NOT regexp_matches(b, '\\p{{L}}') AND regexp_matches(a, '\\p{{L}}') THEN 'digit_letter'
WHEN NOT regexp_matches(a || b, '[\\p{{L}}\\p{{N}}\\s]') THEN 'punctuation' ELSE 'substitution' END AS kind FROM p) SELECT kind, count(*) AS n FROM k GROUP BY 1""")
def edit_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How the second reading's word differs, of tokens at the same place."""
    t = _tokens(spark, d)
    a, b = (t.where(F.col("source") == s).select(*PAGE, "token_pos", F.col("text").alias(s)) for s in ("docling", "easyocr"))
    return a.join(b, [*PAGE, "token_pos"]).select(T.edit_kinds("docling", "easyocr").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT hard_case_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(notes, ''), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'file') AS slug, regexp_replace(filename, '\\.[^.]*$', '.md') AS prediction_file, string_split(filename, '.')[-1] AS extension FROM hard_cases""")
def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hard_cases")
    return h.select("hard_case_id", T.slug(F.coalesce("notes", F.lit(""))).alias("slug"), F.regexp_replace("filename", "\\.[^.]*$", ".md").alias("prediction_file"), F.element_at(F.split("filename", "\\."), -1).alias("extension")).distinct()


@query("""SELECT DISTINCT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS dense_length, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed_length, len(regexp_extract_all(text, '[ăâđêôơưĂÂĐÊÔƠƯ\\x{1EA0}-\\x{1EF9}]')) AS n_vietnamese, length(replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), ' ')) AS markdown_length FROM documents WHERE text IS NOT NULL""")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.dense_length(t).alias("dense_length"), F.length(T.collapsed(t)).alias("collapsed_length"), F.regexp_count(t, F.lit(f"[{T.VIETNAMESE}]")).alias("n_vietnamese"), F.length(T.markdown_escape(t)).alias("markdown_length")).distinct()


@query(f"""{_T} SELECT d.token_id, r.region_pos FROM d JOIN r ON {_ON} AND {_CI}""")
def center_containment(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return boxes.inside(_doc(t), _regions(t), PAGE).select(F.col("a_token_id").alias("token_id"), F.col("b_region_pos").alias("region_pos"))


@query(f"""{_T} SELECT d.token_id FROM d WHERE EXISTS (SELECT 1 FROM r WHERE {_ON} AND {_CI})""")
def owned_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    own = boxes.inside(_doc(t), _regions(t), PAGE).select(F.col("a_token_id").alias("token_id"))
    return _doc(t).join(own, "token_id", "left_semi").select("token_id")


@query(f"""{_T} SELECT d.token_id FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_ON} AND {_CI})""")
def orphan_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    own = boxes.inside(_doc(t), _regions(t), PAGE).select(F.col("a_token_id").alias("token_id"))
    return _doc(t).join(own, "token_id", "left_anti").select("token_id")


@query(f"""{_T}, c AS (SELECT d.token_id, count(*) AS n, count(*) > 1 AS multiple FROM d JOIN r ON {_ON} AND {_CI} GROUP BY 1)
SELECT CASE WHEN c.n IS NULL THEN 'EXCLUDED' WHEN c.n = 1 THEN 'ACCEPTED' ELSE 'UNRESOLVED' END AS disposition, count(*) AS n FROM d LEFT JOIN c USING (token_id) GROUP BY 1""")
def claims_disposition(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    n = boxes.inside(_doc(t), _regions(t), PAGE).groupBy(F.col("a_token_id").alias("token_id")).agg(F.count("*").alias("k"))
    kind = evidence.disposition(F.coalesce("k", F.lit(0)), F.lit(False))
    return _doc(t).join(n, "token_id", "left").select(kind.alias("disposition")).groupBy("disposition").agg(F.count("*").alias("n"))


@query(f"""{_T}, m AS (SELECT d.token_id, min(r.region_pos) AS region_pos, count(*) AS n FROM d JOIN r ON {_ON} AND (d.x0 + d.x1) / 2 BETWEEN r.x0 - 3 AND r.x1 + 3 AND (d.y0 + d.y1) / 2 BETWEEN r.y0 - 3 AND r.y1 + 3 GROUP BY 1)
SELECT token_id, region_pos FROM m WHERE n = 1""")
def unique_margin_match(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return boxes.unique_near(_doc(t), _regions(t), PAGE, "token_id", 3.0).select(F.col("a_token_id").alias("token_id"), F.col("b_region_pos").alias("region_pos"))


@query(f"""{_T} SELECT r.document_id, r.page_index, r.region_pos, string_agg(d.text, ' ' ORDER BY d.token_pos, d.text) AS text, count(*) AS n_tokens FROM d JOIN r ON {_ON} AND {_CI} GROUP BY 1, 2, 3""")
def region_text(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return boxes.region_text(boxes.inside(_doc(t), _regions(t), PAGE), PAGE).withColumnRenamed("b_region_pos", "region_pos")


_FR = "greatest(0, least(d.x1, r.x1) - greatest(d.x0, r.x0)) * greatest(0, least(d.y1, r.y1) - greatest(d.y0, r.y0)) / ((d.x1 - d.x0) * (d.y1 - d.y0))"


@query(f"""{_T}, f AS (SELECT d.token_id, r.region_pos, {_FR} AS frac FROM d JOIN r ON {_ON} WHERE d.x1 > d.x0 AND d.y1 > d.y0), k AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY frac DESC, region_pos) AS n FROM f WHERE frac > 0)
SELECT token_id, region_pos, round(frac, 6) AS frac FROM k WHERE n = 1 AND frac >= 0.4""")
def argmax_region(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    return boxes.best_overlap(_doc(t), _regions(t), PAGE, "token_id", "region_pos", 0.4).select(F.col("a_token_id").alias("token_id"), F.col("b_region_pos").alias("region_pos"), F.round("frac", 6).alias("frac"))


@query(f"""{_T}, p AS (SELECT a.document_id, a.page_index, a.region_pos AS pos_a, b.region_pos AS pos_b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab FROM r a JOIN r b ON a.document_id = b.document_id AND a.page_index = b.page_index AND a.region_pos < b.region_pos)
SELECT document_id, page_index, pos_a, pos_b, round(i / (aa + ab - i), 6) AS iou, round(i / aa, 6) AS of_a, round(i / ab, 6) AS of_b FROM p WHERE i > 0""")
def box_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(_tokens(spark, d))
    a, b = G.Box.of("a_"), G.Box.of("b_")
    p = boxes.box_join(boxes.prefixed(r, "a_", PAGE), boxes.prefixed(r, "b_", PAGE), PAGE, (F.col("a_region_pos") < F.col("b_region_pos")) & (G.intersection(a, b) > 0))
    return p.select(*PAGE, F.col("a_region_pos").alias("pos_a"), F.col("b_region_pos").alias("pos_b"), F.round(G.iou(a, b), 6).alias("iou"), F.round(G.containment(a, b), 6).alias("of_a"), F.round(G.containment(b, a), 6).alias("of_b"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    both = t.groupBy(*PAGE).agg(F.countDistinct("source").alias("n")).where("n = 2").select(*PAGE)
    t = t.join(both, PAGE, "left_semi")
    return evidence.fusion_groups(t.where("source = 'docling'"), t.where("source = 'easyocr'"), PAGE)


_WS = "list_distinct(list_filter(string_split_regex(lower({}), '[^0-9a-z\\x{{E0}}-\\x{{1EF9}}]+'), lambda x: x <> ''))"


_DUAL = f"""{_T}, two AS (SELECT document_id, page_index FROM t GROUP BY 1, 2 HAVING count(DISTINCT source) = 2), d2 AS (SELECT d.* FROM d JOIN two USING (document_id, page_index)), e2 AS (SELECT e.* FROM e JOIN two USING (document_id, page_index)),
f AS (SELECT d.document_id, d.page_index, d.token_pos AS fine_pos, r.token_pos AS anchor_pos, d.text, d.y0, d.x0, d.confidence, {_FR} AS frac FROM e2 d JOIN d2 r ON {_ON} WHERE d.x1 > d.x0 AND d.y1 > d.y0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_index, fine_pos ORDER BY frac DESC, anchor_pos) AS n FROM f WHERE frac > 0) WHERE n = 1 AND frac >= 0.4),
h AS (SELECT document_id, page_index, anchor_pos, string_agg(text, ' ' ORDER BY y0, x0, fine_pos) AS ft, avg(confidence) AS fc, count(*) AS nf FROM k GROUP BY 1, 2, 3),
g AS (SELECT d2.document_id, d2.page_index, 'anchor' AS side, d2.token_pos, d2.text AS anchor_text, coalesce(h.ft, '') AS fine_text, h.fc AS fine_confidence, 1 AS n_anchor, coalesce(h.nf, 0) AS n_fine FROM d2 LEFT JOIN h ON d2.document_id = h.document_id AND d2.page_index = h.page_index AND d2.token_pos = h.anchor_pos
UNION ALL SELECT e2.document_id, e2.page_index, 'fine', e2.token_pos, '', e2.text, e2.confidence, 0, 1 FROM e2 WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document_id = e2.document_id AND k.page_index = e2.page_index AND k.fine_pos = e2.token_pos)),
w AS (SELECT *, {_WS.format("anchor_text")} AS wa, {_WS.format("fine_text")} AS wf FROM g), s AS (SELECT *, CASE WHEN len(list_concat(wa, wf)) = 0 THEN 1.0 ELSE len(list_intersect(wa, wf)) / len(list_distinct(list_concat(wa, wf))) END AS similarity FROM w),
z AS (SELECT *, CASE WHEN n_fine = 0 THEN 'single_anchor' WHEN n_anchor = 0 THEN 'single_fine' WHEN similarity >= 0.7 THEN 'keep_both_agree' WHEN similarity < 0.3 THEN 'conflict' ELSE 'keep_both_partial' END AS decision FROM s)"""


@query(f"""{_DUAL} SELECT document_id, page_index, side, token_pos, anchor_text, fine_text, round(fine_confidence, 9) AS fine_confidence, n_anchor, n_fine, similarity, decision, CASE WHEN decision = 'conflict' THEN 'conflict' WHEN decision = 'keep_both_partial' OR coalesce(decision = 'single_fine' AND fine_confidence < 0.4, false) THEN 'suspicious' ELSE 'trusted' END AS status FROM z""")
def fusion_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).withColumn("fine_confidence", F.round("fine_confidence", 9))


@query(f"""{_T}, two AS (SELECT document_id, page_index FROM t GROUP BY 1, 2 HAVING count(DISTINCT source) = 2), d2 AS (SELECT d.* FROM d JOIN two USING (document_id, page_index)), e2 AS (SELECT e.* FROM e JOIN two USING (document_id, page_index)),
f AS (SELECT d.document_id, d.page_index, d.token_pos AS fine_pos, r.token_pos AS anchor_pos, d.text, d.y0, d.x0, {_FR} AS frac FROM e2 d JOIN d2 r ON {_ON} WHERE d.x1 > d.x0 AND d.y1 > d.y0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_index, fine_pos ORDER BY frac DESC, anchor_pos) AS n FROM f WHERE frac > 0) WHERE n = 1 AND frac >= 0.4),
h AS (SELECT document_id, page_index, anchor_pos, string_agg(text, ' ' ORDER BY y0, x0, fine_pos) AS ft FROM k GROUP BY 1, 2, 3),
g AS (SELECT d2.document_id, d2.page_index, 1 AS na, CASE WHEN h.ft IS NULL THEN 0 ELSE 1 END AS nf, {_WS.format("d2.text")} AS wa, {_WS.format("coalesce(h.ft, '')")} AS wf FROM d2 LEFT JOIN h ON d2.document_id = h.document_id AND d2.page_index = h.page_index AND d2.token_pos = h.anchor_pos
UNION ALL SELECT e2.document_id, e2.page_index, 0, 1, [], [] FROM e2 WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document_id = e2.document_id AND k.page_index = e2.page_index AND k.fine_pos = e2.token_pos)),
s AS (SELECT *, CASE WHEN len(list_concat(wa, wf)) = 0 THEN 1.0 ELSE len(list_intersect(wa, wf)) / len(list_distinct(list_concat(wa, wf))) END AS sim FROM g),
c AS (SELECT document_id, page_index, CASE WHEN nf = 0 THEN 'a' WHEN na = 0 THEN 'f' WHEN sim >= 0.7 THEN 'g' WHEN sim < 0.3 THEN 'c' ELSE 'p' END AS k FROM s)
SELECT document_id, page_index, count(*) AS n_groups, count_if(k = 'a') AS n_single_anchor, count_if(k = 'f') AS n_single_fine, count_if(k = 'g') AS n_keep_both_agree, count_if(k = 'p') AS n_keep_both_partial, count_if(k = 'c') AS n_conflict, round(CASE WHEN count_if(k IN ('g', 'p', 'c')) > 0 THEN count_if(k = 'c') / count_if(k IN ('g', 'p', 'c')) ELSE 0.0 END, 6) AS conflict_rate FROM c GROUP BY 1, 2""")
def fusion_summary(spark: SparkSession, d: str) -> DataFrame:
    return evidence.fusion_summary(_groups(spark, d), PAGE).withColumn("conflict_rate", F.round("conflict_rate", 6))


@query(f"""{_T}, p AS (SELECT document_id, page_index, source, list_distinct(list_filter(string_split_regex(lower(string_agg(text, ' ' ORDER BY token_pos, token_id)), '[^0-9a-z\\x{{E0}}-\\x{{1EF9}}]+'), lambda x: x <> '')) AS ws, string_agg(text, ' ' ORDER BY token_pos, token_id) AS tx FROM t GROUP BY 1, 2, 3),
j AS (SELECT a.document_id, a.page_index, a.tx AS old, b.tx AS new, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) AS ag FROM p a JOIN p b ON a.document_id = b.document_id AND a.page_index = b.page_index AND a.source = 'docling' AND b.source = 'easyocr')
SELECT document_id, page_index, CASE WHEN ag < 0.5 THEN 'suspicious' ELSE 'trusted' END AS verdict, CASE WHEN ag >= 0.5 THEN 'skipped' WHEN length(new) > 0 AND new <> old AND ag >= 0.3 THEN 'replaced' ELSE 'kept' END AS decision FROM j""")
def recovery_decisions(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_sort(F.collect_list(F.struct("token_pos", "token_id", "text")))
    p = _tokens(spark, d).groupBy(*PAGE, "source").agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("tx"))
    a, b = (p.where(F.col("source") == s).select(*PAGE, F.col("tx").alias(n)) for s, n in (("docling", "old"), ("easyocr", "new")))
    j = a.join(b, PAGE).withColumn("ag", T.jaccard(T.word_set(F.col("old")), T.word_set(F.col("new"))))
    fused = evidence.decision(F.lit(1), F.lit(1), F.col("ag"))
    return j.select(*PAGE, quality.agreement_verdict(F.col("ag")).alias("verdict"), evidence.scan_recovery(F.col("ag"), F.col("new"), F.col("old"), F.lit(False), fused).alias("decision"))


@query(f"""{_T}, o AS (SELECT *, max(y1) OVER w AS reach FROM d WINDOW w AS (PARTITION BY document_id, page_index ORDER BY y0, x0, token_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_index ORDER BY y0, x0, token_id) AS seg FROM o), u AS (SELECT document_id, page_index, seg, min(y0) AS top FROM g GROUP BY 1, 2, 3),
q AS (SELECT document_id, page_index, list(top ORDER BY top) AS tops FROM u GROUP BY 1, 2),
f AS (SELECT document_id, page_index, list_reduce(list_transform(tops, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] > 4.0 THEN list_concat(acc, x) ELSE acc END) AS starts FROM q)
SELECT g.token_id, CAST(len(list_filter(f.starts, lambda s: s <= u.top)) - 1 AS INT) AS band FROM g JOIN u USING (document_id, page_index, seg) JOIN f ON f.document_id = g.document_id AND f.page_index = g.page_index""")
def row_bands(spark: SparkSession, d: str) -> DataFrame:
    return sequences.row_bands(_doc(_tokens(spark, d)), PAGE, "token_id").select("token_id", "band")


@query(f"""{_T}, w AS (SELECT *, max(x1) OVER (PARTITION BY document_id, page_index) AS wd FROM r), n AS (SELECT * FROM w WHERE x1 - x0 < 0.8 * wd), g AS (SELECT document_id, page_index, wd, x0 - max(x1) OVER (PARTITION BY document_id, page_index ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap, max(x1) OVER (PARTITION BY document_id, page_index ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n),
b AS (SELECT document_id, page_index, max(wd) AS wd, max(CASE WHEN gap > 0 THEN gap END) AS gap FROM g GROUP BY 1, 2), f AS (SELECT b.document_id, b.page_index, b.wd, b.gap, min(g.reach) AS reach FROM b LEFT JOIN g ON g.document_id = b.document_id AND g.page_index = b.page_index AND g.gap = b.gap GROUP BY 1, 2, 3, 4)
SELECT document_id, page_index, round(CASE WHEN gap >= 0.06 * wd THEN reach + gap / 2 END, 6) AS gutter_x FROM f""")
def gutters(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(_tokens(spark, d)).withColumn("wd", F.max("x1").over(Window.partitionBy(*PAGE)))
    return sequences.gutter(r, PAGE, "wd").withColumn("gutter_x", F.round("gutter_x", 6))


@query(f"""{_T}, c AS (SELECT *, x0 - lag(x1) OVER q AS gap, abs(y1 - lag(y1) OVER q) AS dy FROM d WINDOW q AS (PARTITION BY document_id, page_index ORDER BY token_pos, token_id))
SELECT token_id, sum(CASE WHEN gap < -0.5 OR gap > 1.2 * (y1 - y0) OR dy > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_index ORDER BY token_pos, token_id) AS run FROM c""")
def span_split(spark: SparkSession, d: str) -> DataFrame:
    t = _doc(_tokens(spark, d)).withColumn("size", F.col("y1") - F.col("y0")).withColumn("origin_y", F.col("y1"))
    return sequences.split_runs(t.withColumn("pos", F.struct("token_pos", "token_id")), PAGE, "pos").select("token_id", "run")


@query(f"""{_T}, q AS (SELECT document_id, page_index, region_pos % 7 AS row_no, min(y0) AS y, min(region_pos) AS f FROM r GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_index ORDER BY y, f) - 1 AS new_row FROM q)
SELECT r.document_id, r.page_index, r.region_pos, k.new_row FROM r JOIN k ON r.document_id = k.document_id AND r.page_index = k.page_index AND r.region_pos % 7 = k.row_no""")
def renumber_rows(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(_tokens(spark, d)).withColumn("row_no", F.col("region_pos") % 7)
    return sequences.renumbered(r, PAGE, "row_no", "region_pos").select(*PAGE, "region_pos", "new_row")


@query()
def line_bands(spark: SparkSession, d: str) -> DataFrame:
    return sequences.line_bands(_doc(_tokens(spark, d)), PAGE, "token_id")


@query()
def row_clusters(spark: SparkSession, d: str) -> DataFrame:
    return sequences.row_clusters(_doc(_tokens(spark, d)), PAGE, "token_id")


@query()
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    r = _regions(_tokens(spark, d)).withColumn("wd", F.max("x1").over(Window.partitionBy(*PAGE)))
    return sequences.page_order(r, PAGE, "region_pos", "wd")


@query()
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    t = _tokens(spark, d)
    a, b = (t.where(F.col("source") == s).drop("source", "text", "confidence") for s in ("docling", "easyocr"))
    pairs = boxes.box_join(boxes.prefixed(a, "a_", PAGE), boxes.prefixed(b, "b_", PAGE), PAGE).withColumn("iou", G.iou(G.Box.of("a_"), G.Box.of("b_"))).where("iou >= 0.5")
    return sequences.greedy_match(pairs.select(*PAGE, "a_token_pos", "b_token_pos", "iou"), PAGE, "a_token_pos", "b_token_pos", "iou", 0.5)


_CELLS = """WITH g AS (SELECT DISTINCT grid_id, grid, spans FROM annotated_grids), r AS (SELECT grid_id, unnest(grid) AS row_cells, generate_subscripts(grid, 1) - 1 AS "row" FROM g), c AS (SELECT grid_id, "row", unnest(row_cells) AS text, generate_subscripts(row_cells, 1) - 1 AS col FROM r)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return tables.cells(table(spark, d, "annotated_grids").select("grid_id", "grid").distinct(), "grid_id")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "annotated_grids").select("grid_id", "spans").distinct()
    return g.select("grid_id", F.inline("spans"))


@query(f"""{_CELLS} SELECT grid_id, "row", col, text FROM c""")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query(f"""{_CELLS}, k AS (SELECT grid_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS x FROM c) SELECT grid_id, count(*) AS n_cells, count_if(length(x) > 0) AS n_filled, round(avg(CASE WHEN length(x) > 0 THEN 1.0 ELSE 0.0 END), 6) AS fill_rate, round(avg(CASE WHEN length(x) > 0 THEN length(x) END), 6) AS mean_length FROM k GROUP BY 1""")
def table_fill(spark: SparkSession, d: str) -> DataFrame:
    return tables.fill_features(_cells(spark, d), ["grid_id"]).withColumn("fill_rate", F.round("fill_rate", 6)).withColumn("mean_length", F.round("mean_length", 6))


@query("""WITH g AS (SELECT DISTINCT grid_id, spans FROM annotated_grids), s AS (SELECT grid_id, unnest(spans) AS s FROM g), p AS (SELECT grid_id, s.row_at AS r0, s.col_at AS c0, greatest(1, coalesce(s.row_span, 1)) AS rs, greatest(1, coalesce(s.col_span, 1)) AS cs FROM s),
q AS (SELECT grid_id, c0, cs, unnest(range(r0, r0 + rs)) AS slot_row FROM p), k AS (SELECT grid_id, slot_row, unnest(range(c0, c0 + cs)) AS slot_col FROM q)
SELECT grid_id, count(*) AS n_slots, count(DISTINCT (slot_row, slot_col)) AS n_distinct FROM k GROUP BY 1""")
def span_slots(spark: SparkSession, d: str) -> DataFrame:
    s = tables.slots(_spans(spark, d), ["grid_id"])
    return s.groupBy("grid_id").agg(F.count("*").alias("n_slots"), F.countDistinct("slot_row", "slot_col").alias("n_distinct"))


@query("""WITH g AS (SELECT DISTINCT grid_id, spans FROM annotated_grids), s AS (SELECT grid_id, unnest(spans) AS s FROM g), p AS (SELECT grid_id, s.row_at AS r0, s.col_at AS c0, greatest(1, coalesce(s.row_span, 1)) AS rs, greatest(1, coalesce(s.col_span, 1)) AS cs FROM s UNION ALL SELECT grid_id, s.row_at, s.col_at, 2, 2 FROM s WHERE grid_id % 4 = 0),
q AS (SELECT grid_id, c0, cs, unnest(range(r0, r0 + rs)) AS slot_row FROM p), k AS (SELECT grid_id, slot_row, unnest(range(c0, c0 + cs)) AS slot_col FROM q) SELECT grid_id, slot_row, slot_col, count(*) AS n FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Slots that spans share; every fourth grid gets a second span of two by two at each of its own."""
    s = _spans(spark, d)
    planted = s.where(F.col("grid_id") % 4 == 0).withColumns({"row_span": F.lit(2), "col_span": F.lit(2)})
    return tables.overlaps(s.unionByName(planted), ["grid_id"])


@query(f"""{_CELLS}, l AS (SELECT grid_id, "row", '| ' || string_agg(coalesce(text, ''), ' | ' ORDER BY col) || ' |' AS line, count(*) AS n, row_number() OVER (PARTITION BY grid_id ORDER BY "row") AS k FROM c GROUP BY grid_id, "row")
SELECT grid_id, string_agg(line || CASE WHEN k = 1 THEN chr(10) || '|' || repeat(' --- |', CAST(n AS INT)) ELSE '' END, chr(10) ORDER BY "row") AS markdown FROM l GROUP BY 1""")
def grid_markdown(spark: SparkSession, d: str) -> DataFrame:
    return tables.markdown(_cells(spark, d), ["grid_id"])


_SPANNED = f"""{_CELLS}, sp AS (SELECT grid_id, s.row_at AS "row", s.col_at AS col, max(s.row_span) AS row_span, max(s.col_span) AS col_span FROM (SELECT grid_id, unnest(spans) AS s FROM g) GROUP BY 1, 2, 3),
cs AS (SELECT c.grid_id, c."row", c.col, c.text, greatest(1, coalesce(row_span, 1)) AS rs, greatest(1, coalesce(col_span, 1)) AS sc FROM c LEFT JOIN sp ON c.grid_id = sp.grid_id AND c."row" = sp."row" AND c.col = sp.col)"""


def _spanned(spark: SparkSession, d: str) -> DataFrame:
    sizes = _spans(spark, d).groupBy("grid_id", F.col("row_at").alias("row"), F.col("col_at").alias("col")).agg(F.max("row_span").alias("row_span"), F.max("col_span").alias("col_span"))
    return _cells(spark, d).join(sizes, ["grid_id", "row", "col"], "left")


_ESC = "replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(f"""{_SPANNED}, o1 AS (SELECT grid_id, col, sc, unnest(range("row", "row" + rs)) AS sr FROM cs), o2 AS (SELECT grid_id, sr, unnest(range(col, col + sc)) AS sk FROM o1), ov AS (SELECT grid_id, sr, sk, count(*) AS n FROM o2 GROUP BY 1, 2, 3), sh AS (SELECT grid_id, max(sr) + 1 AS nr, max(sk) + 1 AS nk, max(n) > 1 AS bad FROM ov GROUP BY 1),
h1 AS (SELECT grid_id, nk, unnest(range(0, nr)) AS sr FROM sh), h2 AS (SELECT grid_id, sr, unnest(range(0, nk)) AS sk FROM h1), td AS (SELECT grid_id, "row" AS sr, col AS sk, '<td' || CASE WHEN rs > 1 THEN ' rowspan="' || CAST(rs AS VARCHAR) || '"' ELSE '' END || CASE WHEN sc > 1 THEN ' colspan="' || CAST(sc AS VARCHAR) || '"' ELSE '' END || '>' || {_ESC} || '</td>' AS td FROM cs UNION ALL SELECT grid_id, sr, sk, '<td></td>' FROM h2 WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.grid_id = h2.grid_id AND ov.sr = h2.sr AND ov.sk = h2.sk)),
tr AS (SELECT grid_id, sr, '<tr>' || string_agg(td, '' ORDER BY sk, td) || '</tr>' AS tr FROM td GROUP BY 1, 2) SELECT grid_id, CASE WHEN NOT any_value(bad) THEN '<table>' || string_agg(tr, '' ORDER BY sr) || '</table>' END AS html FROM tr JOIN sh USING (grid_id) GROUP BY 1""")
def grid_html(spark: SparkSession, d: str) -> DataFrame:
    return tables.html(_spanned(spark, d), ["grid_id"])


@query(f"""{_SPANNED} SELECT grid_id, CASE WHEN bool_or(rs > 1 OR sc > 1 OR coalesce(regexp_matches(text, '[|\\r\\n]'), false)) THEN 'html' ELSE 'markdown' END AS form FROM cs GROUP BY 1""")
def grid_forms(spark: SparkSession, d: str) -> DataFrame:
    """Which form can say each grid."""
    return tables.written(_spanned(spark, d), ["grid_id"]).select("grid_id", "form")


@query(f"""{_SPANNED}, k AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY "row", col) AS pos, max("row") OVER (PARTITION BY grid_id) + 1 AS nr, max(col) OVER (PARTITION BY grid_id) + 1 AS nk FROM cs), o1 AS (SELECT *, unnest(range("row", least("row" + rs, nr))) AS r FROM k), o2 AS (SELECT *, unnest(range(col, least(col + sc, nk))) AS c FROM o1)
SELECT grid_id, r, c, arg_max({{'t': text}}, pos).t AS text FROM o2 GROUP BY 1, 2, 3""")
def dense_grid(spark: SparkSession, d: str) -> DataFrame:
    c = _spanned(spark, d)
    w = Window.partitionBy("grid_id")
    c = c.withColumn("pos", F.row_number().over(w.orderBy("row", "col"))).withColumn("nr", F.max("row").over(w) + 1).withColumn("nc", F.max("col").over(w) + 1)
    return tables.dense(c, ["grid_id"], F.col("nr"), F.col("nc"))


@query(f"""{_CELLS}, p AS (SELECT grid_id, "row", col, CASE WHEN (grid_id + "row") % 19 = 0 THEN text || 'x' ELSE text END AS text FROM c WHERE (grid_id + col) % 17 <> 0),
j AS (SELECT coalesce(c.grid_id, p.grid_id) AS grid_id, c.grid_id AS t, p.grid_id AS q, c.text AS a, p.text AS b FROM c FULL JOIN p ON c.grid_id = p.grid_id AND c."row" = p."row" AND c.col = p.col)
SELECT grid_id, count_if(t IS NOT NULL AND q IS NOT NULL) AS matched, count_if(q IS NULL) AS missing, count_if(t IS NULL) AS extra, count_if(t IS NOT NULL AND q IS NOT NULL AND a IS NOT DISTINCT FROM b) AS equal FROM j GROUP BY 1""")
def cell_score(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    p = c.where((F.col("grid_id") + F.col("col")) % 17 != 0).withColumn("text", F.when((F.col("grid_id") + F.col("row")) % 19 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return tables.score(c, p, ["grid_id"])


_CP = """WITH s AS (SELECT DISTINCT study_id, document_id, pages FROM case_studies), p AS (SELECT study_id, document_id, unnest(pages) AS p, generate_subscripts(pages, 1) - 1 AS pos FROM s), q AS (SELECT study_id, document_id, pos, unnest(p) FROM p WHERE p IS NOT NULL),
b AS (SELECT study_id, document_id, pos, unnest(region_bboxes) AS b, generate_subscripts(region_bboxes, 1) - 1 AS region_pos FROM q), v AS (SELECT study_id, document_id, pos, region_pos, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1 FROM b WHERE len(b) = 4)"""


def _study_pages(spark: SparkSession, d: str) -> DataFrame:
    # maps cannot be compared, so repeated rows go by their key
    s = table(spark, d, "case_studies").select("study_id", "document_id", "pages").dropDuplicates(["study_id"])
    return s.select("study_id", "document_id", F.posexplode("pages").alias("pos", "p")).where("p is not null").select("study_id", "document_id", "pos", "p.*")


def _study_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = _study_pages(spark, d).select("study_id", "document_id", "pos", F.posexplode("region_bboxes").alias("region_pos", "b")).where("size(b) = 4")
    return b.select("study_id", "document_id", "pos", "region_pos", *(F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


_CP = _CP.replace("SELECT DISTINCT study_id, document_id, pages FROM case_studies", "SELECT study_id, any_value(document_id) AS document_id, any_value(pages) AS pages FROM case_studies GROUP BY 1")


@query(f"""{_CP} SELECT document_id, count(*) AS n_regions, round(avg((x1 - x0) * (y1 - y0)), 4) AS mean_area, min(x0) AS x0, max(y1) AS y1 FROM v GROUP BY 1""")
def region_stats(spark: SparkSession, d: str) -> DataFrame:
    b = _study_boxes(spark, d)
    return b.groupBy("document_id").agg(F.count("*").alias("n_regions"), F.round(F.avg(G.Box.of().area()), 4).alias("mean_area"), F.min("x0").alias("x0"), F.max("y1").alias("y1"))


@query(f"""{_CP} SELECT study_id, pos, region_pos FROM b WHERE b IS NULL OR len(b) <> 4 OR len(list_filter(b, lambda v: v IS NULL OR NOT isfinite(v))) > 0 OR b[1] > b[3] OR b[2] > b[4]""")
def box_violations(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of any form that are none: missing, of another size, not finite or not ordered."""
    b = _study_pages(spark, d).select("study_id", "pos", F.posexplode("region_bboxes").alias("region_pos", "b"))
    return b.where(G.verdict(F.col("b")) != "ok").select("study_id", "pos", "region_pos")


@query(f"""{_CP}, k AS (SELECT study_id, CAST(coalesce(page_index, pos) AS BIGINT) AS page_key, pos FROM q UNION ALL SELECT study_id, 0, pos FROM q WHERE study_id % 5 = 0 AND pos = 1) SELECT study_id, page_key, count(*) AS n FROM k GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a study with the same key; every fifth study of two pages or more gets a second page 0."""
    p = _study_pages(spark, d)
    k = p.select("study_id", F.coalesce("page_index", "pos").cast("bigint").alias("page_key"))
    planted = p.where("study_id % 5 = 0 and pos = 1").select("study_id", F.lit(0).cast("bigint").alias("page_key"))
    return k.unionByName(planted).groupBy("study_id", "page_key").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""{_CP}, m AS (SELECT unnest(map_entries(orphan_classes)) AS e FROM q WHERE orphan_classes IS NOT NULL) SELECT e.key AS class, sum(e.value) AS n, count(*) AS n_pages FROM m GROUP BY 1""")
def orphan_classes(spark: SparkSession, d: str) -> DataFrame:
    m = _study_pages(spark, d).select(F.explode("orphan_classes").alias("class", "v"))
    return m.groupBy("class").agg(F.sum("v").alias("n"), F.count("*").alias("n_pages"))


@query(f"""{_CP}, l AS (SELECT study_id, unnest(region_labels) AS label FROM q) SELECT label, count(*) AS n, count(DISTINCT study_id) AS n_studies FROM l GROUP BY 1""")
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = _study_pages(spark, d).select("study_id", F.explode("region_labels").alias("label"))
    return x.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("study_id").alias("n_studies"))


@query("""WITH u AS (SELECT DISTINCT unbundle_id, must_contain, docling.text AS t FROM ocr_unbundle), n AS (SELECT unbundle_id, t, unnest(must_contain) AS s FROM u), m AS (SELECT unbundle_id, avg(CASE WHEN contains(coalesce(t, ''), s) THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM n WHERE s IS NOT NULL GROUP BY 1)
SELECT unbundle_id, n, round(recall, 6) AS recall, recall = 1.0 AS perfect FROM m""")
def needle_recall(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "ocr_unbundle").select("unbundle_id", "must_contain", F.coalesce("docling.text", F.lit("")).alias("t")).distinct()
    n = u.select("unbundle_id", "t", F.explode("must_contain").alias("s")).where("s is not null")
    return n.groupBy("unbundle_id").agg(F.count("*").alias("n"), F.round(F.avg(F.contains("t", "s").cast("int")), 6).alias("recall"), F.every(F.contains("t", "s")).alias("perfect"))


@query("""WITH u AS (SELECT DISTINCT unbundle_id, list_filter(must_contain, lambda x: x IS NOT NULL) AS m, docling.text AS t FROM ocr_unbundle WHERE must_contain IS NOT NULL AND docling.text IS NOT NULL), p AS (SELECT unbundle_id, list_filter(list_transform(m, lambda s: instr(t, s)), lambda i: i > 0) AS spots FROM u)
SELECT unbundle_id, len(spots) AS n_found, spots = list_sort(spots) AS in_order FROM p""")
def needle_order(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "ocr_unbundle").where("must_contain is not null and docling.text is not null").select("unbundle_id", F.array_compact("must_contain").alias("m"), F.col("docling.text").alias("t")).distinct()
    at = F.filter(F.transform("m", lambda s: F.position(s, F.col("t"))), lambda p: p > 0)
    return u.select("unbundle_id", F.size(at).alias("n_found"), T.positions_monotonic(F.col("m"), F.col("t")).alias("in_order"))
