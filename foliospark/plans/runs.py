"""Queries on runs, metrics, crawls, samples and streams, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import geometry as G
from foliospark.functions import url as U
from foliospark.operators import crawl, metrics, sampling
from foliospark.session import table
from foliospark.streaming import logs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _log(df: DataFrame) -> DataFrame:
    """The event table as a stage log."""
    return df.select("event_id", "ts", F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("device"), (F.col("value") / 100).alias("seconds"), (F.col("event_type") == "error").alias("failed"))


_LOG = "WITH l AS (SELECT event_id, ts, event_type AS stage, user_id % 3 AS device, value / 100 AS seconds, event_type = 'error' AS failed FROM events)"


@query(f"""{_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY stage, device ORDER BY ts, event_id) AS n FROM l),
g AS (SELECT stage, device, count(*) AS n, count_if(failed) AS failures, max(CASE WHEN n = 1 THEN seconds END) AS cold, avg(CASE WHEN n > 1 THEN seconds END) AS warm_mean, median(CASE WHEN n > 1 THEN seconds END) AS warm_median, min(CASE WHEN n > 1 THEN seconds END) AS warm_min, max(CASE WHEN n > 1 THEN seconds END) AS warm_max, sum(seconds) AS total FROM r GROUP BY 1, 2)
SELECT stage, device, n, failures, round(cold, 5) AS cold, round(warm_mean, 5) AS warm_mean, round(warm_median, 5) AS warm_median, round(warm_min, 5) AS warm_min, round(warm_max, 5) AS warm_max, round(total, 4) AS total, round(total / sum(total) OVER (), 6) AS share, round(CASE WHEN cold - warm_mean >= 0 THEN cold - warm_mean END, 5) AS implied_load FROM g""")
def stage_profile(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.stage_profile(_log(table(spark, d, "events")), ["stage", "device"], ["ts", "event_id"], "seconds", F.col("failed"))
    return g.select("stage", "device", "n", "failures", *(F.round(c, 5).alias(c) for c in ("cold", "warm_mean", "warm_median", "warm_min", "warm_max")), F.round("total", 4).alias("total"), F.round("share", 6).alias("share"), F.round("implied_load", 5).alias("implied_load"))


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN i = CAST(ceil(0.95 * n) AS INT) - 1 THEN value END) AS p95_rank, max(CASE WHEN i = n // 2 THEN value END) AS upper_median, max(CASE WHEN i = least(n - 1, CAST(floor(0.9 * n) AS INT)) THEN value END) AS p90_truncated, max(CASE WHEN i = CAST(floor(0.95 * (n - 1)) AS INT) THEN value END) AS p95_floored, round(quantile_cont(value, 0.95), 6) AS p95_linear, round(median(value), 6) AS median FROM v GROUP BY 1""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value").where("value is not null")
    rules = {"p95_rank": metrics.nearest_rank(0.95), "upper_median": metrics.upper_median(), "p90_truncated": metrics.truncated(0.9), "p95_floored": metrics.floored(0.95)}
    rules |= {f"{k}95": v for k, v in metrics.interpolated(0.95).items()} | {f"{k}50": v for k, v in metrics.interpolated(0.5).items()}
    g = metrics.order_statistics(e, ["event_type"], "value", rules).join(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    p95 = metrics.between(F.col("lo95"), F.col("hi95"), F.col("n"), 0.95)
    return g.select("event_type", "p95_rank", "upper_median", "p90_truncated", "p95_floored", F.round(p95, 6).alias("p95_linear"), F.round((F.col("lo50") + F.col("hi50")) / 2, 6).alias("median"))


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT e.event_type, count(*) AS n_slow FROM events e JOIN m USING (event_type) WHERE e.value > 3 * m.med AND e.value > 1 GROUP BY 1""")
def runtime_outliers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "value")
    m = metrics.median(e, ["event_type"], "value", "med")
    return e.join(m, "event_type").where((F.col("value") > 3 * F.col("med")) & (F.col("value") > 1)).groupBy("event_type").agg(F.count("*").alias("n_slow"))


_TP = """WITH o AS (SELECT o_orderkey, o_custkey % 7 AS site, field, value FROM (SELECT o_orderkey, o_custkey, 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, o_custkey, 'priority', o_orderpriority FROM orders)),
p AS (SELECT o_orderkey, field, CASE WHEN o_orderkey % 11 = 0 THEN value || 'x' ELSE value END AS got FROM o WHERE o_orderkey % 13 <> 0),
j AS (SELECT o.site, o.field, coalesce(o.value = p.got, false) AS hit, p.got IS NOT NULL AS has FROM o LEFT JOIN p USING (o_orderkey, field)),
c AS (SELECT site, field, count_if(hit) AS tp, count_if(has AND NOT hit) AS fp, count_if(NOT hit) AS fn FROM j GROUP BY 1, 2)"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = o.select("o_orderkey", (F.col("o_custkey") % 7).alias("site"), F.explode(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")).alias("field", "value"))
    p = t.where(F.col("o_orderkey") % 13 != 0).select("o_orderkey", "field", F.when(F.col("o_orderkey") % 11 == 0, F.concat("value", F.lit("x"))).otherwise(F.col("value")).alias("value"))
    return metrics.field_outcomes(t, p, ["o_orderkey", "field"])


def _rounded(df: DataFrame, cols: list[str], n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@query(f"""{_TP} SELECT field, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1 FROM c GROUP BY 1""")
def field_prf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.prf(_outcomes(spark, d), ["field"]), ["precision", "recall", "f1"])


@query(f"""{_TP} SELECT site, field, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def grouped_field_prf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.prf(_outcomes(spark, d), ["site", "field"]), ["precision", "recall", "f1"])


@query(f"""{_TP}, f AS (SELECT site, field, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c) SELECT field, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.prf(_outcomes(spark, d), ["site", "field"]).groupBy("field").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@query("""WITH c AS (SELECT DISTINCT study_id, char_recall, order_ok FROM case_studies WHERE char_recall IS NOT NULL), b AS (SELECT least(CAST(floor(char_recall * 5) AS INT), 4) AS band, char_recall, CASE WHEN order_ok IS NULL THEN NULL WHEN order_ok THEN 1.0 ELSE 0.0 END AS hit FROM c)
SELECT CAST(r.band AS INT) AS band, count(b.band) AS n, CAST(sum(CAST(char_recall AS DECIMAL(28, 10))) AS DOUBLE) / count(char_recall) AS mean_score, CAST(sum(CAST(hit AS DECIMAL(28, 10))) AS DOUBLE) / count(hit) AS hit_rate FROM (SELECT unnest(range(5)) AS band) r LEFT JOIN b ON b.band = r.band GROUP BY 1""")
def calibration_bands(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "case_studies").select("study_id", "char_recall", F.col("order_ok").cast("int").cast("double").alias("hit")).distinct()
    return metrics.calibration(c, "char_recall", "hit")


@query("""WITH c AS (SELECT DISTINCT study_id, language, exact, char_recall FROM case_studies WHERE exact IS NOT NULL AND char_recall IS NOT NULL) SELECT language, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(exact, char_recall) END, 6) AS r FROM c GROUP BY 1""")
def pearson_guarded(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "case_studies").select("study_id", "language", "exact", "char_recall").distinct().dropna(subset=["exact", "char_recall"])
    return c.groupBy("language").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 3, F.corr("exact", "char_recall")), 6).alias("r"))


@query("""WITH c AS (SELECT DISTINCT study_id, language, exact, char_recall FROM case_studies WHERE exact IS NOT NULL AND char_recall IS NOT NULL), k AS (SELECT language, row_number() OVER (PARTITION BY language ORDER BY exact, study_id) - row_number() OVER (PARTITION BY language ORDER BY char_recall, study_id) AS d FROM c)
SELECT language, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN 1 - 6 * sum(d * d) / (count(*) * (count(*) * count(*) - 1)) END, 6) AS rho FROM k GROUP BY 1""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "case_studies").select("study_id", "language", "exact", "char_recall").distinct().dropna(subset=["exact", "char_recall"])
    return _rounded(metrics.spearman(c, "exact", "char_recall", ["language"], "study_id"), ["rho"])


@query("""WITH c AS (SELECT DISTINCT study_id, language, exact AS base, char_recall AS cand FROM case_studies WHERE exact IS NOT NULL AND char_recall IS NOT NULL)
SELECT language, count(*) AS n, count_if(cand > base) AS better, count_if(cand < base) AS worse, count_if(cand = base) AS ties, round(avg(cand - base), 6) AS mean_delta FROM c GROUP BY 1""")
def paired_deltas(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "case_studies").select("study_id", "language", "exact", "char_recall").distinct().dropna(subset=["exact", "char_recall"])
    p = metrics.paired(c.select("study_id", "language", F.col("exact").alias("v")), c.select("study_id", "language", F.col("char_recall").alias("v")), ["study_id", "language"], "v")
    return p.groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("cand") > F.col("base")).alias("better"), F.count_if(F.col("cand") < F.col("base")).alias("worse"), F.count_if(F.col("cand") == F.col("base")).alias("ties"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query("""WITH c AS (SELECT DISTINCT study_id, labels, exact FROM case_studies), l AS (SELECT unnest(labels) AS label, exact FROM c) SELECT label, count(exact) AS n, round(avg(exact), 6) AS mean, round(median(exact), 6) AS median FROM l WHERE exact IS NOT NULL GROUP BY 1 HAVING count(exact) >= 5""")
def stratified_means(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "case_studies").select("study_id", "labels", "exact").distinct()
    x = c.select(F.explode("labels").alias("label"), "exact").where("exact is not null")
    return x.groupBy("label").agg(F.count("exact").alias("n"), F.round(F.avg("exact"), 6).alias("mean"), F.round(F.median("exact"), 6).alias("median")).where("n >= 5")


@query("""WITH h AS (SELECT DISTINCT hard_case_id, failure_mode, difficulty FROM hard_cases) SELECT failure_mode, count_if(difficulty = 'easy') AS easy, count_if(difficulty = 'medium') AS medium, count_if(difficulty = 'hard') AS hard FROM h GROUP BY 1""")
def failure_by_difficulty(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hard_cases").select("hard_case_id", "failure_mode", "difficulty").distinct()
    return h.groupBy("failure_mode").pivot("difficulty", ["easy", "medium", "hard"]).agg(F.count("hard_case_id")).fillna(0, ["easy", "medium", "hard"])


@query("""WITH h AS (SELECT DISTINCT hard_case_id, document_type, language FROM hard_cases) SELECT document_type, language, count(*) AS n, CAST(grouping(document_type) AS INT) AS all_types, CAST(grouping(language) AS INT) AS all_languages FROM h GROUP BY GROUPING SETS ((document_type, language), (document_type), (language), ())""")
def case_groupings(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "hard_cases").select("hard_case_id", "document_type", "language").distinct().createOrReplaceTempView("_cases")
    return spark.sql("SELECT document_type, language, count(*) AS n, CAST(grouping(document_type) AS INT) AS all_types, CAST(grouping(language) AS INT) AS all_languages FROM _cases GROUP BY GROUPING SETS ((document_type, language), (document_type), (language), ())")


@query("""WITH m AS (SELECT DISTINCT label_id, reviewer, flagged FROM moderation_labels), g AS (SELECT reviewer, count(*) AS n, sum(flagged) AS k FROM m GROUP BY 1), q AS (SELECT *, k / n AS p FROM g)
SELECT reviewer, n, round(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS low, round(least(1, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n)), 6) AS high FROM q""")
def wilson_intervals(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "moderation_labels").select("label_id", "reviewer", "flagged").distinct().groupBy("reviewer").agg(F.count("*").alias("n"), F.sum("flagged").alias("k"))
    return m.withColumn("w", G.wilson(F.col("k"), F.col("n"))).select("reviewer", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query("""WITH a AS (SELECT DISTINCT study_id, document_id FROM case_studies), e AS (SELECT document_id || '.md' AS f FROM a), g AS (SELECT document_id || CASE WHEN study_id % 9 = 0 THEN '_x.md' ELSE '.md' END AS f FROM a WHERE study_id % 7 <> 0)
SELECT 'missing' AS problem, count(*) AS n FROM (SELECT DISTINCT f FROM e EXCEPT SELECT f FROM g) UNION ALL SELECT 'unexpected', count(*) FROM (SELECT DISTINCT f FROM g EXCEPT SELECT f FROM e) UNION ALL SELECT 'common', count(*) FROM (SELECT f FROM e INTERSECT SELECT f FROM g)""")
def prediction_alignment(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "case_studies").select("study_id", "document_id").distinct()
    e = a.select(F.concat("document_id", F.lit(".md")).alias("f"))
    g = a.where(F.col("study_id") % 7 != 0).select(F.concat("document_id", F.when(F.col("study_id") % 9 == 0, "_x.md").otherwise(".md")).alias("f"))
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("problem"), "n")
    return n(e.distinct().join(g, "f", "left_anti"), "missing").unionByName(n(g.distinct().join(e, "f", "left_anti"), "unexpected")).unionByName(n(e.intersect(g), "common"))


@query("""WITH a AS (SELECT DISTINCT document_id, page_index, n_words AS v FROM quality_results), b AS (SELECT document_id, page_index, CASE WHEN page_index % 5 = 0 THEN v + 1 ELSE v END AS v FROM a WHERE page_index % 11 <> 10)
SELECT a.document_id, a.page_index, a.v AS base, b.v AS cand FROM a JOIN b USING (document_id, page_index) WHERE a.v IS DISTINCT FROM b.v""")
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "quality_results").select("document_id", "page_index", F.col("n_words").alias("base")).distinct()
    b = a.where(F.col("page_index") % 11 != 10).select("document_id", "page_index", F.when(F.col("page_index") % 5 == 0, F.col("base") + 1).otherwise(F.col("base")).alias("cand"))
    return a.join(b, ["document_id", "page_index"]).where(~F.col("base").eqNullSafe(F.col("cand")))


@query("""WITH p AS (SELECT DISTINCT document_id, page_index FROM page_inputs), q AS (SELECT DISTINCT document_id, page_index FROM quality_results) SELECT 'unassessed' AS gap, count(*) AS n FROM p ANTI JOIN q USING (document_id, page_index) UNION ALL SELECT 'unknown', count(*) FROM q ANTI JOIN p USING (document_id, page_index)""")
def provenance_gaps(spark: SparkSession, d: str) -> DataFrame:
    k = ["document_id", "page_index"]
    p, q = (table(spark, d, t).select(*k).distinct() for t in ("page_inputs", "quality_results"))
    n = lambda df, g: df.agg(F.count("*").alias("n")).select(F.lit(g).alias("gap"), "n")
    return n(p.join(q, k, "left_anti"), "unassessed").unionByName(n(q.join(p, k, "left_anti"), "unknown"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) SELECT sha, min(doc_id) AS first_doc, count(*) AS n_docs FROM h GROUP BY 1""")
def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    return h.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))


@query("""SELECT feed, file_seq, line_no, record_id FROM (SELECT *, row_number() OVER (PARTITION BY feed, line_no ORDER BY file_seq DESC, arrived_at DESC, record_id DESC) AS n FROM run_files) WHERE n = 1""")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return crawl.latest_per(table(spark, d, "run_files").select("feed", "file_seq", "line_no", "record_id", "arrived_at"), ["feed", "line_no"], ["file_seq", "arrived_at", "record_id"]).drop("arrived_at")


@query("""SELECT DISTINCT record_id, feed, file_seq FROM run_files ORDER BY record_id LIMIT 50 OFFSET 100""")
def artifact_listing(spark: SparkSession, d: str) -> DataFrame:
    """One page of a listing: the limit is the feature."""
    return table(spark, d, "run_files").select("record_id", "feed", "file_seq").distinct().orderBy("record_id").offset(100).limit(50)


@query("""WITH RECURSIVE m AS (SELECT count(*) AS m FROM part), e AS (SELECT p_partkey AS src, (2 * p_partkey + 1) % (SELECT m FROM m) AS dst FROM part UNION ALL SELECT p_partkey, (2 * p_partkey + 2) % (SELECT m FROM m) FROM part),
r AS (SELECT CAST(1 AS BIGINT) AS url, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.url WHERE r.depth < 20) SELECT url, min(depth) AS depth FROM r GROUP BY 1""")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    """All parts within 20 links of the first."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    m = p.agg(F.count("*").alias("m")).first().m  # one number
    e = p.select(F.col("k").alias("src"), F.explode(F.array((2 * F.col("k") + 1) % m, (2 * F.col("k") + 2) % m)).alias("dst"))
    return crawl.levels(spark.range(1, 2).select(F.col("id").alias("url")), e, 20)


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of the supplier table, in forms that need work."""
    k = F.col("s_suppkey").cast("string")
    forms = F.array(F.concat(F.lit("HTTP://Example.COM:80/a/./b/../"), k, F.lit("#x")), F.concat(F.lit("https://example.org/%7Eu/"), k, F.lit("?b=2&a=1")), F.concat(F.lit("ftp://example.org/"), k), F.concat(F.lit("https://example.com//c/"), k, F.lit("%2"), F.lit("")), F.concat(F.lit("../x/"), k))
    return table(spark, d, "supplier").select("s_suppkey", F.posexplode(forms).alias("form", "raw"))


@query("""WITH s AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS k FROM supplier) SELECT s_suppkey, 0 AS form, 'http://example.com/a/' || k AS url, CAST(NULL AS VARCHAR) AS error FROM s UNION ALL SELECT s_suppkey, 1, 'https://example.org/~u/' || k || '?b=2&a=1', NULL FROM s UNION ALL SELECT s_suppkey, 2, NULL, 'unsupported_scheme' FROM s UNION ALL SELECT s_suppkey, 3, NULL, 'invalid_percent_encoding' FROM s UNION ALL SELECT s_suppkey, 4, 'https://example.com/x/' || k, NULL FROM s""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = _urls(spark, d).withColumn("n", U.url_normalize("raw", F.when(F.col("form") == 4, F.lit("https://example.com/p/q"))))
    return u.select("s_suppkey", "form", "n.url", "n.error")


@query("""WITH n AS (SELECT count(*) AS n FROM supplier) SELECT 'accepted' AS decision, 2 * n AS n FROM n UNION ALL SELECT 'cross_origin', n FROM n UNION ALL SELECT 'unsupported_scheme', n FROM n UNION ALL SELECT 'invalid_percent_encoding', n FROM n""")
def scope_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Admission of the discovered addresses, with every rule in order."""
    u = _urls(spark, d).withColumn("n", U.url_normalize("raw", F.lit("https://example.com/p/q"))).select("s_suppkey", "form", F.col("n.url").alias("url"), F.col("n.error").alias("error"))
    seen = F.row_number().over(Window.partitionBy("url").orderBy("s_suppkey", "form")) > 1
    u = u.withColumn("origin", U.origin(F.col("url"))).withColumn("seen", seen)
    rule = crawl.admission(F.coalesce(F.regexp_extract("url", "^([a-z]+):", 1), F.lit("")), F.coalesce(F.col("origin").endswith("example.com"), F.lit(False)), F.lit(True), F.coalesce(F.col("url").rlike("/denied/"), F.lit(False)), F.col("form"), 4, F.col("seen"))
    return u.withColumn("decision", F.coalesce("error", rule)).groupBy("decision").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE k AS (SELECT s_suppkey AS a FROM supplier), h AS (SELECT a, CASE WHEN a % 5 = 4 THEN a - 3 ELSE a + 1 END AS b FROM k WHERE a % 5 <> 0),
r AS (SELECT a AS start, a AS here, [a] AS path, 'open' AS state FROM k UNION ALL
SELECT r.start, CASE WHEN h.b IS NULL OR list_contains(r.path, h.b) OR len(r.path) > 10 THEN r.here ELSE h.b END, CASE WHEN h.b IS NULL OR list_contains(r.path, h.b) OR len(r.path) > 10 THEN r.path ELSE list_append(r.path, h.b) END,
CASE WHEN h.b IS NULL THEN 'ok' WHEN list_contains(r.path, h.b) THEN 'loop' WHEN len(r.path) > 10 THEN 'limit' ELSE 'open' END FROM r LEFT JOIN h ON h.a = r.here WHERE r.state = 'open')
SELECT 'https://e.org/' || CAST(start AS VARCHAR) AS url, 'https://e.org/' || CAST(here AS VARCHAR) AS final, CAST(len(path) - 1 AS INT) AS hops, state AS outcome FROM r WHERE state <> 'open'""")
def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "supplier").select("s_suppkey")
    hop = k.where(F.col("s_suppkey") % 5 != 0).select(F.concat(F.lit("https://e.org/"), "s_suppkey").alias("src"), F.concat(F.lit("https://e.org/"), F.when(F.col("s_suppkey") % 5 == 4, F.col("s_suppkey") - 3).otherwise(F.col("s_suppkey") + 1)).alias("dst"))
    return crawl.redirects(k.select(F.concat(F.lit("https://e.org/"), "s_suppkey").alias("url")), hop)


@query("""WITH p AS (SELECT DISTINCT page_input_id, document_id, page_index FROM page_inputs), s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_index, page_input_id) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM p)
SELECT page_input_id FROM s WHERE n <= 3 OR i IN (CAST(floor(0 * n / 3) AS INT), CAST(floor(1 * n / 3) AS INT), CAST(floor(2 * n / 3) AS INT))""")
def sampled_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_inputs").select("page_input_id", "document_id", "page_index").distinct()
    p = p.withColumn("i", F.row_number().over(Window.partitionBy("document_id").orderBy("page_index", "page_input_id")) - 1)
    return sampling.evenly(p, ["document_id"], "i", 3).select("page_input_id")


@query("""SELECT hard_case_id, document_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY sha256('7:' || case_id)) AS rank FROM (SELECT DISTINCT hard_case_id, case_id, document_type FROM hard_cases)) WHERE rank <= 5""")
def hash_ranked_strata(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hard_cases").select("hard_case_id", "case_id", "document_type").distinct()
    s = sampling.per_stratum(h, ["document_type"], F.col("case_id"), 5, "7")
    return s.select("hard_case_id", "document_type", F.row_number().over(Window.partitionBy("document_type").orderBy(sampling.stable_rank(F.col("case_id"), "7"))).alias("rank"))


@query()
def marginal_strata(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 20 of the benchmark's cases, balanced over document types and languages."""
    h = table(spark, d, "hard_cases").select(F.col("hard_case_id").alias("id"), F.coalesce("document_type", F.lit("")).alias("document_type"), F.coalesce("language", F.lit("")).alias("language")).distinct()
    return sampling.marginal_sample(h, ["document_type", "language"], 20)


@query("""SELECT event_type AS stage, count(*) AS n, count_if(event_type = 'error') AS failures, round(min(value / 100), 6) AS fastest, round(max(value / 100), 6) AS slowest FROM events GROUP BY 1""")
def stream_stage_profile(spark: SparkSession, d: str) -> DataFrame:
    s = logs.drain(logs.profile(_log(logs.read(spark, d, glob="events.parquet", schema=_schema(spark, d)))), "complete")
    return s.select("stage", "n", "failures", F.round("fastest", 6).alias("fastest"), F.round("slowest", 6).alias("slowest"))


def _schema(spark: SparkSession, d: str) -> str:
    return table(spark, d, "events").schema.simpleString()[7:-1].replace(":", " ")


@query("""SELECT DISTINCT event_id, user_id, event_type FROM events""")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every event is delivered twice; its key is kept for a day of event time."""
    e = logs.read(spark, d, glob="events.parquet", schema=_schema(spark, d)).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return logs.drain(logs.distinct(e.unionByName(e), ["event_id"], "ts", "1 day").drop("ts"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hour; a window is dropped from the state a day of event time after its end."""
    e = logs.read(spark, d, glob="events.parquet", schema=_schema(spark, d)).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    s = logs.drain(logs.windows(e, "ts", "1 hour", None, "1 day", ["event_type"]), "update", ["window_start", "event_type"])
    return s.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, round(sum(value), 4) AS used, count(*) AS n, sum(value) > 1000.0 AS exceeded FROM events GROUP BY 1""")
def stream_budget(spark: SparkSession, d: str) -> DataFrame:
    e = logs.read(spark, d, glob="events.parquet", schema=_schema(spark, d)).select("user_id", "value")
    return logs.drain(logs.budget(e, "user_id", "value", 1000.0), "update", ["user_id"]).select("user_id", F.round("used", 4).alias("used"), "n", "exceeded")
