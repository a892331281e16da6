"""Queries on crawl policies, HTML, sequences and validation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import policy, routing, tables
from foliospark.plans.pages import _CELLS, _cells
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


@query("""WITH a AS (SELECT s_suppkey, unnest([(s_suppkey * 37) % 256, (s_suppkey * 11) % 256]) AS x FROM supplier), n AS (SELECT s_suppkey, x * 16777216 + (s_suppkey % 256) * 65536 + 257 AS n FROM a),
v AS (SELECT s_suppkey, n BETWEEN 0 AND 16777215 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 1681915904 AND 1686110207 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3221225472 AND 3221225727 OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n >= 3758096384 AS bad FROM n)
SELECT s_suppkey, CASE WHEN bool_or(bad) THEN 'ssrf_blocked' ELSE 'ok' END AS verdict FROM v GROUP BY 1""")
def egress_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with two addresses each, made of the supplier numbers."""
    k = F.col("s_suppkey")
    address = lambda x: F.concat_ws(".", x % 256, k % 256, F.lit(1), F.lit(1))
    s = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array(address(k * 37), address(k * 11))).alias("address"))
    return policy.host_verdict(s, "s_suppkey", "address")


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 3 AS site, '/' || CAST(p_partkey % 4 AS VARCHAR) || '/' || CAST(p_partkey % 10 AS VARCHAR) || '/x' AS path FROM part), u AS (SELECT * FROM (VALUES (0, '/1', false), (0, '/1/5', true), (1, '/', false), (1, '/2/', true), (1, '/2/8', false)) t(site, prefix, allow)),
h AS (SELECT id, allow, row_number() OVER (PARTITION BY id ORDER BY length(prefix) DESC, allow DESC) AS n FROM r JOIN u ON r.site = u.site AND starts_with(path, prefix)) SELECT r.id, coalesce(h.allow, true) AS allowed FROM r LEFT JOIN h ON h.id = r.id AND h.n = 1""")
def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The longest rule of a site that begins a path decides."""
    k = F.col("p_partkey")
    r = table(spark, d, "part").select(k.alias("id"), (k % 3).alias("site"), F.concat(F.lit("/"), (k % 4).cast("string"), F.lit("/"), (k % 10).cast("string"), F.lit("/x")).alias("path"))
    rules = spark.createDataFrame([(0, "/1", False), (0, "/1/5", True), (1, "/", False), (1, "/2/", True), (1, "/2/8", False)], "site bigint, prefix string, allow boolean")
    return policy.robots_rules(r, rules, "site", "path", "id")


@query("""WITH e AS (SELECT event_id, user_id % 7 AS site, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS sec, event_type FROM events), l AS (SELECT site, sec, event_id AS version FROM e WHERE event_id % 20 = 0), q AS (SELECT event_id, site, sec FROM e WHERE event_id % 20 <> 0)
SELECT q.event_id, CASE WHEN q.sec - l.sec <= 300 THEN l.version END AS version FROM q ASOF LEFT JOIN (SELECT site, sec, max(version) AS version FROM l GROUP BY 1, 2) l ON q.site = l.site AND q.sec >= l.sec""")
def robots_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each request with the rules its site last loaded, if not older than 300 seconds."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 7).alias("site"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    load = e.where("event_id % 20 = 0").groupBy("site", "at").agg(F.max("event_id").alias("version"))
    return policy.as_of(e.where("event_id % 20 <> 0"), load, "site", "at", 300, "version").select("event_id", "version")


@query("""WITH s AS (SELECT s_suppkey, [200, 404, 403, 500, 204][CAST(s_suppkey % 5 AS INT) + 1] AS status, s_suppkey % 90 AS delay FROM supplier) SELECT CASE WHEN status = 404 THEN 'all' WHEN status = 403 THEN 'nothing' WHEN status = 500 THEN 'unavailable' WHEN delay > 60 THEN 'nothing' ELSE 'rules' END AS access, count(*) AS n FROM s GROUP BY 1""")
def robots_access(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    status = F.get(F.array(*(F.lit(x) for x in (200, 404, 403, 500, 204))), (k % 5).cast("int"))
    return table(spark, d, "supplier").groupBy(policy.robots_access(status, k % 90).alias("access")).agg(F.count("*").alias("n"))


_U = "SELECT p_partkey AS k, ['http', 'https', 'ftp'][CAST(p_partkey % 3 AS INT) + 1] AS scheme, ['example.com', 'a.example.com', 'badexample.com', 'other.org'][CAST(p_partkey % 4 AS INT) + 1] AS host, ['/docs/a', '/docs/private/a', '/else'][CAST(p_partkey % 5 AS INT) % 3 + 1] AS path FROM part"


@query(f"""WITH u AS ({_U}) SELECT k, CASE WHEN scheme = 'ftp' THEN 'unsupported_scheme' WHEN NOT (host = 'example.com' OR host LIKE '%.example.com') THEN 'host_not_allowed' WHEN NOT starts_with(path, '/docs/') THEN 'path_not_allowed' WHEN path LIKE '%/private/%' THEN 'path_denied' END AS error FROM u""")
def scope_policy(spark: SparkSession, d: str) -> DataFrame:
    """Addresses against allowed domains with subdomains, path prefixes and denied globs."""
    k = F.col("p_partkey")
    of = lambda xs, i: F.get(F.array(*(F.lit(x) for x in xs)), i.cast("int"))
    scheme, host, path = of(("http", "https", "ftp"), k % 3), of(("example.com", "a.example.com", "badexample.com", "other.org"), k % 4), of(("/docs/a", "/docs/private/a", "/else"), k % 5 % 3)
    origin = F.concat(scheme, F.lit("://"), host)
    error = policy.in_scope(F.concat(origin, path), scheme, host, path, origin, [], ["example.com"], ["/docs/"], ["*/private/*"], same_origin=False, subdomains=True)
    return table(spark, d, "part").select(k.alias("k"), error.alias("error"))


@query("""WITH m AS (SELECT p_partkey, ['Application/PDF; charset=x', 'image/png', 'text/plain', ' TEXT/HTML ', NULL][CAST(p_partkey % 5 AS INT) + 1] AS h FROM part), t AS (SELECT lower(trim(string_split(h, ';')[1])) AS media FROM m) SELECT media, CASE media WHEN 'application/pdf' THEN '.pdf' WHEN 'image/png' THEN '.png' WHEN 'text/html' THEN '.html' END AS suffix, count(*) AS n FROM t GROUP BY 1, 2""")
def media_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """File endings of media types; NULL for those that are not taken."""
    from foliospark.functions.url import media_type

    header = F.get(F.array(F.lit("Application/PDF; charset=x"), F.lit("image/png"), F.lit("text/plain"), F.lit(" TEXT/HTML "), F.lit(None)), (F.col("p_partkey") % 5).cast("int"))
    m = table(spark, d, "part").select(media_type(header).alias("media"))
    return m.groupBy("media", routing.looked_up(F.col("media"), routing.SUFFIXES, None).alias("suffix")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, CAST(i AS INT) AS pos, CASE i WHEN 0 THEN 'a' ELSE 'img' END AS tag, CASE i WHEN 0 THEN '/p/' || CAST(k AS VARCHAR) ELSE 'i' || CAST(k % 7 AS VARCHAR) || '.png' END AS href, '/c/' || CAST(k AS VARCHAR) AS canonical FROM p, (SELECT unnest(range(CASE WHEN true THEN 2 END)) AS i)""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of small pages made of the part table, in document order, with the canonical hint."""
    k = F.col("p_partkey")
    s = k.cast("string")
    html = F.concat(F.lit("<html><head><link rel=canonical href='/c/"), s, F.lit("'></head><a name=x>no</a><a class=y href='/p/"), s, F.lit("'>t</a><img alt='' src=\"i"), (k % 7).cast("string"), F.lit('.png"></html>'))
    return policy.links_of(table(spark, d, "part").select(k.alias("k"), html.alias("html")), "k", "html").drop("truncated")


@query(f"""{_CELLS}, f AS (SELECT grid_id, "row", col, nullif(trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')), '') AS text FROM c) SELECT grid_id, CAST("row" AS INT) AS "row", CAST(col AS INT) AS col, coalesce(text, '') AS text FROM f""")
def html_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Grids written as HTML and read again give their cells; slots without a cell come back as empty ones and are left out."""
    c = _cells(spark, d)
    html = tables.html(c.withColumns({"row_span": F.lit(1), "col_span": F.lit(1)}), ["grid_id"])
    return policy.cells_of(html, "grid_id", "html").join(c.select("grid_id", "row", "col"), ["grid_id", "row", "col"], "left_semi").select("grid_id", "row", "col", "text")


@query("""WITH t AS (SELECT DISTINCT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, len(w) AS n, coalesce(nullif(list_position(w, 'the'), 0), len(w) + 1) AS e, coalesce(nullif(list_position(w, ''), 0), len(w) + 1) AS p FROM t) SELECT doc_id, CAST(least(e, p, n + 1) - 1 AS INT) AS length, e <= n AND e < p AS ended FROM p""")
def generated_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Words of each text before the first end word ('the') or filler (''), and whether the end word came first."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w")).distinct()
    first = lambda x: F.coalesce(F.nullif(F.array_position("w", F.lit(x)), F.lit(0)), F.size("w") + 1)
    e, p = first("the"), first("")
    return t.select("doc_id", (F.least(e, p, F.size("w") + 1) - 1).cast("int").alias("length"), ((e <= F.size("w")) & (e < p)).alias("ended"))


@query("""WITH g AS (SELECT DISTINCT grid_id, len(grid) AS n_rows, list_max(list_transform(list_filter(grid, lambda r: r IS NOT NULL), lambda r: len(r))) AS n_cols, spans FROM annotated_grids), s AS (SELECT grid_id, n_rows, n_cols, unnest(spans) AS s FROM g), v AS (SELECT grid_id, s.row_at >= 0 AND s.col_at >= 0 AND s.row_at + greatest(1, coalesce(s.row_span, 1)) <= n_rows AND s.col_at + greatest(1, coalesce(s.col_span, 1)) <= n_cols AS ok FROM s)
SELECT coalesce(ok, false) AS within, count(*) AS n FROM v GROUP BY 1""")
def spans_within(spark: SparkSession, d: str) -> DataFrame:
    """Spans that stay within their grid, and those that reach beyond it."""
    g = table(spark, d, "annotated_grids").select("grid_id", "grid", "spans").distinct()
    g = g.select("grid_id", F.size("grid").alias("n_rows"), F.array_max(F.transform(F.filter("grid", lambda r: r.isNotNull()), lambda r: F.size(r))).alias("n_cols"), F.explode("spans").alias("s")).select("n_rows", "n_cols", "s.*")
    one = lambda c: F.greatest(F.lit(1), F.coalesce(c, F.lit(1)))
    ok = (F.col("row_at") >= 0) & (F.col("col_at") >= 0) & (F.col("row_at") + one("row_span") <= F.col("n_rows")) & (F.col("col_at") + one("col_span") <= F.col("n_cols"))
    return g.groupBy(F.coalesce(ok, F.lit(False)).alias("within")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT DISTINCT case_id, must_contain, must_not_contain, expected_tables FROM hard_cases), t AS (SELECT document_id AS case_id, string_agg(text, ' ' ORDER BY page_index, token_pos, token_id) AS t FROM (SELECT DISTINCT token_id, document_id, page_index, source, token_pos, text FROM ocr_tokens) WHERE source = 'docling' GROUP BY 1), g AS (SELECT document_id AS case_id, count(DISTINCT grid_id) AS n FROM annotated_grids GROUP BY 1),
j AS (SELECT case_id, coalesce(t, '') AS t, list_filter(coalesce(must_contain, []), lambda x: x IS NOT NULL) AS m, list_filter(coalesce(must_not_contain, []), lambda x: x IS NOT NULL) AS b, coalesce(n, 0) = coalesce(expected_tables, 0) AS tables_ok FROM h LEFT JOIN t USING (case_id) LEFT JOIN g USING (case_id))
SELECT case_id, CASE WHEN len(m) > 0 THEN len(list_filter(m, lambda x: contains(t, x))) / len(m) END AS recall, len(list_filter(b, lambda x: contains(t, x))) AS n_hallucinated, tables_ok FROM j""")
def case_scores(spark: SparkSession, d: str) -> DataFrame:
    """Required and forbidden strings of each case in the text that was read, and whether its tables are all there."""
    h = table(spark, d, "hard_cases").select("case_id", "must_contain", "must_not_contain", "expected_tables").distinct()
    t = table(spark, d, "ocr_tokens").where("source = 'docling'").select("token_id", F.col("document_id").alias("case_id"), "page_index", "token_pos", "text").distinct()
    # a case is one document of a few pages
    t = t.join(h.select("case_id").distinct(), "case_id", "left_semi").groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "token_pos", "token_id", "text"))), lambda w: w["text"]), " ").alias("t"))
    g = table(spark, d, "annotated_grids").groupBy(F.col("document_id").alias("case_id")).agg(F.countDistinct("grid_id").alias("n"))
    none = F.array().cast("array<string>")
    j = h.join(t, "case_id", "left").join(g, "case_id", "left").withColumn("t", F.coalesce("t", F.lit("")))
    held = lambda c: F.size(F.filter(F.array_compact(F.coalesce(c, none)), lambda x: F.contains("t", x)))
    return j.select("case_id", F.try_divide(held("must_contain"), F.size(F.array_compact(F.coalesce("must_contain", none)))).alias("recall"), held("must_not_contain").alias("n_hallucinated"), (F.coalesce("n", F.lit(0)) == F.coalesce("expected_tables", F.lit(0))).alias("tables_ok"))


@query()
def semantic_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of runs that are equal but for the order of keys, white space, time and version."""
    r = table(spark, d, "run_files").select("record_id", "payload").distinct()
    return r.select("record_id", policy.semantic_hash(F.col("payload"), ("timestamp", "schema_version")).alias("hash"))


@query("""SELECT feed, CAST(file_seq AS INT) AS file_seq FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY file_seq) AS n FROM (SELECT DISTINCT feed, file_seq FROM run_files)) WHERE n <= 2""")
def first_files(spark: SparkSession, d: str) -> DataFrame:
    """The two lowest file numbers of each feed: the limit is the feature."""
    f = table(spark, d, "run_files").select("feed", F.col("file_seq").cast("int").alias("file_seq")).distinct()
    return f.groupBy("feed").agg(F.slice(F.array_sort(F.collect_set("file_seq")), 1, 2).alias("s")).select("feed", F.explode("s").alias("file_seq"))


@query("""WITH p AS (SELECT DISTINCT document_id, page_index FROM page_inputs), m AS (SELECT document_id, min(page_index) AS lo, max(page_index) AS hi, count(*) AS n FROM p GROUP BY 1) SELECT lo = 0 AND hi = n - 1 AS contiguous, count(*) AS n FROM m GROUP BY 1""")
def page_positions(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pages are numbered from 0 without gaps, and those that aren't."""
    m = table(spark, d, "page_inputs").select("document_id", "page_index").distinct().groupBy("document_id").agg(F.min("page_index").alias("lo"), F.max("page_index").alias("hi"), F.count("*").alias("n"))
    return m.groupBy(((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("contiguous")).agg(F.count("*").alias("n"))
