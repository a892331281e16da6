"""Which recogniser, which result, which verdict: decisions as expressions over what was measured."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.geometry import Box, valid
from foliospark.functions.text import collapsed_badly

# Kinds of elements by label of a layout model, and file endings by media type.
ELEMENT_TYPES = {
    "title": "heading", "section-header": "heading", "section_header": "heading", "text": "text", "paragraph": "paragraph",
    "list-item": "list_item", "list_item": "list_item", "table": "table", "picture": "image", "figure": "image", "formula": "formula",
    "checkbox-selected": "checkbox", "checkbox-unselected": "checkbox", "caption": "text", "footnote": "text", "page-header": "other", "page-footer": "other",
}
SUFFIXES = {"application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "image/tiff": ".tiff", "image/bmp": ".bmp", "text/html": ".html"}
SEVERITIES = ("critical", "high", "medium")


def looked_up(key: Column, table: Mapping[str, str], default: str | None) -> Column:
    """A value of a small fixed table, in any case of letters."""
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(m, F.lower(F.trim(key))), F.lit(default))


def latex_wrapped(text: Column) -> Column:
    """Whether a text already stands between signs of a formula."""
    t = F.trim(text)
    pairs = [("$$", "$$"), ("\\[", "\\]"), ("\\(", "\\)"), ("$", "$")]
    out = F.lit(False)
    for a, b in pairs:
        out = out | (F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b)) & (F.length(t) >= len(a) + len(b)))
    return out


def language_route(script: Column) -> Column:
    """Languages and reason of the recogniser by the script that was seen."""
    han = F.lower(F.trim(script)) == "han"
    reason = F.when(script.isNull() | (script == ""), "unavailable").when(han, "han").otherwise("non_han")
    return F.struct(F.when(F.coalesce(han, F.lit(False)), "ch_sim+en").otherwise("en+vi").alias("languages"), reason.alias("reason"))


def fallback_reason(candidate: Column, baseline: Column, error: Column, valid_: Column, empty_regions: Column) -> Column:
    """Why a candidate is not taken; NULL if it is."""
    return (
        F.when(error.isNotNull(), "error").when(candidate.isNull(), "missing").when(~valid_, "invalid").when(F.trim(candidate) == "", "empty")
        .when(empty_regions, "empty_for_regions").when(collapsed_badly(baseline, candidate), "collapsed")
    )


def token_stats(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Per stream of tokens: number, characters that are no space, and whether all are well formed (text, ordered finite box, finite confidence)."""
    sound = F.col("text").isNotNull() & F.coalesce(valid(Box.of()), F.lit(False)) & (F.col("confidence").isNull() | (~F.isnan("confidence") & (F.abs("confidence") < float("inf"))))
    return tokens.groupBy(*keys).agg(F.count("*").alias("n_tokens"), F.sum(F.coalesce(F.length(F.regexp_replace("text", "\\s", "")), F.lit(0))).alias("n_chars"), F.every(sound).alias("valid"), F.sum(F.coalesce(F.regexp_count("text", F.lit("\\x{FFFD}")), F.lit(0))).alias("n_replaced"), F.bool_or(F.coalesce(F.col("text").rlike("[\\p{L}\\p{N}]"), F.lit(False))).alias("has_alnum"))


def routed_outcome(has_candidate: Column, valid_: Column, n_chars: Column, n_replaced: Column, has_alnum: Column) -> Column:
    """What came of a specialised reading."""
    return (
        F.when(~has_candidate, "BASELINE_ONLY").when(~valid_, "SPECIALIZED_MALFORMED").when(n_chars == 0, "SPECIALIZED_EMPTY")
        .when((n_replaced > 0.02 * n_chars) | ~has_alnum, "SPECIALIZED_SUSPICIOUS").otherwise("SPECIALIZED_OK")
    )


def policies(a_conf: Column, b_conf: Column, vietnamese: Column, agreement: Column, a_below: float = 0.6, b_below: float = 0.8, vi_from: float = 0.05, agree_below: float = 0.5) -> dict[str, Column]:
    """Which reading each policy takes: a, b or the fusion of both. A missing signal keeps the default."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    low_a, low_b, vi, apart = yes(a_conf < a_below), yes(b_conf < b_below), F.coalesce(vietnamese, F.lit(0.0)) >= vi_from, yes(agreement < agree_below)
    return {
        "a_always": F.lit("a"), "b_always": F.lit("b"), "b_if_low_confidence": F.when(low_a, "b").otherwise("a"), "b_if_vietnamese": F.when(vi, "b").otherwise("a"),
        "fusion_if_apart": F.when(apart, "fusion").otherwise("a"), "b_first_then_fusion": F.when(low_b, "fusion").otherwise("b"), "b_first_then_a": F.when(low_b, "a").otherwise("b"),
    }


def unpivoted(df: DataFrame, keys: list[str], columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """One row per key and named expression."""
    rows = F.array(*(F.struct(F.lit(k).alias(name), v.alias(value)) for k, v in columns.items()))
    return df.select(*keys, F.inline(rows))


TABLE_LABELS = ("table_detection", "table_structure", "merged_cells", "borderless_table")


def failures(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, type, severity: what went wrong, once per type at its worst. df has labels, recall, hallucinated and tables_ok.

    A document that held nothing back has no rows, whatever its labels say.
    """
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    is_table = lambda x: x.isin(*TABLE_LABELS)
    text, tables = F.filter(labels, lambda x: ~is_table(x)), F.filter(labels, is_table)
    first = lambda *options: F.coalesce(*(F.when(F.size(o) > 0, o) for o in options[:-1]), options[-1])
    grade = F.when(F.col("recall") == 0, 0).when(F.col("recall") < 0.5, 1).otherwise(2)
    rows = lambda when, types, level: F.when(when, F.transform(types, lambda t: F.struct(t.alias("type"), level.alias("level")))).otherwise(F.array().cast("array<struct<type:string,level:int>>"))
    named = lambda x: F.array(F.lit(x))
    found = F.concat(
        rows(F.col("hallucinated"), F.when(F.array_contains(labels, "encoding"), named("encoding")).otherwise(named("other")), F.lit(0)),
        rows(F.col("recall") < 1, first(text, labels, named("other")), grade),
        rows(~F.col("tables_ok"), first(tables, named("table_detection")), F.lit(1)),
    )
    worst = df.select(*keys, F.inline(found)).groupBy(*keys, "type").agg(F.min("level").alias("level"))
    return worst.select(*keys, "type", F.get(F.array(*(F.lit(s) for s in SEVERITIES)), F.col("level")).alias("severity"))


def failure_kind(status: Column, message: Column) -> Column:
    return F.when(F.lower(F.coalesce(message, F.lit(""))).rlike("time[d]?[ -]?out"), "timeout").when(status == "completed", "completed").otherwise("failure")


def comparable_metrics(pairs: list[tuple[str, Column, Column]], errors: Column) -> Column:
    """Names of fields that differ between two runs, NULL equalling NULL, and 'errors' if there were any: the runs compare if it is empty."""
    return F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(n)) for n, a, b in pairs), F.when(errors > 0, F.lit("errors"))))


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """stage, place, n, fraction: rows that pass each condition and all before it; a failed or unknown condition ends the way."""
    passed, so_far = {}, F.lit(True)
    for name, c in stages.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        passed[name] = F.count_if(so_far)
    g = df.agg(F.count("*").alias("_all"), *(c.alias(n) for n, c in passed.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(i).alias("place"), F.col(n).alias("n")) for i, n in enumerate(passed)))
    return g.select("_all", F.inline(rows)).select("stage", "place", "n", F.try_divide("n", "_all").alias("fraction"))


def top_and_rest(df: DataFrame, value: str, k: int) -> DataFrame:
    """value, n of the k most frequent values, and all others as one row NULL with their number of values."""
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), value).limit(k)
    rest = n.join(F.broadcast(top.select(value)), value, "left_anti").agg(F.sum("n").alias("n"), F.count("*").alias("n_values")).where("n_values > 0")  # top has k rows
    return top.withColumn("n_values", F.lit(1).cast("bigint")).unionByName(rest.withColumn(value, F.lit(None).cast("string")))
