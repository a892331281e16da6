"""Queries of the operators for training text, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import canonical, encode, mixing, moderation, mojibake, ocr
from foliospark.session import saved, table


def _pages(spark: SparkSession, sf_dir: str) -> ocr.Pages:
    texts = table(spark, sf_dir, "ocr_unbundle").select(F.col("unbundle_id").alias("id"), F.col("docling.text").alias("text"))
    return ocr.Pages(table(spark, sf_dir, "ocr_tokens"), texts)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("src", F.when(F.col("src") == "page", "ocr_tokens").otherwise("ocr_unbundle"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_pages(spark, sf_dir).found())


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired pages and texts without boxes in continuous paragraphs."""
    return _named(_pages(spark, sf_dir).paragraphs())


def p1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired documents: paragraphs that run over page ends put together."""
    return ocr.documents(saved(ocr.Pages(table(spark, sf_dir, "ocr_tokens")).paragraphs(), "paragraphs"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found(*(table(spark, sf_dir, n) for n in ("ocr_tokens", "annotated_grids", "hard_cases")))


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its canonical text."""
    rows = canonical.values(*(table(spark, sf_dir, n) for n in ("ocr_tokens", "annotated_grids", "hard_cases")))
    return canonical.with_canonical(rows, "text").select("src", "row_id", "pos_a", "pos_b", "canonical").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(table(spark, sf_dir, "page_inputs"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected pages with what could be restored, and whether the three quality ratios showed them."""
    pages, quality = table(spark, sf_dir, "page_inputs"), table(spark, sf_dir, "quality_results")
    done = mojibake.restore(pages).where("affected").select("page_input_id", "restored").distinct()
    keys = pages.select("page_input_id", "document_id", "page_index").distinct()
    shown = quality.groupBy("document_id", "page_index").agg(F.max((F.col("mixed_script_word_ratio") > 0) | (F.col("unexpected_script_ratio") > 0) | (F.col("replacement_ratio") > 0)).alias("shown"))
    return done.join(keys, "page_input_id").join(shown, ["document_id", "page_index"], "left").select("page_input_id", "restored", "shown")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).documents()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share per source."""
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets")).report()


def p7_budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares for a budget of as many tokens as all target sources hold, where caps bind."""
    mix = mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))
    return mix.replan(float(sum(mix.size.values()))).report()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("flagged").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged documents and rate per source."""
    return moderation.rates(p8_scores(spark, sf_dir))


def p8_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well held-out labels are met, per language."""
    return moderation.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p1_documents": p1_documents, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p8_held_out": p8_held_out, "p2_found": p2_found, "p2_canonical": p2_canonical, "p3_found": p3_found, "p3_restored": p3_restored, "p6_ids": p6_ids, "p7_mix": p7_mix, "p7_report": p7_report, "p7_budget_report": p7_budget_report}
SQL: dict[str, str] = {}
