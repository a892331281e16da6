"""Two readings of the same page: fusion, recovery decisions, ownership of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import jaccard, word_set
from foliospark.operators.boxes import best_overlap

OVERLAP, AGREE, CONFLICT, LOW = 0.4, 0.7, 0.3, 0.4


def decision(n_a: Column, n_b: Column, similarity: Column) -> Column:
    return (
        F.when(n_b == 0, "single_anchor").when(n_a == 0, "single_fine")
        .when(similarity >= AGREE, "keep_both_agree").when(similarity < CONFLICT, "conflict").otherwise("keep_both_partial")
    )


def fusion_groups(anchors: DataFrame, fine: DataFrame, keys: list[str]) -> DataFrame:
    """A group per anchor with the fine tokens it holds, and one per fine token that no anchor holds."""
    cols = ["token_pos", "text", "x0", "y0", "x1", "y1", "confidence"]
    a, b = anchors.select(*keys, *cols), fine.select(*keys, *cols)
    owned = best_overlap(b, a, keys, "token_pos", "token_pos", OVERLAP)
    words = F.array_sort(F.collect_list(F.struct("a_y0", "a_x0", "a_token_pos", "a_text")))
    held = owned.groupBy(*keys, F.col("b_token_pos").alias("token_pos")).agg(F.array_join(F.transform(words, lambda w: w["a_text"]), " ").alias("fine_text"), F.avg("a_confidence").alias("fine_confidence"), F.count("*").alias("n_fine"))
    dual = a.join(held, [*keys, "token_pos"], "left").select(*keys, F.lit("anchor").alias("side"), "token_pos", F.col("text").alias("anchor_text"), F.coalesce("fine_text", F.lit("")).alias("fine_text"), "fine_confidence", F.lit(1).alias("n_anchor"), F.coalesce("n_fine", F.lit(0)).alias("n_fine"))
    alone = b.join(owned.select(*keys, F.col("a_token_pos").alias("token_pos")), [*keys, "token_pos"], "left_anti")
    alone = alone.select(*keys, F.lit("fine").alias("side"), "token_pos", F.lit("").alias("anchor_text"), F.col("text").alias("fine_text"), F.col("confidence").alias("fine_confidence"), F.lit(0).alias("n_anchor"), F.lit(1).cast("bigint").alias("n_fine"))
    groups = dual.unionByName(alone).withColumn("similarity", jaccard(word_set(F.col("anchor_text")), word_set(F.col("fine_text"))))
    groups = groups.withColumn("decision", decision(F.col("n_anchor"), F.col("n_fine"), F.col("similarity")))
    weak = (F.col("decision") == "single_fine") & (F.col("fine_confidence") < LOW)
    status = F.when(F.col("decision") == "conflict", "conflict").when((F.col("decision") == "keep_both_partial") | F.coalesce(weak, F.lit(False)), "suspicious").otherwise("trusted")
    return groups.withColumn("status", status)


def fusion_summary(groups: DataFrame, keys: list[str]) -> DataFrame:
    is_ = lambda d: F.col("decision") == d
    n = groups.groupBy(*keys).agg(F.count("*").alias("n_groups"), *(F.count_if(is_(d)).alias("n_" + d) for d in ("single_anchor", "single_fine", "keep_both_agree", "keep_both_partial", "conflict")))
    dual = F.col("n_keep_both_agree") + F.col("n_keep_both_partial") + F.col("n_conflict")
    return n.withColumn("conflict_rate", F.when(dual > 0, F.col("n_conflict") / dual).otherwise(0.0))


def order_recovery(word_agreement: Column, order: Column, suspicious: Column, changed: Column) -> Column:
    """accept, or the first reason against it."""
    return F.when(word_agreement < 0.7, "different_words").when(order >= 0.95, "order_kept").when(suspicious, "suspicious_text").when(~changed, "unchanged").otherwise("accept")


def scan_recovery(agreement: Column, candidate: Column, old: Column, suspicious: Column, fused: Column) -> Column:
    ok = (F.length(candidate) > 0) & (candidate != old) & ~suspicious & fused.isin("keep_both_agree", "keep_both_partial")
    return F.when(agreement >= 0.5, "skipped").when(ok, "replaced").otherwise("kept")


def disposition(n_claims: Column, recovered: Column) -> Column:
    return F.when(recovered, "RECOVERED").when(n_claims == 0, "EXCLUDED").when(n_claims == 1, "ACCEPTED").otherwise("UNRESOLVED")
