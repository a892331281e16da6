"""Mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer. A source may be used at most
max_repeats times. For a total budget, each source gets its share of it; a
source whose share exceeds its cap is clamped at the cap, and what it leaves
goes to the others in proportion to their weights, round by round until no
source exceeds its cap. Without a budget, the largest total is taken at which
no source that has tokens needs clamping, so the targets are met.

A source's amount is e epochs: every document floor(e) times, and a seeded
sample of documents, of the remaining fraction of the source's tokens, once
more. The sample is the documents of the lowest hash up to the wanted sum. To
find that cut without ordering a source in one task, hashes fall into BINS
fixed bins, bins are summed with map-side combination, and only the one bin in
which the cut lies is ordered.

Defined results: documents of a NULL source or one without target are left
out; a document with NULL or empty text has 0 tokens and follows its hash; a
target source without tokens gets none and its weight goes to the others; a
NULL share or cap counts as 0; repeated targets count once; repeated document
rows count once; empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.encode import TOKENIZER_DIR, VOCABULARY, token_counts
from foliospark.session import checkpoint

BINS = 65_536
MAX_SOURCES = 100_000  # target sources are configuration; their number is checked
SEED = 42


def water_fill(total: float, weights: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Amounts in proportion to weights, none above its cap, of the total or of all caps if these are less."""
    amount = dict.fromkeys(weights, 0.0)
    open_ = {s for s, w in weights.items() if w > 0 and caps[s] > 0}
    left = min(total, sum(caps[s] for s in open_))
    while open_ and left > 0:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * unit >= caps[s]}
        if not full:
            amount.update({s: weights[s] * unit for s in open_})
            break
        for s in full:
            amount[s] = caps[s]
            left -= caps[s]
        open_ -= full
    return amount


def feasible_total(weights: dict[str, float], caps: dict[str, float]) -> float:
    """The largest total at which every source with tokens keeps its share."""
    live = [s for s in weights if weights[s] > 0 and caps[s] > 0]
    share = sum(weights[s] for s in live)
    return min((caps[s] * share / weights[s] for s in live), default=0.0)


class Mix:
    """A planned mix: sizes per document, and per source the epochs and the cut."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = SEED, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
        spark = documents.sparkSession
        goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(MAX_SOURCES + 1).collect()
        if len(goal) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} target sources")
        self.weights = {g.source: float(g.w or 0) for g in goal}
        repeats = {g.source: max(0, int(g.r or 0)) for g in goal}
        names = F.broadcast(spark.createDataFrame([(s,) for s in self.weights], "source string"))  # at most MAX_SOURCES rows, checked above
        wanted = documents.select("doc_id", "source", "text").join(names, "source", "left_semi")
        sized = token_counts(wanted, ["doc_id", "source"], "text", directory, vocabulary)
        # doc_id is unique up to repeated rows, which hold the same text
        sized = sized.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
        self.sized = checkpoint(sized.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**62))).withColumn("bin", F.expr(f"cast(h div {2**62 // BINS} as int)")))
        self.size = dict.fromkeys(self.weights, 0) | {r.source: int(r.n) for r in self.sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        self.repeats = repeats
        self.replan(total_tokens)

    def replan(self, total_tokens: float | None = None) -> Mix:
        """Plan for another budget; documents keep their sizes."""
        caps = {s: float(self.size[s] * self.repeats[s]) for s in self.weights}
        self.total = feasible_total(self.weights, caps) if total_tokens is None else float(total_tokens)
        amount = water_fill(self.total, self.weights, caps)
        plan = []
        for s, a in amount.items():
            epochs = a / self.size[s] if self.size[s] else 0.0
            whole = min(self.repeats[s], int(epochs + 1e-9))
            plan.append((s, whole, max(0.0, a - whole * self.size[s]) if whole < self.repeats[s] else 0.0))
        self.plan = self.sized.sparkSession.createDataFrame(plan, "source string, whole int, part double")
        return self

    def documents(self) -> DataFrame:
        """doc_id, source, n_tokens, copies of every document that is used."""
        plan = F.broadcast(self.plan)  # one row per target source
        bins = self.sized.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"))
        below = F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n")
        cut = bins.withColumn("below", below).join(plan, "source").where("part > 0 and below < part and below + n >= part").select("source", F.col("bin").alias("cut"), "below")
        rows = self.sized.join(plan, "source").join(F.broadcast(cut), "source", "left")  # at most one cut per source
        edge = rows.where("bin = cut")
        run = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id"))
        # a document is in if the sum comes nearer to the wanted part with it than without it
        edge = edge.withColumn("more", (F.col("below") + run - F.col("n_tokens") / 2 <= F.col("part")).cast("int"))
        rest = rows.where("cut is null or bin <> cut").withColumn("more", F.expr("case when bin < cut then 1 else 0 end"))
        used = rest.unionByName(edge).withColumn("copies", F.col("whole") + F.col("more"))
        return used.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")

    def report(self) -> DataFrame:
        """Per target source: available and used tokens, target and actual share, epochs and the most copies."""
        spark = self.sized.sparkSession
        goal = spark.createDataFrame([(s, w, self.size[s]) for s, w in self.weights.items()], "source string, target_share double, available_tokens bigint")
        used = self.documents().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("n_docs"))
        out = goal.join(used, "source", "left").fillna(0, ["used_tokens", "most_copies", "n_docs"])
        total = F.sum("used_tokens").over(Window.partitionBy())  # over one row per target source
        return out.withColumn("actual_share", F.try_divide(F.col("used_tokens"), total)).withColumn("epochs", F.try_divide(F.col("used_tokens"), F.col("available_tokens")))
