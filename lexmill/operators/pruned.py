"""Exact BM25 top-k that leaves out most postings of frequent terms.

Bounds of a term's part of a score come from the kept statistics (greatest tf and least length of each power of two of
length, so they hold for every posting). In rounds, for all questions at once:

1. the rarest terms of a question, up to SEED_ROWS postings, are scored; the kth of these scores, with what negative
   terms could still take away, is a threshold that the kth of the whole scores reaches;
2. terms are essential unless the bounds of all weaker ones together stay under the threshold: a document that has only
   unessential terms can't be among the k best, so only postings of essential terms make candidates;
3. candidates whose score and the unessential bounds stay under the threshold go, and only the survivors look up their
   unessential terms.

Questions whose threshold isn't above the score of documents without a match (0) prune nothing, so padding and negative
idf come out as in the unpruned ranking.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import stored

from . import kept as K
from . import ranking

#: Postings of the terms that set a question's threshold.
SEED_ROWS = 20_000
#: Scores are ranked on eight decimals, so a bound this little under the threshold still counts.
MARGIN = 1e-6


@dataclass
class Search:
    """A pruned ranking and what it reads, as DataFrames; release() frees what is kept for the rounds."""

    kept: K.Kept
    questions: DataFrame
    k: int
    seed_rows: int = SEED_ROWS
    _held: list = field(default_factory=list)

    def _keep(self, df: DataFrame) -> DataFrame:
        self._held.append(df.persist())
        return df

    def release(self) -> None:
        for df in self._held:
            df.unpersist()
        self._held.clear()

    def __post_init__(self):
        ranking.check_depth(self.k)
        most = F.array_max(F.transform("bounds", lambda b: K.impact(self.kept, F.lit(1.0), b["tf"], b["dl"])))
        asked = K.asked_terms(self.kept, self.questions)
        self.asked = self._keep(asked.withColumn("_b", F.col("w") * most).withColumn("most", F.greatest(F.lit(0.0), "_b")).withColumn("least", F.least(F.lit(0.0), "_b")).drop("_b", "bounds"))
        rare = Window.partitionBy("qid").orderBy("df", "term")
        upto = F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, 0))
        sown = self.asked.withColumn("_seed", (upto <= self.seed_rows) | (F.row_number().over(rare) == 1))
        self.seeds = sown.where("_seed").drop("_seed")
        first = ranking.ranked(K.scores(self.kept, self.seeds), self.k).where(F.col("rank") == self.k).select("qid", "score")
        lost = sown.groupBy("qid").agg(F.sum(F.when(~F.col("_seed"), F.col("least")).otherwise(F.lit(0.0))).alias("lost"))
        reach = first.join(lost, "qid").select("qid", (F.col("score") + F.col("lost") - MARGIN).alias("reach")).where("reach > 0")
        weak = Window.partitionBy("qid").orderBy("most", F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
        split = self.asked.join(reach, "qid", "left").withColumn("_sum", F.sum("most").over(weak))
        self.terms = self._keep(split.withColumn("essential", F.col("reach").isNull() | (F.col("_sum") >= F.col("reach"))).drop("_sum"))

    def _parts(self, postings: DataFrame) -> DataFrame:
        return postings.select("qid", "doc_id", K.impact(self.kept, F.col("w"), F.col("tf"), F.col("dl")).alias("score"))

    def scores(self) -> DataFrame:
        """(qid, doc_id, score) of every document that may be among the k best."""
        essential, weaker = self.terms.where("essential"), self.terms.where("NOT essential")
        found = K.scores(self.kept, essential)
        rest = self.terms.groupBy("qid").agg(F.max("reach").alias("reach"), F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(F.lit(0.0))).alias("rest"))
        self.candidates = self._keep(found.join(K._few(rest), "qid").where(F.col("reach").isNull() | (F.col("score") + F.col("rest") >= F.col("reach"))).select("qid", "doc_id", "score"))
        # A document's questions are one row, joined by doc_id alone: candidates lie as the postings are dealt, and
        # each posting of a weaker term moves once, whatever the number of questions.
        held = self.candidates.groupBy("doc_id").agg(F.collect_set("qid").alias("_asked"))
        near = K.dealt_postings(self.kept, weaker).join(held.hint("shuffle_hash"), "doc_id")
        looked = self._parts(near.join(K._few(weaker.select("qid", "term", "w")), "term").where(F.array_contains("_asked", F.col("qid"))))
        return self.candidates.unionByName(looked).groupBy("qid", "doc_id").agg(F.sum("score").alias("score"))

    def topk(self) -> DataFrame:
        """(qid, rank, doc_id, score), as the unpruned ranking gives it."""
        pads = self.kept.units.select("doc_id", F.lit(0.0).alias("pad"))
        return ranking.dense_topk(self.scores(), self.questions, pads, self.k, lambda df: stored(df, "ranked"))

    def postings_met(self) -> DataFrame:
        """One row a question: postings that an unpruned ranking joins (every), and that this one joins (met): seeds, essential terms, and lookups."""
        size = lambda terms, name: terms.groupBy("qid").agg(F.sum("df").alias(name))
        self.scores()
        looks = self.candidates.join(self.terms.where("NOT essential").select("qid", "term"), "qid").groupBy("qid").agg(F.count(F.lit(1)).alias("_l"))
        rows = size(self.asked, "every").join(size(self.seeds, "_s"), "qid", "left").join(size(self.terms.where("essential"), "_e"), "qid", "left").join(looks, "qid", "left")
        return rows.select("qid", "every", sum((F.coalesce(c, F.lit(0)) for c in ("_s", "_e", "_l")), F.lit(0)).alias("met"))
