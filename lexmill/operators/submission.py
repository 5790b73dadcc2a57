"""Submissions: made from predictions, and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import few
from .ranking import deduplicated

#: Rules in the order in which they are checked.
RULES = ("columns", "nulls", "duplicates", "too_many", "missing_qids", "extra_qids", "unknown_docs")


def with_rank(predictions: DataFrame, position: str | None = None) -> DataFrame:
    """predictions with a rank: their own, or a running count of each question by an explicit position column."""
    if "rank" in predictions.columns:
        return predictions
    if position is None:
        raise ValueError("predictions need a rank or a position column: a DataFrame has no order of its own")
    return predictions.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(position)).cast("long"))


def ranked_submission(predictions: DataFrame, k: int = 5, position: str | None = None) -> DataFrame:
    """(qid, rank, doc_id): each question's first k distinct documents; the rank gives a file its order."""
    ids = with_rank(predictions, position).withColumn("qid", F.col("qid").cast("string")).withColumn("doc_id", F.col("doc_id").cast("string"))
    return deduplicated(ids, k)


def create_submission(predictions: DataFrame, k: int = 5, position: str | None = None) -> DataFrame:
    """The submission itself: qid, doc_id, ordered by question and rank."""
    return ranked_submission(predictions, k, position).orderBy("qid", "rank").select("qid", "doc_id")


def violations(submission: DataFrame, questions: DataFrame, documents: DataFrame, k: int = 5) -> DataFrame:
    """(rule, n): how often each rule is broken, in the order of RULES, as one union of small aggregates."""
    s = submission.select("qid", "doc_id")
    q = questions.select("qid").distinct()
    # Only the ids that a submission names are looked for: where they are few, the documents' ids are neither shuffled nor made distinct.
    named = few(s.select("doc_id").distinct())
    d = documents.select("doc_id").join(named, "doc_id", "left_semi").distinct()
    wrong = int(submission.columns[:2] != ["qid", "doc_id"] or len(submission.columns) > 2)
    n = F.count(F.lit(1)).alias("n")
    counts = {
        "columns": submission.sparkSession.range(1).select(F.lit(wrong).cast("long").alias("n")),
        "nulls": s.where(F.col("qid").isNull() | F.col("doc_id").isNull()).agg(n),
        "duplicates": s.groupBy("qid", "doc_id").count().where("count > 1").agg(n),
        "too_many": s.groupBy("qid").count().where(F.col("count") > k).agg(n),
        "missing_qids": q.join(s, "qid", "left_anti").agg(n),
        "extra_qids": s.select("qid").distinct().join(q, "qid", "left_anti").agg(n),
        "unknown_docs": s.select("doc_id").distinct().join(d, "doc_id", "left_anti").agg(n),
    }
    out = None
    for rule in RULES:
        row = counts[rule].select(F.lit(rule).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def validate_submission(submission: DataFrame, questions: DataFrame, documents: DataFrame, k: int = 5) -> None:
    """ValueError on the first broken rule."""
    if submission.columns != ["qid", "doc_id"]:
        raise ValueError(f"columns: {submission.columns}, not ['qid', 'doc_id']")
    found = {r["rule"]: r["n"] for r in violations(submission, questions, documents, k).collect()}
    for rule in RULES:
        if found[rule]:
            raise ValueError(f"{rule}: {found[rule]}")
