"""Validation splits without leakage, and what describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import stored

from .folds import fold_of_groups

RARE = "__rare_topic__"


def collapse_rare(questions: DataFrame, min_count: int = 10, topic: str = "topic") -> DataFrame:
    """topic_bucket: the topic if it has at least min_count questions, else the rare bucket."""
    counts = questions.groupBy(topic).agg(F.count(F.lit(1)).alias("_n"))
    return questions.join(counts, questions[topic].eqNullSafe(counts[topic]), "left").drop(counts[topic]).withColumn("topic_bucket", F.when(F.col("_n") >= min_count, F.col(topic)).otherwise(F.lit(RARE))).drop("_n")


def distribution_score(part: DataFrame, whole: DataFrame, parts: int, topic: str = "topic") -> DataFrame:
    """One row: relative size error of the part against 1/parts of the whole, plus the L1 distance of the topic shares."""
    share = lambda df, name: df.groupBy(topic).agg(F.count(F.lit(1)).alias("n")).withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).select(topic, name)
    both = share(whole, "_a").join(share(part, "_b"), topic, "full")
    l1 = both.agg(F.coalesce(F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))), F.lit(0.0)).alias("l1"))
    want = whole.agg((F.count(F.lit(1)) / parts).alias("_want"))
    size = part.agg(F.count(F.lit(1)).alias("_n")).crossJoin(want).select((F.abs(F.col("_n") - F.col("_want")) / F.greatest(F.col("_want"), F.lit(1.0))).alias("size_error"))
    return size.crossJoin(l1).withColumn("score", F.col("size_error") + F.col("l1"))


def fold_scores(questions: DataFrame, fold: str = "fold", topic: str = "topic") -> DataFrame:
    """The distribution score of every fold at once: (fold, size_error, l1, score)."""
    counts = questions.groupBy(fold, topic).agg(F.count(F.lit(1)).alias("n"))
    totals = questions.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(fold).alias("parts"))
    both = counts.withColumn("size", F.sum("n").over(Window.partitionBy(fold))).withColumn("t", F.sum("n").over(Window.partitionBy(topic))).crossJoin(F.broadcast(totals))
    of_all, mean = F.col("t") / F.col("total"), F.col("total") / F.col("parts")
    return both.groupBy(fold).agg(
        F.max(F.abs(F.col("size") - mean) / F.greatest(mean, F.lit(1.0))).alias("size_error"),
        # topics without a question in the fold differ by their whole share
        (F.sum(F.abs(F.col("n") / F.col("size") - of_all)) + 1 - F.sum(of_all)).alias("l1"),
    ).withColumn("score", F.round(F.col("size_error") + F.col("l1"), 12))


def best_fold(scores: DataFrame, fold: str = "fold") -> DataFrame:
    """The fold with the smallest score, then the smallest number."""
    return scores.orderBy("score", fold).limit(1)


def fold_summary(questions: DataFrame, fold: str = "fold") -> DataFrame:
    return questions.where(F.col(fold).isNotNull()).groupBy(fold).agg(F.count(F.lit(1)).alias("num_queries"), F.countDistinct("gold_doc_id").alias("num_gold_docs"), F.countDistinct("topic").alias("num_topics"))


def holdout_summary(questions: DataFrame, role: str = "role") -> DataFrame:
    return questions.groupBy(role).agg(F.count(F.lit(1)).alias("num_queries"), F.countDistinct("gold_doc_id").alias("num_gold_docs"), F.countDistinct("topic").alias("num_topics"))


def fold_leakage(questions: DataFrame, fold: str = "fold") -> DataFrame:
    """By fold: gold documents of its questions, gold documents of the other folds, those in both, and their share."""
    pairs = questions.where(F.col(fold).isNotNull()).select(fold, "gold_doc_id").distinct()
    spread = pairs.groupBy("gold_doc_id").agg(F.count(F.lit(1)).alias("_f"))
    total = spread.agg(F.count(F.lit(1)).alias("_total"))
    leaking = (F.col("_f") > 1).cast("long")
    found = pairs.join(spread, "gold_doc_id").groupBy(fold).agg(F.count(F.lit(1)).alias("num_gold_docs"), F.sum(leaking).alias("num_leaking"), F.avg(leaking.cast("double")).alias("leaking_share"))
    others = F.col("_total") - F.col("num_gold_docs") + F.col("num_leaking")
    return found.crossJoin(F.broadcast(total)).select(fold, "num_gold_docs", others.alias("num_train_docs"), "num_leaking", "leaking_share")


def grouped_folds(questions: DataFrame, parts: int, seed: int, min_count: int = 10, name: str = "fold") -> DataFrame:
    """questions with a fold such that no gold document is in two folds and topics are spread evenly (null without a gold document)."""
    folds = fold_of_groups(collapse_rare(questions, min_count), "gold_doc_id", "topic_bucket", parts, seed)
    return questions.join(folds.withColumnRenamed("fold", name), "gold_doc_id", "left")


def relaxed_folds(questions: DataFrame, parts: int = 5, seed: int = 42, min_count: int = 10) -> DataFrame:
    """relaxed_cv_fold: questions dealt in turn within their topic bucket, in the order of a seeded hash; documents may repeat over folds."""
    w = Window.partitionBy("topic_bucket").orderBy(F.xxhash64(F.lit(seed), "qid"), "qid")
    return collapse_rare(questions, min_count).withColumn("relaxed_cv_fold", F.pmod(F.row_number().over(w) - 1, F.lit(parts)).cast("int")).drop("topic_bucket")


def validation_splits(questions: DataFrame, holdout_parts: int = 5, cv_parts: int = 4, relaxed_parts: int = 5, min_count: int = 10, seed: int = 42) -> tuple[DataFrame, dict]:
    """One row per question(qid, question, gold_doc_id, topic): topic_bucket, strict_holdout_role, strict_cv_fold (null on the holdout), relaxed_cv_fold; and the parameters with the fold that was chosen.

    The holdout is the candidate fold whose size and topics are nearest to the whole; the strict folds are made of
    the rest with the buckets counted anew.
    """
    base = stored(questions.select("qid", "question", "gold_doc_id", "topic"), "questions")
    candidates = grouped_folds(base, holdout_parts, seed, min_count, "_c")
    chosen = best_fold(fold_scores(candidates, "_c"), "_c").first()
    chosen = None if chosen is None else int(chosen["_c"])
    marked = candidates.withColumn("strict_holdout_role", F.when(F.col("_c") == F.lit(chosen), "holdout").otherwise("dev")).drop("_c")
    dev = grouped_folds(marked.where(F.col("strict_holdout_role") == "dev"), cv_parts, seed + 1, min_count, "strict_cv_fold")
    relaxed = relaxed_folds(base, relaxed_parts, seed, min_count).select("qid", "relaxed_cv_fold")
    buckets = collapse_rare(base, min_count).select("qid", "topic_bucket")
    out = marked.join(buckets, "qid").join(dev.select("qid", "strict_cv_fold"), "qid", "left").join(relaxed, "qid")
    metadata = {"holdout_fold": chosen, "holdout_splits": holdout_parts, "strict_cv_splits": cv_parts, "relaxed_cv_splits": relaxed_parts, "min_topic_count_for_stratify": min_count, "random_state": seed}
    return out.select("qid", "question", "gold_doc_id", "topic", "topic_bucket", "strict_holdout_role", "strict_cv_fold", "relaxed_cv_fold"), metadata


def validation_assignments(questions: DataFrame, **options) -> DataFrame:
    """The assignments of `validation_splits` alone."""
    return validation_splits(questions, **options)[0]


def texts_of(rows: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """rows with the text of the document that `key` names; ValueError with some of the ids if any has no document."""
    missing = [r[0] for r in rows.join(docs.select(F.col("doc_id").alias(key)), key, "left_anti").select(key).distinct().orderBy(key).limit(5).collect()]
    if missing:
        raise ValueError(f"no documents with the ids {missing}")
    return rows.join(docs.select(F.col("doc_id").alias(key), "text"), key)


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined 1:1 with right; ValueError unless the key is unique on both sides and every row of left finds its match."""
    for name, df in (("left", left), ("right", right)):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} repeats on the {name} side")
    if left.join(right, key, "left_anti").limit(1).count():
        raise ValueError(f"some {key} of the left side have no match")
    return left.join(right, key)
