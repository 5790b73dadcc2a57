"""The programs around the engine: experiments with files, validation splits with their protocol, submissions, and a description of the data.

Rankings, aggregates and tables are DataFrames; only small summaries reach the driver, to be written as JSON and Markdown.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import describe, evaluate, index, splits, submission
from lexmill.sources import tables

from .registry import Corpus, Params, depth, experiment, retrieve


def by_split(questions: DataFrame, assignments: DataFrame) -> DataFrame:
    """questions with the split ('cv' or 'holdout') and strict fold of each; ValueError unless every question has one."""
    role = F.when(F.col("strict_holdout_role") == "holdout", "holdout").otherwise("cv")
    placed = assignments.select("qid", role.alias("split"), F.col("strict_cv_fold").cast("int").alias("fold"))
    return splits.aligned(questions, placed, "qid")


def run_experiment(name: str, corpus: Corpus, questions: DataFrame, p: Params, paths: tables.Paths, metric_ks=(5, 20), retrieve_k: int | None = None, test: DataFrame | None = None) -> dict:
    """Runs an experiment on questions with gold_doc_id, topic, split and fold, and writes its files; returns its record.

    predictions/NAME_strict holds the ranking, partitioned by split; predictions/NAME_strict_cv_predictions, .._strict_holdout_predictions and, with test questions, .._test_predictions
    and metrics/NAME_topic_metrics are CSV folders; metrics/NAME_metrics.json is the record.
    """
    tables.ensure_output_dirs(paths)
    out = experiment(corpus, questions, p, metric_ks, retrieve_k)
    metrics, predictions = f"{paths.outputs_dir}/metrics/{name}", f"{paths.outputs_dir}/predictions/{name}"
    tables.write_parts(out["predictions"], f"{predictions}_strict", ("split",), ("fold", "qid", "rank"))
    ranked = questions.sparkSession.read.schema(out["predictions"].schema).parquet(f"{predictions}_strict")
    for split in ("cv", "holdout"):
        tables.write_csv(ranked.where(F.col("split") == split), f"{predictions}_strict_{split}_predictions", ("fold", "qid", "rank"), single=False)
    tables.write_csv(out["topics"], f"{metrics}_topic_metrics", ("split", "fold", "topic"))
    if test is not None:
        tables.write_csv(retrieve(corpus, test, p, depth(metric_ks, retrieve_k)), f"{predictions}_test_predictions", single=False)
    counts = {r["split"]: r["n"] for r in questions.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = evaluate.first_gold_rank(questions, ranked.select("qid", "rank", "doc_id"), depth(metric_ks, retrieve_k))
    folds = placed.where(F.col("split") == "cv").groupBy("fold").agg(F.count(F.lit(1)).alias("num_queries"), *evaluate.recalls(metric_ks)).orderBy("fold").collect()
    record = {
        "experiment": name, "retriever": p.as_record(), "num_documents": corpus.docs.count(), "num_queries": sum(counts.values()), "num_dev_queries": counts.get("cv", 0), "num_holdout_queries": counts.get("holdout", 0),
        "top_k": p.top_k, "retrieve_k": depth(metric_ks, retrieve_k), "metric_ks": list(metric_ks),
        "fold_metrics": [r.asDict() for r in folds], "all_metrics": {r["metric"]: {k: r[k] for k in ("strict_cv_mean", "strict_cv_std", "strict_holdout")} for r in out["summary"].collect()},
    }
    tables.write_json(record, f"{metrics}_metrics.json")
    return record


def make_splits(questions: DataFrame, folder: str, **options) -> dict:
    """Writes validation_splits (CSV), validation_metadata.json and validation_protocol.md for questions(qid, question, gold_doc_id, topic); returns the metadata."""
    assigned, metadata = splits.validation_splits(questions, **options)
    assigned = assigned.persist()
    Path(folder).mkdir(parents=True, exist_ok=True)
    tables.write_csv(assigned, f"{folder}/validation_splits", ("qid",))
    tables.write_json(metadata, f"{folder}/validation_metadata.json")
    spark = questions.sparkSession
    tables.write_report(
        "Validation protocol",
        {
            "Rules": "Choose models by the mean of recall over `strict_cv_fold`, where no right document is in two folds; watch its deviation and the recall of each topic. Touch the holdout only for final checks. `relaxed_cv_fold` lets documents repeat over folds: a gain only there is suspicious.",
            "Parameters": spark.createDataFrame([(k, str(v)) for k, v in metadata.items()], "parameter string, value string"),
            "Holdout": splits.holdout_summary(assigned, "strict_holdout_role").orderBy("strict_holdout_role"),
            "Strict folds": splits.fold_summary(assigned, "strict_cv_fold").orderBy("strict_cv_fold"),
            "Relaxed folds": splits.fold_summary(assigned, "relaxed_cv_fold").orderBy("relaxed_cv_fold"),
            "Documents that relaxed folds share": splits.fold_leakage(assigned, "relaxed_cv_fold").orderBy("relaxed_cv_fold"),
        },
        f"{folder}/validation_protocol.md",
        percent=("leaking_share",),
    )
    assigned.unpersist()
    return metadata


def make_submission(corpus: Corpus, questions: DataFrame, p: Params, paths: tables.Paths, name: str, k: int = 5) -> DataFrame:
    """Ranks test questions, checks the submission and writes it to submissions/NAME as one CSV; returns it."""
    tables.ensure_output_dirs(paths)
    made = submission.create_submission(retrieve(corpus, questions, p, k), k)
    submission.validate_submission(made, questions, corpus.docs, k)
    tables.write_csv(made, f"{paths.outputs_dir}/submissions/{name}", ())
    return made


def describe_data(corpus: Corpus, train: DataFrame, test: DataFrame, path: str, k: int = 5, least: int = 8) -> None:
    """Writes a report on documents, questions(qid, question, gold_doc_id, topic), and what plain TF-IDF makes of them."""
    docs, spark = describe.lengths(corpus.docs), train.sparkSession
    texts = splits.texts_of(train, corpus.docs, "gold_doc_id")
    asked = lambda df: df.withColumn("q_tokens", F.size(T.tokenize(F.col("question"))))
    median = lambda df, c, name: df.agg(F.percentile(c, 0.5).alias(f"{name}_median"), F.percentile(c, 0.9).alias(f"{name}_p90"), F.max(c).cast("double").alias(f"{name}_max"))
    overlap = texts.select("qid", T.containment(T.tokenize(F.col("question")), T.tokenize(F.col("text"))).alias("o"))
    nearest_doc = corpus.keep(describe.nearest(corpus.documents(), keep=corpus.keep))
    units = lambda df: df.select(F.col("qid").alias("unit_id"), F.col("qid").alias("doc_id"), T.tokenize(F.col("question")).alias("tokens"))
    nearest_question = corpus.keep(describe.nearest(index.build_index(units(train)), units(test), keep=corpus.keep))
    share = lambda df, c, *limits: df.agg(F.percentile(c, 0.5).alias("median"), *[F.avg((F.col(c) >= x).cast("double")).alias(f"share_from_{x}") for x in limits])
    placed = corpus.keep(evaluate.first_gold_rank(texts.select("qid", "gold_doc_id", "topic", T.document_kind(F.col("text")).alias("kind"), T.court_instance(F.col("text")).alias("instance")), retrieve(corpus, train, Params(), k), k))
    hard = evaluate.hits_by(placed, "topic", k, least)
    rows = [("documents", corpus.docs.count()), ("train questions", train.count()), ("test questions", test.count())]
    tables.write_report(
        "Data for retrieval",
        {
            "Tables": spark.createDataFrame(rows, "table string, n_rows long"),
            "Kinds of documents": describe.value_counts(corpus.docs.withColumn("kind", T.document_kind(F.col("text"))), "kind").orderBy(F.desc("n"), "value"),
            "Instances": describe.value_counts(corpus.docs.withColumn("instance", T.court_instance(F.col("text"))), "instance").orderBy(F.desc("n"), "value"),
            "Lengths of documents": median(docs, "n_chars", "chars").crossJoin(median(docs, "n_tokens", "tokens")),
            "Groups of equal texts": describe.duplicate_groups(corpus.docs).orderBy(F.desc("n"), "doc_ids").limit(10),
            "Nearest other document": share(nearest_doc, "similarity", 0.7, 0.8),
            "Lengths of questions": median(asked(train), "q_tokens", "train").crossJoin(median(asked(test), "q_tokens", "test")),
            "Topics": describe.value_counts(train, "topic").orderBy(F.desc("n"), "value").limit(20),
            "Right documents": describe.gold_coverage(train, corpus.docs),
            "Words of questions in their documents": share(overlap, "o", 0.3, 0.5),
            "Words of test questions in train questions": describe.vocabulary_coverage(test, train),
            "Nearest train question of each test question": share(nearest_question, "similarity", 0.5, 0.7),
            "Recall of TF-IDF": evaluate.recall_at_k(placed, (1, k)),
            "Recall by kind": evaluate.hits_by(placed, "kind", k, 1).orderBy("kind"),
            "Recall by instance": evaluate.hits_by(placed, "instance", k, 1).orderBy("instance"),
            "Hardest topics": describe.head(hard, 5, f"recall_at_{k}", "topic"),
            "Easiest topics": describe.tail(hard, 5, f"recall_at_{k}", "topic"),
            "Hard documents": describe.head(evaluate.hits_by(placed, "gold_doc_id", k, least), 10, f"recall_at_{k}", "gold_doc_id"),
        },
        path,
    )
