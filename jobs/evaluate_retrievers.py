"""Ranks labelled questions with several retrievers and writes predictions, metrics and a submission for each.

Reads `documents` and `passages` (item_id, text); the passages that stand in a document are the labelled questions, the
document their right answer. Writes under `output`, partitioned, each run replacing the partitions of its retrievers:

- predictions, by retriever and split: the `depth` best documents of each question, and whether they are right;
- metrics, by retriever: recall at each depth, as mean and deviation over the folds and on the holdout;
- submissions, by retriever: the checked submission of `top_k` documents for all passages.

    python -m jobs.evaluate_retrievers --documents PATH --passages PATH --output PATH
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import evaluate, submission
from lexmill.plans.questions import labelled, passages_as_questions
from lexmill.plans.registry import Corpus, Params, retrieve
from lexmill.sources.tables import from_documents

from .common import command_line, parse

log = logging.getLogger("jobs.evaluate_retrievers")


@dataclass(frozen=True)
class Config:
    documents: str
    passages: str
    output: str
    retrievers: tuple = ("bm25", "tfidf")
    top_k: int = 5
    depth: int = 20
    chunking: str = "windows"


def _write(df: DataFrame, path: str, *by: str) -> None:
    """df into the partitions that it has rows of; others stay. Rows of one partition are gathered, so it has few files."""
    df.repartition(*by, F.pmod(F.xxhash64("qid"), F.lit(16)) if "qid" in df.columns else F.lit(0)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, config: Config) -> dict[str, int]:
    """Evaluates every retriever; returns the rows read and written."""
    if len(set(config.retrievers)) != len(config.retrievers) or not config.retrievers:
        raise ValueError("retrievers must be distinct names, one at least")
    depth = max(config.depth, config.top_k)
    raw = spark.read.parquet(config.documents)
    passages = passages_as_questions(spark.read.parquet(config.passages))
    corpus = Corpus(from_documents(raw))
    try:
        # The index that the single retrievers rank with tells the right documents too.
        questions = corpus.keep(labelled(raw, passages, corpus.documents()))
        count = {"documents": corpus.docs.count(), "passages": passages.count(), "questions": questions.count()}
        log.info("read %(documents)d documents and %(passages)d passages, of which %(questions)d have a right document", count)
        for name in config.retrievers:
            # Ranking learns nothing from labels: one ranking of all passages serves metrics and submission.
            ranked = corpus.keep(retrieve(corpus, passages, Params(name=name, chunking=config.chunking), depth))
            told = ranked.join(questions.select("qid", "split", "fold", "gold_doc_id"), "qid")
            rows = told.select(F.lit(name).alias("retriever"), "split", "fold", "qid", "rank", "doc_id", "score", (F.col("doc_id") == F.col("gold_doc_id")).alias("right"))
            _write(rows, f"{config.output}/predictions", "retriever", "split")
            placed = evaluate.first_gold_rank(questions, ranked, depth)
            metrics = evaluate.cv_summary(placed, sorted({config.top_k, depth})).withColumn("retriever", F.lit(name))
            _write(metrics, f"{config.output}/metrics", "retriever")
            best = submission.create_submission(ranked, config.top_k)
            submission.validate_submission(best, passages, corpus.docs, config.top_k)
            _write(best.withColumn("retriever", F.lit(name)), f"{config.output}/submissions", "retriever")
            for table in ("predictions", "metrics", "submissions"):
                count[f"{name} {table}"] = spark.read.parquet(f"{config.output}/{table}").where(F.col("retriever") == name).count()
            log.info("%s: wrote %d predictions, %d metrics and %d submission rows to %s", name, *[count[f"{name} {t}"] for t in ("predictions", "metrics", "submissions")], config.output)
    finally:
        corpus.release()
    return count


def main(argv=None) -> None:
    command_line(run, parse(Config, "evaluate_retrievers", __doc__.splitlines()[0], argv), "evaluate_retrievers")


if __name__ == "__main__":
    main()
