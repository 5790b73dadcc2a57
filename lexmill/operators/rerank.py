"""Passages inside candidate documents, pair scores and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexmill.functions import text as T

from .index import query_terms, rounded
from .ranking import blend, ranked

EMPTY = "__empty__"


def top_chunks(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, limit: int, make=T.tokenize, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, lemmas: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """The best passages of each candidate(qid, doc_id): (qid, doc_id, place, chunk_no, score), ranked by BM25 inside the document alone.

    A document with at most `limit` passages, without any token, or a question without tokens gives its first
    passages in order. Each document is its own corpus: N, df and lengths are keyed by doc_id, so all documents
    are scored together. Passages without tokens count as one empty word.
    """
    near = chunks.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "chunk_no", make(F.col("chunk_text")).alias("tokens"))
    near = keep(near.withColumn("_empty", F.size("tokens") == 0).withColumn("tokens", F.when(F.col("_empty"), F.array(F.lit(EMPTY))).otherwise(F.col("tokens"))))  # tokens of the candidates' passages, read by four joins
    per_doc = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"), F.min(F.col("_empty").cast("int")).alias("_all_empty"))
    postings = near.select("doc_id", "chunk_no", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "chunk_no", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    postings = keep(T.lemma_terms(postings, lemmas, "tf"))
    df = postings.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.join(per_doc.select("doc_id", "n"), "doc_id").withColumn("_i", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = idf.groupBy("doc_id").agg(F.avg("_i").alias("_mean"))
    idf = idf.join(mean, "doc_id").select("doc_id", "term", F.when(F.col("_i") < 0, F.lit(epsilon) * F.col("_mean")).otherwise(F.col("_i")).alias("idf"))
    asked = candidates.select("qid", "doc_id").join(query_terms(questions, make, lemmas), "qid")
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = asked.join(postings, ["doc_id", "term"]).join(idf, ["doc_id", "term"]).join(per_doc.select("doc_id", "avgdl"), "doc_id").groupBy("qid", "doc_id", "chunk_no").agg(F.sum(part).alias("score"))
    sized = questions.select("qid", F.size(make(F.col("question"))).alias("_q"))
    every = candidates.select("qid", "doc_id").join(sized, "qid").join(per_doc, "doc_id").join(near.select("doc_id", "chunk_no"), "doc_id").join(scores, ["qid", "doc_id", "chunk_no"], "left")
    plain = (F.col("n") <= limit) | (F.col("_all_empty") == 1) | (F.col("_q") == 0)
    every = every.withColumn("score", F.when(plain, F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.0))))
    w = Window.partitionBy("qid", "doc_id").orderBy(F.desc(rounded(F.col("score"))), "chunk_no")
    return every.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit).select("qid", "doc_id", "place", F.col("chunk_no").cast("long").alias("chunk_no"), "score")


def containment_scorer(pairs: DataFrame) -> DataFrame:
    """The default pair scorer: the share of the question's distinct tokens that the passage has."""
    return pairs.withColumn("ce", T.containment(T.tokenize(F.col("question")), T.tokenize(F.col("chunk_text"))))


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch_size: int = 16) -> Callable[[DataFrame], DataFrame]:
    """A pair scorer from a model: `load` runs once in each Python worker and returns a function of questions and passages."""

    def scorer(pairs: DataFrame) -> DataFrame:
        schema = StructType([*pairs.schema.fields, StructField("ce", DoubleType())])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score = load()
            for frame in frames:
                out: list[float] = []
                for i in range(0, len(frame), batch_size):
                    part = frame.iloc[i : i + batch_size]
                    out += list(score(part["question"].tolist(), part["chunk_text"].tolist()))
                yield frame.assign(ce=out)

        return pairs.mapInPandas(run, schema)

    return scorer


@dataclass(frozen=True)
class RerankOptions:
    rerank_top_k: int = 20
    chunks_per_doc: int = 1
    combine_mode: str = "ce_only"
    ce_weight: float = 0.7
    sparse_weight: float = 0.3
    rrf_k: int = 60
    batch_size: int = 16
    max_length: int = 512

    def __post_init__(self):
        for name in ("rerank_top_k", "chunks_per_doc", "rrf_k", "batch_size", "max_length"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if self.combine_mode not in ("ce_only", "linear", "rrf"):
            raise ValueError("combine_mode must be ce_only, linear or rrf")
        if min(self.ce_weight, self.sparse_weight) < 0 or self.ce_weight + self.sparse_weight == 0:
            raise ValueError("the weights must not be negative and not both zero")


def rerank(first: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, options: RerankOptions = RerankOptions(), scorer=containment_scorer, lemmas: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """The first stage's candidates(qid, rank, doc_id, score) by pair score: best passage of each document, blended with the first stage, cut at min(k, rerank_top_k)."""
    candidates = first.where(F.col("rank") <= options.rerank_top_k)
    parts = top_chunks(candidates, questions, chunks, options.chunks_per_doc, lemmas=lemmas, keep=keep).join(chunks, ["doc_id", "chunk_no"]).join(questions.select("qid", "question"), "qid")
    ce = scorer(parts.select("qid", "doc_id", "question", "chunk_text")).groupBy("qid", "doc_id").agg(F.max("ce").alias("ce"))
    pairs = candidates.select("qid", "doc_id", F.col("score").alias("sparse")).join(ce, ["qid", "doc_id"])
    return ranked(blend(pairs, options.combine_mode, options.ce_weight, options.sparse_weight, options.rrf_k), min(k, options.rerank_top_k))
