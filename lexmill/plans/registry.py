"""Retrievers by name, their parameters, experiments and sweeps, each as DataFrames from one shared index."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import chunking
from lexmill.operators import evaluate, index, ranking, rerank
from lexmill.sources.shared import stored

#: Documents of one part, about.
DEAL_ROWS = 2_000
NAMES = ("tfidf", "bm25", "chunked_tfidf", "chunked_bm25", "hybrid_rrf", "cross_encoder_rerank")


@dataclass(frozen=True)
class Params:
    """Parameters of a retriever, checked; `as_record` is what an experiment stores."""

    name: str = "tfidf"
    top_k: int = 5
    chunk_size: int = 1600
    chunk_stride: int | None = None
    chunking: str = "structured"
    tokenizer: str = "full"
    chunk_score_aggregation: str = "max"
    chunk_score_top_k: int = 2
    hybrid_retrievers: tuple[str, ...] = ("bm25", "chunked_bm25")
    rrf_k: int = 60
    first_stage: str = "hybrid_rrf"
    rerank: rerank.RerankOptions = rerank.RerankOptions()
    lemmas: bool = False

    def __post_init__(self):
        if self.name not in NAMES:
            raise ValueError(f"the retriever must be one of {NAMES}")
        ranking.check_depth(self.top_k)
        ranking.check_depth(self.chunk_score_top_k)
        ranking.check_depth(self.rrf_k)
        object.__setattr__(self, "chunk_stride", chunking.check_window(self.chunk_size, self.chunk_stride))
        if self.chunk_score_aggregation not in ranking.POOLING:
            raise ValueError(f"pooling must be one of {ranking.POOLING}")
        if self.chunking not in ("structured", "windows") or self.tokenizer not in ("full", "simple"):
            raise ValueError("chunking is structured or windows, the tokenizer full or simple")
        if self.name in ("hybrid_rrf", "cross_encoder_rerank") and (len(self.hybrid_retrievers) < 2 or not set(self.hybrid_retrievers) <= set(NAMES[:4])):
            raise ValueError("fusion takes two or more of the single retrievers")
        if self.first_stage not in NAMES[:5]:
            raise ValueError("the first stage is any other retriever")

    def as_record(self) -> dict:
        keep = {"name", "top_k", "tokenizer", "lemmas"}
        if "chunked" in self.name or self.name in NAMES[4:]:
            keep |= {"chunk_size", "chunk_stride", "chunking", "chunk_score_aggregation", "chunk_score_top_k"}
        if self.name in NAMES[4:]:
            keep |= {"hybrid_retrievers", "rrf_k"}
        if self.name == NAMES[5]:
            keep |= {"first_stage", "rerank"}
        return {k: v for k, v in asdict(self).items() if k in keep}


class Retriever(Protocol):
    """Anything that ranks documents for questions(qid, question): (qid, rank, doc_id, score)."""

    def retrieve(self, questions: DataFrame, k: int) -> DataFrame: ...


class Corpus:
    """Documents(doc_id, text) with the indexes that retrievers share; each is built once, when first needed."""

    def __init__(self, docs: DataFrame, lemmas: DataFrame | None = None):
        self.docs, self.lemmas = docs, lemmas
        self._indexes: dict[tuple, index.Index] = {}
        self._dealt: tuple[DataFrame, int] | None = None
        self._kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, kept until the corpus is released: for what several joins of a query read."""
        self._kept.append(df.persist())
        return df

    def settle(self, df: DataFrame) -> DataFrame:
        """df, written to the shared folder and read back: for small tables that end a long plan, which nothing later has to carry."""
        return stored(df, "settled")

    def terms(self, questions: DataFrame, tokenizer: str) -> DataFrame:
        """The terms of questions, lemmatised as those of the documents and passages are."""
        return index.query_terms(questions, index.tokenizer(tokenizer), self.lemmas)

    def dealt(self) -> tuple[DataFrame, int]:
        """The documents, dealt by doc_id once for all that is made of them, and into how many parts: about DEAL_ROWS documents each."""
        if self._dealt is None:
            parts = max(self.docs.sparkSession.sparkContext.defaultParallelism, -(-self.docs.count() // DEAL_ROWS))
            self._dealt = (self.docs.repartition(parts, "doc_id"), parts)
        return self._dealt

    @staticmethod
    def key(p: Params) -> tuple:
        """What names the index that a single retriever reads."""
        return (p.chunking, p.chunk_size, p.chunk_stride, p.tokenizer, p.name == "chunked_bm25") if "chunked" in p.name else ("documents", p.tokenizer)

    def documents(self, tokenizer: str = "full", keep: bool = True) -> index.Index:
        """The index of whole documents; without `keep` its postings aren't kept, for what reads them once."""
        key = ("documents", tokenizer)
        if key not in self._indexes:
            docs, parts = self.dealt()
            self._indexes[key] = index.build_index(index.documents_as_units(docs, index.tokenizer(tokenizer)), lemmas=self.lemmas, parts=parts, whole=True, keep=keep)
        return self._indexes[key]

    def chunks(self, p: Params, candidates: DataFrame | None = None) -> DataFrame:
        """The passages, or those of candidates(doc_id), which are stored."""
        make = chunking.structured_chunks if p.chunking == "structured" else chunking.window_chunks
        if candidates is None:
            return make(self.dealt()[0], p.chunk_size, p.chunk_stride)
        near = self.docs.join(index.few(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
        return self.settle(make(near, p.chunk_size, p.chunk_stride))

    def passages(self, p: Params, drop_empty: bool) -> index.Index:
        key = (p.chunking, p.chunk_size, p.chunk_stride, p.tokenizer, drop_empty)
        if key not in self._indexes:
            self._indexes[key] = index.build_index(index.chunks_as_units(self.chunks(p), index.tokenizer(p.tokenizer)), drop_empty, self.lemmas, self.dealt()[1])
        return self._indexes[key]

    def drop(self, but: tuple | None = None) -> None:
        """Frees the indexes, all or but one; what is asked for later builds them anew."""
        for key in [k for k in self._indexes if k != but]:
            self._indexes.pop(key).release()

    def release(self) -> None:
        self.drop()
        for x in self._kept:
            x.unpersist()
        self._kept = []

    def __del__(self):
        with contextlib.suppress(Exception):  # the session may be gone
            self.release()


def passage_scores(corpus: Corpus, questions: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Passage scores of the chunked retrievers, and how many passages each document has in the index."""
    bm25 = p.name == "chunked_bm25"
    made = corpus.passages(p, drop_empty=bm25)
    terms = corpus.terms(questions, p.tokenizer)
    scores = (index.bm25_scores if bm25 else index.tfidf_scores)(made, terms, keep=corpus.settle)
    counts = made.units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return scores, corpus.dealt()[0].select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


def retrieve(corpus: Corpus, questions: DataFrame, p: Params, k: int | None = None, scorer=None) -> DataFrame:
    """The k best documents (qid, rank, doc_id, score) of each question(qid, question); re-ranking takes a pair scorer, containment by default."""
    k = ranking.check_depth(p.top_k if k is None else k)
    if p.name in ("tfidf", "bm25"):
        terms = corpus.terms(questions, p.tokenizer)
        made = corpus.documents(p.tokenizer)
        scores = (index.bm25_scores if p.name == "bm25" else index.tfidf_scores)(made, terms, keep=corpus.settle)
        return ranking.dense_topk(scores, questions, corpus.docs.select("doc_id", F.lit(0.0).alias("pad")), k, corpus.settle)
    if p.name in ("chunked_tfidf", "chunked_bm25"):
        scores, counts = passage_scores(corpus, questions, p)
        pooled, pads = ranking.pool(scores, counts, p.chunk_score_aggregation, p.chunk_score_top_k)
        return ranking.dense_topk(pooled, questions, pads, k, corpus.settle)
    if p.name == "hybrid_rrf":
        parts = []
        for n in p.hybrid_retrievers:
            corpus.drop(but=corpus.key(replace(p, name=n)))  # rankings are stored, so two indexes never stand beside each other
            parts.append(retrieve(corpus, questions, replace(p, name=n), k))
        return ranking.reciprocal_rank_fusion(parts, k, p.rrf_k)
    first = corpus.settle(retrieve(corpus, questions, replace(p, name=p.first_stage), p.rerank.rerank_top_k))  # read by four joins
    corpus.drop()  # the candidates' passages are all that follows
    return rerank.rerank(first, questions, corpus.chunks(p, first), k, p.rerank, scorer or rerank.containment_scorer, corpus.lemmas, corpus.settle)


@dataclass(frozen=True)
class NamedRetriever:
    corpus: Corpus
    params: Params
    scorer: Callable[[DataFrame], DataFrame] | None = None

    def retrieve(self, questions: DataFrame, k: int) -> DataFrame:
        return retrieve(self.corpus, questions, self.params, k, self.scorer)


def create_retriever(name: str, corpus: Corpus, load_model: Callable | None = None, **options) -> NamedRetriever:
    """A retriever by name. load_model(max_length) runs once in each Python worker of the re-ranker and returns a
    function of questions and passages, which is called with batch_size pairs at once."""
    p = Params(name=name, lemmas=corpus.lemmas is not None, **options)
    scorer = None
    if load_model is not None:
        if name != "cross_encoder_rerank":
            raise ValueError("only the re-ranker takes a model")
        most = p.rerank.max_length
        scorer = rerank.model_scorer(lambda: load_model(most), p.rerank.batch_size)
    return NamedRetriever(corpus, p, scorer)


def depth(metric_ks, retrieve_k: int | None = None) -> int:
    """The depth to retrieve: the largest metric depth by default, ValueError if less."""
    most = max(evaluate.metric_depths(metric_ks))
    retrieve_k = most if retrieve_k is None else retrieve_k
    if retrieve_k < most:
        raise ValueError("retrieve_k must reach the largest metric depth")
    return retrieve_k


def experiment(corpus: Corpus, questions: DataFrame, p: Params, metric_ks=(5, 20), retrieve_k: int | None = None) -> dict[str, DataFrame]:
    """predictions, topic metrics and summary for questions with gold_doc_id, topic, split and fold.

    Ranking learns nothing from labels, so the index is built once and all folds and the holdout are scored together.
    """
    k = depth(metric_ks, retrieve_k)
    if p.name == "cross_encoder_rerank" and p.rerank.rerank_top_k < k:
        raise ValueError("rerank_top_k must reach retrieve_k")
    predictions = corpus.keep(retrieve(corpus, questions, p, k))
    placed = corpus.keep(evaluate.first_gold_rank(questions, predictions, k))
    return {"predictions": predictions.join(questions.select("qid", "split", "fold"), "qid"), "topics": evaluate.topic_metrics(placed, metric_ks), "summary": evaluate.cv_summary(placed, metric_ks)}


def _labelled(summary: DataFrame, **labels) -> DataFrame:
    return summary.select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")


def sweep_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("strict_cv_mean"), F.desc("strict_holdout"), "strict_cv_std")


def pooling_sweep(corpus: Corpus, questions: DataFrame, p: Params, modes=ranking.POOLING, metric_k: int = 5, depth_: int = 20) -> DataFrame:
    """One row per pooling mode; index and passage scores are made once for all of them, and the scores are not stored."""
    scores, counts = passage_scores(corpus, questions, p)
    pooled, pads = ranking.pool_several(scores, counts, tuple(modes), p.chunk_score_top_k)
    # All modes are ranked in one pass, as questions of their own: a mode's number goes before its question's name.
    named = F.array(*[F.struct(F.concat(F.lit(f"{i}|"), "qid").alias("qid"), F.col(mode).alias("score")) for i, mode in enumerate(modes)])
    every = corpus.settle(ranking.ranked(pooled.select("doc_id", F.inline(named)), depth_))
    out = None
    for i, mode in enumerate(modes):
        own = every.where(F.col("qid").startswith(f"{i}|")).withColumn("qid", F.expr(f"substring(qid, {len(str(i)) + 2})"))
        scored = pooled.select("qid", "doc_id", F.col(mode).alias("score"))
        placed = evaluate.first_gold_rank(questions, ranking.dense_topk(scored, questions, pads[mode], depth_, corpus.settle, own), depth_)
        row = _labelled(evaluate.cv_summary(placed, [metric_k]), chunk_score_aggregation=mode, chunk_score_top_k=p.chunk_score_top_k)
        out = row if out is None else out.unionByName(row)
    return out


def parse_windows(specs: list[str]) -> list[tuple[int, int]]:
    """SIZE:STRIDE strings; ValueError for a wrong form, a wrong number or a stride outside the size."""
    out = []
    for spec in specs:
        size, colon, stride = spec.partition(":")
        if not colon or not size.strip().isdigit() or not stride.strip().isdigit():
            raise ValueError(f"not SIZE:STRIDE: {spec!r}")
        out.append((int(size), chunking.check_window(int(size), int(stride))))
    return out


def chunking_sweep(corpus: Corpus, questions: DataFrame, p: Params, specs=("900:450", "1200:600", "1600:800", "2000:1000"), metric_k: int = 5, depth_: int = 20) -> DataFrame:
    """One row per SIZE:STRIDE with its overlap; each index is freed before the next is made."""
    out = None
    for size, stride in parse_windows(list(specs)):
        placed = corpus.keep(evaluate.first_gold_rank(questions, retrieve(corpus, questions, replace(p, chunk_size=size, chunk_stride=stride), depth_), depth_))
        placed.count()
        corpus.drop()  # one index at a time
        row = _labelled(evaluate.cv_summary(placed, [metric_k]), chunk_size=size, chunk_stride=stride, chunk_overlap=size - stride)
        out = row if out is None else out.unionByName(row)
    return out
