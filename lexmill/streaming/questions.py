"""A stream of questions against a static corpus: each micro-batch is ranked as a batch query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexmill.plans.registry import Corpus, Params, retrieve


def rank_stream(questions: DataFrame, corpus: Corpus, params: Params, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int | None = None) -> StreamingQuery:
    """Starts a query that ranks streaming questions(qid, question) and hands each batch's ranking to sink.

    The index is static, so no state and no watermark is needed; a batch that is run again gives the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(retrieve(corpus, batch.select("qid", "question"), params, k), number)

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
