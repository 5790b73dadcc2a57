"""The jobs as registered queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import kept
from lexmill.plans import sql as S
from lexmill.sources.shared import new_folder

from . import evaluate_retrievers, index_documents


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting of the index, and a row without a term for documents without tokens."""
    folder = new_folder(spark, "job1")
    config = index_documents.Config(f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint", buckets=8)
    for _ in range(2):
        index_documents.run(spark, config)
    index = kept.open_index(spark, f"{folder}/index")
    return index.units.join(index.postings.select("doc_id", "term", "tf"), "doc_id", "left").select("doc_id", "dl", "term", "tf")


def job2_evaluate_retrievers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction of the labelled questions."""
    config = evaluate_retrievers.Config(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", new_folder(spark, "job2"))
    for _ in range(2):
        evaluate_retrievers.run(spark, config)
    out = spark.read.parquet(f"{config.output}/predictions")
    return out.select("retriever", "split", "fold", "qid", "rank", "doc_id", F.round("score", 6).alias("score"), "right")


_RANKED = lambda name, scoring: f"SELECT '{name}' AS retriever, * FROM (WITH {S.document_scores(scoring)},\n{S.top('dense', 20)}\nSELECT * FROM ranked)"
QUERIES = {"job1_index_documents": job1_index_documents, "job2_evaluate_retrievers": job2_evaluate_retrievers}
SQL = {
    "job1_index_documents": f"WITH {S.DOCS},\n{S.units(None)},\n{S.POSTINGS}\nSELECT lens.doc_id, CAST(dl AS BIGINT) AS dl, term, CAST(tf AS BIGINT) AS tf FROM lens LEFT JOIN postings ON postings.unit_id = lens.unit_id",
    "job2_evaluate_retrievers": f"""WITH {S.GOLD}, r AS ({_RANKED('bm25', S.BM25)} UNION ALL {_RANKED('tfidf', S.TFIDF)})
SELECT retriever, split, fold, qid, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score, doc_id = gold_doc_id AS right FROM r JOIN gold USING (qid)""",
}
