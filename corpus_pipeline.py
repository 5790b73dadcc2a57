"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import discard_since, stored, table, written
from lexmill.llm.op1_jaccard_join import one_of_each
from lexmill.llm.op2_language_id import accepted, fit
from lexmill.llm.op5_line_dedup import dedup_lines
from lexmill.llm.op8_mixing import mix_sources
from lexmill.llm.op10_decontamination import decontaminate

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language model accepts them; those without a letter, or unlike every language, go."""
    docs = docs.select(*COLUMNS)
    return accepted(docs, fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document; a line that stands in ten documents or more stays once, in the one with the smallest doc_id. n_chars follows the text."""
    out = dedup_lines(docs, min_docs=10, keep="first", carry=("lang", "source"))
    return out.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles of Jaccard similarity 0.8 or more connect: the smallest doc_id."""
    return one_of_each(docs.select(*COLUMNS), k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item in 20 words with 4 of 5 equal."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies."""
    mixed = mix_sources(docs.select(*COLUMNS), carry=("text", "lang", "n_chars"))
    return mixed.where(F.col("copies") > 0).select(*COLUMNS, "size", "copies", "taken")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: SQL can't express the first stage (a trained model), so the whole has none; tests/llm/test_pipeline.py checks each stage and run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mark = written()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        discard_since(mark, docs)  # what the stage stored on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
