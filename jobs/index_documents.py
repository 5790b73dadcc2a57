"""Keeps an inverted index up to date with a folder of documents.

New Parquet files under `documents` are read by a file stream with a checkpoint, in micro-batches of at most `max_files`
files, until none is left. Each batch becomes one partition of the index at `output` (see lexmill.operators.kept);
documents that came before are replaced. A batch that failed half-way is written again by the next run and replaces
what it left, and a run without new files changes nothing.

    python -m jobs.index_documents --documents PATH --output PATH --checkpoint PATH
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lexmill.operators import kept
from lexmill.sources.tables import from_documents

from .common import command_line, parse

log = logging.getLogger("jobs.index_documents")


@dataclass(frozen=True)
class Config:
    documents: str
    output: str
    checkpoint: str
    buckets: int = 64
    max_files: int = 1000
    tokenizer: str = "full"


def run(spark: SparkSession, config: Config) -> dict[str, int]:
    """Indexes what is new; returns the rows written to each table of the index, and the number of batches."""
    total = {"batches": 0}

    def each(batch: DataFrame, number: int) -> None:
        written = kept.append(from_documents(batch), config.output, number, config.buckets, config.tokenizer)
        log.info("batch %d: read %d documents (%d replace older ones), wrote %d postings of %d terms to %s", number, written["units"], written["replaced"], written["postings"], written["terms"], config.output)
        total["batches"] += 1
        for name, n in written.items():
            total[name] = total.get(name, 0) + n

    schema = spark.read.parquet(config.documents).select("doc_id", "text").schema
    # A pattern that only the path itself matches: as one, it may also be a single file, not just a folder.
    path = config.documents.rstrip("/")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.max_files).parquet(f"{path[:-1]}[{path[-1]}]")
    stream = files.writeStream.foreachBatch(each).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    log.info("done: %d new batches from %s", total["batches"], config.documents)
    return total


def main(argv=None) -> None:
    command_line(run, parse(Config, "index_documents", __doc__.splitlines()[0], argv), "index_documents")


if __name__ == "__main__":
    main()
