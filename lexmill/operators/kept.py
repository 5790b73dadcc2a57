"""An inverted index that is kept in files, grown batch by batch, and opened by its path.

Four tables stand under the path, each partitioned by batch; a batch that is written again replaces itself:

- postings(doc_id, term, part, tf, dl), bucketed by (term, part). A term that many documents of a batch hold is cut
  into parts of about PART_ROWS postings by its documents, so that no frequent term is one task's work.
- terms(term, df, parts, bounds), bucketed by term: what the batch adds to each term's document frequency, and bounds for
  its postings: for each power of two of document length the greatest tf and the least length, which bound a score
  whatever the mean length becomes. Documents that the batch replaces take their counts back as negative rows.
- units(doc_id, dl), bucketed by doc_id, and replaced(doc_id, of, dl): documents of older batches that came again.

Statistics are sums over these partial rows. Opening registers the files as tables with unique names; a join with the
postings needs no exchange of them, since the asked side is dealt to their buckets or, when small, broadcast.
"""

from __future__ import annotations

import contextlib
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from lexmill.sources.shared import stored

from . import index as I
from . import ranking

#: Postings of a term in one part, about.
PART_ROWS = 1_000_000
#: Documents of one task that counts words or sums scores, about.
DEAL_ROWS = 2_000
#: Rows that one task sorts and writes, about: a bucket of more has several files.
FILE_ROWS = 4_000_000
#: Rows of a side that may be broadcast after they were counted.
BROADCAST_ROWS = 200_000
TABLES = {
    "postings": ("doc_id STRING, term STRING, part INT, tf BIGINT, dl BIGINT", ("term", "part")),
    "terms": ("term STRING, df BIGINT, parts INT, bounds ARRAY<STRUCT<tf: BIGINT, dl: BIGINT>>", ("term",)),
    "units": ("doc_id STRING, dl BIGINT", ("doc_id",)),
    "replaced": ("doc_id STRING, of BIGINT, dl BIGINT", ("doc_id",)),
}


@dataclass(frozen=True)
class Kept:
    """An open index: postings(doc_id, term, part, tf, dl), terms(term, df, parts, bounds), units(doc_id, dl); n documents of avgdl tokens."""

    postings: DataFrame
    terms: DataFrame
    units: DataFrame
    n: int
    avgdl: float
    tokenizer: str
    names: tuple[str, ...]

    def release(self) -> None:
        """Forget the tables' names; the files stay."""
        for name in self.names:
            self.postings.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _settings(spark: SparkSession, path: str):
    """(buckets, tokenizer) of the index at path, None if there is none."""
    try:
        return spark.read.schema("buckets INT, tokenizer STRING").json(f"{path}/settings").first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _register(spark: SparkSession, path: str, buckets: int, existing: bool) -> dict[str, str]:
    made = {}
    for name, (columns, keys) in TABLES.items():
        made[name] = f"lexmill_{name}_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {made[name]} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}/{name}' OPTIONS (partitionOverwriteMode 'dynamic')")
        if existing:
            spark.sql(f"MSCK REPAIR TABLE {made[name]}")
    return made


def _few(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it was counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def parts_of(spark: SparkSession, n: int) -> int:
    """Into how many parts n documents are dealt."""
    return max(spark.sparkContext.defaultParallelism, -(-n // DEAL_ROWS))


def append(docs: DataFrame, path: str, batch: int, buckets: int = 64, tokenizer: str = "full", part_rows: int = PART_ROWS) -> dict[str, int]:
    """Writes docs(doc_id, text) as a batch of the index at path; returns the rows written to each table.

    Documents that older batches hold are replaced; of several rows with one doc_id that with the greatest text counts,
    rows without doc_id are left out, null texts are empty. Writing a batch again gives the same files' contents.
    buckets and tokenizer are fixed by the first batch.
    """
    spark = docs.sparkSession
    found = _settings(spark, path)
    if found is None:
        spark.createDataFrame([(buckets, tokenizer)], "buckets INT, tokenizer STRING").coalesce(1).write.mode("overwrite").json(f"{path}/settings")
    else:
        buckets, tokenizer = found
    names = _register(spark, path, buckets, found is not None)

    def write(name: str, df: DataFrame, rows: int = 0) -> None:
        columns = [c for c in spark.table(names[name]).columns if c != "batch"]
        keys = TABLES[name][1]
        # Buckets are remainders of the keys' hash, so each of a multiple of as many tasks has rows of one bucket only.
        tasks = buckets * max(1, -(-rows // (FILE_ROWS * buckets)))
        dealt = df.select(*columns).repartition(tasks, *keys).sortWithinPartitions(*keys)
        # Only the partition that is written is replaced: its table option says so.
        spark.sql(f"INSERT OVERWRITE TABLE {names[name]} SELECT {', '.join(columns)}, CAST({int(batch)} AS BIGINT) AS batch FROM {{dealt}}", dealt=dealt)

    try:
        make = I.tokenizer(tokenizer)
        dealt = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        once = dealt.repartition(parts_of(spark, dealt.count()), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
        split = once.select("doc_id", make(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("dl"), F.explode_outer("t").alias("term"))
        counted = split.groupBy("doc_id", "dl", "term").agg(F.count("term").alias("tf")).persist(StorageLevel.MEMORY_AND_DISK)
        units = counted.select("doc_id", "dl").distinct()
        words = counted.where("term IS NOT NULL")
        parts = F.ceil(F.sum("_n") / F.lit(part_rows)).cast("int")
        steps = words.groupBy("term", F.floor(F.log2("dl")).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))
        terms = steps.groupBy("term").agg(F.sum("_n").alias("df"), parts.alias("parts"), F.collect_list(F.struct("tf", "dl")).alias("bounds"))
        hot = terms.where("parts > 1").select("term", "parts")
        placed = words.join(_few(hot), "term", "left")
        part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")
        n_words = words.count()
        write("postings", placed.select("doc_id", "term", part.alias("part"), "tf", "dl"), n_words)
        write("units", units)
        older = f"batch < {int(batch)}"
        gone = spark.table(names["replaced"]).where(older).select("doc_id", F.col("of").alias("batch"))
        again = spark.table(names["units"]).where(older).join(units.select("doc_id"), "doc_id", "left_semi").join(gone, ["doc_id", "batch"], "left_anti")
        write("replaced", again.select("doc_id", F.col("batch").alias("of"), "dl"))
        taken = _few(spark.table(names["replaced"]).where(f"batch = {int(batch)}").select("doc_id", F.col("of").alias("batch")))
        back = spark.table(names["postings"]).where(older).join(taken, ["doc_id", "batch"]).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        none = [F.lit(0).alias("parts"), F.array().cast("array<struct<tf:bigint,dl:bigint>>").alias("bounds")]
        write("terms", terms.unionByName(back.select("term", "df", *none)), n_words)
        counted.unpersist()
        written = {name: spark.table(names[name]).where(f"batch = {int(batch)}").count() for name in TABLES}
    finally:
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return written


def open_index(spark: SparkSession, path: str) -> Kept:
    """The index at path as it stands; FileNotFoundError if there is none."""
    found = _settings(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    names = _register(spark, path, found[0], True)
    t = {name: spark.table(x) for name, x in names.items()}
    gone = t["replaced"].select("doc_id", F.col("of").alias("batch"))
    postings, units = t["postings"], t["units"]
    if not gone.isEmpty():
        gone = _few(gone)
        postings, units = (x.join(gone, ["doc_id", "batch"], "left_anti") for x in (postings, units))
    terms = t["terms"].groupBy("term").agg(F.sum("df").alias("df"), F.max("parts").alias("parts"), F.flatten(F.collect_list("bounds")).alias("bounds")).where("df > 0")
    total = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    (n, dl), (less, less_dl) = total(t["units"]), total(t["replaced"])
    return Kept(postings.drop("batch"), terms, units.drop("batch"), n - less, (dl - less_dl) / max(1, n - less), found[1], tuple(names.values()))


def build(docs: DataFrame, path: str, **options) -> Kept:
    """docs as the only batch of a new index, open."""
    append(docs, path, 0, **options)
    return open_index(docs.sparkSession, path)


# --- ranking ------------------------------------------------------------------------------------


def idf(kept: Kept, df: Column) -> Column:
    return F.ln(F.lit(kept.n) - df + 0.5) - F.ln(df + 0.5)


def impact(kept: Kept, w: Column, tf: Column, dl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """A term's part of a BM25 score."""
    return w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(kept.avgdl)))


def asked_terms(kept: Kept, questions: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """The known terms of questions(qid, question): (qid, term, w, df, parts, bounds), w being the idf as often as the question says the term."""
    mean = kept.terms.agg(F.coalesce(F.avg(idf(kept, F.col("df"))), F.lit(0.0))).first()[0]
    own = idf(kept, F.col("df"))
    w = F.col("qtf") * F.when(own < 0, F.lit(epsilon * mean)).otherwise(own)
    terms = I.query_terms(questions, I.tokenizer(kept.tokenizer))
    return kept.terms.join(terms, "term").select("qid", "term", w.alias("w"), "df", "parts", "bounds")


def by_parts(asked: DataFrame) -> DataFrame:
    """asked, once for each part of its term: what meets the buckets of the postings."""
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def dealt_postings(kept: Kept, asked: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl) of the asked terms, each posting once, dealt by document."""
    wanted = _few(by_parts(asked.select("term", "parts").distinct()).select("term", "part"))
    near = kept.postings.join(wanted, ["term", "part"], "left_semi").select("doc_id", "term", "tf", "dl")
    return near.repartition(parts_of(kept.postings.sparkSession, kept.n), "doc_id")


def scores(kept: Kept, asked: DataFrame) -> DataFrame:
    """(qid, doc_id, score) of all documents that share one of the asked terms.

    The postings of asked terms, each once whatever the number of questions, are dealt by document; there they meet the
    questions and are summed, so no pair of a question and a document is shuffled.
    """
    met = dealt_postings(kept, asked).join(_few(asked.select("qid", "term", "w")), "term")
    return met.groupBy("qid", "doc_id").agg(F.sum(impact(kept, F.col("w"), F.col("tf"), F.col("dl"))).alias("score"))


def bm25_topk(kept: Kept, questions: DataFrame, k: int) -> DataFrame:
    """The k best (qid, rank, doc_id, score) of each question, documents without a match with score 0."""
    pads = kept.units.select("doc_id", F.lit(0.0).alias("pad"))
    asked = stored(asked_terms(kept, questions).drop("bounds"), "asked")
    return ranking.dense_topk(scores(kept, asked), questions, pads, k, lambda df: stored(df, "ranked"))
