"""Question sets from the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.index import Index, few
from lexmill.sources.shared import stored
from lexmill.sources.tables import from_documents, spread


#: Terms of questions that may be broadcast; more are joined with a shuffle.
BROADCAST_TERMS = 200_000
#: Passages without an inner word that each text is searched for at once, about.
WORDLESS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(from_documents(table(spark, sf_dir, "documents")), "doc_id")


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a question (qid, question)."""
    return passages_as_questions(table(spark, sf_dir, "benchmark"))


def passages_as_questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.concat(F.lit("b_"), F.col("item_id").cast("string")).alias("qid"), F.coalesce("text", F.lit("")).alias("question"))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of the conversations as a question."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))


def labelled_questions(spark: SparkSession, sf_dir: str, made: Index | None = None, longest: int | None = None) -> DataFrame:
    """The benchmark passages with their gold documents, found by an index of the documents or their windows where there is one."""
    return labelled(table(spark, sf_dir, "documents"), benchmark_questions(spark, sf_dir), made, longest)


def labelled(docs: DataFrame, questions: DataFrame, made: Index | None = None, longest: int | None = None) -> DataFrame:
    """The questions(qid, question) that stand verbatim in a document: qid, question, gold_doc_id (the smallest id as text), topic (its language and source), fold, split.

    A document with the passage has each word between the passage's first and last blank, so candidates meet on
    the rarest of these and only they are compared as text. Passages without such a word are a query set of their own,
    which each document's text is searched for in blocks of WORDLESS passages. Empty passages stand nowhere. Where an
    index of the whole documents is at hand (full tokens, no lemmas), it tells which hold a word, and no text is cut into words.
    An index of windows does as well, by words of up to `longest` characters, by which windows overlap: these stand whole in one.
    """
    docs = docs.where(F.col("text").isNotNull())
    questions = questions.where("question <> ''")
    runs = lambda text: F.regexp_extract_all(T.normalize(text), F.lit(T.TOKEN), F.lit(0))
    short = lambda every: every if longest is None else F.filter(every, lambda w: F.length(w) <= longest)
    words = lambda text: F.array_distinct(runs(text) if made is None else short(T.generic_tokens(T.normalize(text))))
    inner = F.regexp_extract("question", r"(?s)\s(.*)\s", 1)
    asked = questions.select("qid", "question", F.explode(words(inner)).alias("term"))
    if made is None:
        terms = asked.select("term").distinct()
        small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        terms = F.broadcast(terms) if small else terms
        held = docs.select("doc_id", F.explode(words(F.col("text"))).alias("term")).join(terms, "term")
        frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        frequency = made.terms
    rarest = asked.join(frequency, "term").groupBy("qid", "question").agg(F.min(F.struct("df", "term")).alias("_r")).select("qid", "question", F.col("_r.term").alias("term"))
    texts = docs.select("doc_id", "text", "lang", "source")
    # What is told of a pair's text is computed where the text is: pairs are narrow.
    told = lambda pairs: pairs.select("qid", "question", "doc_id", "lang", "source", F.position(F.col("question"), F.col("text")).alias("_at"), F.length("text").alias("_chars"))
    if made is not None:
        # The index has the candidates, which are narrow; texts are read for them only.
        rarest = stored(rarest.select("qid", "term"), "rarest")
        near = stored(made.postings.join(few(rarest), "term").select("qid", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct(), "candidates")
        pairs = texts.join(few(near), "doc_id").join(few(questions.select("qid", "question")), "qid")
    elif small:
        # Each text is asked for the few rarest terms in one pass; neither words nor texts are shuffled.
        rarest = stored(rarest, "rarest")
        sought = F.broadcast(rarest.agg(F.collect_set("term").alias("_sought")))  # one row of at most BROADCAST_TERMS terms
        near = texts.crossJoin(sought).withColumn("term", F.explode(F.array_intersect(words(F.col("text")), F.col("_sought")))).drop("_sought")
        pairs = near.join(F.broadcast(rarest), "term")
    else:
        pairs = rarest.join(held, "term").join(texts, "doc_id")
    pairs = told(pairs.where(F.contains("text", F.col("question"))))
    wordless = questions.where(F.size(words(inner)) == 0)
    n = wordless.count()
    for i in range(-(-n // WORDLESS)):
        block = wordless.where(F.pmod(F.xxhash64("qid"), F.lit(-(-n // WORDLESS))) == i).select("qid", "question").collect()
        if block:
            listed = F.array(*[F.struct(F.lit(q).alias("qid"), F.lit(t).alias("question")) for q, t in block])
            found = texts.withColumn("_q", F.explode(F.filter(listed, lambda q: F.contains("text", q["question"]))))
            pairs = pairs.unionByName(told(found.select(F.col("_q.qid").alias("qid"), F.col("_q.question").alias("question"), "doc_id", "text", "lang", "source")))
    first = Window.partitionBy("qid").orderBy(F.col("doc_id").cast("string"))
    gold = pairs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
    fold = F.pmod("doc_id", F.lit(5)).cast("long")
    return gold.select("qid", "question", F.col("doc_id").cast("string").alias("gold_doc_id"), F.concat_ws("/", "lang", "source").alias("topic"), fold.alias("fold"), F.when(fold == 4, "holdout").otherwise("cv").alias("split"), "_at", "_chars").withColumn("gold_evidence_char_start", (F.col("_at") - 1).cast("long")).withColumn("gold_evidence_char_end", F.col("gold_evidence_char_start") + F.length("question")).withColumn("doc_chars", F.col("_chars").cast("long")).drop("_at", "_chars")
