"""The registered queries: each operator on whole tables, with SQL that says the same where SQL can."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import chunking
from lexmill.functions import text as T
from lexmill.operators import describe, evaluate, index, kept, lemmas, pruned, ranking, rerank, splits, submission
from lexmill.sources import tables
from lexmill.sources.shared import new_folder, stored

from . import sql as S
from .questions import benchmark_questions, corpus_documents, labelled_questions, table, user_turns
from .registry import Corpus, Params, chunking_sweep, pooling_sweep, retrieve, sweep_order

QUERIES: dict = {}
SQL: dict[str, str] = {}
WINDOWS = Params(name="chunked_bm25", chunking="windows")


_MADE: list[Corpus] = []


def _corpus(spark: SparkSession, d: str, lemmas: DataFrame | None = None) -> Corpus:
    """The documents as a corpus; what it keeps is released when the query's result is no longer held."""
    _MADE.append(Corpus(corpus_documents(spark, d), lemmas))
    return _MADE[-1]


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__

        @functools.wraps(f)
        def run(spark, d):
            _MADE.clear()
            out = f(spark, d)
            out._corpora = tuple(_MADE)
            _MADE.clear()
            return out

        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return f

    return register


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def long(c: str):
    return F.col(c).cast("long").alias(c)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- text ---------------------------------------------------------------------------------------


@query(f"WITH {S.DOCS} SELECT doc_id, md5({S.norm('text')}) AS normal, CAST(length({S.norm('text')}) AS BIGINT) AS n_chars FROM docs")
def normalize_documents(spark, d):
    n = T.normalize(F.col("text"))
    return corpus_documents(spark, d).select("doc_id", F.md5(n).alias("normal"), F.length(n).cast("long").alias("n_chars"))


@query(f"WITH {S.DOCS} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {S.tokens('text')} AS t FROM docs)")
def tokenize_documents(spark, d):
    t = corpus_documents(spark, d).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", "t")).alias("tokens"))


@query(f"WITH {S.DOCS} SELECT term, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM docs) GROUP BY term")
def token_stats(spark, d):
    t = corpus_documents(spark, d).select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return t.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(f"WITH {S.DOCS} SELECT doc_id, array_to_string({S.dates(S.norm('text'))}, ' ') AS dates, array_to_string({S.dotted(S.norm('text'))}, ' ') AS dotted FROM docs")
def numeric_reference_tokens(spark, d):
    n = T.normalize(F.col("text"))
    return corpus_documents(spark, d).select("doc_id", F.concat_ws(" ", T.numeric_date_tokens(n)).alias("dates"), F.concat_ws(" ", T.dotted_tokens(n)).alias("dotted"))


#: A reference made of each document's number, before its text: the Cyrillic patterns meet every row.
_REFERENCE = "'Ст. ' || (doc_id % 300 + 1) || '.2 ГК РФ и ФЗ-' || (400 + doc_id % 50) || ' от 5 мая 2021 года, дело № 2-' || doc_id || '/2020, УИД 77-' || doc_id || ' '"
_REFERRED = f"r AS (SELECT doc_id, coalesce(text, '') AS text, {_REFERENCE} || coalesce(text, '') AS t FROM documents)"


@query(f"""WITH {_REFERRED}, n AS (SELECT doc_id, {S.norm('t')} AS n, {S.norm('text')} AS own FROM r),
t AS (SELECT doc_id, list_concat(list_concat({S.generic('n')}, ['статья', 'article_' || (doc_id % 300 + 1) || '.2', 'фз', 'law_' || (400 + doc_id % 50), 'гк', 'рф', 'code_гк_рф']),
  list_concat(list_concat({S.dates('own')}, ['date_2021-05-05', 'case_2-' || doc_id || '/2020', 'uid_77-' || doc_id]), {S.dotted('n')})) AS t FROM n)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM t""")
def legal_special_tokens(spark, d):
    text = F.concat(F.expr(_REFERENCE), F.coalesce("text", F.lit("")))
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), T.tokenize(text).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", "t")).alias("tokens"))


@query(f"WITH {S.DOCS} SELECT doc_id, md5(array_to_string({S.lemma_tokens('text')}, ' ')) AS tokens FROM docs")
def lemma_lookup(spark, d):
    docs = _corpus(spark, d).dealt()[0]
    rows = docs.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    return T.lemmatize(rows, _lemmas(spark, d), key="doc_id").select("doc_id", F.md5(F.concat_ws(" ", "tokens")).alias("tokens"))


_STRIPPED = lambda x: rf"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"


@query(rf"WITH {S.DOCS}, p AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_STRIPPED("replace(text, '. ', '.' || chr(10) || ' ' || chr(10))")}, '\n\s*\n+'), lambda x: {_STRIPPED('x')}), lambda x: x <> '') AS p FROM docs) SELECT doc_id, CAST(len(p) AS BIGINT) AS n_parts, md5(array_to_string(p, '|')) AS parts FROM p")
def paragraph_split(spark, d):
    spread = F.replace(F.col("text"), F.lit(". "), F.lit(".\n \n"))  # each sentence as a paragraph
    p = corpus_documents(spark, d).select("doc_id", T.paragraphs(spread).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_parts"), F.md5(F.concat_ws("|", "p")).alias("parts"))


_SPACED = r"trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g'))"


@query(rf"WITH {S.DOCS}, s AS (SELECT doc_id, list_filter(string_split(regexp_replace({_SPACED}, '([.!?…;:])\s+([А-ЯЁA-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS s FROM docs) SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences FROM s")
def sentence_split(spark, d):
    s = corpus_documents(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.concat_ws("\n", "s")).alias("sentences"))


@query(f"WITH {S.DOCS},\n{S.windows(1600, 800)}\nSELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, md5(chunk_text) AS chunk FROM chunks")
def hard_split(spark, d):
    return chunking.window_chunks(corpus_documents(spark, d), 1600, 800).select("doc_id", long("chunk_no"), F.md5("chunk_text").alias("chunk"))


@query(f"WITH {S.DOCS},\n{S.structured(1600, 800)}\nSELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, md5(chunk_text) AS chunk FROM chunks")
def chunks_structured(spark, d):
    return chunking.structured_chunks(corpus_documents(spark, d), 1600, 800).select("doc_id", long("chunk_no"), F.md5("chunk_text").alias("chunk"))


#: A court's header before each document's text, by its number; every fifth has none.
_HEADERS = ("АПЕЛЛЯЦИОННОЕ ОПРЕДЕЛЕНИЕ", "Третий кассационный суд", "Р Е Ш Е Н И Е", "Апелляционный суд")
_HEADED = "CASE " + " ".join(f"WHEN doc_id % 5 = {i} THEN '{h}' || chr(10)" for i, h in enumerate(_HEADERS)) + " ELSE '' END || coalesce(text, '')"


@query(f"""WITH h AS (SELECT doc_id, {_HEADED} AS t FROM documents), k AS (SELECT doc_id, t, regexp_replace(upper(substr(t, 1, 800)), '[ \n]', '', 'g') AS h FROM h)
SELECT doc_id, CASE WHEN contains(h, 'АПЕЛЛЯЦИОННОЕОПРЕДЕЛЕНИЕ') THEN 'апелляционное определение' WHEN contains(upper(substr(t, 1, 1500)), 'КАССАЦИОН') THEN 'кассационное определение' WHEN contains(substr(h, 1, 300), 'РЕШЕНИЕ') THEN 'решение' ELSE 'определение' END AS kind FROM k""")
def document_kind(spark, d):
    return table(spark, d, "documents").select("doc_id", T.document_kind(F.expr(_HEADED)).alias("kind"))


@query(f"""WITH h AS (SELECT doc_id, upper(substr({_HEADED}, 1, 1500)) AS h FROM documents)
SELECT doc_id, CASE WHEN contains(h, 'КАССАЦИОН') THEN 'кассация' WHEN contains(h, 'АПЕЛЛЯЦИОН') THEN 'апелляция' ELSE 'первая инстанция' END AS instance FROM h""")
def court_instance(spark, d):
    return table(spark, d, "documents").select("doc_id", T.court_instance(F.expr(_HEADED)).alias("instance"))


@query(f"WITH {S.GOLD}, t AS (SELECT qid, {S.tokens('question')} AS a, {S.tokens('coalesce(text, chr(32))')} AS b FROM gold JOIN documents ON CAST(doc_id AS VARCHAR) = gold_doc_id) SELECT qid, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a)) END, 6) AS there, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(b, a)) / len(list_distinct(b)) END, 6) AS back FROM t")
def token_containment(spark, d):
    both = labelled_questions(spark, d).join(corpus_documents(spark, d), F.col("gold_doc_id") == F.col("doc_id"))
    a, b = T.tokenize(F.col("question")), T.tokenize(F.col("text"))
    return rounded(both.select("qid", T.containment(a, b).alias("there"), T.containment(b, a).alias("back")), "there", "back")


@query(f"WITH {S.GOLD} SELECT qid, gold_doc_id, CAST(place0 AS BIGINT) AS start, CAST(place0 + length(question) AS BIGINT) AS stop, true AS matches, round(place0 / chars, 6) AS position FROM gold")
def evidence_offsets(spark, d):
    both = labelled_questions(spark, d).join(corpus_documents(spark, d), F.col("gold_doc_id") == F.col("doc_id"), "left")
    a, b = F.col("gold_evidence_char_start"), F.col("gold_evidence_char_end")
    return both.select("qid", "gold_doc_id", a.alias("start"), b.alias("stop"), T.evidence_matches(F.col("text"), a.cast("int"), b.cast("int"), F.col("question")).alias("matches"), F.round(T.position_ratio(a, F.col("doc_chars")), 6).alias("position"))


@query("WITH t AS (SELECT doc_id, lang || '/' || source AS topic FROM documents) SELECT doc_id, topic, CASE WHEN count(*) OVER (PARTITION BY topic) >= 10 THEN topic ELSE '__rare_topic__' END AS topic_bucket FROM t")
def rare_topic_collapse(spark, d):
    topics = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("topic"))
    return splits.collapse_rare(topics, 10).select("doc_id", "topic", "topic_bucket")


# --- index --------------------------------------------------------------------------------------

_INDEX = f"WITH {S.DOCS},\n{S.units(None)},\n{S.POSTINGS}\n"


@query(_INDEX + "SELECT unit_id, term, CAST(tf AS BIGINT) AS tf FROM postings")
def postings(spark, d):
    return _corpus(spark, d).documents(keep=False).postings.select("unit_id", "term", "tf")


@query(_INDEX + "SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM bm")
def term_stats_bm25(spark, d):
    return rounded(index.bm25_terms(_corpus(spark, d).documents(keep=False)), "idf")


@query(_INDEX + "SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM ti")
def term_stats_tfidf(spark, d):
    return rounded(index.tfidf_terms(_corpus(spark, d).documents(keep=False)), "idf")


# --- retrieval ----------------------------------------------------------------------------------


def _ranking(params: Params, k: int = 5, lemmas: bool = False):
    def run(spark, d):
        corpus = _corpus(spark, d, _lemmas(spark, d, params.name != "bm25") if lemmas else None)
        return rounded(retrieve(corpus, benchmark_questions(spark, d), params, k), "score")

    return run


query(S.topk(), "bm25_topk")(_ranking(Params(name="bm25")))
query(S.topk(scoring=S.TFIDF), "tfidf_topk")(_ranking(Params(name="tfidf")))
query(S.topk(scoring=S.TFIDF, tok=S.simple_tokens), "tfidf_simple_topk")(_ranking(Params(name="tfidf", tokenizer="simple")))
for _mode in ranking.POOLING:
    query(S.topk(chunked=(1600, 800), mode=_mode), f"chunked_bm25_{_mode}")(_ranking(replace(WINDOWS, chunk_score_aggregation=_mode)))
query(S.topk(scoring=S.TFIDF, chunked=(1600, 800)), "chunked_tfidf_max")(_ranking(replace(WINDOWS, name="chunked_tfidf")))
query(S.topk(chunked=("structured", 1600, 800)), "chunked_bm25_structured")(_ranking(Params(name="chunked_bm25")))
query(f"WITH {S.fused(20)}\n{S.show('hybrid')}", "hybrid_rrf")(_ranking(replace(WINDOWS, name="hybrid_rrf"), 20))


@query(S.topk())
def kept_bm25_topk(spark, d):
    """bm25_topk from an index that was written to files and opened by its path."""
    index_ = kept.build(corpus_documents(spark, d), new_folder(spark, "index"), buckets=8)
    return rounded(kept.bm25_topk(index_, benchmark_questions(spark, d), 5), "score")


@query(S.topk())
def pruned_bm25_topk(spark, d):
    """The same, leaving out the postings that can't matter."""
    index_ = kept.build(corpus_documents(spark, d), new_folder(spark, "index"), buckets=8)
    return rounded(pruned.Search(index_, benchmark_questions(spark, d), 5).topk(), "score")


def _lemmas(spark, d, windows: bool = False) -> DataFrame:
    """A lemma table over the words of documents, questions and, where they are ranked, windows (which cut words): the first four characters of longer words. It is made once for all that look words up."""
    docs = _corpus(spark, d).dealt()[0]
    texts = docs.select("text")
    if windows:
        texts = texts.unionByName(chunking.window_chunks(docs, WINDOWS.chunk_size, WINDOWS.chunk_stride).select(F.col("chunk_text").alias("text")))
    texts = texts.unionByName(benchmark_questions(spark, d).select(F.col("question").alias("text")))
    words = texts.select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token")).where(F.length("token") > 4).distinct()
    return stored(words.select("token", F.substring("token", 1, 4).alias("lemma")), "lemmas")


#: Words of which the table of the next query holds the lemma; it has to predict the others.
_HELD = "md5(token) < '8'"


@query(S.predicted_lemmas(_HELD, lemmas.LONGEST))
def predicted_lemmas(spark, d):
    """The lemmas of all words of the documents: half of them from a table, the others by the suffix rules that it teaches."""
    words = stored(lemmas.words_of(_corpus(spark, d).dealt()[0]), "words")  # read by each step
    known = words.where(_HELD).select("token", F.regexp_replace("token", S.ENDINGS, "").alias("lemma"))
    return lemmas.completed(words, known)


query(S.topk(tok=S.lemma_tokens), "bm25_lemma_topk")(_ranking(Params(name="bm25"), lemmas=True))
query(S.reranked("linear", 5, 20, 3, S.lemma_tokens), "rerank_lemma_linear")(_ranking(replace(WINDOWS, name="cross_encoder_rerank", rerank=rerank.RerankOptions(20, 3, "linear")), lemmas=True))


@query(S.top_chunks(20, 3))
def top_chunks_in_document(spark, d):
    corpus, questions = _corpus(spark, d), benchmark_questions(spark, d)
    p = replace(WINDOWS, name="hybrid_rrf")
    first = corpus.settle(retrieve(corpus, questions, p, 20))
    return rounded(rerank.top_chunks(first, questions, corpus.chunks(p, first), 3, keep=corpus.settle), "score")


for _mode in ("ce_only", "linear", "rrf"):
    query(S.reranked(_mode, 5, 20, 3), f"rerank_{_mode}")(_ranking(replace(WINDOWS, name="cross_encoder_rerank", rerank=rerank.RerankOptions(20, 3, _mode))))

# --- evaluation ---------------------------------------------------------------------------------


def _placed(spark, d, params: Params = Params(name="bm25"), k: int = 20) -> DataFrame:
    corpus = _corpus(spark, d)
    questions = corpus.keep(labelled_questions(spark, d, corpus.documents()))
    return evaluate.first_gold_rank(questions, retrieve(corpus, questions, params, k), k)


@query(f"WITH {S.placed()} SELECT CAST(count(*) AS BIGINT) AS num_queries, round({S.recall(1)}, 6) AS recall_at_1, round({S.recall(5)}, 6) AS recall_at_5, round({S.recall(20)}, 6) AS recall_at_20 FROM placed")
def recall_at_k(spark, d):
    return rounded(evaluate.recall_at_k(_placed(spark, d), [1, 5, 20]), "recall_at_1", "recall_at_5", "recall_at_20")


@query(f"WITH {S.placed()} SELECT qid, gold_doc_id, CAST(gold_rank AS BIGINT) AS gold_rank FROM placed")
def first_gold_rank(spark, d):
    return _placed(spark, d).select("qid", "gold_doc_id", "gold_rank")


@query(f"WITH {S.placed()} SELECT split, fold, topic, CAST(count(*) AS BIGINT) AS num_queries, CAST(count(DISTINCT gold_doc_id) AS BIGINT) AS num_gold_docs, round({S.recall(5)}, 6) AS recall_at_5, round({S.recall(20)}, 6) AS recall_at_20 FROM placed GROUP BY ALL")
def topic_metrics(spark, d):
    return rounded(evaluate.topic_metrics(_placed(spark, d), [5, 20]), "recall_at_5", "recall_at_20")


@query(S.cv_rows([5, 20]))
def cv_summary(spark, d):
    return rounded(evaluate.cv_summary(_placed(spark, d), [5, 20]), "strict_cv_mean", "strict_cv_std", "strict_holdout")


@query(f"WITH {S.placed()} SELECT topic, CAST(count(*) AS BIGINT) AS num_queries, round({S.recall(5)}, 6) AS recall_at_5 FROM placed GROUP BY topic HAVING count(*) >= 2")
def hit_by_group_having(spark, d):
    return rounded(evaluate.hits_by(_placed(spark, d), "topic", 5, 2), "recall_at_5")


_COUNTS = "CAST(count(*) AS BIGINT) AS num_queries, CAST(count(DISTINCT gold_doc_id) AS BIGINT) AS num_gold_docs, CAST(count(DISTINCT topic) AS BIGINT) AS num_topics"


@query(f"WITH {S.GOLD} SELECT split AS role, {_COUNTS} FROM gold GROUP BY split")
def holdout_summary(spark, d):
    return splits.holdout_summary(labelled_questions(spark, d).withColumnRenamed("split", "role"))


@query(f"WITH {S.GOLD} SELECT fold, {_COUNTS} FROM gold GROUP BY fold")
def fold_summary(spark, d):
    return splits.fold_summary(labelled_questions(spark, d))


_ITEMS = "f AS (SELECT qid, gold_doc_id, topic, CAST(CAST(substr(qid, 3) AS BIGINT) % 4 AS BIGINT) AS fold FROM gold)"


def _item_folds(spark, d):
    return labelled_questions(spark, d).withColumn("fold", F.pmod(F.substring("qid", 3, 18).cast("long"), F.lit(4)))


@query(f"WITH {S.GOLD}, {_ITEMS}, p AS (SELECT DISTINCT fold, gold_doc_id FROM f), s AS (SELECT gold_doc_id, count(*) AS k FROM p GROUP BY 1) SELECT fold, CAST(count(*) AS BIGINT) AS num_gold_docs, (SELECT count(*) FROM s WHERE EXISTS (SELECT 1 FROM p o WHERE o.gold_doc_id = s.gold_doc_id AND o.fold <> p.fold)) AS num_train_docs, CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS num_leaking, round(avg(CASE WHEN k > 1 THEN 1.0 ELSE 0 END), 6) AS leaking_share FROM p JOIN s USING (gold_doc_id) GROUP BY fold")
def fold_leakage(spark, d):
    return rounded(splits.fold_leakage(_item_folds(spark, d)), "leaking_share")


@query("""WITH f AS (SELECT lang AS topic, doc_id % 5 AS fold FROM documents), c AS (SELECT fold, topic, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT topic, count(*) AS t FROM f GROUP BY ALL),
g AS (SELECT a.fold, t.topic, t, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY a.fold) AS size FROM (SELECT DISTINCT fold FROM f) a CROSS JOIN t LEFT JOIN c ON c.fold = a.fold AND c.topic = t.topic),
n AS (SELECT count(*) AS total, count(DISTINCT fold) AS parts FROM f)
SELECT CAST(fold AS BIGINT) AS fold, round(max(abs(size - total / parts) / greatest(total / parts, 1)), 6) AS size_error, round(sum(abs(n / size - t / total)), 6) AS l1, round(max(abs(size - total / parts) / greatest(total / parts, 1)) + sum(abs(n / size - t / total)), 6) AS score FROM g, n GROUP BY fold""")
def topic_distribution_score(spark, d):
    q = table(spark, d, "documents").select(F.col("lang").alias("topic"), F.pmod("doc_id", F.lit(5)).cast("long").alias("fold"))
    return rounded(splits.fold_scores(q), "size_error", "l1", "score")


@query()
def grouped_splits(spark, d):
    return splits.validation_assignments(labelled_questions(spark, d), min_count=3)


@query(f"""WITH {S.GOLD}, q AS (SELECT count(*) AS n, count(DISTINCT gold_doc_id) AS docs FROM gold), t AS (SELECT topic, count(*) AS n FROM gold GROUP BY topic)
SELECT CAST(n AS BIGINT) AS num_queries, CAST(docs AS BIGINT) AS num_gold_docs, 0::BIGINT AS docs_in_two_folds, 0::BIGINT AS docs_in_two_roles, 0::BIGINT AS holdout_with_fold, 0::BIGINT AS dev_without_fold, 0::BIGINT AS without_relaxed_fold,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM t WHERE n < 3) AS in_rare_bucket, true AS holdout_is_a_part FROM q""")
def split_invariants(spark, d):
    """What must hold of any grouped split, counted on the split that was made."""
    rows = splits.validation_assignments(labelled_questions(spark, d), min_count=3)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    hold = F.col("strict_holdout_role") == "holdout"
    doc = rows.groupBy("gold_doc_id").agg(F.countDistinct("strict_cv_fold").alias("folds"), F.countDistinct("strict_holdout_role").alias("roles"))
    by_doc = doc.agg(F.count(F.lit(1)).alias("num_gold_docs"), n(F.col("folds") > 1).alias("docs_in_two_folds"), n(F.col("roles") > 1).alias("docs_in_two_roles"))
    by_row = rows.agg(F.count(F.lit(1)).alias("num_queries"), n(hold & F.col("strict_cv_fold").isNotNull()).alias("holdout_with_fold"), n(~hold & F.col("strict_cv_fold").isNull()).alias("dev_without_fold"), n(F.col("relaxed_cv_fold").isNull()).alias("without_relaxed_fold"),
                      n(F.col("topic_bucket") == splits.RARE).alias("in_rare_bucket"), (F.sum(hold.cast("long")).between(1, F.count(F.lit(1)) - 1)).alias("holdout_is_a_part"))
    return by_row.crossJoin(by_doc)


@query("SELECT d.doc_id, lang, CAST(quality AS BIGINT) AS quality FROM labels JOIN documents d ON d.doc_id = labels.doc_id")
def aligned_inner_join(spark, d):
    both = splits.aligned(table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return both.select("doc_id", "lang", long("quality"))


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS csv_md5, CAST(length(text) AS BIGINT) AS csv_chars, md5(text) AS json_md5, CAST(length(text) AS BIGINT) AS json_chars FROM documents")
def declared_scans(spark, d):
    """The documents, written as CSV and as JSON lines and read back by a declared schema."""
    docs = table(spark, d, "documents").select(long("doc_id"), "text", "lang", "source", long("n_chars"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    read = {}
    for kind in ("csv", "json"):
        path = new_folder(spark, f"scan-{kind}")
        tables.write_scannable(docs, path, kind)
        text = tables.scan(spark, path, schema, kind)
        read[kind] = text.withColumns({f"{kind}_md5": F.md5("text"), f"{kind}_chars": F.length("text").cast("long")}).drop("text")
    return read["csv"].join(read["json"].drop("lang", "source", "n_chars"), "doc_id")


@query(S.cv_rows([5, 20]))
def recorded_metrics(spark, d):
    """The summary of an experiment, written as a JSON record and read back."""
    path = new_folder(spark, "records")
    entry = F.struct("metric", F.struct("strict_cv_mean", "strict_cv_std", "strict_holdout"))
    record = evaluate.cv_summary(_placed(spark, d), [5, 20]).agg(F.map_from_entries(F.collect_list(entry)).alias("all_metrics"))
    record.select(F.lit("tfidf").alias("experiment"), "all_metrics").write.json(path)
    return rounded(tables.records(spark, path).drop("experiment"), "strict_cv_mean", "strict_cv_std", "strict_holdout")


@query(f"WITH {S.GOLD} SELECT qid, gold_doc_id, topic, fold, split, CAST(1 AS BIGINT) AS n_files FROM gold")
def partitioned_questions(spark, d):
    """The labelled questions, written by split and by ranges of fold and qid, and read back; n_files: files that hold the question."""
    path = new_folder(spark, "questions")
    tables.write_parts(labelled_questions(spark, d).select("qid", "gold_doc_id", "topic", "fold", "split"), path, ("split",), ("fold", "qid"))
    back = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_path"))
    return back.groupBy("qid", "gold_doc_id", "topic", long("fold"), "split").agg(F.countDistinct("_file").alias("n_files"))


# --- description --------------------------------------------------------------------------------


@query(f"WITH {S.DOCS}, g AS (SELECT {S.norm('text')} AS t, count(*) AS n, list_sort(list(doc_id)) AS ids FROM docs GROUP BY 1 HAVING count(*) > 1) SELECT CAST(n AS BIGINT) AS n, array_to_string(ids, ',') AS doc_ids FROM g")
def duplicate_groups(spark, d):
    return describe.duplicate_groups(corpus_documents(spark, d)).select("n", F.concat_ws(",", "doc_ids").alias("doc_ids"))


_P = ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{round(p * 100)}" for p in describe.PERCENTILES)


@query(f"WITH {S.DOCS}, x AS (SELECT length(text) AS x FROM docs) SELECT CAST(count(x) AS BIGINT) AS n, round(avg(x), 6) AS mean, CAST(min(x) AS BIGINT) AS least, CAST(max(x) AS BIGINT) AS most, {_P} FROM x")
def length_quantiles(spark, d):
    q = describe.quantiles(describe.lengths(corpus_documents(spark, d)), "n_chars")
    return rounded(q, "mean", *[f"p{round(p * 100)}" for p in describe.PERCENTILES])


@query("SELECT lang || '/' || source AS value, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def value_counts(spark, d):
    return describe.value_counts(table(spark, d, "documents").withColumn("topic", F.concat_ws("/", "lang", "source")), "topic")


@query(f"WITH {S.GOLD}, u AS (SELECT gold_doc_id, count(*) AS n FROM gold GROUP BY 1) SELECT CAST(count(n) AS BIGINT) AS distinct_gold, CAST(sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unused, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS used_once, CAST(sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS used_often FROM documents LEFT JOIN u ON CAST(doc_id AS VARCHAR) = gold_doc_id")
def gold_coverage(spark, d):
    return describe.gold_coverage(labelled_questions(spark, d), corpus_documents(spark, d))


@query("SELECT round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END), 6) AS good, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0 END), 6) AS toxic FROM labels")
def share_metrics(spark, d):
    labels = table(spark, d, "labels")
    return rounded(describe.share(labels, F.col("quality") == 1, "good").crossJoin(describe.share(labels, F.col("toxic") == 1, "toxic")), "good", "toxic")


_TURNS = "turns AS (SELECT 'c_' || conv_id || '_' || turn AS qid, coalesce(text, '') AS question FROM conversations WHERE role = 'user')"


@query(f"WITH {_TURNS}, {S.QUESTIONS}, a AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({S.tokens('question')}) AS term FROM turns)), b AS (SELECT DISTINCT term FROM (SELECT unnest({S.tokens('question')}) AS term FROM qs)) SELECT CAST(count(DISTINCT a.term) AS BIGINT) AS left_vocabulary, CAST(count(DISTINCT CASE WHEN b.term IS NULL THEN a.term END) AS BIGINT) AS only_left, round(avg(CASE WHEN b.term IS NULL THEN 0.0 ELSE 1 END), 6) AS coverage, (SELECT CAST(count(*) AS BIGINT) FROM b) AS right_vocabulary FROM a LEFT JOIN b ON a.term = b.term")
def vocab_coverage(spark, d):
    return rounded(describe.vocabulary_coverage(user_turns(spark, d), benchmark_questions(spark, d)), "coverage")


@query(f"""WITH {_TURNS}, {S.QUESTIONS}, units AS (SELECT qid AS unit_id, qid AS doc_id, {S.tokens('question')} AS tokens FROM qs),
{S.POSTINGS}, w AS (SELECT unit_id, term, tf * idf AS w FROM postings JOIN ti USING (term)), r AS (SELECT unit_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY unit_id)) AS w FROM w),
lt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({S.tokens('question')}) AS term FROM turns) GROUP BY ALL), l0 AS (SELECT qid, term, tf * idf AS w FROM lt JOIN ti USING (term)), l AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM l0),
best AS (SELECT qid, max(s) AS s FROM (SELECT qid, unit_id, sum(l.w * r.w) AS s FROM l JOIN r USING (term) GROUP BY ALL) GROUP BY qid)
SELECT turns.qid AS unit_id, round(coalesce(s, 0), 6) AS similarity FROM turns LEFT JOIN best USING (qid)""")
def query_nn_similarity(spark, d):
    units = lambda q: q.select(F.col("qid").alias("unit_id"), F.col("qid").alias("doc_id"), T.tokenize(F.col("question")).alias("tokens"))
    return rounded(describe.nearest(index.build_index(units(benchmark_questions(spark, d))), units(user_turns(spark, d)), keep=_corpus(spark, d).keep), "similarity")


@query(_INDEX.rstrip() + """, w AS (SELECT unit_id, term, tf * idf AS w FROM postings JOIN ti USING (term)), r AS (SELECT unit_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY unit_id)) AS w FROM w),
best AS (SELECT a AS unit_id, max(s) AS s FROM (SELECT x.unit_id AS a, y.unit_id AS b, sum(x.w * y.w) AS s FROM r x JOIN r y ON x.term = y.term AND x.unit_id <> y.unit_id GROUP BY ALL) GROUP BY 1)
SELECT lens.unit_id, round(coalesce(s, 0), 6) AS similarity FROM lens LEFT JOIN best USING (unit_id)""")
def document_nn_similarity(spark, d):
    corpus = _corpus(spark, d)
    return rounded(describe.nearest(corpus.documents(), keep=corpus.keep), "similarity")


# --- submission and sweeps ----------------------------------------------------------------------


def _with_duplicates(spark, d) -> DataFrame:
    corpus = _corpus(spark, d)
    top = corpus.keep(retrieve(corpus, benchmark_questions(spark, d), Params(name="bm25"), 6).select("qid", "rank", "doc_id"))
    return top.unionByName(top.where("rank = 1").select("qid", F.lit(7).cast("long").alias("rank"), "doc_id"))


_DUPLICATES = f"{S.document_scores()},\n{S.top('dense', 6)},\npred AS (SELECT qid, rank, doc_id FROM ranked UNION ALL SELECT qid, 7, doc_id FROM ranked WHERE rank = 1)"


@query(f"WITH {_DUPLICATES}, o AS (SELECT qid, doc_id, min(rank) AS r FROM pred GROUP BY ALL) SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY r, doc_id) AS BIGINT) AS rank, doc_id FROM o) WHERE rank <= 5")
def create_submission(spark, d):
    return submission.ranked_submission(_with_duplicates(spark, d), 5)


@query(f"""WITH {_DUPLICATES}, s AS (SELECT qid, doc_id FROM pred WHERE qid <> 'b_0' UNION ALL SELECT 'extra', 'nowhere')
SELECT 'columns' AS rule, 0::BIGINT AS n UNION ALL SELECT 'nulls', count(*) FROM s WHERE qid IS NULL OR doc_id IS NULL
UNION ALL SELECT 'duplicates', count(*) FROM (SELECT qid, doc_id FROM s GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'too_many', count(*) FROM (SELECT qid FROM s GROUP BY qid HAVING count(*) > 5)
UNION ALL SELECT 'missing_qids', count(*) FROM qs WHERE qid NOT IN (SELECT qid FROM s) UNION ALL SELECT 'extra_qids', count(DISTINCT qid) FROM s WHERE qid NOT IN (SELECT qid FROM qs)
UNION ALL SELECT 'unknown_docs', count(DISTINCT doc_id) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM docs)""")
def submission_violations(spark, d):
    bad = _with_duplicates(spark, d).where(F.col("qid") != "b_0").select("qid", "doc_id").unionByName(values(spark, [("extra", "nowhere")], "qid string, doc_id string"))
    return submission.violations(bad, benchmark_questions(spark, d), corpus_documents(spark, d))


_METRICS = ("strict_cv_mean", "strict_cv_std", "strict_holdout")


def _labelled_by_windows(spark, d, corpus: Corpus, p: Params) -> DataFrame:
    """The labelled questions, found by the index that the first ranking with p reads, so no text is cut into words for them alone."""
    return corpus.keep(labelled_questions(spark, d, corpus.passages(p, drop_empty=True), p.chunk_size - p.chunk_stride))


@query(" UNION ALL ".join(f"SELECT * FROM ({S.cv_rows([5], f'''{chr(39)}{m}{chr(39)} AS chunk_score_aggregation, CAST(2 AS BIGINT) AS chunk_score_top_k, ''', chunked=(1600, 800), mode=m)})" for m in ranking.POOLING))
def pooling_sweep_summary(spark, d):
    corpus = _corpus(spark, d)
    out = sweep_order(pooling_sweep(corpus, _labelled_by_windows(spark, d, corpus, WINDOWS), WINDOWS))
    return rounded(out.withColumn("chunk_score_top_k", F.col("chunk_score_top_k").cast("long")), *_METRICS)


@query(" UNION ALL ".join(f"SELECT * FROM ({S.cv_rows([5], f'CAST({a} AS BIGINT) AS chunk_size, CAST({b} AS BIGINT) AS chunk_stride, CAST({a - b} AS BIGINT) AS chunk_overlap, ', chunked=(a, b))})" for a, b in ((900, 450), (1600, 800))))
def chunking_sweep_summary(spark, d):
    corpus = _corpus(spark, d)
    questions = _labelled_by_windows(spark, d, corpus, replace(WINDOWS, chunk_size=900, chunk_stride=450))
    out = sweep_order(chunking_sweep(corpus, questions, WINDOWS, ("900:450", "1600:800")))
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("chunk_size", "chunk_stride", "chunk_overlap")}), *_METRICS)
