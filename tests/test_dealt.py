"""Scores stay where the documents were dealt: no pair of a question and a document is shuffled or stored."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexmill.functions import chunking
from lexmill.functions import text as T
from lexmill.operators import evaluate, index, ranking, submission
from lexmill.plans import registry
from lexmill.plans.questions import labelled
from lexmill.plans.registry import Corpus, Params, passage_scores, retrieve
from lexmill.sources.tables import from_documents


@pytest.fixture
def corpus(spark):
    rows = [(str(i), " ".join(f"word{(i * j) % 37} rare{i}x{j}" for j in range(1, 5 + i % 9)) if i % 11 else "") for i in range(60)]
    c = Corpus(spark.createDataFrame(rows, "doc_id string, text string"))
    yield c
    c.release()


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([("q0", "word1 word2 word3 word1"), ("q1", "word5 rare7x2 unknown"), ("q2", "")], "qid string, question string")


def exchanges(df):
    """The keys of the shuffles in the plan of df itself, without those inside cached tables."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    own = re.sub(r"InMemoryRelation[\s\S]*?(?=\n[ :]*(?:\+-|:-) (?!.*InMemoryRelation)(?:Broadcast|HashAggregate|Project \[qid)|\Z)", "", plan)
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", own)


@pytest.mark.parametrize("name", ["chunked_bm25", "chunked_tfidf"])
@pytest.mark.parametrize("mode", ranking.POOLING)
def test_pairs_are_not_shuffled(corpus, questions, name, mode):
    p = Params(name=name, chunking="windows", chunk_size=40, chunk_score_aggregation=mode)
    scores, counts = passage_scores(corpus, questions, p)
    pooled, _ = ranking.pool(scores, counts, mode, 2)
    keys = exchanges(pooled)
    assert not [k for k in keys if "unit_id" in k or re.search(r"qid#\d+, doc_id", k)]


def test_scores_are_not_kept(corpus, questions):
    kept = []
    scores = index.bm25_scores(corpus.documents(), corpus.terms(questions, "full"))
    ranking.dense_topk(scores, questions, corpus.docs.select("doc_id", F.lit(0.0).alias("pad")), 3, lambda df: kept.append(df) or df)
    assert all(df.count() <= 3 * 60 and "rank" in df.columns or df.columns in (["qid"], ["doc_id", "pad"], ["qid", "_hit"]) for df in kept)


@pytest.mark.parametrize("name", ["tfidf", "bm25", "chunked_tfidf", "chunked_bm25"])
def test_few_parts_and_broadcasts_change_nothing(spark, corpus, questions, name, monkeypatch):
    p = Params(name=name, chunking="windows", chunk_size=40, top_k=7)
    rows = lambda c: [(r["qid"], r["rank"], r["doc_id"], pytest.approx(r["score"])) for r in retrieve(c, questions, p).orderBy("qid", "rank").collect()]
    want = rows(corpus)
    monkeypatch.setattr(index, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(registry, "DEAL_ROWS", 3)
    other = Corpus(corpus.docs)
    assert other.dealt()[1] == 20
    assert rows(other) == want
    other.release()


def test_frequent_terms(spark):
    terms = spark.createDataFrame([("a", 9), ("b", 8), ("c", 3), ("d", 1), ("e", 1)], "term string, df long")
    assert [index.frequent_from(terms, n) for n in (5, 4, 3, 2, 1)] == [1, 2, 2, 4, 16]


def test_labelled_shuffles_no_texts(spark, tmp_path):
    """Pairs of a passage and a document that holds it are narrow before they meet a shuffle."""
    long = " ".join(f"filler{i}" for i in range(300))
    docs = spark.createDataFrame([(i, f"{long} the quick brown fox {i} " if i % 2 else long, "en", "web", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    questions = spark.createDataFrame([("b_0", "the quick brown fox"), ("b_1", "not there at all")], "qid string, question string")
    got = labelled(docs, questions)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :].split("\n")[0]
    assert "text#" not in window
    assert "Join Inner, (doc_id" not in plan  # no join with the texts again
    row = got.first()
    assert got.count() == 1 and row["gold_doc_id"] == "1" and row["gold_evidence_char_start"] == len(long) + 1


def test_one_index_at_a_time(spark, corpus, questions, monkeypatch):
    """A fusion's indexes never stand beside each other, and none is left when candidates are re-ranked."""
    live, make = [], index.build_index
    monkeypatch.setattr(index, "build_index", lambda *a, **k: live.append(len(corpus._indexes)) or make(*a, **k))
    p = Params(name="cross_encoder_rerank", chunking="windows", chunk_size=40)
    assert retrieve(corpus, questions, p, 3).count() == 9
    assert live == [0, 0] and not corpus._indexes


def test_labelled_by_index_cuts_no_text(spark):
    """Gold documents by the index are those found without it, and no text of a document is cut into words."""
    docs = spark.createDataFrame([(i, f"Lead-in {i}.\n the quick\tBROWN fox {i % 3} jumps over 3.14 of it. End" if i % 4 else None, "en", "web", 1) for i in range(24)], "doc_id long, text string, lang string, source string, n_chars long")
    questions = spark.createDataFrame([("b_0", "quick\tBROWN fox 2 jumps"), ("b_1", "fox 9 jumps"), ("b_2", "the of"), ("b_3", "x 3.14 of"), ("b_4", "fox"), ("b_5", "")], "qid string, question string")
    corpus = Corpus(from_documents(docs))
    got, want = labelled(docs, questions, corpus.documents()), labelled(docs, questions)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r["qid"] for r in got.collect()} == {"b_0", "b_4"}
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    corpus.release()


def test_units_are_rows_of_their_own(spark, corpus):
    """Lengths need no distinct, the corpus no pass over postings; what is read once is not kept."""
    made = corpus.documents()
    assert "Aggregate" not in re.sub(r"InMemoryRelation[\s\S]*", "", made.units._jdf.queryExecution().optimizedPlan().toString())
    assert made.units.count() == 60 and made.units.where("dl = 0").count() == 6
    n, avgdl = made.corpus.first()
    assert (n, avgdl) == tuple(made.units.selectExpr("count(*)", "avg(dl)").first())
    once = Corpus(corpus.docs).documents(keep=False)
    assert not once.counted.is_cached and once.postings.count() == made.postings.count()
    none = index.build_index(index.documents_as_units(corpus.docs.where("false")))
    assert tuple(none.corpus.first()) == (0, None)


def test_plain_texts_are_not_normalised(spark):
    """Only texts with a sign of a special token are tried for one, and the tokens are those of the normal form."""
    odd = ["Plain\x1c words  of 1999.", "été à la plage", "", None, "3.4.2021", "a-b", "дело", "٣.٤"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    n = T.normalize(F.coalesce("text", F.lit("")))
    rows = df.select("text", T.may_hold_special(F.coalesce("text", F.lit(""))).alias("may"), (T.tokenize(F.col("text")) == F.concat(T.generic_tokens(n), T.special_tokens(n))).alias("same")).collect()
    assert all(r["same"] for r in rows)
    assert [r["may"] for r in rows] == [False] * 4 + [True] * 4


def test_blank_windows_are_not_copied(spark):
    """Blank windows go by the first character that isn't white space; no window is rewritten for that."""
    df = spark.createDataFrame([("ab" + " " * 8 + "\x1c\x1f\u2003\n" + "cd",)], "text string")
    made = df.select(chunking.hard_windows(F.col("text"), 4, 4).alias("w"))
    assert "regexp_replace" not in made._jdf.queryExecution().analyzed().toString()
    assert [tuple(w) for w in made.first()["w"]] == [(0, "ab  "), (1, "\u2003\ncd")]


@pytest.mark.parametrize("name", ["bm25", "tfidf"])
def test_vocabulary_is_gone_through_once(spark, corpus, questions, name):
    """The terms that are asked for are kept with their weights: what scores reads neither the table of terms nor the corpus again."""
    kept = []
    make = index.bm25_scores if name == "bm25" else index.tfidf_scores
    scores = make(corpus.documents(), corpus.terms(questions, "full"), keep=lambda df: kept.append(df) or corpus.settle(df))
    assert len(kept) == 1 and set(kept[0].columns) > {"qid", "term"}
    plan = scores.drop("score")._jdf.queryExecution().optimizedPlan().toString()
    if name == "bm25":  # a cosine needs the weights of all terms for the norms
        assert plan.count("InMemoryRelation") == 1
    want = make(corpus.documents(), corpus.terms(questions, "full"))
    plain = lambda df: [(r["qid"], r["unit_id"], pytest.approx(r["score"])) for r in df.orderBy("qid", "unit_id").collect()]
    assert plain(scores) == plain(want)


def test_documents_of_a_submission_are_looked_up(spark):
    """Unknown documents are found by the few ids that are named; the ids of all documents meet no shuffle of their own."""
    docs = spark.createDataFrame([(str(i),) for i in range(50)] + [(None,)], "doc_id string")
    s = spark.createDataFrame([("q0", "3"), ("q0", "nowhere"), ("q0", None), ("q1", "nowhere")], "qid string, doc_id string")
    got = submission.violations(s, spark.createDataFrame([("q0",)], "qid string"), docs)
    assert {r["rule"]: r["n"] for r in got.collect()} == {"columns": 0, "nulls": 1, "duplicates": 0, "too_many": 0, "missing_qids": 0, "extra_qids": 1, "unknown_docs": 2}
    assert "LeftSemi, (doc_id" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("size", [60, 1600])
def test_labelled_by_windows(spark, size):
    """Gold documents by an index of windows are those found without one, also for words that no window holds whole, and no text is cut into words."""
    text = lambda i: f"Lead in {i}.\n the quick brown fox {i % 3} jumps over {'z' * 31}{i % 2} of it and {'filler ' * 9} End" if i % 4 else None
    docs = spark.createDataFrame([(i, text(i), "en", "web", 1) for i in range(24)], "doc_id long, text string, lang string, source string, n_chars long")
    questions = spark.createDataFrame([("b_0", "quick brown fox 2 jumps"), ("b_1", f"over {'z' * 31}1 of"), ("b_2", "the of"), ("b_3", f"jumps over {'z' * 31}0 of it")], "qid string, question string")
    corpus, p = Corpus(from_documents(docs)), Params(name="chunked_bm25", chunking="windows", chunk_size=size)
    got = labelled(docs, questions, corpus.passages(p, True), size // 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, labelled(docs, questions).collect()))
    assert {r["qid"] for r in got.collect()} == {"b_0", "b_1", "b_3"}
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    corpus.release()


def test_modes_are_ranked_in_one_pass(corpus, questions, monkeypatch):
    """A sweep over pooling modes ranks the passages' scores once, with the metrics of one ranking after the other."""
    p = Params(name="chunked_bm25", chunking="windows", chunk_size=40)
    gold = questions.withColumns({"gold_doc_id": F.when(F.col("qid") == "q1", "7").otherwise("3"), "topic": F.lit("t"), "split": F.when(F.col("qid") == "q2", "holdout").otherwise("cv"), "fold": F.lit(0)})
    want = {}
    for mode in ranking.POOLING:
        placed = evaluate.first_gold_rank(gold, retrieve(corpus, gold, replace(p, chunk_score_aggregation=mode), 20), 20)
        want[mode] = evaluate.cv_summary(placed, [5]).first()["strict_cv_mean"]
    calls, make = [], ranking.ranked
    monkeypatch.setattr(ranking, "ranked", lambda scores, k: calls.append("_m" in scores._jdf.queryExecution().analyzed().toString()) or make(scores, k))
    got = {r["chunk_score_aggregation"]: r["strict_cv_mean"] for r in registry.pooling_sweep(corpus, gold, p).collect()}
    assert got == want and calls.count(True) == 1
