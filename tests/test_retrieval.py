"""Scores, pooling, fusion, evaluation and submissions against values made by hand and a plain version."""

import math

import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluate, index, ranking, rerank, splits, submission
from lexmill.plans import registry

DOCS = [("d1", "alpha beta"), ("d2", "alpha gamma gamma"), ("d3", "delta")]


def corpus(spark, rows=DOCS):
    return registry.Corpus(spark.createDataFrame(rows, "doc_id string, text string"))


def asked(spark, *questions):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "qid string, question string")


def scores(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in df.orderBy("qid", "rank").collect()]


def test_bm25(spark):
    got = registry.retrieve(corpus(spark), asked(spark, "alpha gamma"), registry.Params(name="bm25"), 3)
    assert scores(got) == [("d2", 0.680834), ("d1", 0.063853), ("d3", 0.0)]


def test_tfidf(spark):
    got = registry.retrieve(corpus(spark), asked(spark, "alpha gamma zzz"), registry.Params(), 3)
    assert scores(got) == [("d2", 0.959146), ("d1", 0.366447), ("d3", 0.0)]


def test_lemmas_on_both_sides(spark):
    docs = spark.createDataFrame([("d1", "решение суда"), ("d2", "жалоба"), ("d3", ""), ("d4", "ответчик просил"), ("d5", "договор займа")], "doc_id string, text string")
    lemmas = spark.createDataFrame([("суда", "суд"), ("судом", "суд"), ("судом", "судья"), ("жалобу", "жалоба")], "token string, lemma string")
    c = registry.Corpus(docs, lemmas)
    for name in ("bm25", "tfidf", "chunked_bm25", "chunked_tfidf"):
        for question, best in (("судом", "d1"), ("суда", "d1"), ("жалобу", "d2")):
            got = registry.retrieve(c, asked(spark, question), registry.Params(name=name), 1).first()
            assert got["doc_id"] == best, (name, question)
    assert registry.create_retriever("bm25", c).params.as_record()["lemmas"]
    near = rerank.top_chunks(spark.createDataFrame([("q0", "d")], "qid string, doc_id string"), asked(spark, "судом"), spark.createDataFrame([("d", i, t) for i, t in enumerate(["прочее слово", "иное", "и решение суда"])], "doc_id string, chunk_no int, chunk_text string"), 1, lemmas=lemmas)
    assert near.first()["chunk_no"] == 2


def test_model_through_the_registry(spark):
    c = corpus(spark, [(f"d{i}", "alpha " * (i + 1)) for i in range(4)])
    made = registry.create_retriever("cross_encoder_rerank", c, lambda most: lambda qs, ts: [float(most + len(qs)) - len(t) for t in ts], first_stage="bm25", rerank=rerank.RerankOptions(4, 1, "ce_only", batch_size=1, max_length=7))
    got = made.retrieve(asked(spark, "alpha"), 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["d0", "d1", "d2", "d3"] and got[0]["score"] == 7 + 1 - len("alpha")
    with pytest.raises(ValueError):
        registry.create_retriever("bm25", c, lambda most: None)


def test_padding_by_id_and_empty_question(spark):
    got = registry.retrieve(corpus(spark), asked(spark, "delta", ""), registry.Params(name="bm25"), 2)
    rows = [(r["qid"], r["doc_id"]) for r in got.orderBy("qid", "rank").collect()]
    assert rows == [("q0", "d3"), ("q0", "d1"), ("q1", "d1"), ("q1", "d2")]


def test_dense_padding_equals_all_pairs(spark):
    scored = spark.createDataFrame([("q", f"d{i}", s) for i, s in enumerate([0.5, -1.0, 2.0, 0.0, -0.2])], "qid string, doc_id string, score double")
    pads = spark.createDataFrame([(f"d{i}", float(i % 3) - 0.5) for i in range(12)], "doc_id string, pad double")
    for k in range(1, 13):
        got = scores(ranking.dense_topk(scored, scored.select("qid").distinct(), pads, k))
        known = {r["doc_id"]: r["score"] for r in scored.collect()}
        every = sorted(((r["doc_id"], known.get(r["doc_id"], r["pad"])) for r in pads.collect()), key=lambda x: (-x[1], x[0]))
        assert got == every[:k]


@pytest.mark.parametrize(("mode", "want"), [("max", 3.0), ("top2_sum", 5.0), ("mean_topk", 2.0), ("logsumexp", 3.407606)])
def test_pooling(spark, mode, want):
    best = spark.createDataFrame([([3.0, 2.0, 1.0, 0.0],), ([],)], "s array<double>").select(ranking.pooled(F.col("s"), mode, 3)).collect()
    assert round(best[0][0], 6) == want and best[1][0] == -math.inf


def test_pool_counts_zeros(spark):
    rows = spark.createDataFrame([("q", "d", -2.0)], "qid string, doc_id string, score double")
    counts = spark.createDataFrame([("d", 3), ("e", 2)], "doc_id string, n long")
    pooled, pads = ranking.pool(rows, counts, "mean_topk", 3)
    assert pooled.first()["score"] == pytest.approx(-2 / 3)
    assert {r["doc_id"]: r["pad"] for r in pads.collect()} == {"d": 0.0, "e": 0.0}


def test_rank_fusion(spark):
    make = lambda ids: spark.createDataFrame([("q", i + 1, d) for i, d in enumerate(ids)], "qid string, rank long, doc_id string")
    assert scores(ranking.reciprocal_rank_fusion([make("xy"), make("yz")], 3)) == [("y", 0.032522), ("x", 0.016393), ("z", 0.016129)]
    with pytest.raises(ValueError):
        ranking.reciprocal_rank_fusion([], 3)


def test_min_max(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("c", -math.inf), ("c", 1.0), ("c", 2.0)], "qid string, s double")
    got = rows.select("qid", "s", ranking.min_max("s").alias("m")).collect()
    assert sorted((r["qid"], r["m"]) for r in got) == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 1.0), ("b", 1.0), ("c", 0.0), ("c", 0.0), ("c", 1.0)]


def test_reranking_permutes_candidates(spark):
    c = corpus(spark, [(f"d{i}", "alpha " * (i + 1) + "gamma beta delta"[: 6 * i]) for i in range(5)])
    q = asked(spark, "alpha gamma beta")
    p = registry.Params(name="cross_encoder_rerank", first_stage="bm25", rerank=rerank.RerankOptions(4, 1, "linear"))
    first = registry.retrieve(c, q, registry.Params(name="bm25"), 4)
    assert {r["doc_id"] for r in registry.retrieve(c, q, p, 4).collect()} == {r["doc_id"] for r in first.collect()}


def test_model_scorer(spark):
    scorer = rerank.model_scorer(lambda: lambda qs, ts: [float(len(t)) for t in ts], batch_size=2)
    pairs = spark.createDataFrame([("q", "d", "a", "xxx"), ("q", "e", "a", "x")], "qid string, doc_id string, question string, chunk_text string")
    assert {r["doc_id"]: r["ce"] for r in scorer(pairs).collect()} == {"d": 3.0, "e": 1.0}


@pytest.mark.parametrize("bad", [{"rerank_top_k": 0}, {"chunks_per_doc": 0}, {"combine_mode": "x"}, {"ce_weight": -1.0}, {"ce_weight": 0.0, "sparse_weight": 0.0}, {"batch_size": 0}])
def test_rerank_guards(bad):
    with pytest.raises(ValueError):
        rerank.RerankOptions(**bad)


@pytest.mark.parametrize("bad", [{"name": "x"}, {"top_k": 0}, {"chunk_score_aggregation": "x"}, {"name": "hybrid_rrf", "hybrid_retrievers": ("bm25",)}, {"first_stage": "cross_encoder_rerank"}, {"chunk_stride": 5000}])
def test_param_guards(bad):
    with pytest.raises(ValueError):
        registry.Params(**bad)


def test_records_and_windows():
    assert registry.Params(name="bm25").as_record() == {"name": "bm25", "top_k": 5, "tokenizer": "full", "lemmas": False}
    assert registry.parse_windows(["900:450"]) == [(900, 450)]
    for bad in ("900", "a:b", "10:20"):
        with pytest.raises(ValueError):
            registry.parse_windows([bad])


def test_recall(spark):
    q = spark.createDataFrame([("q1", "b"), ("q2", "z")], "qid string, gold_doc_id string")
    p = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "a"), ("q1", 3, "b"), ("q2", 1, "a")], "qid string, rank long, doc_id string")
    row = evaluate.recall_at_k(evaluate.first_gold_rank(q, p, 2), [1, 2]).first()
    assert (row["recall_at_1"], row["recall_at_2"]) == (0.0, 0.5)
    assert evaluate.recall_at_k(evaluate.first_gold_rank(q.limit(0), p, 2), [1]).first()["recall_at_1"] == 0.0


def test_folds_do_not_leak(spark):
    q = spark.createDataFrame([(f"q{i}", "x", f"d{i % 17}", f"t{i % 4}") for i in range(80)], "qid string, question string, gold_doc_id string, topic string")
    out = splits.validation_assignments(q, min_count=5).collect()
    assert len(out) == 80
    folds, roles = {}, {}
    for r in out:
        assert (r["strict_cv_fold"] is None) == (r["strict_holdout_role"] == "holdout")
        folds.setdefault(r["gold_doc_id"], set()).add(r["strict_cv_fold"])
        roles.setdefault(r["gold_doc_id"], set()).add(r["strict_holdout_role"])
    assert all(len(x) == 1 for x in [*folds.values(), *roles.values()])


def test_submission_rules(spark):
    q, d = asked(spark, "a", "b"), spark.createDataFrame([(f"d{i}",) for i in range(9)], "doc_id string")
    make = lambda rows, schema="qid string, doc_id string": spark.createDataFrame(rows, schema)
    good = [("q0", "d1"), ("q1", "d2")]
    submission.validate_submission(make(good), q, d)
    bad = {
        "columns": make(good, "doc_id string, qid string"),
        "nulls": make([*good, ("q0", None)]),
        "duplicates": make([*good, ("q0", "d1")]),
        "too_many": make([*good, *[("q0", f"d{i}") for i in range(2, 8)]]),
        "missing_qids": make(good[:1]),
        "extra_qids": make([*good, ("q9", "d1")]),
        "unknown_docs": make([*good, ("q0", "x")]),
    }
    for rule, rows in bad.items():
        with pytest.raises(ValueError, match=rule):
            submission.validate_submission(rows, q, d)


def test_created_submission(spark):
    p = spark.createDataFrame([("q", i, d) for i, d in enumerate("aabc", 1)], "qid string, position long, doc_id string")
    got = submission.ranked_submission(p, 2, "position").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["a", "b"]
    made = submission.create_submission(p, 2, "position")
    assert [tuple(r) for r in made.collect()] == [("q", "a"), ("q", "b")]
    submission.validate_submission(made, spark.createDataFrame([("q",)], "qid string"), spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    with pytest.raises(ValueError):
        submission.create_submission(p, 2)


def test_experiment_summary(spark):
    rows = [(f"q{i}", f"alpha w{i}x", f"d{i}", "t", i % 4 if i < 8 else 4, "cv" if i < 8 else "holdout") for i in range(10)]
    q = spark.createDataFrame(rows, "qid string, question string, gold_doc_id string, topic string, fold int, split string")
    c = corpus(spark, [(f"d{i}", f"alpha beta w{i}x") for i in range(10)])
    out = registry.experiment(c, q, registry.Params(name="bm25"), (1, 5))
    assert {r["metric"]: (r["strict_cv_mean"], r["strict_cv_std"], r["strict_holdout"]) for r in out["summary"].collect()} == {"recall_at_1": (1.0, 0.0, 1.0), "recall_at_5": (1.0, 0.0, 1.0)}
    with pytest.raises(ValueError):
        registry.experiment(c, q, registry.Params(name="bm25"), (5,), 2)


def test_streamed_questions(spark, tmp_path):
    from lexmill.streaming.questions import rank_stream

    asked(spark, "alpha gamma").write.json(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("qid string, question string").json(str(tmp_path / "in"))
    rank_stream(stream, corpus(spark), registry.Params(name="bm25"), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), 1).awaitTermination(60)
    assert [(r["qid"], r["doc_id"]) for r in got] == [("q0", "d2")]


def labelled(spark):
    rows = [(f"q{i}", f"alpha w{i % 9}x", f"d{i % 9}", f"t{i % 2}") for i in range(27)]
    return spark.createDataFrame(rows, "qid string, question string, gold_doc_id string, topic string")


def test_programs_write_their_files(spark, tmp_path):
    from lexmill.plans import programs
    from lexmill.sources import tables

    paths = tables.Paths(str(tmp_path / "raw"), str(tmp_path / "p"), str(tmp_path / "o"))
    c = corpus(spark, [(f"d{i}", f"alpha beta w{i}x") for i in range(9)])
    metadata = programs.make_splits(labelled(spark), str(tmp_path / "v"), holdout_parts=3, cv_parts=2, min_count=3)
    assert metadata["strict_cv_splits"] == 2 and metadata["holdout_fold"] in (0, 1, 2)
    report = (tmp_path / "v" / "validation_protocol.md").read_text()
    assert "## Strict folds" in report and "100.0 %" in report and (tmp_path / "v" / "validation_metadata.json").exists()
    split = tables.load_splits(spark, str(tmp_path / "v" / "validation_splits"))
    questions = programs.by_split(labelled(spark), split)
    record = programs.run_experiment("e", c, questions, registry.Params(name="bm25"), paths, (1, 5), test=asked(spark, "w1x"))
    assert record["all_metrics"]["recall_at_1"]["strict_holdout"] == 1.0 and record["num_queries"] == 27 and [f["recall_at_1"] for f in record["fold_metrics"]] == [1.0, 1.0]
    for name in ("predictions/e_strict_cv_predictions", "predictions/e_strict_holdout_predictions", "predictions/e_test_predictions", "metrics/e_topic_metrics", "metrics/e_metrics.json"):
        assert (tmp_path / "o" / name).exists(), name
    made = programs.make_submission(c, asked(spark, "w1x", "w2x"), registry.Params(name="bm25"), paths, "s")
    assert [r["doc_id"] for r in tables.read_csv(spark, str(tmp_path / "o/submissions/s")).collect()] == [r["doc_id"] for r in made.collect()]
    programs.describe_data(c, labelled(spark), asked(spark, "w1x gamma"), str(tmp_path / "eda.md"))
    text = (tmp_path / "eda.md").read_text()
    assert "| documents | 9 |" in text and "## Hardest topics" in text and "| 27 | 1.0000 | 1.0000 |" in text


def test_missing_documents_are_named(spark):
    with pytest.raises(ValueError, match="nowhere"):
        splits.texts_of(spark.createDataFrame([("q", "nowhere")], "qid string, gold_doc_id string"), corpus(spark).docs, "gold_doc_id")


def test_padding_beyond_the_front(spark, monkeypatch):
    """A question that matches most documents with scores below the pads."""
    monkeypatch.setattr(ranking, "FRONT", 4)
    scored = spark.createDataFrame([("q", f"d{i:02d}", -1.0) for i in range(30)] + [("r", "d31", -1.0)], "qid string, doc_id string, score double")
    pads = spark.createDataFrame([(f"d{i:02d}", 0.0) for i in range(40)], "doc_id string, pad double")
    got = ranking.dense_topk(scored, scored.select("qid").distinct(), pads, 3).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["doc_id"]) for r in got] == [("q", "d30"), ("q", "d31"), ("q", "d32"), ("r", "d00"), ("r", "d01"), ("r", "d02")]
