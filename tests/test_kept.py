"""The kept index and the pruned ranking against an index built at once and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import index, kept, pruned, ranking


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(50)]
    weights = [1 / (i + 1) for i in range(50)]
    return [(str(i), " ".join(rng.choices(words, weights, k=rng.randrange(1, 40)))) for i in range(n)] + [("e", ""), ("n", None)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def same_as_built_at_once(spark, opened, rows):
    once = index.build_index(index.documents_as_units(docs_of(spark, [(a, b or "") for a, b in rows])))
    assert rows_of(opened.postings, "doc_id", "term", "tf") == rows_of(once.postings, "doc_id", "term", "tf")
    assert rows_of(opened.units, "doc_id", "dl") == rows_of(once.units, "doc_id", "dl")
    assert rows_of(opened.terms, "term", "df") == rows_of(once.terms, "term", "df")
    n, avgdl = once.corpus.first()
    assert opened.n == n and opened.avgdl == pytest.approx(avgdl)
    once.release()


def test_batches_replace_documents(spark, tmp_path):
    path, rows = f"file://{tmp_path}/i", corpus(1)
    first, second = rows[:40], [*rows[40:], ("3", "word1 anew"), ("3", "word0"), ("5", ""), (None, "word2"), ("7", rows[7][1])]
    kept.append(docs_of(spark, first), path, 0, buckets=4, part_rows=7)
    written = kept.append(docs_of(spark, second), path, 1, part_rows=7)
    assert written["replaced"] == 3
    again = kept.append(docs_of(spark, second), path, 1, part_rows=7)  # as after a failure half-way
    assert again == written
    now = dict(rows) | {"3": "word1 anew", "5": ""}
    opened = kept.open_index(spark, path)
    same_as_built_at_once(spark, opened, list(now.items()))
    assert opened.terms.agg(F.max("parts")).first()[0] > 1  # frequent terms are in parts
    bounds = opened.postings.join(opened.terms, "term").where("NOT exists(bounds, b -> b.tf >= tf AND b.dl <= dl) OR part >= parts")
    assert bounds.isEmpty()
    opened.release()
    kept.append(docs_of(spark, [("3", "word9 third")]), path, 2)  # replaced twice
    opened = kept.open_index(spark, path)
    same_as_built_at_once(spark, opened, list((now | {"3": "word9 third"}).items()))
    opened.release()


def test_no_exchange_of_the_postings(spark, tmp_path):
    opened = kept.build(docs_of(spark, corpus(2)), f"file://{tmp_path}/i", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = kept.asked_terms(opened, spark.createDataFrame([("q", "word1 word2")], "qid string, question string"))
        met = opened.postings.join(kept.by_parts(asked), ["term", "part"])
        plan = met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "_postings_" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for x in reversed(lines[:scan]):  # the operators between the scan and the join
        if depth(x) < at:
            above.append(x)
            at = depth(x)
        if "Join" in x and depth(x) == at:
            break
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in x for x in above)
    opened.release()


def test_there_must_be_an_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        kept.open_index(spark, f"file://{tmp_path}/none")


def brute(rows, questions, k):
    from collections import Counter

    docs = {d: (t or "").split() for d, t in rows}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for t in docs.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    out = set()
    for q, asked in questions:
        scored = []
        for d, t in docs.items():
            tf = Counter(t)
            s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in asked.split() if tf[w])
            scored.append((-round(s, 8), d))
        out |= {(q, r, d) for r, (_, d) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize(("docs", "k", "seeds"), [(60, 3, 5), (60, 70, 20_000), (2, 2, 1), (300, 4, 30)])
def test_pruned_ranking_equals_brute_force(spark, tmp_path, docs, k, seeds):
    rows = corpus(docs, docs) if docs > 2 else [("a", "word1 word2 word2"), ("b", "word1 word3"), ("c", "word1"), ("d", None)]
    rng = random.Random(docs)
    questions = [(f"q{i}", " ".join(rng.choices([f"word{j}" for j in range(50)], [1 / (j + 1) for j in range(50)], k=rng.randrange(1, 9)))) for i in range(12)] + [("none", "unknown"), ("empty", "")]
    opened = kept.build(docs_of(spark, rows), f"file://{tmp_path}/i", buckets=4)
    asked = spark.createDataFrame(questions, "qid string, question string")
    search = pruned.Search(opened, asked, k, seeds)
    assert {tuple(r) for r in search.topk().select("qid", "rank", "doc_id").collect()} == brute(rows, questions, k)
    search.release()
    opened.release()


def test_few_postings_are_met_where_a_rare_term_decides(spark, tmp_path):
    rows = [(f"{i:04d}", "common often " + " ".join(f"word{i % 7}" for _ in range(i % 5))) for i in range(3000)] + [(f"r{i}", "common rareword rareword") for i in range(6)]
    opened = kept.build(docs_of(spark, rows), f"file://{tmp_path}/i", buckets=4)
    asked = spark.createDataFrame([("q", "common often rareword")], "qid string, question string")
    search = pruned.Search(opened, asked, 5, 10)
    assert [r["doc_id"] for r in search.topk().orderBy("rank").collect()] == ["r0", "r1", "r2", "r3", "r4"]
    every, met = search.postings_met().select("every", "met").first()
    assert every > 6000 and met < 100
    search.release()
    opened.release()


@pytest.mark.parametrize("k", [1, 3, 9])
def test_padding_equals_a_ranking_of_all(spark, k, monkeypatch):
    monkeypatch.setattr(ranking, "FRONT", 2)  # the list of pads has to grow
    rng = random.Random(k)
    pads = [(f"d{i}", rng.choice([0.0, 0.0, 0.5, -1.0])) for i in range(20)]
    scores = [(f"q{q}", d, rng.choice([-2.0, 0.0, 0.4, 3.0])) for q in range(4) for d, _ in pads if rng.random() < (0.1, 0.5, 1.0, 0.95)[q]]
    made = ranking.dense_topk(spark.createDataFrame(scores, "qid string, doc_id string, score double"), spark.createDataFrame([(f"q{q}",) for q in range(5)], "qid string"), spark.createDataFrame(pads, "doc_id string, pad double"), k)
    have = {(q, d): s for q, d, s in scores}
    want = set()
    for q in range(5):
        order = sorted((-have.get((f"q{q}", d), p), d) for d, p in pads)
        want |= {(f"q{q}", r, d) for r, (_, d) in enumerate(order[:k], 1)}
    assert {tuple(r) for r in made.select("qid", "rank", "doc_id").collect()} == want


def test_kept_scores_shuffle_postings_not_pairs(spark, tmp_path):
    opened = kept.build(docs_of(spark, corpus(40, 1)), f"file://{tmp_path}/i", buckets=4)
    asked = kept.asked_terms(opened, spark.createDataFrame([(f"q{i}", f"word{i} word{i + 1}") for i in range(5)], "qid string, question string"))
    plan = kept.scores(opened, asked)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(qid#" not in plan.split("hashpartitioning(doc_id")[0]
    opened.release()


def test_a_large_bucket_has_several_files(spark, tmp_path, monkeypatch):
    """No task sorts a whole bucket: the rows of a task are bounded, each file holds one bucket's rows, and the index is the same."""
    monkeypatch.setattr(kept, "FILE_ROWS", 50)
    rows = corpus(5, 120)
    opened = kept.build(docs_of(spark, rows), f"file://{tmp_path}/i", buckets=2)
    files = spark.read.parquet(f"{tmp_path}/i/postings").groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.expr("pmod(hash(term, part), 2)")).alias("b")).collect()
    assert len(files) > 10 and all(r["b"] == 1 for r in files)
    same_as_built_at_once(spark, opened, rows)
    opened.release()


def test_lookups_of_candidates_shuffle_no_pairs(spark, tmp_path):
    opened = kept.build(docs_of(spark, corpus(6, 200)), f"file://{tmp_path}/i", buckets=2)
    questions = spark.createDataFrame([("q0", "word0 word1 word48 word49"), ("q1", "word2 word47")], "qid string, question string")
    search = pruned.Search(opened, questions, 2, seed_rows=5)
    plan = search.scores()._jdf.queryExecution().executedPlan().toString()
    own = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert not [x for x in own if "doc_id" in x and ("term" in x.split("hashpartitioning(")[1].split(")")[0])]
    got = {(r["qid"], r["doc_id"]): r["score"] for r in ranking.ranked(search.scores(), 2).collect()}
    want = {(r["qid"], r["doc_id"]): r["score"] for r in ranking.ranked(kept.scores(opened, kept.asked_terms(opened, questions)), 2).collect()}
    assert got == pytest.approx(want)
    search.release()
    opened.release()
