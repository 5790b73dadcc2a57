"""Lemmas by an analyser and by learned suffixes, and exact order statistics, against brute force."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import describe, lemmas


def brute_rules(table, longest):
    counts = {}
    for token, lemma in table:
        kept = max((i for i in range(max(0, len(token) - longest), min(len(token), len(lemma)) + 1) if token[:i] == lemma[:i]), default=None)
        if kept is None:
            continue
        change = (len(token) - kept, lemma[kept:])
        for size in range(max(1, change[0]), min(longest, len(token)) + 1):
            counts.setdefault(token[-size:], Counter())[change] += 1
    return {suffix: min(c, key=lambda x: (-c[x], x)) for suffix, c in counts.items()}


def brute_lemma(word, rules, longest):
    for size in range(min(longest, len(word) - 1), 0, -1):
        if word[-size:] in rules:
            cut, add = rules[word[-size:]]
            return word[: len(word) - cut] + add or word
    return word


@pytest.mark.parametrize(("seed", "longest"), [(1, 6), (2, 3), (3, 1)])
def test_predicted_lemmas(spark, seed, longest):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abи") for _ in range(rng.randrange(1, 6))) + rng.choice(["", "ing", "ed", "ами", "a"])
    table = {w: (w[: -rng.randrange(1, 4)] or w) + rng.choice(["", "", "ть", "e"]) for w in (word() for _ in range(150))} | {"went": "go"}
    words = [word() for _ in range(150)] + ["x", "went", None]
    rows = [*table.items(), ("went", "zz"), (None, "n"), ("", "n"), ("nothing", None)]
    given = spark.createDataFrame(rows, "token string, lemma string")
    rules = brute_rules(sorted(table.items()), longest)
    assert {r["suffix"]: (r["cut"], r["add"]) for r in lemmas.suffix_rules(given, longest).collect()} == rules
    got = lemmas.completed(spark.createDataFrame([(w,) for w in words], "token string"), given, longest).collect()
    want = {w: table.get(w) or brute_lemma(w, rules, longest) for w in words if w is not None}
    assert len(got) == len(want) and {r["token"]: r["lemma"] for r in got} == want
    assert lemmas.completed(spark.createDataFrame([], "token string"), given).count() == 0
    none = lemmas.completed(spark.createDataFrame([("ab",)], "token string"), given.limit(0)).collect()
    assert [tuple(r) for r in none] == [("ab", "ab")]


def test_analyser_is_loaded_once_a_task(spark):
    loaded = spark.sparkContext.accumulator(0)

    def load():
        loaded.add(1)
        return lambda w: None if w == "stay" else w[:2]

    words = spark.createDataFrame([(w,) for w in ["running", "stay", "running", None, "ab"]], "token string")
    table = lemmas.analysed(words.coalesce(1), load)
    assert sorted(tuple(r) for r in table.collect()) == [("ab", "ab"), ("running", "ru"), ("stay", "stay")]
    assert 1 <= loaded.value <= 4  # a task each, at most, not a call for each word
    docs = spark.createDataFrame([("d", "running stay art 2021")], "doc_id string, text string")
    rows = docs.select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    assert T.lemmatize(rows, lemmas.analysed(lemmas.words_of(docs), load), key="doc_id").first()["tokens"] == ["ru", "stay", "ar", "2021"]


@pytest.mark.parametrize("cells", [2, 7, 1024])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_quantiles_are_exact(spark, kind, cells):
    rng = np.random.default_rng(cells)
    x = np.concatenate([rng.lognormal(5, 3, 400), np.full(100, 12.0), -rng.random(20), [1e12, 0.0]])
    x = x.astype(np.int64) if kind == "long" else x
    df = spark.createDataFrame([(v,) for v in x.tolist()] + [(None,)], f"v {kind}").repartition(3)
    r = describe.quantiles(df, "v", cells).first()
    assert (r["n"], r["least"], r["most"]) == (len(x), x.min(), x.max())
    for p in describe.PERCENTILES:
        assert r[f"p{round(p * 100)}"] == pytest.approx(np.quantile(x, p), rel=1e-12)


def test_quantiles_of_few_values(spark):
    df = spark.createDataFrame([(2**60 + 1,), (2**60 + 2,), (2**60 + 2,)], "v long")
    assert describe.order_statistics(df, [0, 1, 2], 2**60 + 1, 2**60 + 2) == {0: 2**60 + 1, 1: 2**60 + 2, 2: 2**60 + 2}
    empty = describe.quantiles(df.limit(0), "v").first()
    assert empty["n"] == 0 and empty["mean"] is None and empty["p50"] is None
    assert describe.quantiles(df.limit(1), "v").first()["p99"] == float(2**60 + 1)


def test_lookups_leave_counts_where_they_were_dealt(spark):
    counts = spark.createDataFrame([("d1", "d1", "words", 2), ("d1", "d1", "wordy", 1), ("d2", "d2", "other", 1)], "unit_id string, doc_id string, term string, tf long").repartition(3, "doc_id")
    table = spark.createDataFrame([("words", "word"), ("wordy", "word")], "token string, lemma string")
    out = T.lemma_terms(counts, table, "tf", 3)
    assert sorted(tuple(r) for r in out.select("doc_id", "term", "tf").collect()) == [("d1", "word", 3), ("d2", "other", 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and ("unit_id" in x or "term" in x.split("hashpartitioning(")[1].split(")")[0])]


@pytest.mark.parametrize("limit", [0, 10])
def test_a_large_table_gives_the_same_lemmas(spark, monkeypatch, limit):
    monkeypatch.setattr(T, "LEMMA_ROWS", limit)
    rows = spark.createDataFrame([("1", ["words", "x", "words"], "a"), ("2", [], "b"), ("3", None, "c")], "unit_id string, tokens array<string>, more string")
    table = spark.createDataFrame([("words", "word")], "token string, lemma string")
    got = {r["unit_id"]: (r["tokens"], r["more"]) for r in T.lemmatize(rows, table).collect()}
    assert got == {"1": (["word", "x", "word"], "a"), "2": ([], "b"), "3": ([], "c")}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_words_of_the_corpus_are_read_off_once(spark):
    from lexmill.plans import queries

    for df in (queries._lemmas(spark, "/root/testdata/sf0.001", True), queries.predicted_lemmas(spark, "/root/testdata/sf0.001")):
        assert "documents.parquet" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert not any("documents.parquet" in f for f in df.inputFiles())
