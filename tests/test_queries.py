"""Each registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = (
    "normalize_documents tokenize_documents token_stats numeric_reference_tokens legal_special_tokens lemma_lookup predicted_lemmas paragraph_split sentence_split hard_split chunks_structured pruned_bm25_topk document_kind court_instance "
    "token_containment evidence_offsets rare_topic_collapse term_stats_bm25 term_stats_tfidf bm25_topk tfidf_topk chunked_bm25_logsumexp hybrid_rrf rerank_linear bm25_lemma_topk rerank_lemma_linear recall_at_k topic_metrics cv_summary fold_leakage split_invariants "
    "topic_distribution_score duplicate_groups length_quantiles gold_coverage vocab_coverage query_nn_similarity create_submission submission_violations aligned_inner_join declared_scans recorded_metrics partitioned_questions"
).split()


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, views, name):
    df = entry.queries()[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    spark.catalog.clearCache()
    cursor = views.execute(entry.oracle_sql()[name])
    want = plain(cursor.fetchall(), [c[0] for c in cursor.description])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if not any(isinstance(x, str) for x in a) else repr(a) == repr(b)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
