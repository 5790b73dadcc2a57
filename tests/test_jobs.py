"""The jobs: two runs over growing input, reruns, and their command lines."""

import pytest
from pyspark.sql import functions as F

from jobs import evaluate_retrievers, index_documents
from jobs.common import parse
from lexmill.operators import kept

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, rows):
    made = [(i, t, "en", "s", None) for i, t in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def index_rows(spark, path):
    opened = kept.open_index(spark, path)
    out = (sorted(map(tuple, opened.postings.select("doc_id", "term", "tf", "dl").collect())), sorted(map(tuple, opened.terms.select("term", "df").collect())), opened.n, opened.avgdl)
    opened.release()
    return out


def test_the_index_grows_with_its_input(spark, tmp_path):
    docs, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    config = index_documents.Config(docs, f"{out}/index", f"{out}/checkpoint", buckets=4)
    first = [(i, f"alpha beta word{i % 3}") for i in range(20)] + [(20, None), (21, "")]
    put(spark, docs, first)
    done = index_documents.run(spark, config)
    assert done["batches"] == 1 and done["units"] == 22 and done["replaced"] == 0
    before = index_rows(spark, config.output)
    assert index_documents.run(spark, config) == {"batches": 0}  # nothing new: nothing changes
    assert index_rows(spark, config.output) == before
    second = [(3, "alpha replaced"), (30, "gamma gamma delta")]
    put(spark, docs, second)
    done = index_documents.run(spark, config)
    assert done["batches"] == 1 and done["units"] == 2 and done["replaced"] == 1
    # The same as one run over everything, with the newest text of each document.
    whole = f"file://{tmp_path}/whole"
    put(spark, whole, list((dict(first) | dict(second)).items()))
    once = index_documents.Config(whole, f"{out}/once", f"{out}/once-checkpoint", buckets=2)
    index_documents.run(spark, once)
    assert index_rows(spark, config.output) == index_rows(spark, once.output)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lexmill_")]  # no names are left behind


def test_small_batches_and_a_single_file(spark, tmp_path):
    docs = f"file://{tmp_path}/docs"
    for i in range(3):
        put(spark, docs, [(i, f"one two{i}"), (9, f"version{i} of nine")])
    config = index_documents.Config(docs, f"file://{tmp_path}/i", f"file://{tmp_path}/c", buckets=2, max_files=1)
    assert index_documents.run(spark, config)["batches"] == 3
    found = index_rows(spark, config.output)
    assert found[2] == 4 and sum(d == "9" for d, *_ in found[0]) == 2  # version2, nine
    file = sorted(p for p in (tmp_path / "docs").glob("*.parquet"))[0]
    alone = index_documents.Config(str(file), f"file://{tmp_path}/i2", f"file://{tmp_path}/c2", buckets=2)
    assert index_documents.run(spark, alone)["units"] == 2


def test_retrievers_are_evaluated_again_with_the_same_result(spark, tmp_path):
    text = lambda i: " ".join(f"word{(i * 7 + j * j) % 90}" for j in range(60))
    docs, passages, out = (f"file://{tmp_path}/{x}" for x in ("docs", "passages", "out"))
    put(spark, docs, [(i, text(i)) for i in range(30)] + [(99, None)])
    asked = [(i, " ".join(text(i).split()[5:25])) for i in range(0, 30, 3)] + [(70, "words that stand nowhere"), (71, None), (72, "word1"), (73, "\u65e5\u672c")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(passages)
    config = evaluate_retrievers.Config(docs, passages, out, ("bm25",), depth=6)
    counted = evaluate_retrievers.run(spark, config)
    assert counted["questions"] == 11 and counted["bm25 predictions"] == 66 and counted["bm25 submissions"] == 70
    read = lambda t: sorted(map(repr, spark.read.parquet(f"{out}/{t}").collect()))
    before = {t: read(t) for t in ("predictions", "metrics", "submissions")}
    assert evaluate_retrievers.run(spark, config) == counted
    assert {t: read(t) for t in before} == before
    # Another retriever adds its partitions and leaves the others.
    evaluate_retrievers.run(spark, evaluate_retrievers.Config(docs, passages, out, ("tfidf",), depth=6))
    assert [r for r in read("metrics") if "bm25" in r] == before["metrics"] and len(read("metrics")) == 2 * len(before["metrics"])
    hits = spark.read.parquet(f"{out}/predictions").where("retriever = 'bm25' AND rank = 1 AND qid <> 'b_72'").agg(F.avg(F.col("right").cast("double"))).first()[0]
    assert hits == 1.0


def test_command_lines(tmp_path):
    file = tmp_path / "c.yaml"
    file.write_text("buckets: 3\noutput: there\n")
    config = parse(index_documents.Config, "index_documents", "x", ["--config", str(file), "--documents", "d", "--checkpoint", "c", "--buckets", "5"])
    assert config == index_documents.Config("d", "there", "c", 5)
    own = parse(evaluate_retrievers.Config, "evaluate_retrievers", "x", ["--documents", "d", "--passages", "p", "--output", "o", "--retrievers", "bm25,chunked_bm25"])
    assert own == evaluate_retrievers.Config("d", "p", "o", ("bm25", "chunked_bm25"))
    file.write_text("nothing: 3\n")
    with pytest.raises(ValueError):
        parse(index_documents.Config, "index_documents", "x", ["--config", str(file)])


def test_right_documents_are_told_by_the_index_of_the_ranking(spark, tmp_path, monkeypatch):
    """The job cuts the texts into words once: the index that it ranks with finds the right documents."""
    docs, passages = f"file://{tmp_path}/docs", f"file://{tmp_path}/passages"
    put(spark, docs, [(i, f"lead the quick brown fox {i % 3} jumps far") for i in range(12)])
    spark.createDataFrame([(1, "quick brown fox 2 jumps"), (2, "nowhere to be found")], "item_id long, text string").write.parquet(passages)
    made, find = [], evaluate_retrievers.labelled
    monkeypatch.setattr(evaluate_retrievers, "labelled", lambda *a: made.append(a[2:]) or find(*a))
    done = evaluate_retrievers.run(spark, evaluate_retrievers.Config(docs, passages, f"file://{tmp_path}/out", ("bm25",), 2, 3))
    assert done["questions"] == 1 and len(made[0]) == 1 and made[0][0].whole
    right = spark.read.parquet(f"file://{tmp_path}/out/predictions").where("right").collect()
    assert [(r["qid"], r["doc_id"]) for r in right] in ([("b_1", "11")], [])
