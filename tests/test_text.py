"""Tokens and passages against values made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import chunking as C
from lexmill.functions import text as T


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(T.tokenize(F.col("t"))).first()[0]


def test_tokens_of_a_reference(spark):
    assert tokens(spark, "ст. 10.2 ГК РФ от 05.03.2019") == ["гк", "рф", "2019", "статья", "article_10.2", "гк", "рф", "code_гк_рф", "date_2019-03-05", "10.2", "05.03.2019"]


REFERENCES = [
    ("ст. 10.2 ГК РФ от 05.03.2019", "гк рф 2019 статья article_10.2 гк рф code_гк_рф date_2019-03-05 10.2 05.03.2019"),
    ("ФЗ-400", "фз 400 фз law_400"),
    ("400-фз", "400 фз фз"),
    ("статьи 12", "статьи статья article_12"),
    ("статье 10", "статье"),
    ("5 мая 2021 года", "мая 2021 года date_2021-05-05"),
    ("5 мая 2021 г. и 17 декабря 1999", "мая 2021 декабря 1999 date_2021-05-05 date_1999-12-17"),
    ("№ 2-15/2020", "2020 case_2-15/2020"),
    ("УИД 77-RS-0001", "уид 0001 uid_77-rs-0001"),
    ("01.02.49 и 01.02.50", "date_2049-02-01 date_1950-02-01 01.02.49 01.02.50"),
    ("Граждан кодекс; гражданский кодекс Российской Федерации", "граждан кодекс гражданский кодекс российской федерации гк рф code_гк_рф"),
    ("1.2.3 x", "1.2.3"),
    ("", ""),
]


@pytest.mark.parametrize(("text", "want"), REFERENCES)
def test_references(spark, text, want):
    assert tokens(spark, text) == want.split()


def test_kinds_and_instances(spark):
    rows = [("АПЕЛЛЯЦИОННОЕ ОПРЕДЕЛЕНИЕ", "апелляционное определение", "апелляция"), ("Кассационный суд", "кассационное определение", "кассация"), ("Р Е Ш Е Н И Е", "решение", "первая инстанция"), ("прочее", "определение", "первая инстанция")]
    got = spark.createDataFrame(rows, "t string, kind string, instance string").select(T.document_kind(F.col("t")).alias("a"), "kind", T.court_instance(F.col("t")).alias("b"), "instance").collect()
    assert all(r["a"] == r["kind"] and r["b"] == r["instance"] for r in got)


def test_paragraphs(spark):
    rows = spark.createDataFrame([("a b\n \nc\n\n\n d ",), ("  ",), ("one\ntwo",)], "t string").select(T.paragraphs(F.col("t"))).collect()
    assert [r[0] for r in rows] == [["a b", "c", "d"], [], ["one\ntwo"]]


def test_laws(spark):
    assert tokens(spark, "ФЗ-400")[-2:] == ["фз", "law_400"]
    assert {"фз", "law_400-фз"} <= set(tokens(spark, "федеральный закон от 28.12.2013 № 400-ФЗ"))
    assert not any(t.startswith("law_") for t in tokens(spark, "400-фз"))
    assert tokens(spark, "статье 10") == ["статье"]


def test_years(spark):
    rows = spark.createDataFrame([("49",), ("50",), ("123",), ("2019",)], "y string").select(T.year(F.col("y"))).collect()
    assert [r[0] for r in rows] == ["2049", "1950", "0123", "2019"]


def test_null_and_empty(spark):
    assert tokens(spark, None) == [] and tokens(spark, "") == []


def test_lemmas_leave_special_tokens(spark):
    rows = spark.createDataFrame([("a", ["суда", "date_2020-01-01", "гк", "x9"])], "unit_id string, tokens array<string>")
    lemmas = spark.createDataFrame([("суда", "суд"), ("гк", "?"), ("x9", "?")], "token string, lemma string")
    assert T.lemmatize(rows, lemmas).first()["tokens"] == ["суд", "date_2020-01-01", "гк", "x9"]


def cut(text, size, stride):
    """text in windows of size, one each stride; blank ones go."""
    starts = range(0, max(1, len(text) - size + stride), stride) if text else ()
    return [w for s in starts if (w := text[s : s + size]).strip()]


def test_windows(spark):
    text = spark.createDataFrame([("x" * 25,)], "text string")
    sizes = lambda stride: [len(r["chunk_text"]) for r in text.select(F.inline(C.hard_windows(F.col("text"), 10, stride))).collect()]
    assert sizes(5) == [10] * 4 and sizes(10) == [10, 10, 5]


def test_pack(spark):
    rows = [("aaaa\n\nbbbb\n\ncccc", ["aaaa bbbb", "bbbb cccc"]), ("aaaaaaaa\n\nbbb", ["aaaaaaaa", "bbb"]), ("  ", ["  "]), (None, [""])]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    got: dict = {}
    for r in C.structured_chunks(docs, 10, 5).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk_text"])
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_pack_covers_all_words_and_ends(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab .\nAB", k=rng.randrange(200))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, stride in ((1, 1), (5, 2), (30, 30)):
        got: dict = {}
        for r in C.structured_chunks(docs, size, stride).collect():
            got.setdefault(r["doc_id"], []).append(r["chunk_text"])
        for i, t in enumerate(texts):
            assert set("".join(t.split())) == set("".join("".join(got[i]).split()))
            assert got[i] == [t] or all(c == c.strip() or len(c) <= size for c in got[i])


def test_windows_match_cut(spark):
    texts = ["", "x" * 25, "ab " * 9, "abcdefghij", " " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, stride in ((10, 5), (10, 10), (7, 3)):
        got = {r["doc_id"]: [] for r in docs.collect()}
        for r in C.window_chunks(docs, size, stride).orderBy("doc_id", "chunk_no").collect():
            got[r["doc_id"]].append(r["chunk_text"])
        assert got == {i: cut(t, size, stride) or [t] for i, t in enumerate(texts)}


def test_structured_chunks_keep_empty_documents(spark):
    docs = spark.createDataFrame([("a", None), ("b", "one. Two")], "doc_id string, text string")
    assert {r["doc_id"]: r["chunk_text"] for r in C.structured_chunks(docs, 100).collect()} == {"a": "", "b": "one. Two"}


@pytest.mark.parametrize("stride", [0, -1, 11])
def test_bad_stride(stride):
    with pytest.raises(ValueError):
        C.check_window(10, stride)
