"""Operators 2, 3, 4, 6, 9: brute force, the tokenizer's library, held-out accuracy; and the edge cases of each."""

import os
import random
import re
import time

import numpy as np
import pytest

from lexmill.llm import op2_language_id as lang
from lexmill.llm import op4_tokens as tok
from lexmill.llm import op6_quality as quality
from lexmill.llm import op9_pii as pii
from lexmill.llm.op3_hamming import MultiIndex, hamming_topk, sign_codes

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "er"], "cc": ["ção", "ñe", "ue", "ir"]}


def documents(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(list(SYLLABLES))
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[name]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), name, "s", 1.0, 7))
    rows += [(n, None, "aa", "s", 1.0, 7), (n + 1, "", None, "s", 1.0, 7), (n + 2, "123 !? 😀", "bb", "s", 1.0, 7), (None, "kalo mitu kalo", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, held_out int")


def test_language_id(spark):
    docs = documents(spark)
    models = lang.fit(docs)
    got = {r["doc_id"]: r for r in lang.identify(docs, models).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(got[i]["lang_pred"] == truth[i] and not got[i]["rejected"] for i in range(300)) and sum(r["held_out"] for r in got.values()) > 30
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (300, 301, 302))
    assert got[None]["lang_pred"] == "aa" and all(0 <= r["score"] <= 1 for r in got.values())
    strange = spark.createDataFrame([(1, "xqz wvj yfx qzw " * 20, "aa")], "doc_id long, text string, lang string")
    assert lang.identify(strange, models).first()["rejected"] and lang.accepted(strange, models).count() == 0
    assert lang.accepted(docs, models).count() == 301
    assert lang.fit(docs.limit(0)) is None and lang.identify(docs.limit(5), None).where("lang_pred = 'und' and not rejected").count() == 5


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abcd "), 400))
    grams, counts = np.unique(lang._grams(lang._codes([text])[0]), return_counts=True)
    models = lang.Models(["x"], [lang.kneser_ney(grams, counts)])
    letters = np.append(models.orders[0][0], np.uint64(ord("q")))  # and one that is unknown
    for context in ("abc", "dd ", "zzz"):
        head = sum(np.uint64(ord(c)) << np.uint64(16 * (3 - i)) for i, c in enumerate(context))
        assert np.exp(models._backed_off(head | letters, 4)).sum() == pytest.approx(1, abs=1e-5)


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    models = lang.fit(documents(spark))
    texts = ["kalo mitu " * 50, "", "schung ein", "12", "x" * 301]
    whole = models.entropies(texts)
    for piece in (1, 7, 100):
        monkeypatch.setattr(lang, "PIECE", piece)
        for a, b in zip(models.entropies(texts), whole, strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy_of_language_id(spark):
    got = lang.op2_language_id(spark, SF).where("held_out and lang_pred <> 'und'")
    truth = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert len(rows) > 100 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_auc_of_quality(spark):
    got = quality.op6_quality_classifier(spark, SF).where("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    rows = got.join(labels, "doc_id").collect()
    good, bad = [np.array([r["score"] for r in rows if r["quality"] == x]) for x in (1, 0)]
    auc = np.mean((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :]))
    assert len(good) > 10 and len(bad) > 10 and auc > 0.97


def brute_topk(codes, queries, k):
    out = []
    for q, c in queries:
        near = sorted({(bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in codes if i is not None and i != q})[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def test_hamming_topk(spark):
    rng = random.Random(6)
    word = lambda: rng.getrandbits(64) - 2**63
    base = [word() for _ in range(12)]
    codes = [(i, base[i % 12] ^ (1 << rng.randrange(62)) * (i % 3 > 0)) for i in range(150)] + [(i, word()) for i in range(150, 220)] + [(300 + i, base[0]) for i in range(20)]
    rows = spark.createDataFrame([(*c, "s", 1) for c in [*codes, codes[3], (None, 5), (900, None)]], "id long, code long, shard string, block int")
    queries = [(i, c) for i, c in codes if i % 20 == 0] + [(10_000, base[1])]
    asked = spark.createDataFrame([*queries, queries[0], (None, 1), (7, None)], "query_id long, code long")
    for options in ({}, {"shard": 60, "block": 4}):
        got = hamming_topk(rows, asked, 5, **options).collect()
        assert sorted(tuple(r) for r in got) == brute_topk(codes, queries, 5)
    assert hamming_topk(rows.limit(0), asked, 5).count() == hamming_topk(rows, asked.limit(0), 5).count() == 0
    few = hamming_topk(spark.createDataFrame([("b", 1), ("a", 1), ("c", -1)], "id string, code long"), spark.createDataFrame([("a", 1)], "query_id string, code long"), 5)
    assert sorted((r["rank"], r["id"], r["distance"]) for r in few.collect()) == [(1, "b", 0), (2, "c", 63)]


def test_segments_are_searched_one_by_one():
    """Random codes, families of near codes and codes that share a segment, in pieces of any size; every answer against all distances."""
    from lexmill.llm import op3_hamming

    rng = np.random.default_rng(4)
    codes = np.concatenate([rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2), np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)), np.full(30, 99, np.uint64), np.uint64(0xFFFF) | rng.integers(0, 2**40, 80, dtype=np.uint64) << np.uint64(20)])
    queries = np.concatenate([codes[::7], rng.integers(0, 2**63, 20, dtype=np.uint64)])
    own = np.append(np.arange(0, len(codes), 7), np.full(20, -1))
    every = np.bitwise_count(queries[:, None] ^ codes[None, :]).astype(int)
    for held, k in ((1 << 20, 10), (50, 3), (1 << 20, 1000)):
        op3_hamming.HELD = held
        q, at, d = MultiIndex(codes).nearest(queries, own, k)
        for i in range(len(queries)):
            want = sorted((every[i, c], c) for c in range(len(codes)) if c != own[i])[:k]
            assert list(zip(d[q == i].tolist(), at[q == i].tolist(), strict=True)) == want
    op3_hamming.HELD = 1 << 20


def test_sign_codes(spark):
    v = spark.createDataFrame([([0.5, -1.0, None] + [0.0] * 60 + [2.0],), (None,), ([1.0],)], "embedding array<double>")
    assert [r["code"] for r in sign_codes(v).collect()] == [1 - 2**63, 0, 1]
    long_ = spark.createDataFrame([([1.0] * 65,)], "embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        sign_codes(long_).collect()


def test_token_counts(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = ["", "  a  b ", "a\n\nb \n c", "<|endoftext|> x<|endoftext|>", "日本語 テスト　全角", "it's we'll  don't", "\x1c\x1d a\x85b\xa0 c", "x" * 3000, "½ ²³ ①x", "😀😀 x", " lead", "trail "]
    texts += ["".join(rng.choice("abe TN12é\n\t .,'<|>") for _ in range(rng.randrange(80))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in tok.count_tokens(docs, path, 500).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len(t.encode()), n > 500), t
    assert (got[None]["n_tokens"], got[None]["n_bytes"]) == (0, 0)
    small = tok.Counter(tok.load_merges(path), cache=2)
    assert [small.count(t) for t in texts] == [got[i]["n_tokens"] for i in range(len(texts))]


def test_quality(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 60))]
        rows.append((i, " ".join(words) if good else " ".join(w + "###" for w in words), "x", 0.5))
        if i % 2:
            labels.append((i, int(good), None))
    rows += [(700, None, "x", 0.5), (701, "", "x", 0.5), (None, "abc def", "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    marked = spark.createDataFrame([*labels, (700, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, text string")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, quality.fit(docs, marked)).collect()}
    wrong = [i for i, t, _, _ in rows[:600] if got[i]["held_out"] and got[i]["predicted"] != int("#" not in t)]
    assert len(wrong) <= 2 and all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 603
    assert quality.fit(docs, marked.where("quality = 1")) is None and quality.score_quality(docs.limit(3), None).where("score = 0.5").count() == 3


def test_flat_trees_follow_the_splits():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = quality.boost(x, y, trees=30, depth=3)
    for row, score in zip(x[:40], model.score(x[:40]), strict=True):
        total = model.start
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda s: re.sub(r"\D", "", s)

    def keep(kind, s):
        if kind == 1:
            return all(int(x) <= 255 for x in s.split("."))
        if kind == 2:
            d = digits(s)
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == 0 or 8 <= len(digits(s)) <= 15

    return [(k, *m.span()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, t) if keep(k, m.group())]


def test_base_spans():
    rng = random.Random(9)
    parts = ["a@b.c", "@", ".", "x-y@z", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-0100", "+", "12", " ", "é", "a.b@c-d.e.f@g.h", "\n", "-"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_odd_texts_of_personal_data():
    """Very long parts and tokens: no error, and time that grows with the text's length."""
    zeros = "0" * 6000
    assert pii.base_spans(f"{zeros}1.2.{zeros}.255 9{zeros}.1.1.1") == [(1, 0, 6000 + len("1.2.") + 6000 + len(".255"))]
    texts = ["A1b2+/" * 170_000, "ab12#" * 200_000, "1" * 1_000_000, "a=" + "bbbbbb=" * 140_000, "1.2." * 250_000, "x@" * 500_000, "+1" * 500_000, "a@b.c " * 160_000 + "k" * 40_000]
    for t in texts:
        start = time.perf_counter()
        fixed = pii.base_spans(t)
        for a, b in pii.candidates(t, fixed):
            assert 0 <= a < b <= len(t) and not any(s < b and a < e for _, s, e in fixed[:50])
        assert time.perf_counter() - start < 5, t[:20]


def test_reliabilities_are_recovered():
    """Votes of labelers whose accuracies are known: EM finds these, the share of true spans, and the truth."""
    rng = np.random.default_rng(3)
    right, speaks = np.array([0.95, 0.9, 0.85, 0.75, 0.65, 0.8]), np.array([0.9, 0.8, 0.9, 0.7, 0.9, 0.6])
    truth = rng.random(40_000) < 0.3
    said = np.where((rng.random((40_000, 6)) < right) == truth[:, None], 1, -1) * (rng.random((40_000, 6)) < speaks)
    patterns, where, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    share, found, post = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.02 and np.abs(found - right).max() < 0.03
    assert ((post[where.ravel()] > 0.5) == truth).mean() > 0.95


def test_personal_data(spark):
    rng = random.Random(10)
    fill = lambda: " ".join(rng.choice(["the", "lorem", "ipsum", "dolor"]) for _ in range(8))
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f"{fill()} password={key(18)} {fill()}" for _ in range(40)] + [f'{fill()} token = "{key(40)}" {fill()}' for _ in range(40)] + [f"{fill()} note: nothing here, 2020-01-01 {fill()}" for _ in range(40)] + ["mail é a.b@c.de now", "", None]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs, pii.fit(docs)).collect()}
    assert sum(got[i]["n_secret"] for i in range(80)) == 80 and sum(got[i]["n_secret"] for i in range(80, 123)) == 0
    assert got[120]["spans"] == got[120]["base"] == "email:7:15" and got[121]["spans"] == got[122]["spans"] == ""
    for i in range(80):
        kind, a, b = got[i]["spans"].split(":")
        assert kind == "secret" and re.fullmatch("[0-9a-f]+", texts[i][int(a) : int(b)])
    assert pii.fit(docs.limit(0)) is None
