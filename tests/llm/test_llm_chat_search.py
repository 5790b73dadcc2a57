"""Operators 11 and 12 against brute force: reply trees and round trips, ranked search with skipped blocks."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import op11_chat_format as chat
from lexmill.llm import op12_ranked_search as ranked

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>", "<|end|>", "\\", "<\\/s>", "<", "[", "|", " ", "ok", "é", "\U0001f600", "\n"]


def odd(rng, n=6):
    return "".join(rng.choice(CONTROL) for _ in range(rng.randrange(n)))


def test_turns_come_back_exactly(spark):
    rng = random.Random(1)
    rows = [(i, [(rng.choice(["user", "assistant", "system", "tool", "a|>b", "", None]), rng.choice([None, odd(rng), odd(rng, 30)])) for _ in range(rng.randrange(6))]) for i in range(400)]
    made = spark.createDataFrame(rows, "id long, turns array<struct<role:string,text:string>>").select("id", "turns", chat.formatted(F.col("turns")).alias("f"))
    for r in made.select("turns", "f.formatted", "f.loss", chat.read_back(F.col("f.formatted")).alias("back")).collect():
        assert [tuple(t) for t in r["back"]] == [(t[0] or "", t[1] or "") for t in r["turns"]]
        said = [t[1] or "" for t in r["turns"] if t[0] == "assistant"]
        undo = lambda s: re.sub(r"\\(\\?)", r"\1", s)
        assert [undo(r["formatted"][a:b]) for a, b in r["loss"]] == said
        for turn in r["turns"]:  # markers stand only where the template put them
            assert r["formatted"].count("</s>") == len(said)


def tree_rows(seed, trees=12, most=40):
    rng, rows = random.Random(seed), []
    for t in range(trees):
        n = rng.randrange(1, most)
        for i in range(n):
            shape = rng.random()
            parent = None if i == 0 or shape < 0.03 else (i - 1 if t % 3 == 0 else rng.randrange(i))
            rows.append((t if t else None, i, 999 if shape > 0.98 else parent, rng.choice(["user", "assistant"]), f"m{t}.{i}", rng.choice([None, 0.5, 1.0, 2.0])))
    rows += [(77, 1, 2, "user", "ring", 1.0), (77, 2, 1, "user", "ring", 1.0), (77, 3, 2, "user", "below a ring", 1.0), (78, None, None, "user", "no node", 1.0), (79, 5, None, "user", None, None), (79, 5, None, None, "b", None)]
    return rows


TREE = "tree long, node long, parent long, role string, text string, score double, depth int, leaf string, a string"


def brute_paths(rows, best):
    out = {}
    by_tree: dict = {}
    for t, n, p, role, text, score in rows:
        if n is not None:
            have = by_tree.setdefault(t, {})
            new = (p, role, text, score)
            key = lambda x: (x[1] is not None, x[1] or "", x[2] is not None, x[2] or "")
            if n not in have or key(new) < key(have[n]):
                have[n] = new
    for t, nodes in by_tree.items():
        answered, found = {p for p, *_ in nodes.values()}, []
        for leaf in nodes:
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][0]
            if leaf not in answered and len(path) <= len(nodes):
                scores = [nodes[x][3] for x in path if nodes[x][3] is not None]
                found.append((-round(sum(scores) / len(scores) if scores else 0.0, 9), leaf, path[::-1]))
        for place, (s, leaf, path) in enumerate(sorted(found), 1):
            if best is None or place <= best:
                out[t, leaf] = (place, -s, [(nodes[x][1] or "", nodes[x][2] or "") for x in path])
    return out


@pytest.mark.parametrize("best", [1, 2, None])
def test_reply_trees_equal_brute_force(spark, best):
    rows = tree_rows(3)
    messages = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], TREE)
    made = chat.format_trees(messages, best).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    got = {(r["tree"], r["leaf"]): (r["branch"], pytest.approx(r["branch_score"]), [tuple(x) for x in r["back"]]) for r in made}
    want = brute_paths(rows, best)
    assert got.keys() == want.keys()
    for k, (place, score, turns) in want.items():
        assert got[k][0] == place and got[k][1] == score and got[k][2] == turns
    assert all(r["n_turns"] == len(r["back"]) for r in made)


def test_flat_conversations_and_edges(spark):
    schema = "conv_id long, turn long, role string, text string, node int, tree string"
    rows = [(1, 1, "assistant", "b", 0, "t"), (1, 0, "user", None, 0, "t"), (1, 1, "assistant", "b", 0, "t"), (None, 0, "user", "n", 0, "t"), (None, None, None, "first", 0, "t"), (2, 5, "tool", "<|", 0, "t")]
    made = chat.digests(chat._formatted(chat.threads(spark.createDataFrame(rows, schema)), 1))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in made.collect()}
    assert got == {1: (3, 2), None: (2, 0), 2: (1, 0)}
    empty = spark.createDataFrame([], schema)
    assert chat._formatted(chat.threads(empty), 1).count() == 0


def test_a_long_thread(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", "x" * 50) for i in range(700)] + [(6, 0, "user", "y" * 200_000)]
    made = chat.digests(chat._formatted(chat.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 1))
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in made.collect()} == {(5, 700, 17_500), (6, 1, 0)}


# --- ranked search ------------------------------------------------------------------------------


def brute_search(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    texts = [(d, find(t)) for d, t in docs if d is not None]
    texts = [(d, w) for d, w in texts if w]
    n, total = len(texts), sum(len(w) for _, w in texts)
    df: dict = {}
    for _, w in texts:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(find(t))
    out = set()
    for i, words in asked.items():
        scored = []
        for d, w in texts:
            m = 50 + (50 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * w.count(x)) // (1000 * w.count(x) + 20 * m)) for x in words if x in w)
            if s > 0:
                scored.append((-s, d))
        out |= {(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)}
    return out


def search_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É1", "straße", "Ünï"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(rng.randrange(10**6), " -".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for _ in range(n)]
    docs += [(7, docs[0][1]), (8, docs[0][1]), (9, None), (10, ""), (11, "- _ ."), (None, "w1 w2"), (12, "w3 " * 5000), (13, "W1")]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 12)))) for i in range(8)] + [(50, None), (51, "nowhere"), (None, "w1"), (3, "w39 w38")]
    return docs, items


DOCS = "doc_id long, text string, n long, ids string, score int"


@pytest.mark.parametrize(("k", "options"), [(5, {}), (50, {"shard_docs": 7}), (3, {"shard_postings": 20, "item_block": 9})])
def test_search_equals_brute_force(spark, k, options):
    docs, items = search_rows(k)
    table = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS).repartition(3)
    got = ranked.search(table, spark.createDataFrame(items, "item_id long, text string"), k, **options)
    assert {tuple(r) for r in got.collect()} == brute_search(docs, items, k)
    assert got.count() == len(brute_search(docs, items, k))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a", 0, "", 0)], DOCS)
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs, asked).count() == ranked.search(full, items).count() == 0
    with pytest.raises(ValueError):
        ranked.search(full, asked, 0)


def test_block_ends_are_the_cheapest_of_the_allowed_lengths():
    rng = np.random.default_rng(4)
    for _ in range(40):
        sizes = rng.integers(1, 14, 5)
        parts = rng.integers(1, 1000, sizes.sum())
        offsets = np.append(0, np.cumsum(sizes))
        ends = ranked.block_ends(parts, offsets, 2.0)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            x = parts[a:b]
            block = int(2.0 * np.abs(x - x.mean()).mean() + 1)
            best = [0]
            for j in range(1, len(x) + 1):
                best.append(min(best[j - n] + n * int(x[j - n : j].max()) - int(x[j - n : j].sum()) + block for n in ranked.LENGTHS if n <= j))
            own = [int(e) for e in ends if a < e <= b]
            assert own[-1] == b
            edges = [int(a), *own]
            total = sum((q - p) * int(parts[p:q].max()) - int(parts[p:q].sum()) + block for p, q in zip(edges[:-1], edges[1:], strict=True))
            assert abs(total - best[-1]) <= len(x)  # the list's cost of a block is rounded from running sums


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    n = 20_000
    lists = [np.union1d(rng.choice(n, 8000, replace=False), np.arange(501, 520)) for _ in range(6)]
    doc, term = np.concatenate(lists), np.repeat(np.arange(6), [len(x) for x in lists])
    tf = rng.integers(1, 3, len(doc)) + 30 * (rng.random(len(doc)) < 0.001)
    tf[(doc > 500) & (doc < 520)] = 40  # a few documents far above the others
    shard = ranked.Shard(np.arange(n), np.full(n, 100), doc, term, tf)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    weights = np.array([900, 800, 700, 600, 500, 400])
    scores, ids = shard.best(np.arange(6), weights, 5, none)
    whole = np.zeros(n, np.int64)
    np.add.at(whole, doc, (10**9 * tf) // (1000 * tf + 2000) * weights[term])
    order = np.lexsort((np.arange(n), -whole))[:5]
    assert (ids == order).all() and (scores == whole[order]).all()
    assert shard.read < len(doc) / 20
