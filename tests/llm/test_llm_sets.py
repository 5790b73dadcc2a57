"""Operators 1, 5, 7, 8, 10 against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import components as comps
from lexmill.llm import fm_index, op1_jaccard_join
from lexmill.llm.op1_jaccard_join import _parities, differing_bits, jaccard_components, one_of_each
from lexmill.llm.op5_line_dedup import dedup_lines
from lexmill.llm.op7_substring_dedup import remove_repeated_windows
from lexmill.llm.op8_mixing import mix_sources
from lexmill.llm.op10_decontamination import contamination, decontaminate, seed_mask
from lexmill.llm.repeats import Suspects, repeated

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, h long, x string, _row int, key string"


def table(spark, rows):
    """Rows (doc_id, text[, source]) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", 1, "x", 2, "k") for r in rows], SCHEMA)


def corpus(seed, n=60, words=40):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice([f"w{i}" for i in range(60)] + ["the"] * 8) for _ in range(k))
    rows = [(i, pick(rng.randrange(1, words))) for i in range(n)]
    for i in range(n, 2 * n):  # exact and near copies of documents and of copies
        words_ = rows[rng.randrange(len(rows))][1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words_[rng.randrange(len(words_))] = f"n{rng.randrange(99)}"
        rows.append((i, "\n".join(words_) if rng.random() < 0.2 else " ".join(words_)))
    rows += [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, " \n\t"), (2 * n + 3, "A b"), (2 * n + 4, "a B"), (2 * n + 5, "lone " * 3000)]
    rng.shuffle(rows)
    return rows


def brute_components(rows, k=4, percent=85):
    sets = []
    for _, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), d) if x is not None], default=None)
    return sorted([(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)], key=repr)


@pytest.mark.parametrize(("seed", "k", "percent", "options"), [(1, 4, 85, {}), (2, 3, 80, {"held": 200, "common": 2, "rounds": 0}), (3, 2, 50, {"held": 50, "common": 3}), (4, 1, 30, {"common": 2}), (5, 4, 85, {"common": 1, "rounds": 1})])
def test_jaccard_components(spark, seed, k, percent, options):
    rows = corpus(seed)
    got = jaccard_components(table(spark, rows).repartition(3), k=k, percent=percent, **options)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], key=repr) == brute_components(rows, k, percent)


def test_jaccard_families_of_unlinked_texts(spark):
    """Many texts that are alike but seldom linked, with shared edits, of one size and of several; sets at the threshold itself."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(6)}"
        rows.append((i, " ".join(w[: rng.choice([60, 70, 80, 80])])))
    for n in (20, 40, 100):  # 100 * intersection = 85 * union, and one less
        rows += [(1000 + n, " ".join(f"x{n}_{i}" for i in range(n))), (2000 + n, " ".join(f"x{n}_{i}" for i in range(n * 85 // 100))), (3000 + n, " ".join(f"y{n}_{i}" for i in range(n))), (4000 + n, " ".join(f"y{n}_{i}" for i in range(n * 85 // 100 - 1)))]
    for options in ({"k": 1}, {"k": 2, "rounds": 0}, {"k": 1, "common": 4}):
        got = jaccard_components(table(spark, rows).repartition(4), **options)
        assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()], key=repr) == brute_components(rows, options["k"])


def test_jaccard_nulls_and_repeats(spark):
    t = "a b c d e f g h"
    rows = [(None, t), (5, t), (5, t), (None, "q r s t u"), (3, t + " i"), (9, None)]
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_components(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(None, 5), (5, 5), (5, 5), (None, None), (3, 3), (9, 9)], key=repr)
    kept = [r["doc_id"] for r in one_of_each(table(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([None, 5, 3, 9], key=repr)  # the null that stays is alone with its text
    assert jaccard_components(table(spark, [])).count() == 0


def verified_pairs(spark, monkeypatch, rows, **options):
    """The components of rows, and how many pairs of sets were verified on the way."""
    seen = []

    def stored(df):
        out = op1_stored(df)
        if df.columns == ["p", "x", "lo", "hi", "link"]:
            seen.append(out.count())
        return out

    op1_stored = op1_jaccard_join.stored
    with monkeypatch.context() as m:
        m.setattr(op1_jaccard_join, "stored", stored)
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(table(spark, rows).repartition(4), **options).collect()]
    return sorted(got, key=repr), sum(seen)


def passages_in_random_order(n, seed=44, take=30, of=44):
    rng = random.Random(seed)
    passages = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(of)]
    rows = [(i, " ".join(rng.sample(passages, take))) for i in range(n)]
    return [*rows, (n, rows[0][1] + " more"), (n + 1, "first " + rows[0][1]), (n + 2, rows[n // 2][1].replace(" p3w4 ", " other "))]


def test_texts_of_shared_passages_are_not_verified_pairwise(spark, monkeypatch):
    """Texts of the same passages in random order meet in all regions, but few pairs are verified, and twice the texts don't bring four times as many."""
    few, many = passages_in_random_order(100), passages_in_random_order(200)
    got, n_few = verified_pairs(spark, monkeypatch, few)
    assert got == brute_components(few)
    got, n_many = verified_pairs(spark, monkeypatch, many)
    assert got == brute_components(many)
    assert n_many < 2.5 * max(n_few, len(few))
    assert n_many < 2 * len(many) < len(many) ** 2 / 2


def test_a_busy_pivot_is_dealt_to_several_tasks(spark, monkeypatch):
    """Near copies of one text, all in the cell of one pivot."""
    monkeypatch.setattr(op1_jaccard_join, "SPLIT", 7)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(base[:10] + [f"e{i}"] + base[11:])) for i in range(60)]
    got, _ = verified_pairs(spark, monkeypatch, rows, k=2)
    assert got == brute_components(rows, 2)


def test_parities_bound_the_difference_of_sets(spark):
    rng = np.random.default_rng(5)
    pairs, true = [], []
    for n, m, common in [(50, 60, 40), (60, 130, 50), (1, 1, 1), (1, 1, 0), (500, 4000, 300), (1024, 1025, 1000)]:
        u = rng.integers(0, 1 << 64, n + m - common, dtype=np.uint64)
        a, b = u[:n], u[n - common :]
        pairs.append((_parities(a, n).tolist(), _parities(b, m).tolist()))
        true.append(n + m - 2 * common)
    got = [r["d"] for r in spark.createDataFrame(pairs, "a array<long>, b array<long>").coalesce(1).select(differing_bits(F.col("a"), F.col("b")).alias("d")).collect()]
    assert all(d <= t and (t - d) % 2 == 0 for d, t in zip(got, true, strict=True))
    assert got[0] >= 15 and got[2] == 0 and got[5] >= 40


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        if len(seen) > 1:
            want[v] = min(seen)
    got = {r["x"]: r["comp"] for r in comps.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def brute_lines(rows, least=10, chars=1):
    """Rows with the same id are one document, rows without an id one each."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, (d, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add((d, i if d is None else 0))
    count = {k: len(v) for k, v in holders.items()}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(key(x)) >= chars and count[key(x)] >= least)]
        out.append((d, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def test_lines_of_repeated_rows_count_once(spark):
    rows = [(1, "own\nshared")] * 6 + [(2, "shared"), (3, "other"), (None, "other"), (None, "other")]
    got = dedup_lines(table(spark, rows).repartition(4), min_docs=3)
    assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()], key=repr) == brute_lines(rows, 3)


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,2)", "date", "string", "double"])
def test_ids_of_any_type(spark, kind):
    rows = [(i, "the same line here again and again so it is long enough to be a window of words\nown " + str(i)) for i in range(1, 5)]
    docs = table(spark, rows).withColumn("doc_id", F.expr("date_add(date('2020-01-01'), int(doc_id))") if kind == "date" else F.col("doc_id").cast(kind))
    lines = dedup_lines(docs, min_docs=3, keep="first").orderBy("doc_id").collect()
    assert [r["n_dropped"] for r in lines] == [0, 1, 1, 1]
    assert [r["n_removed"] > 0 for r in remove_repeated_windows(docs).orderBy("doc_id").collect()] == [False, True, True, True]


@pytest.mark.parametrize(("chars", "options"), [(1, {}), (5, {"filter_bytes": 0}), (1, {"key_bytes": 0})])
def test_line_dedup(spark, chars, options):
    rng = random.Random(7)
    pool = [" Common Line ", "common line", "É line", "é line", "x", "", "tail\r"] + [f"line {i}" for i in range(200)]
    rows = [(i, "\n".join(rng.choice(pool[:12] if rng.random() < 0.5 else pool) for _ in range(rng.randrange(1, 8)))) for i in range(80)] + [(None, None), (90, ""), (91, "\n\n"), (91, "\n\n")]
    got = dedup_lines(table(spark, rows).repartition(5), min_chars=chars, carry=("source",), **options)
    assert sorted([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()], key=repr) == brute_lines(rows, chars=chars)
    assert got.select("carried.source").distinct().count() == 1


def test_line_dedup_first_stays(spark):
    rows = [(i, f"same\nown {i}\nsame") for i in range(5, 0, -1)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(table(spark, rows), min_docs=2, keep="first").collect()}
    assert got == {1: "same\nown 1", **{i: f"own {i}" for i in range(2, 6)}}
    with pytest.raises(ValueError):
        dedup_lines(table(spark, rows), min_docs=1)
    assert dedup_lines(table(spark, [])).count() == 0


def test_repeats_are_exact_and_complete(spark):
    import pyarrow as pa

    rows = [(i, f"{i % 40 if i < 50 else i}") for i in range(400)]
    df = table(spark, rows).repartition(6)
    found = repeated(df.select("text"), lambda b: np.array([int(x) for x in b.column(0).to_pylist()], np.uint64), 400)
    assert {r["h"] for r in found.collect()} == set(range(10))
    s = Suspects(found)
    assert s.tester()(np.arange(10, dtype=np.uint64)).all() and s.tester()(np.arange(50, 10_050, dtype=np.uint64)).mean() < 0.01
    assert pa


def brute_windows(rows, k):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min([x for x in (first.get(key, d), d) if x is not None], default=None)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - k + 1):
            f = first[tuple(w[i : i + k])]
            if f is not None and (d is None or f < d):
                gone |= set(range(i, i + k))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "options"), [(13, {}), (5, {"hot": 1}), (4, {"filter_bytes": 0, "broadcast_bytes": 0}), (4, {"broadcast_bytes": 0, "key_rows": 0})])
def test_substring_dedup(spark, k, options):
    rows = [*corpus(11, 40, 60), (None, "lone " * 30), (7, "lone " * 70)]
    got = remove_repeated_windows(table(spark, rows), k, **options)
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()], key=repr) == brute_windows(rows, k)


def test_fm_index_finds_what_is_there():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 6, 399), 0)
    fm = fm_index.FMIndex(text, 8, np.arange(400))
    query = rng.integers(1, 6, 300)
    length, low, high = fm_index.matching_statistics(fm, query, np.arange(300), 8)
    raw = bytes(text.tolist())
    for e in range(300):
        n = 0
        while n < 8 and n <= e and bytes(query[e - n : e + 1].tolist()) in raw:
            n += 1
        assert length[e] == n
        if n:
            at = {i for i in range(400 - n + 1) if raw[i : i + n] == bytes(query[e - n + 1 : e + 1].tolist())}
            assert set(fm.labels[low[e] : high[e]].tolist()) == at


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", "c", "é", None] + ["a"] * 3)) for i in range(3000)] + [(None, "x", "a"), (1, None, "zero"), (2, "", "zero")]
    got = mix_sources(table(spark, rows), carry=("text",)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    want, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        want = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if want[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 90
    again = mix_sources(table(spark, rows[::-1]), broadcast_rows=0).collect()
    assert sorted((repr(r["doc_id"]), r["taken"]) for r in again) == sorted((repr(r["doc_id"]), r["taken"]) for r in got)
    assert mix_sources(table(spark, [])).count() == 0


def test_repeated_rows_come_near_the_target(spark):
    rows = [(1, "w w w w w", "a")] * 1000 + [(2, "x " * 5, "b")] * 300 + [(3, "y", None)] + [(i, "z " * (i % 9), "b") for i in range(10, 200)]
    for parts in (1, 7):
        got = mix_sources(table(spark, rows).repartition(parts), carry=("text",)).collect()
        taken, target, sizes = {}, {}, {}
        for r in got:
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            target[r["source"]] = r["target"]
        assert len(got) == len(rows) and all(r["copies"] <= 3 for r in got)
        assert all(abs(taken[s] - target[s]) <= 9 for s in target), (taken, target)
        again = sorted((r["doc_id"], r["taken"]) for r in got)
        assert parts == 1 or again == before
        before = again


def test_words_of_a_structure_that_collides_modulo_powers_of_two():
    import pyarrow as pa

    from lexmill.llm.common import Words, text_bytes

    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes = Words(*text_bytes(pa.array([f"{word} {other}", f"x {other}", "x", word]))).hashes()
    assert hashes[0] != hashes[1] and hashes[1] == hashes[3] and hashes[2] == hashes[4] and hashes[0] == hashes[5]


def test_decontamination(spark):
    rng = random.Random(4)
    pick = lambda k: [rng.choice(["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(50)] + ["the"]) for _ in range(k)]
    items = [(i, " ".join(pick(30))) for i in range(6)] + [(6, "too short"), (7, None), (9, None)]
    items.append((8, items[0][1]))
    rows = [(i, " ".join(pick(80))) for i in range(30)] + [(30, None), (31, "")]
    body = items[2][1].split(" ")
    spoiled = ["zz" if i % 9 == 4 else w for i, w in enumerate(body)]
    third = ["zz" if i % 3 == 1 else w for i, w in enumerate(body)]
    rows += [(40, " ".join(pick(20) + body + pick(20)).upper()), (41, " ".join(pick(5) + spoiled)), (42, " ".join(pick(9) + third)), (43, " ".join(pick(9) + items[0][1].split(" ")[4:])), (44, " ".join(body[:12])), (40, " ".join(pick(9)))]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    for options in ({}, {"broadcast_rows": 0}):
        got = sorted((r["doc_id"], r["item_id"], r["n_items"]) for r in contamination(table(spark, rows), bench, **options).collect())
        assert got == [(40, 2, 1), (41, 2, 1), (43, 0, 2)]
    kept = sorted(r["doc_id"] for r in decontaminate(table(spark, rows), bench).collect())
    assert kept == sorted([*range(32), 40, 42, 44])
    assert contamination(table(spark, []), bench).count() == 0 and contamination(table(spark, rows), bench.limit(0)).count() == 0


def brute_pairs(rows, items, window=20, share=0.8):
    """{(doc_id, item_id): (doc_start, n_equal)} of the best alignments of documents and items, all scanned."""
    words = lambda t: [x.lower() for x in WORD.findall(t or "")]
    found = {}
    for d, text in rows:
        a = words(text)
        for i, item in items:
            b = words(item)
            run = min(window, len(b))
            for start in range(1 - len(b), len(a)) if b else ():
                eq = [0 <= start + j < len(a) and a[start + j] == b[j] for j in range(len(b))]
                n = max(sum(eq[s : s + run]) for s in range(len(b) - run + 1))
                if n >= share * run:
                    found[d, i] = max(found.get((d, i), (-1, 0)), (n, -start))
    return {k: (-start, n) for k, (n, start) in found.items()}


def found_pairs(spark, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["doc_start"], r["n_equal"]) for r in contamination(table(spark, rows), bench, **options).collect()}


def test_masks_hit_every_run():
    for share in (0.7, 0.8, 1.0):
        for words in range(1, 21):
            differ = max(n for n in range(words) if words - n >= share * words)
            mask = seed_mask(words, share)
            for bad in itertools.combinations(range(words), differ):
                assert any(all(p + i not in bad for i in mask) for p in range(words - mask[-1])), (words, share, bad)
    assert seed_mask(20, 0.8) == (0, 1, 2, 4)


def test_decontamination_misses_no_substitutions(spark):
    rng = random.Random(11)
    pick = lambda k: [rng.choice([f"w{i}" for i in range(40)]) for _ in range(k)]
    items = [(i, " ".join(pick(n))) for i, n in enumerate([10, 11, 12, 14, 15, 15, 16, 19, 20, 20, 21, 37, 60])]
    rows = [(i, " ".join(pick(50))) for i in range(10)]
    for i, item in items:
        body = item.split(" ")
        spoiled = [["zz" if j % 5 == phase else w for j, w in enumerate(body)] for phase in range(5)]
        run = min(20, len(body))
        for _ in range(12):
            off, n = rng.randrange(len(body) - run + 1), rng.choice([run // 5, run // 5, run // 5 + 1])
            bad = {off + j for j in rng.sample(range(run), n)} | set(range(off)) | set(range(off + run, len(body)))
            spoiled.append(["zz" if j in bad else w for j, w in enumerate(body)])
        rows += [(100 * (i + 1) + j, " ".join(pick(rng.randrange(4)) + x[rng.choice([0, 0, 2]):] + pick(rng.randrange(9)))) for j, x in enumerate(spoiled)]
    for options in ({}, {"window": 12, "share": 0.7}):
        expected = brute_pairs(rows, items, **options)
        assert len(expected) > 100 and found_pairs(spark, rows, items, **options) == expected


def test_decontamination_by_short_items(spark):
    rng = random.Random(12)
    pick = lambda k: [rng.choice([f"w{i}" for i in range(9)]) for _ in range(k)]
    items = [(i, " ".join(pick(i % 9 + 1))) for i in range(18)] + [(20, ""), (21, None), (22, " \n"), (23, "Lone")]
    rows = [(i, " ".join(pick(rng.randrange(12)))) for i in range(60)] + [(100 + i, f"x {t} y".upper()) for i, t in items if t] + [(200, None), (201, "lone " * 50)]
    expected = brute_pairs(rows, items)
    got = found_pairs(spark, rows, items)
    same = {i: min(j for j, t in items if (t or "").split() == (x or "").split()) for i, x in items}
    assert len(expected) > 50 and got == {(d, i): x for (d, i), x in expected.items() if same[i] == i}


def test_digests_of_queries(spark, tmp_path):
    from lexmill.llm.op5_line_dedup import op5_line_dedup
    from lexmill.llm.op7_substring_dedup import op7_substring_dedup

    rows = [(1, "a\nb"), (2, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["kept_sha256"] for r in op5_line_dedup(spark, str(tmp_path)).collect()} == {1: hashlib.sha256(b"a\nb").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert {r["doc_id"]: r["kept_sha256"] for r in op7_substring_dedup(spark, str(tmp_path)).collect()} == {1: hashlib.sha256(b"a b").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
    assert F


def test_shingles_of_many_texts_take_little_memory():
    """Word hashes of a batch are made in small slices: Python workers keep what the largest slice needed."""
    import tracemalloc

    import pyarrow as pa

    from lexmill.llm import common, op1_jaccard_join

    texts = pa.array([" ".join(f"word{i}x{j}" for j in range(500)) for i in range(800)])
    common._powers.clear()
    tracemalloc.start()
    n = sum(len(u) for u in op1_jaccard_join.shingle_sets(texts, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 800 * 497
    assert peak < 64 << 20
    assert sum(a.nbytes for a in common._powers.values()) < 24 << 20
