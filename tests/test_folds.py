"""Folds of groups: no group is in two folds, and the classes are even within what groups left over can hold."""

import random
from collections import Counter, defaultdict

import pytest

from lexmill.operators import folds

SCHEMA = "gold string, topic string"


def made(spark, rows, parts, seed=1, limit=folds.LIMIT):
    out = {r["gold"]: r["fold"] for r in folds.fold_of_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), "gold", "topic", parts, seed, limit).collect()}
    assert set(out) == {g for g, _ in rows if g is not None} and set(out.values()) <= set(range(parts))
    return out


def spread(rows, found, parts):
    """By class, the largest difference between the counts of two folds."""
    counts = defaultdict(lambda: [0] * parts)
    for g, t in rows:
        counts[t][found[g]] += 1
    return {t: max(c) - min(c) for t, c in counts.items()}


@pytest.mark.parametrize("parts", [2, 3, 5])
def test_single_rows_differ_by_one(spark, parts):
    rows = [(f"g{t}-{i}", f"t{t}" if t else None) for t in range(4) for i in range(7 + 11 * t)]
    assert max(spread(rows, made(spark, rows, parts), parts).values()) <= 1


def test_mixed_groups_stay_even(spark):
    rng = random.Random(5)
    rows = [(f"g{i}", f"t{min(rng.randrange(5), rng.randrange(5))}") for i in range(300) for _ in range(1 + (i % 3))]
    found = made(spark, rows, 4)
    kinds = Counter()
    for g in {g for g, _ in rows}:
        kinds[tuple(sorted(Counter(t for h, t in rows if h == g).items()))] += 1
    left = Counter()  # what the groups hold that whole rounds leave over
    for kind, n in kinds.items():
        for t, c in kind:
            left[t] += (n % 4) * c
    got = spread(rows, found, 4)
    assert all(got[t] <= left[t] for t in got)
    assert max(got.values()) <= 3  # and far below that bound, since these are placed one by one


def test_the_same_rows_and_seed_give_the_same_folds(spark):
    rows = [(f"g{i % 40}", f"t{i % 7}") for i in range(150)]
    assert made(spark, rows, 3) == made(spark, rows[::-1], 3) != made(spark, rows, 3, seed=2)


@pytest.mark.parametrize("limit", [0, 3])
def test_without_the_driver(spark, limit):
    rows = [(f"g{i}", f"t{(i * j) % 9}") for i in range(90) for j in range(1 + i % 4)]
    found = made(spark, rows, 4, limit=limit)
    sizes = Counter(found.values())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert max(spread(rows, found, 4).values()) <= 15


def test_a_kind_that_holds_nearly_all_groups(spark, monkeypatch):
    monkeypatch.setattr(folds, "SLICES", 8)
    rows = [(f"g{i}", "t") for i in range(1001)] + [("big", "t")] * 50 + [(None, "t")]
    found = made(spark, rows, 5)
    assert sorted(Counter(f for g, f in found.items() if g != "big").values()) == [200, 200, 200, 200, 201]


def test_empty(spark):
    assert made(spark, [], 3) == {} and made(spark, [(None, "t")], 3) == {}
