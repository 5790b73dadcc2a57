"""Structure-aware packing against a plain version in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import chunking

SPACE = r"[\s\x1c-\x1f]"


def plain(text, size, stride):
    def windows(x):
        step = max(1, stride)
        starts = range(0, max(1, len(x) - size + step), step)
        return [w for s in starts if re.sub(SPACE, "", w := x[s : s + size])]

    u = []
    for p in (re.sub(f"{SPACE}+", " ", p).strip(" ") for p in re.split(rf"\n{SPACE}*\n+", text.strip())):
        parts = ([p] if len(p) <= size else [s for s in re.split(r"(?<=[.!?…;:])\s+(?=[А-ЯЁA-Z0-9])", p) if s]) if p else []
        for part in parts:
            u += [part] if len(part) <= size else windows(part)
    out, first, overlap = [], 0, size - stride
    while first < len(u):
        end = first + 1
        while end < len(u) and len(" ".join(u[first : end + 1])) <= size:
            end += 1
        out.append(" ".join(u[first:end]))
        if end == len(u):
            break
        back = end
        if overlap:
            back = end - 1
            while back > first and len(" ".join(u[back - 1 : end])) <= overlap:
                back -= 1
        first = max(back, first + 1)
    return out or [text]


def odd(rng):
    made = []
    for _ in range(rng.randrange(8)):
        n = rng.choice([1, 1, 2, 3, 5, 30])
        words = ["".join(rng.choice("abcdeXYÉ9Я") for _ in range(rng.choice([1, 2, 4, 9, 40]))) for _ in range(n)]
        made.append("".join(w + rng.choice([" ", " ", ". ", "; ", "\n", "  ", "… "]) for w in words))
        made.append(rng.choice(["\n\n", "\n \t\n", " ", "\n\n\n", "\x1c\n\n"]))
    return "".join(made)


@pytest.mark.parametrize(("size", "stride"), [(10, 5), (10, 10), (20, 3), (40, 20), (7, 1), (1600, 800)])
def test_chunks_equal_the_plain_version(spark, size, stride):
    rng = random.Random(size * stride)
    texts = [odd(rng) for _ in range(250)] + ["", " ", "\n\n", "x" * 95, "A. B. C. D", "a " * 3000, "Word number one. " * 400]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id int, text string")
    got: dict = {}
    for r in chunking.structured_chunks(docs, size, stride).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["chunk_text"]))
    assert got.pop(-1) == [(0, "")]
    for i, t in enumerate(texts):
        assert got[i] == list(enumerate(plain(t, size, stride))), (i, t)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    assert "Python" not in chunking.structured_chunks(docs)._jdf.queryExecution().executedPlan().toString()


def test_a_unit_costs_the_same_in_a_long_chunk(spark):
    """The fold keeps what the open chunk takes as a number: no list of its units is added up or copied for each unit."""
    df = spark.createDataFrame([(["ab"] * 5000,)], "u array<string>")
    made = df.select(chunking.packed(F.col("u"), 12_000, 6_000).alias("c"))
    assert "held" not in made._jdf.queryExecution().analyzed().toString()
    assert [len(c) for c in made.first()["c"]] == [11_999, 8_999]
