"""Operator 6: a quality classifier of histogram gradient-boosted trees over document statistics.

Trees are complete and of one depth, so they flatten into arrays: the children of node i are 2i + 1 and 2i + 2, and a
batch of documents walks all trees with numpy alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lean, maybe_broadcast, slices, table
from .op2_language_id import held_out

#: Labelled rows that the trees are fitted on, about: the bound of the sample.
SAMPLE_ROWS = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "lines_per_word", "upper", "digit", "not_ascii", "stop", "comma", "bar", "bang", "hash", "percent", "ampersand", "star", "dollar", "other_punct",
    "same_as_before", "distinct_words", "upper_words", "one_byte_words", "short_words", "long_words", "word_bytes_sd", "line_bytes", "longest_word",
)


def statistics(column: pa.Array) -> np.ndarray:
    """The features of each text; null and empty texts have zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for i, j, data, offsets in slices(column):
        n = np.diff(offsets)
        has = np.flatnonzero(n > 0)
        if not len(has):
            continue
        w = Words(data, offsets)
        k = np.diff(w.first)
        begin = offsets[:-1][has]

        def per_text(flags, begin=begin, has=has, n=n):
            x = np.zeros(len(n))
            x[has] = np.add.reduceat(flags, begin, dtype=np.int64)
            return x

        def per_word(values, w=w, k=k):
            x = np.zeros(len(k))
            some = np.flatnonzero(k)
            if len(some):
                x[some] = np.add.reduceat(values, w.first[:-1][some], dtype=np.float64)
            return x

        size = (w.end - w.start).astype(float)
        h = w.hashes()
        text_of = np.repeat(np.arange(len(k)), k)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
        kinds = np.array([len(np.unique(h[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)], float)
        upper = (data >= 65) & (data <= 90)
        cum_upper = np.append(0, np.cumsum(upper))
        shout = cum_upper[w.end] - cum_upper[w.start] >= np.maximum(2, size * 0.6)
        lines = per_text(data == 10) + 1
        is_punct = (data > 32) & (data < 128) & ~upper & ~((data >= 97) & (data <= 122)) & ~((data >= 48) & (data <= 57))
        chars = np.maximum(n, 1).astype(float)
        words = np.maximum(k, 1).astype(float)
        marks = [per_text(data == ord(c)) / words for c in ".,|!#%&*$"]
        longest = np.zeros(len(k))
        some = np.flatnonzero(k)
        if len(some):
            longest[some] = np.maximum.reduceat(size, w.first[:-1][some])
        mean = per_word(size) / words
        f = [
            np.log1p(n), np.log1p(k), mean, lines / words, per_text(upper) / chars, per_text((data >= 48) & (data <= 57)) / chars, per_text(data >= 128) / chars, *marks, per_text(is_punct) / words,
            per_word(same) / words, kinds / words, per_word(shout) / words, per_word(size == 1) / words, per_word(size <= 3) / words, per_word(size >= 12) / words, np.sqrt(np.maximum(per_word(size**2) / words - mean**2, 0)), n / lines, longest,
        ]
        block = np.column_stack(f)
        block[n == 0] = 0
        out[i:j] = block
    return out


class Trees:
    """Boosted trees as flat arrays: feature, threshold by tree and node, value by tree and leaf."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.feature, self.threshold, self.value = [], [], []

    def freeze(self) -> Trees:
        self.feature, self.threshold, self.value = np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.value)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over histograms of at most `bins` quantile bins."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.int64)
    rate_of_one = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(rate_of_one / (1 - rate_of_one))))
    margin = np.full(len(y), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            split_bin = np.full(width, bins, np.int64)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - base) * bins + binned[:, f]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(hs < 1) | (ha - hs < 1)] = 0
                gain = gain[:, : len(c)]
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                feature[base : base + width][better] = f
                threshold[base : base + width][better] = c[at[better]]
                split_bin[better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split_bin[node - base])
        leaf = node - (2**depth - 1)
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        margin += value[leaf]
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
    return model.freeze()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, **options) -> Trees | None:
    """Trees from labels(doc_id, quality) outside the held-out rows; None without labels of both kinds.

    About sample_rows labelled rows are used, chosen by the hash of their id, whole texts; null labels and ids are
    left out. Of an id's labels the smallest counts, and of rows that repeat an id one text.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_l"), F.col("quality").cast("int").alias("_q"))
    rows = rows.groupBy("_l").agg(F.min("_q").alias("_q"))
    share = int(min(1.0, sample_rows / max(1, rows.count())) * (1 << 30))
    sample = rows.where(F.pmod(F.xxhash64("_l"), F.lit(1 << 30)) <= share)
    texts = docs.select("doc_id", "text").join(maybe_broadcast(sample, sample.count()), F.col("doc_id") == F.col("_l"))
    texts = texts.groupBy("_l").agg(F.min("text").alias("text"), F.min("_q").alias("_q")).select("text", "_q")
    width = len(FEATURES)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(statistics(b.column(0))), pa.list_(pa.float64())), b.column(1)], ["x", "q"])

    got = texts.mapInArrow(lean(run), "x array<double>, q int").toPandas()
    if not len(got) or got.q.nunique() < 2:
        return None
    x, y = np.array(got.x.tolist()).reshape(-1, width), (got.q.to_numpy() >= 1).astype(float)
    order = np.lexsort([*x.T, y])  # the order in which rows arrive must not matter
    return boost(x[order], y[order], **options)


def score_quality(docs: DataFrame, model: Trees | None, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only the text enters. Null and empty texts are scored by their zero statistics; without a model every score is
    0.5. Repeated rows are scored each; an empty table gives no rows; extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            score = shared.value.score(statistics(b.column(2))) if shared.value else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
