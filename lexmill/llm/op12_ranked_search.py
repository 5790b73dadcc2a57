"""Ranked lexical search with variable blocks: exact top-k by block-max WAND in each shard of documents.

`search(docs, items, k)` ranks all documents for each item. Items are the query set: they are collected in blocks of
bounded size (ITEM_TERMS terms), and each block meets all documents. For a block,

1. documents are tokenised once; a row keeps the document's length and the counts of the asked terms (a stored table);
2. N, L and the document frequencies are counted over all documents;
3. each task cuts its rows into shards of at most SHARD_POSTINGS postings. A shard builds posting lists, and dynamic
   programming sets the block boundaries of each list so that the sum of (block maximum - posting) over its postings
   plus a fixed cost for each block is least. The pivot test of WAND, whether the maxima of the blocks that lie at a
   document reach the threshold, is made for all documents of the shard by one running sum over the blocks' ends.
   Documents are scored by falling bound, so that the threshold rises at once; blocks that hold no document at or above
   it are skipped unread. The threshold of an item is kept from shard to shard of a task;
4. the best k of all shards are ranked.

No posting is shuffled, only k rows an item and task. Scores are integers, so the result does not depend on the
order of sums; bounds are compared with the threshold such that ties are scored too.

Defined cases: null or empty texts, and texts without a term, count for nothing and are never returned; an item without
terms has no rows; items of one item_id are one item with the terms of all its rows; rows without doc_id or item_id are
left out; rows with the same doc_id are documents of their own; without documents or items the result is empty. Other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, lean, stored, table

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Terms of the items that are asked at once; more items are asked in further blocks.
ITEM_TERMS = 400_000
#: Postings, and documents, of one shard.
SHARD_POSTINGS, SHARD_DOCS = 500_000, 65_536
#: Lengths that a block of postings may have: rungs of the dynamic programme.
LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: What a block costs, as a multiple of the mean distance of its list's postings from their mean.
BLOCK_COST = 4.0


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: runs of ASCII letters and digits and of all other characters from U+0080, A-Z lower-cased."""
    return _TERM.findall(text.translate(_LOWER))


# --- posting lists of a shard -----------------------------------------------------------------


def block_ends(parts: np.ndarray, offsets: np.ndarray, cost: float = BLOCK_COST) -> np.ndarray:
    """The ends (exclusive positions) of the blocks of all lists parts[offsets[i]:offsets[i+1]], by dynamic programming.

    best[j] = min over lengths l of best[j - l] + l * max(last l) - sum(last l) + the list's cost of a block. All lists
    take their jth step together; lengths go up to 256 in steps of about 1.4.
    """
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return np.zeros(0, np.int64)
    sizes, starts = sizes[order], offsets[order]
    sums = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(parts, out=sums[1:])
    means = np.zeros(len(offsets) - 1)
    means[order] = (sums[starts + sizes] - sums[starts]) / sizes
    apart = np.append(0.0, np.cumsum(np.abs(parts - np.repeat(means, np.diff(offsets)))))
    block = (cost * (apart[starts + sizes] - apart[starts]) / sizes + 1).astype(np.int64)
    # The maximum of the last l postings at each place; places before the lth of a list are never asked for it.
    steps = np.array(LENGTHS, np.int64)
    peaks = {1: parts.astype(np.int32)}
    cost_at = np.empty((len(parts), len(steps)), np.int32)  # parts are a million at most
    for i, n in enumerate(LENGTHS):
        if n > sizes[0]:
            break
        if n > 1:
            long_, short = (2, 1) if n == 3 else (n // 2, n // 2)
            peak = peaks[long_].copy()
            np.maximum(peak[long_:], peaks[short][:-long_], out=peak[long_:])
            peaks[n] = peak
        cost_at[:, i] = n * peaks[n]
        cost_at[n - 1 :, i] -= sums[n:] - sums[:-n]
    base = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1] + 1, out=base[1:])
    best = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    chosen = np.zeros(len(best), np.int8)
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    for j in range(1, int(sizes[0]) + 1):
        a = alive[j - 1]
        at = base[:a] + j
        usable = int(np.searchsorted(steps, j, side="right"))
        totals = best[at[:, None] - steps[:usable]] + cost_at[starts[:a] + (j - 1), :usable]
        pick = totals.argmin(axis=1)
        chosen[at] = pick
        best[at] = totals[np.arange(a), pick] + block[:a]
    ends, at, live = [], sizes.copy(), np.arange(len(sizes))
    while len(live):
        ends.append(starts[live] + at[live])
        at[live] -= steps[chosen[base[live] + at[live]]]
        live = live[at[live] > 0]
    return np.sort(np.concatenate(ends))


class Shard:
    """Posting lists of some documents in blocks: `best(item, ...)` merges the shard's documents into an item's best."""

    def __init__(self, doc_ids: np.ndarray, norms: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, cost: float = BLOCK_COST):
        """doc: places in doc_ids, ascending; norms: the m of each document."""
        self.doc_ids = doc_ids
        order = np.argsort(term, kind="stable")
        self.doc, term, tf = doc[order], term[order], tf[order]
        self.part = (1_000_000_000 * tf) // (1000 * tf + 20 * norms[self.doc])
        self.terms, first = np.unique(term, return_index=True)
        ends = block_ends(self.part, np.append(first, len(term)), cost)
        self.start = np.append(0, ends[:-1]).astype(np.int64) if len(ends) else ends
        self.end = ends
        self.low, self.high = self.doc[self.start], self.doc[self.end - 1]
        self.peak = np.maximum.reduceat(self.part, self.start) if len(ends) else ends
        self.first_block = np.searchsorted(self.start, np.append(first, len(term)))
        self.read = 0

    def _blocks(self, asked: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of the asked terms, and the weight of each."""
        at = np.searchsorted(self.terms, asked)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == asked[here]
        at, w = at[here], weights[here]
        lo, n = self.first_block[at], self.first_block[at + 1] - self.first_block[at]
        return _ranges(lo, n), np.repeat(w, n)

    def _scores(self, blocks: np.ndarray, w: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of the wanted documents; blocks without one are not read."""
        before = np.append(0, np.cumsum(wanted))
        hit = before[self.high[blocks] + 1] > before[self.low[blocks]]
        start, n = self.start[blocks[hit]], self.end[blocks[hit]] - self.start[blocks[hit]]
        at = _ranges(start, n)
        self.read += len(at)
        doc, add = self.doc[at], self.part[at] * np.repeat(w[hit], n)
        keep = wanted[doc]
        out = np.zeros(len(wanted), np.int64)
        if len(blocks) * 4e10 < 2**53:  # sums of doubles are exact
            out += np.bincount(doc[keep], add[keep].astype(np.float64), len(wanted)).astype(np.int64)
        else:
            np.add.at(out, doc[keep], add[keep])
        return out

    def best(self, asked: np.ndarray, weights: np.ndarray, k: int, have: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """have, the best (scores, doc_ids) so far, with this shard's documents merged in."""
        blocks, w = self._blocks(asked, weights)
        if not len(blocks):
            return have
        n = len(self.doc_ids)
        change = np.zeros(n + 1, np.int64)
        peak = self.peak[blocks] * w
        np.add.at(change, self.low[blocks], peak)
        np.subtract.at(change, self.high[blocks] + 1, peak)
        bound = np.cumsum(change[:n])
        reached = lambda: max(1, int(have[0][-1]) if len(have[0]) >= k else 1)
        left = np.flatnonzero(bound >= reached())
        left = left[np.argsort(-bound[left], kind="stable")]
        round_ = 4 * k
        while len(left):
            now, left = left[:round_], left[round_:]
            wanted = np.zeros(n, bool)
            wanted[now] = True
            scores = self._scores(blocks, w, wanted)[now]
            good = scores >= reached()
            have = merged(np.append(have[0], scores[good]), np.append(have[1], self.doc_ids[now[good]]), k)
            left = left[bound[left] >= reached()]
            round_ *= 16
        return have


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ... of n[i] each."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(start - (ends - n), n)


def merged(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by falling score, then rising id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


# --- on Spark -----------------------------------------------------------------------------------


def _texts(column: pa.Array):
    for x in column:
        yield (x.as_py() or "").encode()


def item_terms(items: DataFrame) -> DataFrame:
    """items(item_id, text) to the distinct (item_id, term)."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.string())])

    @lean
    def split(batches):
        for b in batches:
            ids, found = [], []
            for item, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                for t in set(terms(text)):
                    ids.append(item)
                    found.append(t.decode())
            yield batch(schema, ids, found)

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(split, "item_id long, term string").distinct()


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n, ids, tfs): the number of terms, and the asked ones with their occurrences."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    asked = vocabulary.keys()

    @lean
    def count(batches):
        for b in batches:
            n, ids, tfs = [], [], []
            for text in _texts(b.column(1)):
                every = terms(text)
                found = Counter(every)
                here = sorted(vocabulary[t] for t in found.keys() & asked)
                n.append(len(every))
                ids.append(here)
                by_id = {vocabulary[t]: c for t, c in found.items() if t in asked}
                tfs.append([by_id[i] for i in here])
            yield batch(schema, b.column(0), n, ids, tfs)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<int>")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _searched(rows: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, n_docs: int, n_terms: int, shard_postings: int, shard_docs: int) -> DataFrame:
    """The k best documents (item_id, doc_id, score) of each item among the rows of each task."""
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    @lean
    def search(batches):
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        best = dict.fromkeys(asked, none)
        held: list[tuple] = []

        def finish():
            doc_ids, n, lens, ids, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            shard = Shard(doc_ids, 50 + (50 * n * n_docs) // n_terms, np.repeat(np.arange(len(n)), lens), ids, tfs)
            for item, (terms_, weights) in asked.items():
                best[item] = shard.best(terms_, weights, k, best[item])

        for b in batches:
            ids, tfs = b.column(2), b.column(3)
            lens = np.diff(ids.offsets.to_numpy())
            flat, tf = ids.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
            doc_ids, n, first = b.column(0).to_numpy(), b.column(1).to_numpy(), np.append(0, np.cumsum(lens))
            i = 0
            while i < len(n):
                room = shard_postings - sum(len(x[3]) for x in held)
                j = min(int(np.searchsorted(first, first[i] + room, side="right")) - 1, i + shard_docs - sum(len(x[0]) for x in held))
                if j <= i and held:
                    finish()
                    continue
                j = max(j, i + 1)  # one document of more postings is a shard of its own
                held.append((doc_ids[i:j], n[i:j], lens[i:j], flat[first[i] : first[j]], tf[first[i] : first[j]]))
                i = j
        if held:
            finish()
        ids = np.repeat(np.array(list(best), np.int64), [len(s) for s, _ in best.values()])
        yield batch(schema, ids, np.concatenate([d for _, d in best.values()]), np.concatenate([s for s, _ in best.values()]))

    return rows.select("doc_id", "n", "ids", "tfs").mapInArrow(search, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_block: int = ITEM_TERMS, shard_postings: int = SHARD_POSTINGS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The k best of docs(doc_id, text) for each of items(item_id, text): (item_id, rank, doc_id, score), equal scores by doc_id."""
    if k <= 0:
        raise ValueError("k must be positive")
    spark = docs.sparkSession
    every = stored(item_terms(items))
    blocks = max(1, -(-every.count() // item_block))
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for i in range(blocks):
        # One block of items: bounded by item_block terms (or one item).
        block = every.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i) if blocks > 1 else every
        by_item: dict[int, list[bytes]] = {}
        for item, term in block.toLocalIterator():
            by_item.setdefault(item, []).append(term.encode())
        vocabulary = {t: j for j, t in enumerate(sorted({t for x in by_item.values() for t in x}))}
        if not vocabulary:
            continue
        rows = stored(counted(docs, vocabulary).where("n > 0"))
        n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = dict(tuple(r) for r in rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).toLocalIterator())
        asked = {}
        for item, named in by_item.items():
            known = sorted(vocabulary[t] for t in named if vocabulary[t] in df)
            asked[item] = (np.array(known, np.int64), np.array([weight(n_docs, df[j]) for j in known], np.int64))
        best = _searched(rows.where(F.size("ids") > 0), asked, k, n_docs, n_terms, shard_postings, shard_docs)
        found = found.unionByName(best)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


# --- the registered query -----------------------------------------------------------------------


def op12_ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

QUERIES = {"op12_ranked_search": op12_ranked_search}
SQL = {
    "op12_ranked_search": f"""
WITH words AS MATERIALIZED (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents WHERE doc_id IS NOT NULL),
tf AS MATERIALIZED (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY ALL),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM len),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark WHERE item_id IS NOT NULL)),
w AS (SELECT item_id, term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), whole),
m AS (SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM len, whole),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM w JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
}
