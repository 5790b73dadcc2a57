"""Operator 10: benchmark decontamination by spaced-seed hashing (DataFrame operations only).

A seed is the hash of the words that a fixed mask keeps of a few consecutive words; the words that it ignores may
differ. Masks are chosen to lose no pair: for each length of a run, by trying all places of the words that may differ
(one mask, 1 1 1 0 1, serves all runs of 11 to 20 words at 4 of 5 equal). Where there are too many places to try, or
no spaced mask that loses nothing, the mask is solid: L - r differing words cut a run of L words into L - r + 1 parts,
one of which has r / (L - r + 1) equal words or more, rounded up. Seeds of the benchmark join seeds of the documents;
each hit fixes an alignment of item and document, and the words around it are compared one by one.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, maybe_broadcast, stored, table


#: Places of differing words that are tried to prove a mask, and the longest run (bits of an integer) for which they are.
TRIED, LONGEST = 200_000, 60


def loses_nothing(mask: tuple[int, ...], words: int, differ: int) -> bool:
    """Whether in every run of so many words, of which any `differ` differ, the mask keeps only equal words at some place."""
    left = np.array([sum(1 << i for i in at) for at in combinations(range(words), differ)], np.int64)
    kept = sum(1 << i for i in mask)
    for place in range(words - mask[-1]):
        left = left[left & kept << place != 0]
    return not len(left)


def seed_mask(words: int, share: float, known: tuple[tuple[int, ...], ...] = ()) -> tuple[int, ...]:
    """The places of the words that a seed keeps, so that every run of so many words with at least `share` of them equal has an intact seed: one of the known masks if it will do, else the heaviest and shortest."""
    least = next((n for n in range(1, words) if n >= share * words), words)
    differ = words - least
    solid = -(-least // (differ + 1))
    if differ and words <= LONGEST and comb(words, differ) <= TRIED:
        new = [(0, *inner, span - 1) for weight in (solid + 1, solid) if weight > 1 for span in (weight + 1, weight + 2) if span <= words for inner in combinations(range(1, span - 1), weight - 2)]
        for mask in (*(m for m in known if solid <= len(m) and m[-1] < words), *new):
            if loses_nothing(mask, words, differ):
                return mask
    return tuple(range(solid))


def _words(text):
    return F.regexp_extract_all(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))


def _hashed(words):
    return F.transform(words, lambda x: F.xxhash64(x))


def _seeds(a, masks: list[tuple[int, ...]]):
    """The seeds of an array of word hashes, mask after mask; position p of mask number m is at m * size(a) + p; null where the window is cut."""
    one = lambda m, mask: F.transform(a, lambda x, i: F.when(i + F.lit(mask[-1]) < F.size(a), F.xxhash64(F.lit(m), *[F.get(a, i + F.lit(j)) for j in mask])))
    return F.concat(*[one(m, mask) for m, mask in enumerate(masks)])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 20, share: float = 0.8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Pairs (doc_id, item_id) of docs(doc_id, text) and benchmark(item_id, text) that overlap.

    Words are runs without white space, with A-Z lower-cased. A pair counts if some run of `window` consecutive
    words of the item (all of it, if shorter) lies in the document with at least `share` of its words equal at
    the same places. Columns: doc_id, item_id, n_items (items with these same words; item_id is the smallest),
    doc_start (word where the item's first word would lie, may be negative), n_equal (most equal words in one
    such run), similarity (n_equal over the run's length). A pair has one row, that of its best alignment.

    Every such pair is found, of items of one word as well. Null and empty texts have no pairs. Rows of docs with
    the same doc_id and text give one row; null ids are ids like any other. Extra columns are ignored.
    """
    items = benchmark.select("item_id", _hashed(_words(F.col("text"))).alias("_b")).where(F.size("_b") > 0)
    items = stored(items.groupBy("_b").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items")))
    run = F.least(F.size("_b"), F.lit(window))
    mask_of: dict[int, tuple[int, ...]] = {}
    for words in sorted((r[0] for r in items.select(run).distinct().collect()), reverse=True):
        mask_of[words] = seed_mask(words, share, tuple(dict.fromkeys(mask_of.values())))
    masks = list(dict.fromkeys(mask_of.values())) or [(0,)]
    own = F.lit(-1)
    for words, mask in mask_of.items():
        own = F.when(run == words, masks.index(mask)).otherwise(own)
    seeds = items.select("item_id", F.size("_b").alias("_n"), own.alias("_own"), F.posexplode(_seeds(F.col("_b"), masks)).alias("_p", "_seed"))
    seeds = seeds.where(F.col("_seed").isNotNull() & (F.floor(F.col("_p") / F.col("_n")) == F.col("_own")))
    seeds = stored(seeds.select("item_id", "_seed", F.pmod("_p", "_n").alias("_ip")).distinct())
    n_seeds = seeds.count()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_key"), _hashed(_words(F.col("text"))).alias("_a"))
    hits = keyed.select("doc_id", "_key", F.size("_a").alias("_n"), F.posexplode(_seeds(F.col("_a"), masks)).alias("_p", "_seed")).where(F.col("_seed").isNotNull())
    hits = hits.join(maybe_broadcast(seeds, n_seeds, broadcast_rows), "_seed").select("doc_id", "_key", "item_id", (F.pmod("_p", "_n") - F.col("_ip")).alias("doc_start")).distinct()
    hits = stored(hits.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("item_id", "doc_start")).alias("_hits")))
    n_hits, n_items = hits.count(), items.count()
    # Only documents with a hit are read again; the filter on their keys keeps other texts from moving.
    near = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_k"), F.col("text").alias("_text"))
    near = near.join(maybe_broadcast(hits, n_hits, 200_000), F.expr("_d <=> doc_id and _k = _key")).select("doc_id", "_key", "_hits", _hashed(_words(F.col("_text"))).alias("_a"))
    pairs = near.select("doc_id", "_key", "_a", F.inline("_hits")).join(maybe_broadcast(items.select("item_id", "_b", "n_items"), n_items, 200_000), "item_id")
    equal = F.transform(F.col("_b"), lambda x, j: (F.coalesce(F.when(F.col("doc_start") + j >= 0, F.get(F.col("_a"), F.col("doc_start") + j)) == x, F.lit(False))).cast("int"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_b") - run + 1), lambda s: F.aggregate(F.slice(F.col("_eq"), s, run), F.lit(0), lambda x, y: x + y))
    pairs = pairs.withColumn("_eq", equal).withColumn("n_equal", F.array_max(runs)).withColumn("similarity", F.col("n_equal") / run)
    best = pairs.where(F.col("n_equal") >= F.lit(share) * run).groupBy("doc_id", "_key", "item_id").agg(F.max_by(F.struct("n_items", "doc_start", "n_equal", "similarity"), F.struct("n_equal", -F.col("doc_start"))).alias("_x"))
    return best.select("doc_id", "_key", "item_id", F.col("_x.n_items").alias("n_items"), F.col("_x.doc_start").cast("long").alias("doc_start"), F.col("_x.n_equal").cast("long").alias("n_equal"), F.col("_x.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that overlap no item of the benchmark as `contamination` says."""
    bad = stored(contamination(docs, benchmark, **options).select(F.col("doc_id").alias("_bad_id"), F.col("_key").alias("_bad_key")).distinct())
    return docs.join(maybe_broadcast(bad, bad.count()), F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_key")), "left_anti")


def op10_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
_LIST = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = {
    "op10_benchmark_decontamination": f"""
WITH items AS (SELECT w, min(item_id) AS item_id, count(*) AS n_items FROM (SELECT item_id, {_LIST} AS w FROM benchmark) WHERE len(w) > 0 GROUP BY w),
bw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS ip FROM items),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM (SELECT doc_id, {_LIST} AS w FROM documents)),
places AS (
  SELECT doc_id, item_id, n, p - ip AS doc_start, list(ip) AS ips FROM dw JOIN bw USING (word) GROUP BY doc_id, item_id, n, p - ip HAVING count(*) >= 0.8 * least(20, n)),
runs AS (
  SELECT doc_id, item_id, doc_start, least(20, n) AS run,
    list_max(list_transform(range(0, n - least(20, n) + 1), lambda s: len(list_filter(ips, lambda x: x >= s AND x < s + least(20, n))))) AS n_equal FROM places),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, doc_start) AS r FROM runs WHERE n_equal >= 0.8 * run)
SELECT doc_id, item_id, CAST(n_items AS BIGINT) AS n_items, CAST(doc_start AS BIGINT) AS doc_start, CAST(n_equal AS BIGINT) AS n_equal, n_equal / run AS similarity
FROM best JOIN items USING (item_id) WHERE r = 1"""
}
