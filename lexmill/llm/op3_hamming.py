"""Operator 3: exact top-k search in binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, each indexed by its value. Segments are searched one after the other: first
all with no bit changed, then all with one, and so on. When segments 0 to s were searched with r changed bits and the
others with r - 1, every code within distance r * segments + s was met (pigeonhole), so a query is done as soon as its
kth verified distance is covered by that.

Queries are dealt into blocks and codes into shards; each pair of a block and a shard is searched by one task through
the shard's own index, and the best of all shards are merged.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

BITS = 64
#: Codes in a shard and queries in a block, at most, about; fewer queries where there are tasks to spare.
SHARD, BLOCK, FEW = 200_000, 20_000, 64
#: Probes and candidates that are looked at at once.
HELD = 1 << 20


def sign_codes(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with `code`: bit i is set if element i (missing and null ones count as 0) is above 0. Vectors of more than 64 elements are an error, so none is cut short in silence."""
    bit = lambda i: F.when(F.get(F.col(column), F.lit(i)) > 0, F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("long")
    code = bit(0)
    for i in range(1, BITS):
        code = code.bitwiseOR(bit(i))
    too_long = F.raise_error(F.lit(f"a code has {BITS} bits, but a vector has more elements")).cast("long")
    return vectors.withColumn("code", F.when(F.size(column) > BITS, too_long).otherwise(code))


def cuts(n_codes: int) -> list[tuple[int, int]]:
    """Segments (lowest bit, width) of about log2(n) bits, so that a bucket holds about one code."""
    m = min(16, max(4, round(BITS / math.log2(max(2, n_codes)))))
    edges = [i * BITS // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


@cache
def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.uint64)


class MultiIndex:
    """Codes by the values of their segments: for each segment the codes in order of value, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.segments, self.tables = codes, cuts(len(codes)), []
        for low, width in self.segments:
            value = self.part(codes, low, width)
            starts = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))])
            self.tables.append((np.argsort(value, kind="stable"), starts))

    @staticmethod
    def part(codes: np.ndarray, low: int, width: int) -> np.ndarray:
        return (codes >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)

    def _met(self, queries: np.ndarray, active: np.ndarray, s: int, radius: int):
        """(query number, code number) of the codes that share segment s up to `radius` changed bits and were not met before, in pieces."""
        low, width = self.segments[s]
        masks = _masks(width, radius).astype(np.int64)
        order, starts = self.tables[s]
        for i in range(0, len(active), max(1, HELD // len(masks))):
            some = active[i : i + max(1, HELD // len(masks))]
            value = self.part(queries[some], low, width)[:, None] ^ masks[None, :]
            first, count = starts[value], starts[value + 1] - starts[value]
            done = np.cumsum(count.sum(axis=1))
            begin = 0
            while begin < len(some):  # no more candidates at once than HELD, or those of one query
                end = max(begin + 1, int(np.searchsorted(done, (done[begin - 1] if begin else 0) + HELD, side="right")))
                c, f = count[begin:end].ravel(), first[begin:end].ravel()
                q = np.repeat(np.repeat(some[begin:end], len(masks)), c)
                at = order[np.repeat(f - np.cumsum(c) + c, c) + np.arange(len(q))]
                x = queries[q] ^ self.codes[at]
                new = np.ones(len(q), bool)
                for t, (lo, w) in enumerate(self.segments):
                    if t != s:
                        new &= np.bitwise_count(x >> np.uint64(lo) & np.uint64((1 << w) - 1)) > (radius if t < s else radius - 1)
                yield q[new], at[new], np.bitwise_count(x[new]).astype(np.int64)
                begin = end

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, code number, distance) of each query's k nearest codes; ties go to the smaller code number. own[i] is the code number that query i leaves out, or -1."""
        best = (np.zeros(0, np.int64),) * 3
        bound, seen, active = np.full(len(queries), BITS + 1), np.zeros(len(queries), np.int64), np.arange(len(queries))
        for radius in range(max(w for _, w in self.segments) + 1):
            for s, (_, width) in enumerate(self.segments):
                for q, at, d in self._met(queries, active, s, radius) if radius <= width else ():
                    seen += np.bincount(q, minlength=len(queries))
                    good = (d <= bound[q]) & (at != own[q])
                    q, at, d = (np.concatenate(x) for x in zip(best, (q[good], at[good], d[good]), strict=True))
                    order = np.lexsort((at, d, q))
                    q, at, d = q[order], at[order], d[order]
                    starts = np.searchsorted(q, np.arange(len(queries) + 1))
                    place = np.arange(len(q)) - starts[q]
                    bound[q[place == k - 1]] = d[place == k - 1]
                    best = tuple(x[place < k] for x in (q, at, d))
                covered = len(self.segments) * radius + s
                active = active[(bound[active] > covered) & (seen[active] < len(self.codes))]
                if not len(active):
                    return best
        return best


def hamming_topk(rows: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """For each query(query_id, code) its k nearest rows(id, code) by Hamming distance: query_id, rank, id, distance.

    A row with the query's own id is left out. Ties go to the smaller id. Fewer than k rows give fewer results; rows
    and queries with a null id or code are left out; repeated rows count once for each (id, code), and of ids with
    the same code the k + 1 smallest are indexed, which loses nothing: ties are settled by id. An empty table gives
    no rows. Extra columns are ignored. A task holds one shard of codes and one block of queries, of a bounded size.
    """
    kind = rows.schema["id"].dataType.simpleString()
    query_kind = queries.schema["query_id"].dataType.simpleString()
    by_id = Window.partitionBy("code").orderBy("id")
    kept = rows.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code").distinct().withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    codes = stored(kept.select("id", "code"))
    asked = stored(queries.where(F.col("query_id").isNotNull() & F.col("code").isNotNull()).select("query_id", "code").distinct())
    n_codes, n_queries = codes.count(), asked.count()
    shards = max(1, -(-n_codes // shard))
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n_queries // block), min(-(-tasks // shards), n_queries // FEW))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = codes.select("id", "code", deal("id", shards).alias("shard"), every(blocks).alias("block")).groupBy("shard", "block")
    right = asked.select("query_id", "code", deal("query_id", blocks).alias("block"), every(shards).alias("shard")).groupBy("shard", "block")

    def search(codes_: pa.Table, asked_: pa.Table) -> pa.Table:
        codes_ = codes_.take(pc.sort_indices(codes_.column("id")))
        ids, query_ids = codes_.column("id").combine_chunks(), asked_.column("query_id").combine_chunks()
        word = lambda t: t.column("code").to_numpy().view(np.uint64)
        if not len(ids) or not len(query_ids):
            return pa.table({"query_id": query_ids.slice(0, 0), "id": ids.slice(0, 0), "distance": pa.array([], pa.int64())})
        same = pc.index_in(query_ids, ids) if query_ids.type == ids.type else pa.nulls(len(query_ids), pa.int32())
        own = pc.fill_null(same, -1).to_numpy(zero_copy_only=False)
        q, at, d = MultiIndex(word(codes_)).nearest(word(asked_), own, k)
        return pa.table({"query_id": query_ids.take(pa.array(q)), "id": ids.take(pa.array(at)), "distance": pa.array(d)})

    found = left.cogroup(right).applyInArrow(search, f"query_id {query_kind}, id {kind}, distance long")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


def op3_hamming_topk(spark, sf_dir, k=10, every=20):
    coded = sign_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    queries = coded.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "code")
    return hamming_topk(coded.select(F.col("vec_id").alias("id"), "code"), queries, k).select(F.col("query_id").alias("vec_id"), "rank", F.col("id").alias("neighbor_id"), "distance")


QUERIES = {"op3_hamming_topk": op3_hamming_topk}
SQL = {
    "op3_hamming_topk": """
WITH c AS (SELECT vec_id, CAST(array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code FROM embeddings),
d AS (SELECT q.vec_id, x.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, x.code)) AS BIGINT) AS distance FROM c q JOIN c x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT vec_id, CAST(rank AS BIGINT) AS rank, neighbor_id, distance FROM r WHERE rank <= 10"""
}
