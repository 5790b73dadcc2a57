"""Operator 8: mix sources to target weights with hash-threshold histograms (DataFrame operations only).

Each source gets a target number of words. Whole copies come first; what is left of the target is a budget for
one more copy of some documents, those whose hash lies under a threshold. The threshold is found without a sort:
words are summed by source and hash bucket, the bucket in which the running sum passes the budget is the
boundary, and only rows of the boundary bucket are summed again by the next bits of the hash. The rows of the last
boundary bucket, which are one row or repeats of one row, are numbered over all tasks by sums of each task's rows, and
taken while that comes nearer to the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, maybe_broadcast, stored, table

BITS = 12
LEVELS = 3
LIMIT = 1 << (BITS * LEVELS)


def _bucket(level: int):
    return F.shiftrightunsigned("_h", 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """sizes(_source, source_size) with weight and target.

    The targets share `share` of all words by weight; a target stops at cap times its source's size and the
    excess goes to the others by weight until none is above. That is target = min(cap * size, level * weight),
    and level is the largest of (total - caps of a prefix) / (weights of the rest) over prefixes by cap / weight.
    One row per source meets in one task here: a histogram's keys, not the corpus.
    """
    named = Window.orderBy(F.col("_source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("_level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    return s.withColumn("target", F.least("_cap", F.max("_level").over(every) * F.col("_w"))).select("_source", "source_size", F.col("_w").alias("weight"), "target")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, share: float = 1.0, broadcast_rows: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, source, size, source_size, target, copies, taken, and the columns named in carry.

    size counts words (null or empty text: 0, never taken beyond 0 words). A null source is a source of its own,
    last in order. Repeated rows share a hash; where the threshold falls on them, as many of them are taken as come
    nearest to the target. Rows without a doc_id are hashed by their text alone. A source without words has target 0. An empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    limit = {} if broadcast_rows is None else {"limit": broadcast_rows}
    sized = [F.col("doc_id"), F.col("source").alias("_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("_h")]
    base = stored(docs.select(*sized))
    hist = stored(base.groupBy("_source", _bucket(0).alias("_b")).agg(F.sum("size").alias("_n")))
    found = source_targets(hist.groupBy("_source").agg(F.sum("_n").alias("source_size")), weights, cap, share)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(F.lit(0))
    found = stored(found.withColumn("_full", full.cast("long")).withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size")).withColumn("_t", F.lit(0).cast("long")))
    n = found.count()
    for level in range(LEVELS):
        if level:
            inside = base.join(maybe_broadcast(found.select(F.col("_source").alias("_s"), "_t"), n, **limit), F.expr("_source <=> _s") & (F.shiftrightunsigned("_h", 64 - BITS * level) == F.shiftright("_t", BITS * (LEVELS - level))))
            hist = inside.groupBy("_source", _bucket(level).alias("_b")).agg(F.sum("size").alias("_n"))
        up_to = Window.partitionBy("_source").orderBy("_b")
        h = hist.withColumn("_upto", F.sum("_n").over(up_to)).select(F.col("_source").alias("_s"), "_b", "_n", "_upto")
        h = h.join(maybe_broadcast(found.select("_source", "_rest"), n, **limit), F.expr("_source <=> _s")).where(F.col("_upto") > F.col("_rest"))
        edge = h.groupBy("_s").agg(F.min(F.struct("_b", "_upto", "_n")).alias("_e"))
        step = 1 << (BITS * (LEVELS - 1 - level))
        joined = found.join(edge, F.expr("_source <=> _s"), "left")
        before = F.coalesce(F.col("_e._upto") - F.col("_e._n"), F.lit(0))
        rest = F.col("_rest") - before
        bucket = F.coalesce(F.col("_e._b"), F.lit(0))
        found = stored(joined.select("_source", "source_size", "weight", "target", "_full", rest.alias("_rest"), (F.col("_t") + bucket * F.lit(step)).cast("long").alias("_t")))
    rows = docs.select(*sized, F.struct(*carry).alias("_carried")) if carry else base  # what is carried is read again, not stored
    out = rows.join(maybe_broadcast(found.withColumnRenamed("_source", "_s"), n, **limit), F.expr("_source <=> _s"))
    place, edge = F.shiftrightunsigned("_h", 64 - BITS * LEVELS), F.coalesce(F.col("_rest") > 0, F.lit(False))
    at_edge = edge & (place == F.col("_t")) & (F.col("size") > 0)
    rest_ = [F.col(c) for c in ("doc_id", "_source", "size", "source_size", "target", "_full", "_rest")] + ([F.col("_carried")] if carry else [])
    below = out.where(~at_edge).select(*rest_, (place < F.col("_t")).cast("long").alias("_more"))
    tied = stored(out.where(at_edge).select(*rest_, "_h", F.spark_partition_id().alias("_p")))
    # A running sum over all tasks: what the tasks before hold, and a sum within the task's own rows.
    key = [F.col("_source").isNull().alias("_k0"), F.coalesce(F.col("_source").cast("string"), F.lit("")).alias("_k1"), "_p"]
    held = tied.groupBy(*key).agg(F.sum("size").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("_k0", "_k1").orderBy("_p")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("_k0", "_k1", "_p").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("size").over(inside)
    chosen = tied.select("*", *key[:2]).join(held, ["_k0", "_k1", "_p"]).withColumn("_upto", upto).select(*rest_, (2 * F.col("_upto") - F.col("size") <= 2 * F.col("_rest")).cast("long").alias("_more"))
    copies = F.least(F.col("_full") + F.col("_more"), F.lit(int(cap)))
    return below.unionByName(chosen).select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *[F.col("_carried").getField(c).alias(c) for c in carry])


def op8_source_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_source_mixing": op8_source_mixing}
SQL: dict[str, str] = {}
