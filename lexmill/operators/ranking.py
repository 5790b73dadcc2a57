"""Top-k with dense padding, pooling of passage scores, rank fusion, blends and dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import few, rounded

#: Best pads that are tried first.
FRONT = 2_000
POOLING = ("max", "top2_sum", "mean_topk", "logsumexp")


def check_depth(k: int) -> int:
    if k <= 0:
        raise ValueError("the depth must be positive")
    return k


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best (qid, rank, doc_id, score) by rounded score, then doc_id; Spark limits groups before and after the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc(rounded(F.col("score"))), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= check_depth(k)).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def dense_topk(scores: DataFrame, questions: DataFrame, pads: DataFrame, k: int, keep=None, found: DataFrame | None = None) -> DataFrame:
    """ranked(), where documents that match nothing take part with their pad score.

    pads(doc_id, pad) has every document's score without a match. Only questions whose kth match isn't above the best
    pad need any. For these the first pads in order, FRONT of them or as many as it takes for each to have k without a
    match, are one list; a question takes its k from it by leaving out those that it matches. keep(df), if given, keeps
    the small tables: the ranking and the matches in the list. The scores themselves are never stored. found, if
    given, is ranked(scores, k), kept already.
    """
    scores = scores.select("qid", "doc_id", "score")
    keep = keep or (lambda df: df)
    found = keep(ranked(scores, k)) if found is None else found
    kth = found.groupBy("qid").agg(F.count(F.lit(1)).alias("_m"), F.min(rounded(F.col("score"))).alias("_kth"))
    best = pads.agg(rounded(F.max("pad"))).first()[0]
    if best is None:  # no documents
        return found
    needy = questions.select("qid").distinct().join(kth, "qid", "left").where(F.col("_m").isNull() | (F.col("_m") < k) | (F.col("_kth") <= F.lit(best))).select("qid")
    needy = keep(needy)
    if needy.isEmpty():
        return found
    entry = F.struct((-rounded(F.col("pad"))).alias("o"), F.col("doc_id").alias("doc_id"), F.col("pad").alias("pad"))
    depth = max(FRONT, 2 * k)
    while True:
        front = keep(pads.orderBy(F.desc(rounded(F.col("pad"))), "doc_id").limit(depth))
        small = F.broadcast if depth <= 10 * FRONT else (lambda df: df)
        # As semi-joins on keys of the scores' groups, both may be tried before the scores are summed.
        hits = scores.join(few(needy), "qid", "left_semi").join(small(front.select("doc_id")), "doc_id", "left_semi").join(small(front), "doc_id")
        hits = keep(hits.groupBy("qid").agg(F.collect_list(entry).alias("_hit")))
        if front.count() < depth or hits.where(F.size("_hit") > depth - k).isEmpty():
            break
        depth *= 4  # some question matches nearly all of the first pads
    whole = front.agg(F.sort_array(F.collect_list(entry)).alias("_all"))  # one row of at most depth entries
    free = F.slice(F.when(F.col("_hit").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_hit")), 1, k)
    extra = needy.join(hits, "qid", "left").crossJoin(F.broadcast(whole)).select("qid", F.inline(free))
    return ranked(found.select("qid", "doc_id", "score").unionByName(extra.select("qid", "doc_id", F.col("pad").alias("score"))), k)


def pooled(best: Column, mode: str, k: int) -> Column:
    """One score from an array of a document's passage scores, best first; -inf if there are none."""
    if mode not in POOLING:
        raise ValueError(f"pooling must be one of {POOLING}")
    top = F.slice(best, 1, 2 if mode == "top2_sum" else check_depth(k))
    total = F.aggregate(top, F.lit(0.0), lambda a, x: a + x)
    high = F.get(best, F.lit(0))
    value = {
        "max": high,
        "top2_sum": total,
        "mean_topk": total / F.size(top),
        "logsumexp": high + F.ln(F.aggregate(F.transform(top, lambda x: F.exp(x - high)), F.lit(0.0), lambda a, x: a + x)),
    }[mode]
    return F.when(F.size(best) > 0, value).otherwise(F.lit(float("-inf")))


def pool(scores: DataFrame, n_chunks: DataFrame, mode: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Passage scores(qid, doc_id, score) to document scores and pads; passages that match nothing count as zeros.

    n_chunks(doc_id, n) has each document's passages. At most k zeros matter beside the matches.
    """
    several, pads = pool_several(scores, n_chunks, (mode,), k)
    return several.select("qid", "doc_id", F.col(mode).alias("score")), pads[mode]


def pool_several(scores: DataFrame, n_chunks: DataFrame, modes: tuple[str, ...], k: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """As pool, for several modes in one pass: document scores (qid, doc_id, a column for each mode), and the pads of each mode."""
    keep = max({"max": 1, "top2_sum": 2}.get(mode, check_depth(k)) for mode in modes)
    if keep == 1:
        top = scores.groupBy("qid", "doc_id").agg(F.array(F.max("score")).alias("_s"), F.count(F.lit(1)).alias("_m"))
    else:
        w = Window.partitionBy("qid", "doc_id").orderBy(F.desc("score"))
        # The best `keep` matches decide all modes; the number of matches says how many zeros stand beside them.
        top = scores.withColumn("_r", F.row_number().over(w)).groupBy("qid", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("_r") <= keep, F.col("score"))), asc=False).alias("_s"), F.count(F.lit(1)).alias("_m"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.least(F.lit(keep), F.greatest(n, F.lit(0))).cast("int"))
    # Hashed, the documents' side is the small one, and the scores need no sort.
    joined = top.join(n_chunks.hint("shuffle_hash"), "doc_id").withColumn("_s", F.sort_array(F.concat("_s", zeros(F.col("n") - F.col("_m"))), asc=False))
    pads = {mode: n_chunks.select("doc_id", pooled(zeros(F.col("n")), mode, k).alias("pad")) for mode in modes}
    return joined.select("qid", "doc_id", *[pooled(F.col("_s"), mode, k).alias(mode) for mode in modes]), pads


def reciprocal_rank_fusion(components: list[DataFrame], k: int, rrf_k: int = 60) -> DataFrame:
    """Rankings(qid, rank, doc_id) of one depth to the k best by the sum of 1 / (rrf_k + rank)."""
    if not components:
        raise ValueError("rank fusion needs at least one component")
    every = components[0].select("qid", "rank", "doc_id")
    for c in components[1:]:
        every = every.unionByName(c.select("qid", "rank", "doc_id"))
    return ranked(every.groupBy("qid", "doc_id").agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("score")), k)


def min_max(score: str) -> Column:
    """The score within its question's range, 1 for all where there is no range; -inf is the minimum."""
    w = Window.partitionBy("qid")
    finite = F.when(F.col(score) > float("-inf"), F.col(score))
    low, high = F.min(finite).over(w), F.max(finite).over(w)
    return F.when(high.isNull() | (high <= low), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (F.col(score) - low) / (high - low)))


def blend(pairs: DataFrame, mode: str = "ce_only", ce_weight: float = 0.7, sparse_weight: float = 0.3, rrf_k: int = 60) -> DataFrame:
    """pairs(qid, doc_id, sparse, ce) to (qid, doc_id, score): the pair score, a linear blend of ranges, or weighted reciprocal ranks."""
    if mode == "ce_only":
        return pairs.select("qid", "doc_id", F.col("ce").alias("score"))
    if mode == "linear":
        return pairs.select("qid", "doc_id", (F.lit(ce_weight) * min_max("ce") + F.lit(sparse_weight) * min_max("sparse")).alias("score"))
    if mode == "rrf":
        place = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(rounded(F.col(c))), "doc_id"))
        return pairs.select("qid", "doc_id", (F.lit(ce_weight) / (F.lit(rrf_k) + place("ce")) + F.lit(sparse_weight) / (F.lit(rrf_k) + place("sparse"))).alias("score"))
    raise ValueError("the blend must be ce_only, linear or rrf")


def deduplicated(predictions: DataFrame, k: int) -> DataFrame:
    """Each question's distinct doc_ids in order of their first rank, the first k, ranked anew."""
    once = predictions.groupBy("qid", "doc_id").agg(F.min("rank").alias("_r"))
    w = Window.partitionBy("qid").orderBy("_r", "doc_id")
    return once.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= check_depth(k)).select("qid", "rank", "doc_id")
