"""Folds of groups: no group is in two folds, and classes are spread evenly over the folds.

Groups with the same class counts are dealt to the folds in turn, which is exact for whole rounds. What is left of each
kind (fewer groups than folds) is placed one by one where it fits best, on the driver and only up to `limit` rows of
class counts. Beyond that it is dealt in turn again by leading class and size, and then whatever its kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.sources.shared import stored

#: Slices of the hash within which the groups of one kind are numbered.
SLICES = 1024
#: Rows of class counts that the driver places one by one.
LIMIT = 100_000


def _numbered(groups: DataFrame, kind: Column, seed: int) -> DataFrame:
    """groups(group, ..) with _at, the place from 0 among the groups of its kind in an order drawn by seed, and _n, how many these are.

    Most groups may be of one kind: places are counted within slices of a hash, and only the sizes of slices are summed up.
    """
    hashed = F.xxhash64(F.lit(seed), "group")
    groups = groups.withColumn("_kind", kind).withColumn("_hash", hashed).withColumn("_slice", F.pmod("_hash", F.lit(SLICES)))
    sizes = groups.groupBy("_kind", "_slice").agg(F.count(F.lit(1)).alias("_c"))
    of = Window.partitionBy("_kind")
    before = F.sum("_c").over(of.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_kind", "_slice", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(of).alias("_n"))
    own = F.row_number().over(Window.partitionBy("_kind", "_slice").orderBy("_hash", "group"))
    out = groups.withColumn("_own", own).join(sizes, ["_kind", "_slice"])
    return out.withColumn("_at", F.col("_before") + F.col("_own") - 1).drop("_kind", "_hash", "_slice", "_own", "_before")


def placed(rows: list[tuple], parts: int) -> dict:
    """Folds of the groups of rows(group, class, n): large groups first, each where its classes are rarest so far, then in the smallest fold."""
    groups: dict = {}
    totals: dict = {}
    for group, name, n in rows:
        groups.setdefault(group, []).append((name, n))
        totals[name] = totals.get(name, 0) + n
    filled: list[dict] = [{} for _ in range(parts)]
    sizes = [0] * parts
    out = {}
    for group in sorted(groups, key=lambda g: (-sum(n for _, n in groups[g]), g)):
        counts = groups[group]
        best = min(range(parts), key=lambda p: (sum(filled[p].get(c, 0) * n / totals[c] ** 2 for c, n in counts), sizes[p], p))
        for c, n in counts:
            filled[best][c] = filled[best].get(c, 0) + n
            sizes[best] += n
        out[group] = best
    return out


def fold_of_groups(rows: DataFrame, group: str, classes: str, parts: int, seed: int, limit: int = LIMIT) -> DataFrame:
    """(group, fold) for each value of `group` in rows but null; class null is a class of its own.

    For each class, the folds' counts differ by no more than what single groups and the groups left over of each kind
    hold; classes of groups with one row each differ by one at most. The same rows and seed give the same folds.
    """
    counts = rows.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group"), F.col(classes).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "classes")
    left = counts.groupBy("group").agg(F.bit_xor(F.xxhash64("class", "n")).alias("_equal"), F.max(F.struct("n", "class")).alias("_lead"), F.sum("n").alias("_size"))
    near = F.xxhash64("_lead.class", F.floor(F.log2("_size")))
    made = []
    for kind in (F.col("_equal"), near, F.lit(0).cast("long")):
        dealt = stored(_numbered(left, kind, seed), "dealt")
        whole = F.col("_at") < F.col("_n") - F.pmod("_n", F.lit(parts))
        turn = F.pmod("_at", F.lit(parts)).cast("int").alias("fold")
        made.append(dealt.where(whole).select("group", turn))
        rest = dealt.where(~whole)
        wanted = counts.join(rest.select("group"), "group", "left_semi")
        if wanted.limit(limit + 1).count() <= limit:
            found = placed([tuple(r) for r in wanted.collect()], parts)
            made.append(rows.sparkSession.createDataFrame(list(found.items()), f"group {counts.schema['group'].dataType.simpleString()}, fold int"))
            break
        left = rest.drop("_at", "_n")
    else:
        made.append(rest.select("group", turn))
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out.withColumnRenamed("group", group)
