"""Operator 1: n-gram Jaccard join as a metric-space join with pivots, exact.

A set links only with sets that hold at least `percent` of its shingles, so first each set learns which of its
shingles stand in other sets at all, and how often: shingles are counted by shares of their hashes, and the answers
go back to the sets. A set with too few such shingles (its support) is at more than a link's radius from every other
one and is done. The others are ordered from their rarest shingle to the commonest.

- Regions: each set lies in the regions of its rarest shingles, as many as a linked set could lack and one more; so
  linked sets meet in a region. What stands after a shingle in the order bounds the shingles that both can hold.
- Pivots: in each region the best supported set. Every member that the bound allows gets its distance to the pivot;
  within the radius it is in the pivot's Voronoi cell, and cells that share a set grow together as components.
- Recursion: the members outside of their pivot's component choose pivots of their own among them.
- Windows: members of different components that are left join inside their region and in windows of size (the
  distance to the empty set, by the triangle inequality), where boundary sets are replicated to all windows that they
  reach, and only if their distances to the region's pivot differ by the radius at most.

Every set also has a parity bitmap (for each of at least n values of a hash, whether its shingles there are odd in
number), a point of another metric space: the bits in which two bitmaps differ are fewer than the shingles that only
one of the sets holds, so they bound the Jaccard distance from below. Pairs that the bound parts are never verified;
an eighth of a byte for each shingle moves for them in place of eight. What the bound says of a pivot's distance
serves the windows as well.

Texts with equal sets collapse into one class first. Pairs within one component are never verified.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, lean, maybe_broadcast, slices, stored, table, window_hashes
from .components import components

#: Rounds with new pivots before the pairs that are left are joined in windows.
ROUNDS = 2
#: Shingles that a task sends at once, and shingles in a share, about.
HELD = 1 << 20
SHARE = 1 << 19
#: Sets of one task's block that hold a shingle from which it counts as common, and is no longer sent for each set.
COMMON = 8
#: Sets with the most copies, of which one copy only is sent: so many at most, of so many copies at least.
COPIED, COPIES = 1_000_000, 64
#: Width of the windows of size.
STEP = 1.02
#: Pairs of one pivot that are verified by one task at most, about; a pivot with more has its set replicated.
SPLIT = 1024


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text: runs of k words (A-Z lower-cased), or all words if fewer."""
    for _, _, data, offsets in slices(column):
        w = Words(data, offsets, lower=True)
        h = w.hashes()
        grams = window_hashes(h, k)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield window_hashes(h[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def _key(u: np.ndarray) -> int:
    """The 64-bit name of a set, as a signed number."""
    return xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63)


def _share(h: np.ndarray, shares: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.uint16)


def _cut(a: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of a[edges[i]:edges[i + 1]] for each i."""
    offsets = (edges * a.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(a).tobytes())])


def _joined(column: pa.Array, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind)] + [np.frombuffer(x, kind) for x in column.to_pylist() if x])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before in some column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


#: Messages: the sets and shingles of a share. kind 0: shingles to be counted, 1: shingles that are common (no sets),
#: 2: shingles of sets that are common, dealt by set. counts: shingles of each set.
_ASK = "share int, kind int, xs binary, counts binary, vs binary"
#: Messages by the sets' shares: pairs of set and shingle, with the level of the shingle's frequency; or sets and sizes.
_TELL = "share int, xs binary, vs binary, levels binary, ns binary"


def _ask(block: list[tuple[int, np.ndarray]], shares: int, common: int):
    """The messages of a block of different sets (key, sorted shingles)."""
    xs = np.array([x for x, _ in block], np.int64)
    v = np.concatenate([u for _, u in block])
    x = np.repeat(np.arange(len(block)), [len(u) for _, u in block])
    s = np.sort(v)
    first = _starts(s)
    often = s[first][np.diff(np.append(first, len(s))) >= common]
    is_common = np.isin(v, often)
    for kind, vs, owner, share in ((0, v[~is_common], x[~is_common], None), (1, often, None, None), (2, v[is_common], x[is_common], xs)):
        if not len(vs):
            continue
        share = _share(vs, shares) if share is None else _share(share[owner] + np.int64(-(1 << 63)), shares)
        order = np.argsort(share, kind="stable")
        vs, share = vs[order], share[order]
        at = _starts(share)
        edges = np.append(at, len(vs))
        none = np.zeros(len(edges), np.int64)
        if owner is None:
            owners, counts, cut = np.zeros(0, np.int64), np.zeros(0, np.uint32), none
        else:
            owner = owner[order]
            begin = _starts(share, owner)
            owners, counts, cut = xs[owner[begin]], np.diff(np.append(begin, len(vs))).astype(np.uint32), np.searchsorted(begin, edges)
        yield pa.RecordBatch.from_arrays([pa.array(share[at], pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), _cut(owners, cut), _cut(counts, cut), _cut(vs, edges)], ["share", "kind", "xs", "counts", "vs"])


def _tell(x: np.ndarray, v: np.ndarray, level: np.ndarray, shares: int):
    share = _share(x + np.int64(-(1 << 63)), shares)
    order = np.argsort(share, kind="stable")
    at = _starts(share[order])
    edges = np.append(at, len(x))
    return pa.RecordBatch.from_arrays([pa.array(share[order][at], pa.int32()), _cut(x[order], edges), _cut(v[order], edges), _cut(level[order], edges), pa.nulls(len(at), pa.binary())], ["share", "xs", "vs", "levels", "ns"])


def _answers(batches, shares: int):
    """Of shares of shingles, the pairs of set and shingle whose shingle stands in several sets. What came for a share is held as it came, and unpacked share by share."""
    held: dict[int, list] = {}
    for b in batches:
        for share, *message in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            held.setdefault(share, []).append(message)
    while held:
        _, messages = held.popitem()
        marks = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(vs, np.uint64) for kind, _, _, vs in messages if kind == 1]))
        for passed in (False, True):
            found = [m for m in messages if m[0] == (2 if passed else 0)]
            if not found:
                continue
            v = np.concatenate([np.frombuffer(vs, np.uint64) for _, _, _, vs in found])
            x = np.concatenate([np.repeat(np.frombuffer(xs, np.int64), np.frombuffer(counts, np.uint32)) for _, xs, counts, _ in found])
            if not passed:
                order = np.argsort(v)
                x, v = x[order], v[order]
                twice = np.isin(v, marks)
                twice[1:] |= v[1:] == v[:-1]
                twice[:-1] |= v[1:] == v[:-1]
                x, v = x[twice], v[twice]
            order = np.lexsort((x, v))
            x, v = x[order], v[order]
            one = _starts(v, x)  # a set that several tasks sent counts once
            x, v = x[one], v[one]
            if passed:
                level = np.full(len(v), 255, np.uint8)
            else:
                first = _starts(v)
                sets = np.diff(np.append(first, len(v)))
                level = np.where(np.isin(v[first], marks), 255, np.minimum(254, 8 * np.log2(np.maximum(sets, 1)))).astype(np.uint8)
                several = np.repeat((sets > 1) | (level == 255), sets)
                x, v, level = x[several], v[several], np.repeat(level, sets)[several]
            for i in range(0, len(x), 1 << 20):
                yield _tell(x[i : i + (1 << 20)], v[i : i + (1 << 20)], level[i : i + (1 << 20)], shares)


def _parities(u: np.ndarray, n: int) -> np.ndarray:
    """Whether the shingles u with each value of a hash are odd in number, as the bits of 64-bit words: n bits at least, a power of two."""
    bits = 64
    while bits < n:
        bits *= 2
    odd = (np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def differing_bits(a, b):
    """In how many bits two columns of parity bitmaps differ, the longer one folded to the length of the other (parities add)."""
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    pieces = F.transform(F.sequence(F.lit(0), (F.size(long_) / F.size(short)).cast("int") - 1), lambda i: F.slice(long_, i * F.size(short) + 1, F.size(short)))
    folded = F.aggregate(pieces, short, lambda acc, piece: F.zip_with(acc, piece, lambda p, q: p.bitwiseXOR(q)))
    return F.aggregate(folded, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def _supported(batches, percent: int):
    """Of shares of sets, those with enough shingles that stand in other sets: these in order, the rarest first, and their parities."""
    parts = {"xs": (1, np.int64), "vs": (2, np.uint64), "levels": (3, np.uint8), "ns": (4, np.int64)}
    got = {name: [np.zeros(0, kind)] for name, (_, kind) in parts.items()}
    sized = [np.zeros(0, np.int64)]
    for b in batches:
        with_sizes = b.column(4).is_valid().to_numpy(zero_copy_only=False)
        for rows, names in ((b.filter(pa.array(~with_sizes)), ("xs", "vs", "levels")), (b.filter(pa.array(with_sizes)), ("ns",))):
            for name in names:
                got[name].append(_joined(rows.column(parts[name][0]), parts[name][1]))
            if names == ("ns",):
                sized.append(_joined(rows.column(1), np.int64))
    x, v, level = (np.concatenate(got[name]) for name in ("xs", "vs", "levels"))
    names, ns = np.concatenate(sized), np.concatenate(got["ns"])
    by = np.argsort(names)
    names, ns = names[by], ns[by]
    order = np.lexsort((v, level, x))
    x, v = x[order], v[order]
    one = _starts(x, v) if len(x) else np.zeros(0, np.int64)
    x, v = x[one], v[one]
    first = _starts(x) if len(x) else np.zeros(0, np.int64)
    ends = np.append(first, len(x))
    n = ns[np.searchsorted(names, x[first])]
    good = np.flatnonzero(100 * np.diff(ends) >= percent * n)
    for i in range(0, len(good), 256):
        some = good[i : i + 256]
        lists = [v[ends[j] : ends[j + 1]].view(np.int64) for j in some]
        offsets = np.concatenate([[0], np.cumsum([len(u) for u in lists])]).astype(np.int32)
        bits = [_parities(u.view(np.uint64), int(n[j])) for j, u in zip(some, lists, strict=True)]
        cuts = np.concatenate([[0], np.cumsum([len(w) for w in bits])]).astype(np.int32)
        held = lambda at, values: pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values)))
        yield pa.RecordBatch.from_arrays([pa.array(x[first[some]]), pa.array(n[some]), pa.array(np.diff(offsets).astype(np.int64)), held(cuts, bits), held(offsets, lists)], ["x", "n", "f", "bits", "u"])


def supported_sets(docs: DataFrame, rows: DataFrame, k: int, percent: int, held: int = HELD, common: int = COMMON) -> DataFrame:
    """The sets of docs(doc_id, text) that may link, stored: x, n (size), u (shingles that stand in other sets, the rarest first), f (their number), bits (their parities).

    rows(doc_id, x, n) are the sets' keys and sizes. Shingles go to shares of their hashes, are counted there by
    different sets, and return to shares of the sets; nothing is broadcast but the sets with very many copies, of
    which only the copy with the smallest doc_id sends its shingles. A shingle that is common within a task isn't
    counted set by set: one mark from each task makes it common for all.
    """
    total = rows.agg(F.count("x").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    shares = int(min(20_000, max(8, total["shingles"] // SHARE)))
    copied = rows.where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("least"))
    copied = copied.where((F.col("c") > max(COPIES, total["n"] // COPIED)) & F.col("least").isNotNull()).select("x", "least").collect()
    copied = docs.sparkSession.sparkContext.broadcast({r["x"]: r["least"] for r in copied})

    def ask(batches):
        block, keys, n = [], set(), 0
        for b in batches:
            for doc_id, u in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), k), strict=True):
                x = _key(u) if len(u) else None
                if x is None or x in keys or copied.value.get(x, doc_id) != doc_id:
                    continue
                keys.add(x)
                block.append((x, u))
                n += len(u)
                if n >= held:
                    yield from _ask(block, shares, common)
                    block, keys, n = [], set(), 0
        if block:
            yield from _ask(block, shares, common)

    def sizes(batches):
        for b in batches:
            x, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            share = _share(x + np.int64(-(1 << 63)), shares)
            order = np.argsort(share, kind="stable")
            at = _starts(share[order]) if len(x) else np.zeros(0, np.int64)
            edges, none = np.append(at, len(x)), pa.nulls(len(at), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(share[order][at], pa.int32()), _cut(x[order], edges), none, none, _cut(n[order], edges)], ["share", "xs", "vs", "levels", "ns"])

    told = docs.mapInArrow(lean(ask), _ASK).repartition(shares, "share").mapInArrow(lean(lambda b: _answers(b, shares)), _TELL)
    known = rows.where("x is not null").select("x", "n").distinct().mapInArrow(lean(sizes), _TELL)
    return stored(told.unionByName(known).repartition(shares, "share").mapInArrow(lean(lambda b: _supported(b, percent)), "x long, n long, f long, bits array<long>, u array<long>"))


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, rounds: int = ROUNDS, **options) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, _key (xxhash64 of its text), n_shingles, component_id, n_same, n_links.

    Two rows link when 100 * (shingles in both) >= percent * (shingles in either); component_id is the smallest
    doc_id reachable. n_same is the number of rows with the same set (itself included); n_links counts the links of
    that set to other sets that were verified (pairs already in one component are not, so it is a lower bound).

    Texts that are null, empty or without words have an empty set, link with nothing and are their own component
    (component_id = doc_id, null if that is null). Null ids never name a component of rows with ids. Repeated rows
    are copies of one set. An empty table gives no rows. Extra columns are ignored. Shingles and sets are told apart
    by 64-bit hashes. A text is read whole by one task, whatever its length.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be within 1 and 100")
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_key"))
    radius = 1 - percent / 100

    def scan(batches):
        for b in batches:
            sets = [(_key(u) if len(u) else None, len(u)) for u in shingle_sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x for x, _ in sets], pa.int64()), pa.array([n for _, n in sets], pa.int64())], ["doc_id", "_key", "x", "n"])

    rows = stored(docs.mapInArrow(lean(scan), f"doc_id {kind}, _key long, x long, n long"))
    sets = supported_sets(docs.select("doc_id", "text"), rows, k, percent, **options)
    # Of n shingles, all but those that a linked set must share may be missing in it; the first one more are in its regions.
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    members = sets.select("x", "n", F.size("u").alias("_f"), F.posexplode(F.slice("u", F.lit(1), F.size("u") - least + 1)).alias("_p", "s"))
    members = stored(members.select("s", "x", "n", (F.col("_f") - F.col("_p")).cast("long").alias("rest"), (F.col("_f") / F.col("n")).alias("support")))

    def may_link(rest_a, n_a, rest_b, n_b):
        """Whether sets may share enough, if they share nothing before a shingle after which so many are left."""
        return F.least(rest_a, rest_b) * F.lit(100 + percent) >= F.lit(percent) * (n_a + n_b)

    def verified(pairs: DataFrame, last: bool) -> DataFrame:
        """pairs(p, x) with bounds lo and hi of their distance and whether they link. Sets are read and moved only for the pairs that their parities don't part; in the last join the others needn't be kept."""
        marks = sets.select("x", "n", "f", "bits")
        of = lambda name: marks.select(F.col("x").alias(name), *[F.col(c).alias(f"_{name}{c}") for c in ("n", "f", "bits")])
        both = pairs.join(of("p"), "p").join(of("x"), "x")
        total = F.col("_pn") + F.col("_xn")
        # Shingles of one set only: those of it that stand in no other set, and of the others as many as the parities differ in, at least.
        alone = total - F.col("_pf") - F.col("_xf") + differing_bits(F.col("_pbits"), F.col("_xbits"))
        near = F.lit(100 + percent) * alone <= F.lit(100 - percent) * total
        pairs = both.select("p", "x", (2 * alone / (total + alone)).alias("lo"), near.alias("near"))
        pairs = stored(pairs.where("near") if last else pairs)
        far = pairs.where("not near").select("p", "x", "lo", F.lit(1.0).alias("hi"), F.lit(False).alias("link"))
        pairs = pairs.where("near").select("p", "x")
        ends = stored(pairs.select(F.explode(F.array("p", "x")).alias("x")).distinct())
        found = sets.join(maybe_broadcast(ends, ends.count()), "x", "left_semi").select("x", "n", "u")
        # A pivot with many pairs is dealt to several tasks, each of which gets its set.
        busy = stored(pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("_parts")).where("_parts > 1"))
        busy = maybe_broadcast(busy, busy.count())
        dealt = pairs.join(busy, "p", "left").withColumn("_part", F.pmod(F.xxhash64("x"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        first = found.select(F.col("x").alias("p"), F.col("u").alias("_pu"), F.col("n").alias("_pn")).join(busy, "p", "left")
        first = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        both = dealt.join(first, ["p", "_part"]).join(found.select("x", F.col("u").alias("_xu"), F.col("n").alias("_xn")), "x")
        both = both.withColumn("_i", F.size(F.array_intersect("_pu", "_xu")).cast("long"))
        union = F.col("_pn") + F.col("_xn") - F.col("_i")
        d = 1 - F.col("_i") / union
        out = stored(both.select("p", "x", d.alias("lo"), d.alias("hi"), (F.lit(100) * F.col("_i") >= F.lit(percent) * union).alias("link")))
        discard(ends)
        return out.unionByName(far)

    known = found = pivots = None

    def with_components(now: DataFrame) -> DataFrame:
        if found is None:
            return now.withColumn("comp", F.col("x"))
        return now.join(found, "x", "left").withColumn("comp", F.coalesce("comp", "x"))

    def learn(pairs: DataFrame, last: bool = False) -> bool:
        """Verify pairs(p, x) that are not known yet; whether new links were found."""
        nonlocal known, found
        pairs = pairs.distinct()
        if known is not None:
            pairs = pairs.join(known.select("p", "x").unionByName(known.select(F.col("x").alias("p"), F.col("p").alias("x"))), ["p", "x"], "left_anti")
        new = verified(pairs, last)
        known = new if known is None else known.unionByName(new)
        some = not new.where("link").isEmpty()
        if some or found is None:
            found = components(known.where("link").select(F.col("p").alias("u"), F.col("x").alias("v")))
        return some

    open_ = members
    for _ in range(rounds):
        placed = with_components(open_)
        best = F.max(F.struct("support", "x", "n", "rest", "comp")).alias("_b")
        best = placed.groupBy("s").agg(best, F.min("comp").alias("_l"), F.max("comp").alias("_h")).where(F.col("_l") != F.col("_h"))
        best = stored(best.select("s", F.col("_b.x").alias("p"), F.col("_b.n").alias("_pn"), F.col("_b.rest").alias("_pr"), F.col("_b.comp").alias("_pc")))
        if best.isEmpty():
            break
        pivots = best if pivots is None else pivots
        reach = (F.col("comp") != F.col("_pc")) & may_link(F.col("rest"), F.col("n"), F.col("_pr"), F.col("_pn"))
        some = learn(placed.join(best, "s").where(reach).select("p", "x"))
        # The next pivots come from the members that lie outside of this one's component.
        outside = with_components(open_).join(best.join(found.select(F.col("x").alias("p"), F.col("comp").alias("_c")), "p", "left").select("s", F.coalesce("_c", "p").alias("_c")), "s")
        open_ = stored(outside.where(F.col("comp") != F.col("_c")).select(*members.columns))
        if not some:
            break

    # What is left: members of different components in one region.
    left = with_components(members)
    several = left.groupBy("s").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h")).where(F.col("_l") != F.col("_h")).select("s")
    left = left.join(several, "s", "left_semi")
    if pivots is None:
        left = left.withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(1.0))
    else:
        # From lo to hi of the region's first pivot: at the distance if it is known, beyond the parities' bound, or anywhere.
        left = left.join(pivots.select("s", "p"), "s").join(known.select("p", "x", "lo", "hi"), ["p", "x"], "left")
        at = lambda bound, default: F.when(F.col("p") == F.col("x"), F.lit(0.0)).otherwise(F.coalesce(bound, F.lit(default)))
        left = left.withColumn("lo", at("lo", 0.0)).withColumn("hi", at("hi", 1.0))
    left = stored(left.select("s", "x", "n", "rest", "comp", "lo", "hi"))
    window = lambda n: F.floor(F.log(n) / F.lit(math.log(STEP))).cast("int")
    # A set meets the smaller ones (or as large ones) that its bound allows.
    from_, to = F.ceil(F.col("n") * percent / 100), F.least(F.col("n"), F.floor(F.col("rest") * (100 + percent) / percent) - F.col("n"))
    large = left.withColumn("_from", from_).withColumn("_to", to).where("_from <= _to")
    large = large.select("s", F.explode(F.sequence(window(F.col("_from")), window(F.col("_to")))).alias("w"), *[F.col(c).alias(f"b_{c}") for c in ("x", "n", "rest", "comp", "lo", "hi")])
    small = left.select("s", window(F.col("n")).alias("w"), *[F.col(c).alias(f"a_{c}") for c in ("x", "n", "rest", "comp", "lo", "hi")])
    apart = F.greatest(F.col("a_lo") - F.col("b_hi"), F.col("b_lo") - F.col("a_hi"))
    meet = (F.col("a_comp") != F.col("b_comp")) & (F.struct("a_n", "a_x") < F.struct("b_n", "b_x")) & (apart <= radius + 1e-9)
    meet = meet & may_link(F.col("a_rest"), F.col("a_n"), F.col("b_rest"), F.col("b_n"))
    learn(small.join(large, ["s", "w"]).where(meet).select(F.col("a_x").alias("p"), F.col("b_x").alias("x")), last=True)
    discard(sets, members, left)

    links = known.where("link").select(F.explode(F.array("p", "x")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n_links"))
    classes = rows.where("x is not null").groupBy("x").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same"))
    classes = classes.join(found, "x", "left").join(links, "x", "left").withColumn("comp", F.coalesce("comp", "x"))
    ids = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = classes.join(ids, "comp").select("x", "component_id", "n_same", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rows.where("x is not null").join(classes, "x").select("doc_id", "_key", F.col("n").alias("n_shingles"), "component_id", "n_same", "n_links")
    alone = rows.where("x is null").select("doc_id", "_key", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_same"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, less those whose component has a smaller doc_id.

    Rows that repeat an id within one component are cut to one text, and rows that repeat both to one row; texts
    without words all stay; rows without an id stay if no row with an id is in their component.
    """
    found = stored(jaccard_components(docs, **options).where("n_shingles > 0").select("doc_id", "_key", "component_id"))
    own = found.where(F.col("doc_id") == F.col("component_id"))
    count = own.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("k")).first()
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    if count["n"] != count["k"]:  # only a table with repeated ids pays for the shuffles here
        texts = own.groupBy("doc_id").agg(F.min("_key").alias("_least"))
        gone = gone.unionByName(own.join(texts, "doc_id").where(F.col("_key") != F.col("_least")).drop("_least"))
    gone = stored(gone.select(F.col("doc_id").alias("_gone"), F.col("_key").alias("_gone_key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_gone_key"))
    out = docs.join(maybe_broadcast(gone, gone.count()), same, "left_anti")
    if count["n"] != count["k"]:
        words = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")) != ""
        twice = out.where(F.col("doc_id").isNotNull() & words).withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"]).drop("_text")
        out = twice.unionByName(out.where(~F.coalesce(F.col("doc_id").isNotNull() & words, F.lit(False))))
    return out


def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)"""
}
