"""Operator 7: substring dedup with a compressed FM-index per shard.

Windows of words are dealt to shards by their minimizer, the smallest hash among their 5-word runs, so windows with
the same words meet; consecutive windows with one minimizer travel as one segment of text. Minimizers that stand in
one document only are left out first (repeats.py), and equal segments are sent on once, with the smallest doc_id. In
each shard an FM-index holds all segments; they are streamed through it by backward search, and where the matching
statistics reach the window's length, the suffix interval gives the smallest document that holds the window.

A minimizer with very many different segments is dealt out by whole windows instead, so no shard outgrows its task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, lean, maybe_broadcast, slices, stored, table, window_hashes, within
from .fm_index import FMIndex, matching_statistics
from .repeats import Suspects, expected_bytes, repeated

#: Words in a run whose hash may be a minimizer.
RUN = 5
#: Most windows in one segment.
LONGEST = 48
#: Segments in a shard, about, and segments of one minimizer from which it is split.
SHARD = 12_000
HOT = 4_000
#: Bytes of removed windows that may be broadcast; beyond it texts are shuffled to them.
BROADCAST_BYTES = 8 << 20


def _minimizers(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a run of texts: minimizer, text number, first word (in the run) and number of windows."""
    none = np.zeros(0, np.int64)
    h = words.hashes()
    n_windows = len(h) - k + 1
    counts = np.diff(words.first)
    if n_windows <= 0 or not (counts >= k).any():
        return np.zeros(0, np.uint64), none, none, none
    run = min(RUN, k)
    grams = window_hashes(h, run)
    low, width, need = grams, 1, k - run + 1
    while width * 2 <= need:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < need:
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
    at = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(counts - k + 1, 0)) - np.maximum(counts - k + 1, 0), np.maximum(counts - k + 1, 0))
    m = low[at]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(m)))
    pieces = (length + LONGEST - 1) // LONGEST
    if (pieces > 1).any():
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, length = np.repeat(begin, pieces) + inner * LONGEST, np.minimum(LONGEST, np.repeat(length, pieces) - inner * LONGEST)
    return m[begin], text[begin], at[begin], length


def _once_per_text(m: np.ndarray, text: np.ndarray) -> np.ndarray:
    order = np.argsort(m, kind="stable")
    m, text = m[order], text[order]
    return m[np.concatenate([[True], (m[1:] != m[:-1]) | (text[1:] != text[:-1])])] if len(m) else m


def repeated_windows(docs: DataFrame, k: int = 13, filter_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """Windows of k words that also start in a row with a smaller doc_id, stored by row: (_r, gone), gone having (start word, bits), where bit i stands for the window at start + i.

    docs has doc_id, text and _row, a key of the two. A null doc_id is larger than all others.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("_row", "doc_id", "text")

    def hashes(b):
        found = [np.zeros(0, np.uint64)]
        for _, _, data, offsets in slices(b.column("text")):
            m, text, _, _ = _minimizers(Words(data, offsets), k)
            found.append(_once_per_text(m, text))
        return np.concatenate(found)

    suspects = Suspects(repeated(docs.select("text"), hashes, expected_bytes(docs) // 32), **({} if filter_bytes is None else {"limit_bytes": filter_bytes}))
    test = suspects.tester()

    def segments(batches):
        for b in batches:
            for first, _, data, offsets in slices(b.column(2)):
                words = Words(data, offsets)
                m, text, at, length = _minimizers(words, k)
                keep = np.flatnonzero(test(m)) if len(m) else []
                if not len(keep):
                    continue
                m, text, at, length = m[keep], text[keep], at[keep], length[keep]
                raw = data.tobytes()
                begin, end = words.start[at].tolist(), words.end[at + length + k - 2].tolist()
                seg = [b" ".join(raw[x:y].split()) for x, y in zip(begin, end, strict=True)]
                rows = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array((at - words.first[text]).astype(np.int32)), pa.array(m.view(np.int64)), pa.array(np.fromiter(map(xxhash.xxh3_64_intdigest, seg), np.uint64, len(seg)).view(np.int64)), pa.array(seg, pa.binary()).cast(pa.string())],
                    ["_row", "doc_id", "start", "m", "k", "seg"],
                )

    schema = f"_row long, doc_id {kind}, start int, m long, k long, seg string"
    cand = stored(suspects.narrow(docs.mapInArrow(lean(segments), schema), "m"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")
    once = stored(cand.groupBy("m", "k").agg(F.min(order).alias("d"), F.max("seg").alias("seg")).select("m", "k", F.col("d.doc_id").alias("d"), "seg"))
    many = stored(once.groupBy("m").count().where(F.col("count") > hot).select("m"))
    n_many = many.count()
    temporary = [cand, once]
    if n_many:  # these minimizers' windows travel alone, dealt out by their words

        def split(batches):
            for b in batches:
                rows, starts, segs = [], [], []
                for i, (start, seg) in enumerate(zip(b.column(2).to_pylist(), b.column(5).to_pylist(), strict=True)):
                    w = seg.encode().split(b" ")
                    for j in range(len(w) - k + 1):
                        rows.append(i)
                        starts.append(start + j)
                        segs.append(b" ".join(w[j : j + k]))
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, segs), np.uint64, len(segs)).view(np.int64)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(starts, pa.int32()), pa.array(h), pa.array(h), pa.array(segs, pa.binary()).cast(pa.string())], ["_row", "doc_id", "start", "m", "k", "seg"])

        heavy = maybe_broadcast(many, n_many)
        alone = stored(cand.join(heavy, "m", "left_semi").select(cand.columns).mapInArrow(lean(split), schema))
        temporary.append(alone)
        cand = cand.join(heavy, "m", "left_anti").select(cand.columns).unionByName(alone)
        single = alone.groupBy("m", "k").agg(F.min(order).alias("d"), F.max("seg").alias("seg")).select("m", "k", F.col("d.doc_id").alias("d"), "seg")
        once = once.join(heavy, "m", "left_anti").select(once.columns).unionByName(single)

    shards = int(max(1, once.count() // SHARD))

    def search(group: pa.Table) -> pa.Table:
        segs = group.column("seg").to_pylist()
        d = group.column("d").to_pylist()
        values = [*sorted({x for x in d if x is not None}), None]
        place = {x: i for i, x in enumerate(values)}
        rank = np.fromiter((place[x] for x in d), np.int64, len(d))
        lengths = np.fromiter((s.count(" ") + 1 for s in segs), np.int64, len(segs))
        ids, _ = pd.factorize(np.array(" ".join(segs).split(" "), object))
        first = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int(lengths.sum()) + len(segs), np.int64)  # 0 stands after each segment
        owner = np.repeat(np.arange(len(segs)), lengths + 1)
        inside = np.ones(len(text), bool)
        inside[first + lengths] = False
        text[inside] = ids + 1
        windows = lengths - k + 1
        which = np.repeat(np.arange(len(segs)), windows)
        begin = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        index = FMIndex(text, k, rank[owner])
        # A match that only the window itself has ends the search; what reaches k words stands elsewhere too.
        length, low, high = matching_statistics(index, text, begin + k - 1, k, own=2)
        least = rank[which]
        twice = np.flatnonzero(length == k)
        if len(twice):
            by_suffix = index.labels
            spots, where = np.unique(low[twice], return_inverse=True)
            ends = np.zeros(len(spots), np.int64)
            ends[where] = high[twice]
            least[twice] = np.minimum.reduceat(np.append(by_suffix, np.int32(len(values))), np.column_stack([spots, ends]).ravel())[::2][where]
        mins = [values[x] for x in least]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(windows)), pa.int32()), pa.array(mins, group.column("d").type))
        return pa.table({"m": group.column("m"), "k": group.column("k"), "mins": lists})

    found = once.withColumn("shard", F.pmod(F.xxhash64("m"), F.lit(shards))).groupBy("shard").applyInArrow(search, f"m long, k long, mins array<{kind}>")
    hit = cand.select("_row", "doc_id", "start", "m", "k").join(found, ["m", "k"])
    smaller = lambda x: F.coalesce(x < F.col("doc_id"), x.isNotNull() & F.col("doc_id").isNull())
    gone = F.aggregate(F.transform("mins", lambda x, i: F.when(smaller(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    hit = hit.select(F.col("_row").alias("_r"), "start", gone.alias("gone")).where(F.col("gone") != 0)
    out = stored(hit.groupBy("_r").agg(F.collect_set(F.struct("start", "gone")).alias("gone")))
    discard(*temporary, many, suspects.found)
    return out


def remove_repeated_windows(docs: DataFrame, k: int = 13, broadcast_bytes: int = BROADCAST_BYTES, key_rows: int = 500_000, **options) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text (kept words joined by one blank), n_words, n_removed, spans.

    A word goes if a window of k words over it also starts in a row with a smaller doc_id, as the texts are before
    anything is removed. spans lists the removed runs of words as (start, end), end exclusive. Null and empty
    texts, and texts shorter than k words, lose nothing. A null doc_id is larger than any other; rows with one
    doc_id never remove from each other. An empty table gives no rows. Extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    hits = repeated_windows(docs, k, **options)
    rows, keys = within(hits, 64 + 48 * F.size("gone"), broadcast_bytes), hits.select("_r")
    n_keys = hits.count()
    if n_keys <= key_rows:  # only texts that lose something move to their windows
        keys, same = F.broadcast(keys), F.col("_row") == F.col("_r")
        untouched = docs.join(keys, same, "left_anti").select("doc_id", "text", F.lit(None).cast(hits.schema["gone"].dataType).alias("gone"))
        joined = docs.join(keys, same, "left_semi").join(rows, same).select("doc_id", "text", "gone").unionByName(untouched)
    else:
        joined = docs.join(rows, F.col("_row") == F.col("_r"), "left").select("doc_id", "text", "gone")

    def cut(batches):
        for b in batches:
            out = []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                if not gone:
                    out.append((b" ".join(words), len(words), 0, []))
                    continue
                away = np.zeros(len(words) + 1, np.int8)
                for g in gone:
                    bits, at = g["gone"] & (2**64 - 1), g["start"]
                    while bits:
                        low = (bits & -bits).bit_length() - 1
                        away[at + low : at + low + k] = 1
                        bits &= bits - 1
                edges = np.flatnonzero(np.diff(np.concatenate([[0], away])))
                left = [w for w, x in zip(words, away[:-1].tolist(), strict=True) if not x]
                out.append((b" ".join(left), len(words), len(words) - len(left), [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)]))
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.binary()).cast(pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], spans)], ["doc_id", "text", "n_words", "n_removed", "spans"])

    return joined.mapInArrow(lean(cut), f"doc_id {kind}, text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>")


def op7_substring_dedup(spark, sf_dir):
    return remove_repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
SQL = {
    "op7_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
firsts AS (SELECT win, min(doc_id) AS d FROM wins GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT wins.doc_id, i FROM wins JOIN firsts USING (win) WHERE d < wins.doc_id), range(13) AS t(j)),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
kept AS (
  SELECT doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos.pos) FILTER (WHERE gone.pos IS NULL) AS t
  FROM pos LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
}
