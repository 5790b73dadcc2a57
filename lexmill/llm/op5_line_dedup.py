"""Operator 5: line dedup with two Bloom filters, and exact confirmation of the suspects.

Pass 1 sends each task's distinct line hashes through the filters (repeats.py). Pass 2 reads the texts again and
shuffles only the keys of suspected lines, counted per task first; their exact text decides. Pass 3 drops the lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STRIP, lean, stored, table
from .repeats import Suspects, expected_bytes, repeated

#: Largest set of confirmed keys that is broadcast, in bytes; beyond it drops are found by a join and shuffled by row.
KEY_BYTES = 32 << 20
#: Distinct suspected keys that a task counts before it sends them.
HELD = 200_000


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: stripped at both ends, A-Z lower-cased, as UTF-8. Null is one empty line."""
    return [x.strip(STRIP).lower() for x in (text or "").encode().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", filter_bytes: int | None = None, key_bytes: int = KEY_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, text (kept lines joined by \\n), n_lines, n_dropped, and `carried`, a struct of the columns named in carry, if any.

    A line's key is the line stripped of white space with A-Z lower-cased. Keys of at least min_chars code points
    that stand in at least min_docs (2 or more) documents are repeats; rows with the same doc_id are one document,
    and rows without an id one each. keep="none" drops all their lines; keep="first"
    keeps the first such line of the row with the smallest doc_id (null ids come last; rows that tie all keep it).

    Null and empty texts are one empty line (text ""). Repeated rows are changed each. An empty table gives no rows.
    Extra columns are ignored. Ids may be of any type with an order.
    """
    if min_docs < 2 or min_chars < 1 or keep not in ("none", "first"):
        raise ValueError("min_docs must be 2 or more, min_chars 1 or more, keep 'none' or 'first'")
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    every = docs.select("doc_id", "text", *([F.struct(*carry).alias("carried")] if carry else []))
    docs = docs.select("doc_id", "text")

    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    id_repeats = not ids.where("n > 1").isEmpty()

    def distinct(text):
        return {k for k in line_keys(text) if _long_enough(k, min_chars)}

    def hashes(b):
        return np.fromiter((_hash(k) for t in b.column("text").to_pylist() for k in distinct(t)), np.uint64)

    suspects = Suspects(repeated(docs, hashes, expected_bytes(docs) // 64), **({} if filter_bytes is None else {"limit_bytes": filter_bytes}))
    test = suspects.tester()

    def count(batches):
        # Rows of one document can lie in several tasks: where ids repeat, keys are counted by id.
        held: dict[tuple, list] = {}
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys = list(distinct(text))
                if not keys:
                    continue
                h = np.fromiter(map(_hash, keys), np.uint64, len(keys))
                for i in np.flatnonzero(test(h)):
                    name = (keys[i], doc_id if id_repeats else None)
                    old = held.get(name)
                    if old is None:
                        held[name] = [1, doc_id, int(h[i])]
                    else:
                        old[0] += 1
                        if doc_id is not None and (old[1] is None or doc_id < old[1]):
                            old[1] = doc_id
            if len(held) >= HELD:
                yield sent(held, b.column(0).type)
                held = {}
        if held:
            yield sent(held, b.column(0).type)

    def sent(held, id_type):
        return pa.RecordBatch.from_arrays([pa.array([k.decode() for k, _ in held]), pa.array(np.array([v[2] for v in held.values()], np.uint64).view(np.int64)), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], id_type)], ["key", "h", "n", "first"])

    counted = suspects.narrow(docs.mapInArrow(lean(count), f"key string, h long, n long, first {kind}"), "h")
    if id_repeats:
        counted = counted.groupBy("key", "first").agg(F.when(F.col("first").isNull(), F.sum("n")).otherwise(F.lit(1)).alias("n"))
    confirmed = stored(counted.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") >= min_docs))
    size = confirmed.select(F.coalesce(F.sum(F.octet_length("key") + 100), F.lit(0))).first()[0]
    schema = f"doc_id {kind}, text string, n_lines long, n_dropped long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in every.schema if f.name == "carried")

    def kept(doc_id, text, bad):
        lines, left, seen = (text or "").split("\n"), [], set()
        for line, key in zip(lines, line_keys(text), strict=True):
            if key in bad and not (keep == "first" and key not in seen and bad[key] == doc_id):
                continue
            seen.add(key)
            left.append(line)
        return "\n".join(left), len(lines), len(lines) - len(left)

    def rows(b, per_row):
        ids, more = b.column(0), [c for c, name in zip(b.columns, b.schema.names, strict=True) if name == "carried"]
        out = [kept(d, t, bad) for d, t, bad in zip(ids.to_pylist(), b.column(1).to_pylist(), per_row, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), *more], ["doc_id", "text", "n_lines", "n_dropped", *["carried"] * len(more)])

    if size <= key_bytes:
        known = spark.sparkContext.broadcast({r.key.encode(): r.first for r in confirmed.select("key", "first").toLocalIterator()})

        def drop(batches):
            for b in batches:
                yield rows(b, [known.value] * b.num_rows)

        return every.mapInArrow(lean(drop), schema)

    # Too many repeats to broadcast: each row's suspected keys meet the confirmed ones (one row a key, so the join can
    # split a key that many rows have), and come back to the row.
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    every = every.withColumn("_row", F.xxhash64("doc_id", "text"))

    def spread(batches):
        for b in batches:
            found = [(r, k) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) for k in distinct(t)]
            some = np.flatnonzero(test(np.fromiter((_hash(k) for _, k in found), np.uint64, len(found)))) if found else []
            yield pa.RecordBatch.from_arrays([pa.array([found[i][0] for i in some], pa.int64()), pa.array([found[i][1].decode() for i in some], pa.string())], ["_row", "key"])

    hit = keyed.mapInArrow(lean(spread), "_row long, key string").join(confirmed.select("key", "first"), "key").groupBy("_row").agg(F.collect_set(F.struct("key", "first")).alias("bad"))
    joined = every.join(hit, "_row", "left").drop("_row")

    def drop_joined(batches):
        for b in batches:
            yield rows(b, [{x["key"].encode(): x["first"] for x in bad or ()} for bad in b.column("bad").to_pylist()])

    return joined.mapInArrow(lean(drop_joined), schema)


def op5_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {
    "op5_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_CASE}) AS key FROM lines),
bad AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(bad.key) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN bad ON keyed.key = bad.key GROUP BY doc_id"""
}
