"""Shared pieces: the shared folder, checked broadcasts and vectorised text scanning."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Rows that may be broadcast when a side was counted first; beyond this the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; set here only where it is unset, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if base is not None and not isinstance(base, str):  # a Scala Option
        base = base.get() if base.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Bytes of a batch that a Python function looks at at once.
PIECE_BYTES = 4 << 20
#: Spark's setting by which the shuffle files of a statement are deleted when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _forget() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


atexit.register(_forget)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: cuts lineage and survives lost executors. The shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._stored_path)
        _WRITTEN.remove((df.sparkSession, df._stored_path))


def written() -> int:
    """A mark for `discard_since`."""
    return len(_WRITTEN)


def discard_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables stored since the mark, but those in keep."""
    paths = {df._stored_path for df in keep}
    for spark, path in _WRITTEN[mark:]:
        if path not in paths:
            _delete(spark, path)
    _WRITTEN[mark:] = [x for x in _WRITTEN[mark:] if x[1] in paths]


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside JVMs that need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(f):
    """f, a function for mapInArrow, fed with pieces of batches of about PIECE_BYTES (or one row, if that is longer), and its memory given back when the task ends."""

    def pieces(batches):
        for b in batches:
            step = max(1, b.num_rows * PIECE_BYTES // max(PIECE_BYTES, b.nbytes))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)

    def run(batches):
        yield from f(pieces(batches))
        release_memory()

    return run


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is (a shuffle join)."""
    return F.broadcast(df) if rows <= limit else df


def within(df: DataFrame, bytes_each, limit: int) -> DataFrame:
    """df with a broadcast hint if the sum of an estimate of its rows' bytes is within the limit, else as it is."""
    total = df.agg(F.coalesce(F.sum(bytes_each), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if total <= limit else df


# --- vectorised scanning of UTF-8 texts -------------------------------------------------------

_NON_SPACE = np.ones(256, bool)
_NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Two primes under 2^31, a drawn value for each byte and a drawn base under each: no text's structure can make two
#: polynomials modulo primes agree, as it can modulo a power of two.
_PRIMES = (2147483647, 2147483629)
_DRAWN = [np.random.default_rng(20240229 + i).integers(1, p, 256, dtype=np.int64).astype(np.uint64) for i, p in enumerate(_PRIMES)]
_BASES = [1_103_515_245 + 2 * 739, 1_664_525_017]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(i: int, up: bool, n: int) -> np.ndarray:
    """The first n powers of a base, or of its inverse, modulo its prime."""
    p = _PRIMES[i]
    have = _powers.get((i, up), np.ones(1, np.uint64))
    base = _BASES[i] if up else pow(_BASES[i], -1, p)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), p)) % np.uint64(p)])
    _powers[i, up] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """The words of a run of texts: start and end byte offsets, and first[i]..first[i+1] as the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        inside = _NON_SPACE[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes (two polynomials modulo primes, 62 bits), the same wherever the word stands."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        halves = []
        for i, p in enumerate(np.array(_PRIMES, np.uint64)):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_DRAWN[i][self.data] * _power(i, True, n) % p, out=sums[1:])  # under 2^31 each: no overflow
            halves.append((sums[self.end] - sums[self.start]) % p * _power(i, False, n)[self.start] % p)
        return mix((halves[0] << np.uint64(32)) | halves[1])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; the caller drops runs that cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += words[j : j + n]
    return mix(out)


def slices(column: pa.Array, target: int = 1 << 19):
    """Runs of rows of a string column of about target bytes: (first row, last row + 1, bytes, offsets). Word hashes need some 70 bytes of memory for each, part of which a worker keeps."""
    data, off = text_bytes(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + target, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
