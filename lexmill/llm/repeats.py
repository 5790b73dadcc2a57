"""Which 64-bit hashes occur in at least two places: two Bloom filters, for once-seen and twice-seen hashes.

Each task sends each of its distinct hashes once, marked if the task itself saw it in two places, so a hash that
fills the corpus moves once per task. Hashes are dealt out by value; each share passes through the two filters, and
what the second filter holds is suspected. The few suspects of a share are then counted exactly. No repeat is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix, stored

#: Bits of a filter per hash and bits set for each: in the shares, and in the filter that is broadcast.
BITS, SET = 12, 2
SHARP_BITS, SHARP_SET = 24, 4
#: Largest filter that is broadcast, in bytes; beyond it rows join the suspects with a shuffle.
BROADCAST_BYTES = 48 << 20
#: Hashes kept before a task sends what it has.
HELD = 1 << 20


class Bloom:
    """A Bloom filter over uint64 hashes, set and tested array-wise."""

    def __init__(self, n: int, per_hash: int = BITS, set_bits: int = SET, bits: np.ndarray | None = None):
        self.size = max(64, 1 << max(0, (n * per_hash - 1)).bit_length())
        self.set_bits = set_bits
        self.bits = np.zeros(self.size >> 3, np.uint8) if bits is None else bits

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        m, g = np.uint64(self.size - 1), mix(h)
        step = (g >> np.uint64(32)) * np.uint64(2654435761) | np.uint64(1)
        return [(g + np.uint64(i) * step & m).astype(np.int64) for i in range(self.set_bits)]

    def add(self, h: np.ndarray) -> None:
        for p in self.places(h):
            np.bitwise_or.at(self.bits, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        yes = np.ones(len(h), bool)
        for p in self.places(h):
            yes &= (self.bits[p >> 3] >> (p & 7) & 1).astype(bool)
        return yes


_SENT = pa.schema([("share", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])


def _send(held: list[np.ndarray], shares: int) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(held), return_counts=True)
    share = (h >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)  # by the top bits, so each share is a run
    edges = np.searchsorted(share, np.arange(shares + 1, dtype=np.uint64))
    rows = [(s, h[a:b][n[a:b] == 1].tobytes(), h[a:b][n[a:b] > 1].tobytes()) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT)], schema=_SENT)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(np.frombuffer(once.as_py(), np.uint64), np.frombuffer(more.as_py(), np.uint64)) for b in batches for once, more in zip(b.column("once"), b.column("more"), strict=True)]
    n = sum(len(a) + len(b) for a, b in rows)
    once, twice = Bloom(n), Bloom(n)
    for a, b in rows:
        seen = once.has(a)
        twice.add(a[seen])
        once.add(a[~seen])
        twice.add(b)
        once.add(b)
    none = np.zeros(0, np.uint64)
    # What only a false positive made suspect is counted out here, among the few suspects.
    kept, seen = np.unique(np.concatenate([a[twice.has(a)] for a, _ in rows] + [b for _, b in rows] or [none]), return_counts=True)
    out = kept[(seen > 1) | np.isin(kept, np.concatenate([b for _, b in rows] or [none]), assume_unique=False)]
    for i in range(0, len(out), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(out[i : i + (1 << 17)].view(np.int64))], ["h"])


def repeated(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], expected: int) -> DataFrame:
    """The suspects (h long, stored) among the hashes that `hashes` makes of each batch of rows.

    hashes must give each hash once for each place that counts. expected is about how many there are; it only
    sets how finely they are dealt out.
    """
    shares = int(min(20_000, max(8, expected >> 20)))

    def send(batches):
        held, n = [], 0
        for b in batches:
            held.append(hashes(b))
            n += len(held[-1])
            if n >= HELD:
                yield _send(held, shares)
                held, n = [], 0
        if n:
            yield _send(held, shares)

    sent = rows.mapInArrow(lean(send), "share int, once binary, more binary")
    return stored(sent.repartition(shares, "share").mapInArrow(lean(_suspects), "h long"))


class Suspects:
    """Tests hashes against the suspects: a broadcast Bloom filter where its size allows, else nothing is excluded here and `narrow` joins."""

    def __init__(self, found: DataFrame, limit_bytes: int = BROADCAST_BYTES):
        self.found, self.count = found, found.count()
        size = Bloom(self.count, SHARP_BITS, SHARP_SET, np.zeros(0, np.uint8)).size
        self.filter = None
        if size >> 3 <= limit_bytes:
            self.filter = found.sparkSession.sparkContext.broadcast((self.count, self._packed(size)))

    def _packed(self, size: int) -> np.ndarray:
        """The filter's bits, set on the executors by ranges of places and put together here."""
        parts = max(1, min(64, size >> 16))
        width, n = size // parts, self.count

        def places(batches):
            for b in batches:
                p = np.unique(np.concatenate(Bloom(n, SHARP_BITS, SHARP_SET, np.zeros(0, np.uint8)).places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
                edges = np.searchsorted(p, np.arange(parts + 1) * width)
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([(p[edges[i] : edges[i + 1]] - i * width).astype(np.int32).tobytes() for i in some], pa.binary())], ["part", "places"])

        def pack(batches):
            bits: dict[int, np.ndarray] = {}
            for b in batches:
                for part, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    flags = bits.setdefault(part, np.zeros(width, bool))
                    flags[np.frombuffer(places, np.int32)] = True
            packed = {k: np.packbits(v, bitorder="little").tobytes() for k, v in bits.items()}
            yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array(list(packed.values()), pa.binary())], ["part", "packed"])

        rows = self.found.mapInArrow(lean(places), "part int, places binary").repartition(min(parts, 16), "part").mapInArrow(lean(pack), "part int, packed binary").collect()
        bits = np.zeros(size >> 3, np.uint8)
        for r in rows:
            bits[r.part * (width >> 3) : (r.part + 1) * (width >> 3)] = np.frombuffer(bytes(r.packed), np.uint8)
        return bits

    def tester(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function for the executors: which of an array of hashes may be suspects."""
        held = self.filter
        if held is None:
            return lambda h: np.ones(len(h), bool)
        made: list[Bloom] = []

        def has(h: np.ndarray) -> np.ndarray:
            if not made:
                n, bits = held.value
                made.append(Bloom(n, SHARP_BITS, SHARP_SET, bits))
            return made[0].has(h)

        return has

    def narrow(self, rows: DataFrame, column: str) -> DataFrame:
        """rows whose hash in `column` is suspected, joined only where the filter was too large to broadcast."""
        if self.filter is not None:
            return rows
        return rows.join(self.found.withColumnRenamed("h", column), column, "left_semi").select(rows.columns)


def expected_bytes(rows: DataFrame, column: str = "text") -> int:
    """The UTF-8 bytes in a column: one JVM pass that sizes what follows."""
    return int(rows.select(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])
