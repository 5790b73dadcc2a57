"""Operator 2: language ID with interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a model of character 4-grams. An n-gram's packed code points are its hash; a model is arrays sorted
by it. The arrays of all languages share their keys, so one search gives the log-probabilities in every language.
The language with the lowest cross-entropy per character wins; a text whose cross-entropy is above what that
language's training texts show is rejected.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stored, table

ORDER = 4
DISCOUNT = 0.75
#: Training texts of each language, about: the bound of the labelled sample that the models are fitted on.
SAMPLE_DOCS = 2500
#: Codes that are scored at once.
PIECE = 1 << 18
EDGE = 1  # the code that stands before each text
_LETTERS: list[np.ndarray] = []


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the lower-cased texts, each after three edges, with anything but letters as single blanks; and where each text's edges begin."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x10000)), np.uint16, 0x10000))
        _LETTERS[0][EDGE] = EDGE
    raw = np.frombuffer(("\x01\x01\x01" + "\x01\x01\x01".join(t.replace("\x01", " ") for t in texts)).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    far = raw >= 0x10000
    codes = _LETTERS[0][np.where(far, 32, raw)]
    if far.any():  # letters beyond the first plane share the private-use codes
        new = np.fromiter((0xE000 + c % 0x1800 if chr(c).isalpha() else 32 for c in raw[far].tolist()), np.uint16)
        codes[far] = new
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    codes = codes[keep].astype(np.uint64)
    begins = np.flatnonzero(codes == EDGE)[::3]
    return codes, begins


def _grams(codes: np.ndarray, n: int = ORDER) -> np.ndarray:
    """At each place from n - 1 on, the n codes that end there, packed."""
    out = codes[n - 1 :].copy()
    for j in range(1, n):
        out |= codes[n - 1 - j : len(codes) - j] << np.uint64(16 * j)
    return out


def _parts(texts: list[str], target: int = 1 << 20):
    sizes = np.cumsum([0] + [len(t) + 3 for t in texts])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + target, side="right")) - 1)
        yield i, j
        i = j


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From one language's 4-grams and counts, for each order 1..4: n-grams, probabilities, contexts, weights of the next lower order."""
    tables = []
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order].astype(float)
    by_order = {ORDER: (grams, counts)}
    for n in range(ORDER - 1, 0, -1):  # how many different codes stand before each shorter n-gram
        short, seen = np.unique(by_order[n + 1][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
        by_order[n] = (short, seen.astype(float))
    keys, seen = by_order[1]
    vocabulary = len(keys) + 1
    total = seen.sum()
    weight = DISCOUNT * len(keys) / total
    probability = np.maximum(seen - DISCOUNT, 0) / total + weight / vocabulary
    tables.append((keys, probability, np.zeros(1, np.uint64), np.array([weight / vocabulary])))
    for n in range(2, ORDER + 1):
        keys, seen = by_order[n]
        contexts, first, kinds = np.unique(keys >> np.uint64(16), return_index=True, return_counts=True)
        totals = np.add.reduceat(seen, first)
        weights = DISCOUNT * kinds / totals
        at = np.repeat(np.arange(len(contexts)), kinds)
        low_keys, low, _, _ = tables[-1]
        lower = low[np.searchsorted(low_keys, keys & np.uint64((1 << 16 * (n - 1)) - 1))]
        tables.append((keys, np.maximum(seen - DISCOUNT, 0) / totals[at] + weights[at] * lower, contexts, weights))
    return tables


class Models:
    """All languages' models over shared sorted keys."""

    def __init__(self, languages: list[str], per_language: list[list]):
        self.languages = languages
        self.orders = []
        floor = np.array([t[0][3][0] for t in per_language])
        lower = None
        for n in range(ORDER):
            keys = np.unique(np.concatenate([t[n][0] for t in per_language]))
            contexts = np.unique(np.concatenate([t[n][2] for t in per_language]))
            weights = np.ones((len(contexts), len(languages)))
            for i, t in enumerate(per_language):
                weights[np.searchsorted(contexts, t[n][2]), i] = t[n][3]
            if n == 0:
                probability = np.tile(floor, (len(keys), 1))
            else:
                at = np.searchsorted(contexts, keys >> np.uint64(16))
                probability = weights[at] * self._lookup(lower, keys & np.uint64((1 << 16 * n) - 1))
            for i, t in enumerate(per_language):
                probability[np.searchsorted(keys, t[n][0]), i] = t[n][1]
            lower = (keys, probability)
            self.orders.append((keys, np.log(probability).astype(np.float32), contexts, np.log(weights).astype(np.float32)))
        self.floor = np.log(floor).astype(np.float32)
        self.limits: np.ndarray = np.full(len(languages), np.inf)
        self.spread: np.ndarray = np.zeros(len(languages))

    @staticmethod
    def _lookup(level, keys):
        return level[1][np.searchsorted(level[0], keys)]

    def _backed_off(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Log-probabilities of n-grams that no language has as such."""
        if n == 0:
            return np.tile(self.floor, (len(grams), 1))
        keys, logs, _, _ = self.orders[n - 1]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = logs[at]
        miss = np.flatnonzero(keys[at] != grams)
        if len(miss):
            g = grams[miss]
            low = self._backed_off(g & np.uint64((1 << 16 * (n - 1)) - 1), n - 1) if n > 1 else np.tile(self.floor, (len(g), 1))
            if n > 1:
                _, _, contexts, weights = self.orders[n - 1]
                c = g >> np.uint64(16)
                spot = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
                low = low + np.where((contexts[spot] == c)[:, None], weights[spot], 0)
            out[miss] = low
        return out

    def _sums(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each place the sum of the log-probabilities of the codes before it, the first three left out; PIECE codes at a time, however long a text is."""
        rows = np.clip(places - (ORDER - 1), 0, None)
        out, so_far = np.zeros((len(places), len(self.languages))), np.zeros((1, len(self.languages)))
        for r in range(0, max(0, len(codes) - ORDER + 1), PIECE):
            logs = self._backed_off(_grams(codes[r : r + PIECE + ORDER - 1]), ORDER)
            sums = np.concatenate([so_far, so_far + np.cumsum(logs, axis=0, dtype=np.float64)])
            here = (rows > r) & (rows <= r + len(logs))
            out[here], so_far = sums[rows[here] - r], sums[-1:]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's cross-entropy per character (nats) in each language, scored characters and letters."""
        out, sizes, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, j in _parts(texts):
            codes, begins = _codes(texts[i:j])
            edges = np.append(begins, len(codes))
            sizes[i:j] = np.diff(edges) - 3
            letters[i:j] = np.add.reduceat((codes != 32) & (codes != EDGE), begins)
            sums = self._sums(codes, np.concatenate([edges[:-1] + ORDER - 1, edges[1:]]))
            out[i:j] = sums[: j - i] - sums[j - i :]
        return out / np.maximum(sizes, 1)[:, None], sizes, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text; `und` where there is no letter."""
        ce, sizes, letters = self.entropies(texts)
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(texts)), best]
        score = 1 / np.exp((low[:, None] - ce) * np.minimum(sizes, 100)[:, None]).sum(axis=1)
        none = letters == 0
        rejected = none | (low > self.limits[best] + 4 * self.spread[best] / np.sqrt(np.maximum(sizes, 1)))
        return ["und" if x else self.languages[b] for x, b in zip(none, best, strict=True)], np.where(none, 0.0, score), np.where(none, 0.0, low), rejected


def held_out(doc_id):
    """Whether a row's labels must not be learned from: crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, slack: float = 1.25) -> Models | None:
    """Models of the non-null lang values of docs(doc_id, text, lang) outside the held-out rows; None if there are none.

    The fit takes about sample_docs rows of each language, chosen by the hash of their id and text, whole. A text
    is accepted up to slack times the 99.9th percentile of the cross-entropies of its language's sample, plus
    four standard errors for its length.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("_h"))
    share = {r.lang: sample_docs / r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return None
    cut = F.create_map(*[F.lit(x) for lang, s in share.items() for x in (lang, int(min(1.0, s) * (1 << 30)))])
    sample = stored(rows.where(F.col("_h") < F.element_at(cut, F.col("lang"))).select("lang", "text"))

    def count(batches):
        for b in batches:
            held: dict[str, list] = {}
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                mine = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                for i, j in _parts(mine):
                    codes, _ = _codes(mine[i:j])
                    grams = _grams(codes)
                    held.setdefault(lang, []).append(grams[(grams & np.uint64(0xFFFF)) != EDGE])
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = [x for x in sorted(share) if (counts.lang == x).any()]
    if not languages:
        return None
    models = Models(languages, [kneser_ney(c.gram.to_numpy().view(np.uint64), c.n.to_numpy()) for x in languages for c in [counts[counts.lang == x]]])
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def spread(batches):
        for b in batches:
            ce, sizes, _ = shared.value.entropies(b.column(1).to_pylist())
            own = np.fromiter((languages.index(x) if x in languages else -1 for x in b.column(0).to_pylist()), np.int64)
            ok = own >= 0
            yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(ce[np.arange(len(own)), own][ok]), pa.array(sizes[ok])], ["lang", "ce", "size"])

    seen = sample.mapInArrow(lean(spread), "lang long, ce double, size long").toPandas()
    for i in range(len(languages)):
        mine = seen[(seen.lang == i) & (seen["size"] > 0)]
        ce, root = mine.ce.to_numpy(), np.sqrt(mine["size"].to_numpy())
        if len(ce):
            middle = np.median(ce)
            models.spread[i] = np.quantile(np.abs(ce - middle) * root, 0.99) / 2.6
            models.limits[i] = slack * np.quantile(np.minimum(ce, middle + 4 * models.spread[i] / root), 0.999)
    return models


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    Null and empty texts, and texts without a letter, are `und` with score 0, rejected. If no language could be
    learned every text is `und`, and only those without a letter are rejected. Ties go to the first language in order. Whole
    texts are scored, in pieces where they are long; repeated rows are scored each; an empty table gives no rows;
    extra columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            lang, score, ce, rejected = _predict(m, texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(ce), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")


def _predict(models: Models | None, texts: list[str]):
    if models:
        return models.predict(texts)
    zero = np.zeros(len(texts))
    return ["und"] * len(texts), zero, zero, np.fromiter((not any(map(str.isalpha, t)) for t in texts), bool, len(texts))


def accepted(docs: DataFrame, models: Models | None) -> DataFrame:
    """The rows of docs, with all their columns, that `identify` does not reject."""
    shared, at = docs.sparkSession.sparkContext.broadcast(models), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(~_predict(shared.value, [t or "" for t in b.column(at).to_pylist()])[3]))

    return docs.mapInArrow(lean(run), docs.schema)


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
