"""Operator 4: token counts by heap-and-linked-list byte-pair merging.

The symbols of a piece form a linked list; a heap holds its adjacent pairs by rank, then place. Popping the lowest
pair merges it, and the count is the number of symbols at first less the number of merges: no ids are made.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import lean, table

#: The pre-tokenizer's pattern and the Unicode White_Space set: fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Entries of each worker's caches; a full cache is emptied, so memory is bounded whatever the vocabulary.
CACHE = 400_000


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def load_merges(path: str) -> dict:
    """Symbols of the 256 bytes, merges keyed by (left << 20 | right) as (rank, new symbol), and special strings, of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"]
    pairs = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.setdefault(ids[a] << 20 | ids[b], (rank, ids[a + b]))
    return {"bytes": [ids[s] for s in byte_symbols()], "pairs": pairs, "special": sorted(t["content"] for t in spec["added_tokens"])}


class Counter:
    """Counts the tokens of texts; keeps counts of pieces and of blank-separated chunks seen before."""

    def __init__(self, model: dict, cache: int = CACHE):
        self.symbols, self.pairs, self.cache = model["bytes"], model["pairs"], cache
        self.special = regex.compile("|".join(map(regex.escape, sorted(model["special"], key=len, reverse=True)))) if model["special"] else None
        self.literal = model["special"][0] if len(model["special"]) == 1 else None
        self.find = regex.compile(PIECES).findall
        self.runs = regex.compile(f"[{SPACE}][{SPACE}]").search
        self.cut = regex.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])").split
        self.piece_counts: dict[str, int] = {}
        self.chunk_counts: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Tokens of one piece of the pre-tokenizer."""
        symbols, pairs = self.symbols, self.pairs
        ids = [symbols[b] for b in piece.encode()]
        n = len(ids)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [got[0] * n + i for i in range(n - 1) if (got := pairs.get(ids[i] << 20 | ids[i + 1]))]
        heapify(heap)
        left = n
        while heap:
            rank, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            got = pairs.get(ids[i] << 20 | ids[j])
            if got is None or got[0] != rank:
                continue  # one of the two has changed since
            ids[i], ids[j] = got[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if got := pairs.get(ids[i] << 20 | ids[k]):
                    heappush(heap, got[0] * n + i)
            h = before[i]
            if h >= 0 and (got := pairs.get(ids[h] << 20 | ids[i])):
                heappush(heap, got[0] * n + h)
        return left

    def piece(self, piece: str) -> int:
        count = self.piece_counts.get(piece)
        if count is None:
            count = self.merged(piece)
            if len(piece) <= 64:
                if len(self.piece_counts) >= self.cache:
                    self.piece_counts.clear()
                self.piece_counts[piece] = count
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        One blank between two characters that aren't white space always begins a piece, so the text may be cut
        before it and the parts counted alone.
        """
        if not text:
            return 0
        # Without a run of white space, each blank but one at an end stands alone, and str.split finds the same cuts.
        chunks = self.cut(text) if self.runs(text) or text[0] == " " or text[-1] == " " else text.split(" ")
        total = sum(map(self.piece, self.find(chunks[0])))
        known = self.chunk_counts
        for chunk in chunks[1:]:
            count = known.get(chunk)
            if count is None:
                count = sum(map(self.piece, self.find(" " + chunk)))
                if len(chunk) <= 64:
                    if len(known) >= self.cache:
                        known.clear()
                    known[chunk] = count
            total += count
        return total

    def count(self, text: str) -> int:
        if self.special is None or (self.literal is not None and self.literal not in text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[tuple, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer is the path of a byte-level BPE file in the JSON form; it is read once on the driver, and its table
    (fixed by the vocabulary, not by the data) is broadcast. Null and empty texts have 0 bytes and 0 tokens; a
    null doc_id stays null; repeated rows are counted each; an empty table gives no rows; texts are never cut.
    Strings of added tokens inside a text count as one token each.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_merges(tokenizer))
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        counter = _counters.get((tokenizer,)) or _counters.setdefault((tokenizer,), Counter(model.value))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def op4_token_counts(spark, sf_dir, name="byte_bpe_50k.json"):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(name))


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
