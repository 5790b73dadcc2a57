"""Documents to passages: fixed windows and structure-aware packing, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T


def check_window(size: int, stride: int | None = None) -> int:
    """The stride, half the size by default; ValueError unless 0 < stride <= size."""
    stride = size // 2 if stride is None else stride
    if size <= 0 or not 0 < stride <= size:
        raise ValueError("chunk_stride must be positive and at most chunk_size")
    return stride


def hard_windows(text: Column, size: int, stride: int) -> Column:
    """Windows of `size` code points, one each `stride`, up to the window that reaches the end; blank ones left out. Elements are (chunk_no, chunk_text), numbered over those that stay."""
    check_window(size, stride)
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - F.lit(size)) / F.lit(stride))).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * stride + 1, F.lit(size)))
    cuts = F.filter(cuts, lambda c: c.rlike(r"(?U)[^\s\x1c-\x1f]"))
    return F.when(n > 0, F.transform(cuts, lambda c, i: F.struct(i.alias("chunk_no"), c.alias("chunk_text")))).otherwise(F.array().cast("array<struct<chunk_no:int,chunk_text:string>>"))


def units(text: Column, size: int, stride: int) -> Column:
    """Paragraphs with single blanks; the sentences of those that are too long; windows of what is still too long."""
    spaced = lambda c: F.trim(F.regexp_replace(c, T.SPACES, " "))
    # The ends of paragraphs need no stripping before their blanks are made single and trimmed.
    parts = F.filter(F.transform(F.split(text, T.PARAGRAPH), spaced), lambda p: p != "")
    parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(T.sentences(p))))
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.transform(hard_windows(p, size, stride), lambda w: w["chunk_text"]))))


def packed(every: Column, size: int, stride: int) -> Column:
    """An array of units as chunks, each of units joined by blanks.

    A fold over the units' lengths. Its state is the open chunk, from its first unit up to an end, the characters that its
    units and the blanks behind them take, and the chunks that are closed, as (first, end); so a unit that fits costs the same however many
    are in the chunk. A unit joins the open chunk while that stays within `size`; else the chunk
    is closed, and the next keeps trailing units of up to size - stride characters, one at least, but begins at least
    one unit later. Where the kept units leave no room either, they are a chunk of their own, and so on.
    """
    overlap = size - stride
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def state(first: Column, end: Column, taken: Column, done: Column) -> Column:
        return F.struct(first.alias("first"), end.alias("end"), taken.alias("taken"), done.alias("done"))

    def kept(lengths: Column) -> Column:
        """How many trailing units the next chunk repeats, of those with these lengths, and what they take."""
        if not overlap:
            return F.struct(F.lit(0).alias("n"), F.lit(0).alias("taken"))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("taken"), F.lit(True).alias("open"))

        def more(s: Column, n: Column) -> Column:
            fits = (s["n"] == 0) | (s["open"] & (s["taken"] + n <= overlap))
            return F.when(fits, F.struct((s["n"] + 1).alias("n"), (s["taken"] + n + 1).alias("taken"), F.lit(True).alias("open"))).otherwise(F.struct(s["n"].alias("n"), s["taken"].alias("taken"), F.lit(False).alias("open")))

        # The first unit never stays.
        return F.aggregate(F.reverse(F.slice(lengths, 2, F.size(lengths))), start, more, lambda s: F.struct(s["n"].alias("n"), s["taken"].alias("taken")))

    def fits(s: Column, n: Column) -> Column:
        return (s["end"] == s["first"]) | (s["taken"] + n <= size)

    def spans(lengths: Column) -> Column:
        span = lambda s: F.array(F.struct(s["first"].alias("first"), s["end"].alias("end")))

        def close(s: Column) -> Column:
            return once(kept(F.slice(lengths, s["first"] + 1, s["end"] - s["first"])), lambda k: state(s["end"] - k["n"], s["end"], k["taken"], F.concat(s["done"], span(s))))

        def step(s: Column, n: Column) -> Column:
            add = lambda r: state(r["first"], r["end"] + 1, r["taken"] + n + 1, r["done"])
            room = F.aggregate(F.sequence(F.lit(0), s["end"] - s["first"]), s, lambda t, _: F.when(fits(t, n), t).otherwise(close(t)))
            return F.when(fits(s, n), add(s)).otherwise(once(room, add))

        start = state(F.lit(0), F.lit(0), F.lit(0), F.array().cast("array<struct<first:int,end:int>>"))
        return F.aggregate(lengths, start, step, lambda s: F.when(s["end"] > s["first"], F.concat(s["done"], span(s))).otherwise(s["done"]))

    found = once(F.transform(every, lambda u: F.length(u)), spans)
    return F.transform(found, lambda c: F.array_join(F.slice(every, c["first"] + 1, c["end"] - c["first"]), " "))


def structured_chunks(docs: DataFrame, size: int = 1600, stride: int | None = None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, chunk_no, chunk_text); a document without chunks has its text as the only one."""
    stride = check_window(size, stride)
    text = F.coalesce("text", F.lit(""))
    # Inside a transform the units are made once; as a column they would be put in wherever they are read.
    made = F.transform(F.array(units(text, size, stride)), lambda u: F.when(F.size(u) > 0, packed(u, size, stride)).otherwise(F.array(text)))
    return docs.select("doc_id", F.posexplode(F.get(made, F.lit(0))).alias("chunk_no", "chunk_text"))


#: The same under another name.
character_chunks = structured_chunks


def window_chunks(docs: DataFrame, size: int = 1600, stride: int | None = None) -> DataFrame:
    """As structured_chunks, but with fixed windows."""
    text = F.coalesce("text", F.lit(""))
    found = hard_windows(text, size, check_window(size, stride))
    whole = F.array(F.struct(F.lit(0).alias("chunk_no"), text.alias("chunk_text")))
    return docs.select("doc_id", F.inline(F.when(F.size(found) > 0, found).otherwise(whole)))
