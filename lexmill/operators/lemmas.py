"""Lemmas for words that no table holds: an analyser of the caller's, or rules learned from a table.

Every function works on distinct words, which are far fewer than tokens, and returns a table (token, lemma) that
`functions.text.lemmatize` and the retrievers take.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T

#: The longest suffix that a rule is learned for.
LONGEST = 6
#: Rules that may be broadcast; beyond this they are joined by a shuffle.
BROADCAST_RULES = 200_000


def words_of(texts: DataFrame, column: str = "text") -> DataFrame:
    """The distinct tokens (token) of a column of texts that have a lemma at all: no special tokens, none with a digit."""
    words = texts.select(F.explode(F.array_distinct(T.tokenize(F.col(column)))).alias("token"))
    return words.where(~T.passes_lemmatizer(F.col("token"))).distinct()


def analysed(words: DataFrame, load: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """words(token) with the lemmas of an analyser: load() is called once for each task and gives a function of a word.

    Null words go; a word for which the analyser gives null or nothing keeps its own form. `load` must be picklable
    and find its dictionaries on every executor.
    """

    @F.pandas_udf("string")
    def lemma(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyse = load()
        for batch in batches:
            yield pd.Series([analyse(word) or word for word in batch], dtype=object)

    return words.where("token is not null").select("token").distinct().withColumn("lemma", lemma("token"))


def suffix_rules(lemmas: DataFrame, longest: int = LONGEST) -> DataFrame:
    """What lemmas(token, lemma) teach: for each suffix of a word the commonest change (suffix, cut, add): cut so many characters, then add these.

    Of equally common changes the one that cuts less stays, then the one that adds the smaller text. Words of which
    more than `longest` characters change teach nothing, nor do rows with nulls or empty words. Repeated tokens count
    once, with their smallest lemma.
    """
    known = T.one_lemma(lemmas.where("token <> '' and lemma is not null"))
    n = F.length("token")
    known = known.withColumn("_from", F.greatest(F.lit(0), n - longest)).withColumn("_to", F.least(n, F.length("lemma"))).where("_from <= _to")
    kept = F.array_max(F.filter(F.sequence("_from", "_to"), lambda i: F.substring("token", 1, i) == F.substring("lemma", 1, i)))
    changes = known.withColumn("_kept", kept).where("_kept is not null").select("token", (n - F.col("_kept")).alias("cut"), F.expr("substring(lemma, _kept + 1)").alias("add"))
    lengths = F.sequence(F.greatest(F.col("cut"), F.lit(1)), F.least(n, F.lit(longest)))
    suffixes = changes.select(F.explode(F.transform(lengths, lambda i: F.right("token", i))).alias("suffix"), "cut", "add")
    counted = suffixes.groupBy("suffix", "cut", "add").agg(F.count(F.lit(1)).alias("_n"))
    best = counted.groupBy("suffix").agg(F.min(F.struct((-F.col("_n")).alias("_n"), "cut", "add")).alias("_b"))
    return best.select("suffix", "_b.cut", "_b.add")


def predicted(words: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(token, lemma) of the distinct words(token): changed by the rule of the longest suffix that has one and isn't the whole word; else the word itself."""
    words = words.where("token is not null").select("token").distinct()
    rules = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    lengths = F.sequence(F.lit(1), F.least(F.length("token") - 1, F.lit(longest)))
    spread = words.where(F.length("token") > 1).select("token", F.explode(lengths).alias("_l")).withColumn("suffix", F.right("token", F.col("_l")))
    best = spread.join(rules, "suffix").groupBy("token").agg(F.max(F.struct("_l", "cut", "add")).alias("_b"))
    changed = best.select("token", F.concat(F.expr("left(token, length(token) - _b.cut)"), F.col("_b.add")).alias("lemma"))
    return words.join(changed, "token", "left").withColumn("lemma", F.coalesce(F.nullif("lemma", F.lit("")), "token"))


def completed(words: DataFrame, lemmas: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(token, lemma) of the distinct words(token): by the table where it holds them, else by the rules that it teaches."""
    known = T.one_lemma(lemmas)
    words = words.where("token is not null").select("token").distinct()
    held = words.join(known.where("lemma is not null"), "token")
    return held.unionByName(predicted(words.join(held, "token", "left_anti"), suffix_rules(lemmas, longest), longest))
