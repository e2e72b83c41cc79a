"""Lexicons as tables, and lexicons derived from a corpus where none is given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a list of words is broadcast (some 100 bytes each in a hashed relation: 10 MB); longer ones are joined by shuffle.
SMALL = 100_000


def checked(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it has no more than SMALL rows, and merged otherwise, whatever the optimizer estimates."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table.hint("merge")


def without(tokens: DataFrame, words: DataFrame, kept: Callable) -> tuple[DataFrame, DataFrame | None]:
    """(tokens, words(word)) to join by `lower`, or, where words are too many to be broadcast and those of the tokens that are
    not among them are not, (the tokens that stand in words, None)."""
    if words.limit(SMALL + 1).count() <= SMALL:
        return tokens, words
    unknown = kept(lambda: tokens.select("lower").distinct().join(words.select(F.col("word").alias("lower")), "lower", "left_anti"))
    if unknown.limit(SMALL + 1).count() > SMALL:
        return tokens, words
    return tokens.where("lower IS NOT NULL").join(F.broadcast(unknown), "lower", "left_anti"), None


#: Rows of a ranked list; bands of it are [0, 3000), [3000, 6000), [6000, 9000).
RANKS = 9000


def ranked_list(tokens: DataFrame, size: int = RANKS) -> DataFrame:
    """tokens to (rank, word, tag, freq): the most frequent pairs of lemma and tag, ties by word and tag, rank from 0.

    Only `size` rows are kept before they are numbered, so that the single-task numbering is bounded. Punctuation is left out.
    """
    counts = tokens.where("NOT is_punct").groupBy(F.col("lemma").alias("word"), "tag").agg(F.count("*").cast("double").alias("freq"))
    top = counts.orderBy(F.desc("freq"), "word", "tag").limit(size)
    return top.select((F.row_number().over(Window.orderBy(F.desc("freq"), "word", "tag")) - 1).alias("rank"), "word", "tag", "freq")


def word_list(ranked: DataFrame, low: int, high: int) -> DataFrame:
    """Distinct words of the ranks low to high - 1."""
    return ranked.where((F.col("rank") >= low) & (F.col("rank") < high)).select("word").distinct()


def dictionary(texts: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """(word): words of at least `least` occurrences in the corpus, lower case; a stand-in for a spelling dictionary."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("\\p{L}+"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")
