"""Content and function words, and the indices over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexmill.operators.lexicon import checked
from lexmill.operators.variation import THRESHOLD

#: Tags by class, punctuation tags, and object forms that count as their subject form. Fixed values.
NOUNS, ADJECTIVES, ADVERBS = ("NN", "NNS", "NNP", "NNPS"), ("JJ", "JJR", "JJS"), ("RB", "RBR", "RBS")
VERBS = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD")
PUNCTUATION = ("``", "''", "'", '"', ".", ",", ";", ":", "?", "!", "(", ")", "%", "/", "-", "_", "-LRB-", "-RRB-", "SYM")
SUBJECT = {"me": "i", "him": "he", "her": "she"}
NAMES = ("TAALED_TTR_AW", "TAALED_MTLD_MA_WRAP_CW", "TAALED_MTLD_MA_WRAP_AW", "TAALED_MAAS_TTR_CW", "TAALED_MAAS_TTR_AW", "TAALED_BASIC_NCONTENT_TOKENS", "TAALED_BASIC_NFUNCTION_TYPES")


def classify(tokens: DataFrame, adjectives: DataFrame, real_words: DataFrame | None) -> DataFrame:
    """tokens to (doc_id, sent_id, pos, class, item): class content or function, item the lemma with its suffix.

    adjectives(word) and real_words(word) are lists; tokens that are no real word or are punctuation give no row
    (None: all tokens are real words). Adverbs
    in -ly or -ally whose rest is an adjective are content words.
    """
    rows = tokens.where(~F.col("tag").isin(*PUNCTUATION))
    if real_words is not None:
        rows = rows.join(checked(real_words.select(F.col("word").alias("lower")).distinct()), "lower", "left_semi")
    # The adverbs that the adjectives make, so that tokens are joined once and by their lemma.
    made = adjectives.select(F.explode(F.array(F.concat("word", F.lit("ly")), F.concat("word", F.lit("ally")))).alias("lemma")).distinct()
    rows = rows.join(checked(made.withColumn("_made", F.lit(True))), "lemma", "left")
    tag, lemma = F.col("tag"), F.col("lemma")
    pronoun = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SUBJECT.items() for x in pair)), F.col("lower")), F.col("lower"))
    item = (
        F.when(tag.isin(*NOUNS), F.concat(lemma, F.lit("_cw_nn")))
        .when(tag.isin(*ADJECTIVES), F.concat(lemma, F.lit("_cw")))
        .when(tag.isin(*VERBS), F.concat(lemma, F.when((F.col("dep") == "aux") | (lemma == "be"), "_fw").otherwise("_cw_vb")))
        .when(tag.isin(*ADVERBS), F.concat(lemma, F.when(F.col("_made"), "_cw").otherwise("_fw")))
        .when(tag.isin("PRP", "PRP$"), F.concat(pronoun, F.lit("_fw")))
        .otherwise(F.concat(lemma, F.lit("_fw")))
    )
    return rows.select("doc_id", "sent_id", "pos", item.alias("item")).select(
        "doc_id", "sent_id", "pos", F.when(F.col("item").endswith("_fw"), "function").otherwise("content").alias("class"), "item"
    )


def mtld_wrap(w: list[str], threshold: float = THRESHOLD, least: int = 10) -> float:
    """Moving-average MTLD: from every word on, the words until the ratio falls under the threshold, going on at the start; their mean.

    A start whose segment never closes within one turn gives no length; segments shorter than `least` are extended.
    """
    n = len(w)
    if not n:
        return 0.0
    # All starts go forward together: a word is new in a segment if it was last met before the segment's start.
    code: dict[str, int] = {}
    twice = np.array([code.setdefault(x, len(code)) for x in w] * 2)
    order = np.argsort(twice, kind="stable")
    last = np.full(2 * n, -1)
    same = twice[order[1:]] == twice[order[:-1]]
    last[order[1:][same]] = order[:-1][same]
    start, seen = np.arange(n), np.zeros(n, np.int64)
    total = closed = 0
    for size in range(1, n + 1):
        seen += last[start + size - 1] < start
        if size >= least:
            done = seen / size < threshold
            if done.any():
                closed += int(done.sum())
                total += size * int(done.sum())
                start, seen = start[~done], seen[~done]
                if not len(start):
                    break
    return total / closed if closed else 0.0


@F.pandas_udf(DoubleType())
def _wrap(joined: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in joined:
        yield pd.Series([mtld_wrap(x.split(" ")) if x else 0.0 for x in part], dtype="float64")


def _maas(n: Column, t: Column) -> Column:
    """Maas index to the base 10; 0 where all words differ."""
    return F.when(n > t, F.try_divide(F.log10(n) - F.log10(t), F.log10(n) ** 2)).otherwise(0.0)


def taaled_indices(classified: DataFrame, wrap: bool = True) -> DataFrame:
    """Output of classify() to (doc_id, *NAMES); wrap=False leaves out the two moving indices and with them the Python pass."""
    n, t, m, u = (F.col(c).cast("double") for c in ("_n", "_t", "_m", "_u"))
    indices = [
        F.coalesce(F.try_divide(t, F.sqrt(n)), F.lit(0.0)).alias("TAALED_TTR_AW"), _maas(n, t).alias("TAALED_MAAS_TTR_AW"),
        F.when(m > 0, _maas(m, u)).otherwise(0.0).alias("TAALED_MAAS_TTR_CW"), F.col("_m").alias("TAALED_BASIC_NCONTENT_TOKENS"), (F.col("_t") - F.col("_u")).alias("TAALED_BASIC_NFUNCTION_TYPES"),
    ]
    if not wrap:
        # Counted by item first: an item is of one class, so that types are rows and no distinct count expands the tokens.
        content = F.col("class") == "content"
        items = classified.groupBy("doc_id", "class", "item").agg(F.count("*").alias("f"))
        zero = F.lit(0).cast("long")
        sums = items.groupBy("doc_id").agg(
            F.sum("f").alias("_n"), F.count("*").alias("_t"), F.coalesce(F.sum(F.when(content, F.col("f"))), zero).alias("_m"), F.count_if(content).alias("_u")
        )
        return sums.select("doc_id", *indices)
    words = classified.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "pos", "item"))).alias("_w")).select("doc_id", F.col("_w.item").alias("_w"))
    rows = words.select("doc_id", "_w", F.filter("_w", lambda x: ~x.endswith("_fw")).alias("_c"))
    size = lambda c: F.size(c).cast("long")
    rows = rows.select(
        "doc_id", size("_w").alias("_n"), size(F.array_distinct("_w")).alias("_t"), size("_c").alias("_m"), size(F.array_distinct("_c")).alias("_u"),
        _wrap(F.array_join("_w", " ")).alias("TAALED_MTLD_MA_WRAP_AW"), _wrap(F.array_join("_c", " ")).alias("TAALED_MTLD_MA_WRAP_CW"),
    )
    return rows.select("doc_id", *indices, "TAALED_MTLD_MA_WRAP_AW", "TAALED_MTLD_MA_WRAP_CW").select("doc_id", *NAMES)
