"""Repeated content words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import stored


def repetitions(tokens: DataFrame) -> DataFrame:
    """tokens with is_repetition: the lemma occurs more than once in the document among words that are neither stop words nor coreferent.

    Punctuation takes part in the counts but is never flagged.
    """
    counted = ~F.col("is_stop") & ~F.col("in_coref")
    times = F.count_if(counted).over(Window.partitionBy("doc_id", F.lower("lemma")))
    return tokens.withColumn("is_repetition", counted & ~F.col("is_punct") & (times > 1))


def repetition_cells(tokens: DataFrame) -> DataFrame:
    """tokens to (doc_id, sent_id, word, repeated): lemmas of each sentence and how many of their tokens are repetitions, as in repetitions().

    Four narrow columns are shuffled once, by document; what follows keeps to that partitioning.
    """
    counted = ~F.col("is_stop") & ~F.col("in_coref")
    rows = tokens.select("doc_id", "sent_id", F.lower("lemma").alias("word"), counted.alias("_c"), (counted & ~F.col("is_punct")).alias("_r")).repartition("doc_id")
    rows = rows.groupBy("doc_id", "sent_id", "word").agg(F.count_if("_c").alias("_c"), F.count_if("_r").alias("_r"))
    times = F.sum("_c").over(Window.partitionBy("doc_id", "word"))
    return rows.select("doc_id", "sent_id", "word", F.when(times > 1, F.col("_r")).otherwise(0).alias("repeated"))


def repetition_counts(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """repetition_cells() to (per document, per sentence): repeated tokens and distinct repeated lemmas; sentences without repetition have zeros."""
    rep = F.sum("repeated").alias("repeated")
    sents = cells.groupBy("doc_id", "sent_id").agg(rep, F.count_if(F.col("repeated") > 0).alias("repeated_words"))
    words = cells.groupBy("doc_id", "word").agg(F.sum("repeated").alias("repeated"))
    return words.groupBy("doc_id").agg(rep, F.count_if(F.col("repeated") > 0).alias("repeated_words")), sents


def repetition_statistics(tokens: DataFrame) -> DataFrame:
    """tokens to (scope, n, mean, min, max, median, zeros_percent) for essays and sentences, tokens and words; token counts of sentences leave zeros out."""
    docs, sents = repetition_counts(stored(repetition_cells(tokens)))
    scopes = lambda rows, name, tokens: rows.select(F.explode(F.array(
        F.when(tokens, F.struct(F.lit(name).alias("scope"), F.col("repeated").alias("v"))), F.struct(F.lit(f"{name}_words").alias("scope"), F.col("repeated_words").alias("v"))
    )).alias("x")).where("x IS NOT NULL").select("x.scope", "x.v")
    rows = scopes(docs, "essay", F.lit(True)).unionByName(scopes(sents, "sentence", F.col("repeated") > 0))
    return rows.groupBy("scope").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile("v", F.lit(0.5)).alias("median"),
        (100.0 * F.count_if(F.col("v") == 0) / F.count("*")).alias("zeros_percent"),
    )


def substitution_candidates(tokens: DataFrame) -> DataFrame:
    """(doc_id, lemma, n): content lemmas outside coreference that a document has more than once, the most frequent first."""
    rows = tokens.where(F.col("upos").isin("NOUN", "VERB", "ADJ", "ADV") & ~F.col("in_coref")).groupBy("doc_id", F.lower("lemma").alias("lemma")).agg(F.count("*").alias("n"))
    return rows.where("n > 1").orderBy("doc_id", F.desc("n"), "lemma")
