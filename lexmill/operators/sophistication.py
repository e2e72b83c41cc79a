"""Lexical sophistication: coverage by word lists and mean list frequencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.lexicon import checked
from lexmill.session import stored

#: Bands of the general ranked list. Fixed values.
BANDS = {"CGA1": (0, 3000), "CGA2": (3000, 6000), "CGA3": (6000, 9000)}
#: Labels of the mean frequencies in the order of the lists they are taken from: academic, technical, general bands 1 to 3.
MEANS = ("LS_FOMN_NG", "LS_FOMN_NA", "LS_FOMN_TC", "LS_FOMN_BS", "LS_FOMN_CA")


def lexical_sophistication(tokens: DataFrame, word_lists: dict[str, DataFrame], ranked: dict[str, DataFrame]) -> DataFrame:
    """tokens to (doc_id, LS_FPC_*, LS_FOMN_*).

    word_lists: NG, NA, TC, BS -> (word); ranked: CA, CT, CG -> (rank, word, tag, freq). Coverage is distinct matches over
    all tokens, repeats and punctuation included; a mean frequency is the sum of a list's frequencies of the matched
    entries (entries listed twice add up) over the distinct matched pairs, 0 without a match. Each document's tokens are
    reduced to distinct pairs of lemma and tag before any list is joined; texts without tokens give no row.
    """
    bag = tokens.groupBy("doc_id", F.lower("lemma").alias("word"), "tag").agg(F.count("*").alias("f"))
    bands = {f"{k}": (r, 0, 2**31 - 1) for k, r in ranked.items() if k != "CG"} | {k: (ranked["CG"], *b) for k, b in BANDS.items()}
    # One lexicon of all lists: a row a word, with the lists that hold it and the frequencies of its tags.
    rows = [t.select("word", F.lit(k).alias("list"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("double").alias("freq")) for k, t in word_lists.items()]
    rows += [t.where((F.col("rank") >= low) & (F.col("rank") < high)).select("word", F.lit(k).alias("list"), "tag", F.col("freq").cast("double").alias("freq")) for k, (t, low, high) in bands.items()]
    lexicon = reduce(DataFrame.union, rows).where("word IS NOT NULL").groupBy("word", "tag").agg(
        *(F.max(F.col("list") == k).alias(f"in_{k}") for k in word_lists), *(F.sum(F.when(F.col("list") == k, F.col("freq"))).alias(f"freq_{k}") for k in bands)
    )
    tags = F.map_from_entries(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("tag", F.struct(*(f"freq_{k}" for k in bands)).alias("f")))))
    lexicon = lexicon.groupBy("word").agg(*(F.max(f"in_{k}").alias(f"in_{k}") for k in word_lists), tags.alias("tags"))
    bag = bag.join(checked(stored(lexicon)), "word", "left").withColumn("_f", F.col("tags")[F.col("tag")])
    # A word is once in a list for a document, whatever its tags: its first tag counts for it.
    first = F.col("tag") == F.col("_first")
    bag = bag.withColumn("_first", F.min("tag").over(Window.partitionBy("doc_id", "word")))
    sums = [F.count_if(F.col(f"in_{k}") & first).alias(f"m_{k}") for k in word_lists]
    sums += [x for k in bands for x in (F.count(F.col(f"_f.freq_{k}")).alias(f"m_{k}"), F.sum(F.col(f"_f.freq_{k}")).alias(f"s_{k}"))]
    out = bag.groupBy("doc_id").agg(F.sum("f").alias("n"), *sums)
    shares = [(F.col(f"m_{k}") / F.col("n")).alias(f"LS_FPC_{k}") for k in [*word_lists, *bands]]
    means = [F.coalesce(F.try_divide(f"s_{k}", f"m_{k}"), F.lit(0.0)).alias(label) for label, k in zip(MEANS, bands)]
    return out.select("doc_id", *shares, *means)


def matched_words(tokens: DataFrame, word_lists: dict[str, DataFrame]) -> DataFrame:
    """tokens and lists (word) by name to (list, doc_id, words): the distinct lemmas of each list that each document holds, sorted.

    Documents without a match in a list give no row for it.
    """
    rows = reduce(DataFrame.union, (t.select("word", F.lit(k).alias("list")) for k, t in word_lists.items()))
    lists = rows.groupBy("word").agg(F.collect_set("list").alias("lists"))  # a word's lists are as many as the lists at most
    found = tokens.select("doc_id", F.lower("lemma").alias("word")).distinct().join(checked(lists), "word")
    found = found.select("doc_id", "word", F.explode("lists").alias("list"))
    return found.groupBy("list", "doc_id").agg(F.array_sort(F.collect_list("word")).alias("words"))


def word_shape(tokens: DataFrame) -> DataFrame:
    """tokens to (doc_id, LD_AVG_CH, LD_NUM_SYLL): mean letters of a lemma and mean vowel groups (an approximation of hyphenation)."""
    t = tokens.where("NOT is_punct")
    return t.groupBy("doc_id").agg(
        F.avg(F.length("lemma")).alias("LD_AVG_CH"), F.avg(F.greatest(F.regexp_count(F.lower("lemma"), F.lit("[aeiouy]+")), F.lit(1))).alias("LD_NUM_SYLL")
    )
