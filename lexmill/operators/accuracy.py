"""Spelling errors, corrections, and the accuracy indices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.python_text import expand_contractions
from lexmill.functions.text import words as words_of
from lexmill.operators.lexicon import checked
from lexmill.session import stored


def spelling_errors(tokens: DataFrame, *dictionaries: DataFrame) -> DataFrame:
    """Tokens of ASCII letters that are no entity and stand in none of the dictionaries (word, lower case)."""
    out = tokens.where((F.col("ent_type") == "") & F.col("text").rlike("^[A-Za-z]+$"))
    for words in dictionaries:
        out = out.join(checked(words.select(F.col("word").alias("lower"))), "lower", "left_anti")
    return out


def lexical_accuracy(tokens: DataFrame, *dictionaries: DataFrame) -> DataFrame:
    """tokens to (doc_id, LA_E, LA_ER): spelling errors, and their share of all tokens."""
    wrong = (F.col("ent_type") == "") & F.col("text").rlike("^[A-Za-z]+$")
    rows = tokens.select("doc_id", "lower", wrong.alias("_wrong"))
    for i, words in enumerate(dictionaries):
        known = checked(words.select(F.col("word").alias("lower"), F.lit(True).alias(f"_in{i}")).distinct())
        rows = rows.join(known, "lower", "left").withColumn("_wrong", F.col("_wrong") & F.col(f"_in{i}").isNull()).drop(f"_in{i}")
    e = F.count_if("_wrong")
    return rows.groupBy("doc_id").agg(e.alias("LA_E"), (e / F.count("*")).alias("LA_ER"))


def _deletions(word: str, letters: int = 1) -> F.Column:
    """The word and all it becomes by losing up to so many letters."""
    out = F.array(F.col(word))
    for _ in range(letters):
        less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, less))))
    return out


def _swaps(word: str) -> str:
    """The word with each two neighbouring letters swapped, as SQL."""
    return f"transform(sequence(1, greatest(length({word}) - 1, 1)), i -> concat(substr({word}, 1, i - 1), substr({word}, i + 1, 1), substr({word}, i, 1), substr({word}, i + 2)))"


def corrections(wrong: DataFrame, dictionary: DataFrame, edits: int = 2) -> DataFrame:
    """(word) and dictionary(word, freq) to (word, best): the nearest entry within `edits`, of those the most frequent, ties by word.

    An edit is a letter more, less or another, or two neighbours swapped; with edits = 1 the swap is left out (Levenshtein
    distance one). Words within so many edits share the word or one of its deletions, so the search is an equi-join over
    deletions. Words without such an entry give no row; those longer than any entry and its edits are not looked up.
    """
    longest = dictionary.agg(F.max(F.length("word")).alias("_most"))
    left = wrong.select("word").distinct().crossJoin(F.broadcast(longest)).where(F.length("word") <= F.col("_most") + edits)  # one row
    left = left.select("word", F.explode(_deletions("word", edits)).alias("_key"))
    right = dictionary.select(F.col("word").alias("best"), "freq").select("best", "freq", F.explode(_deletions("best", edits)).alias("_key"))
    near = left.join(right, "_key").where(F.col("word") != F.col("best"))
    if edits > 1:
        near = near.select("word", "best", "freq").distinct()
        near = near.withColumn("_d", F.expr(f"""CASE WHEN levenshtein(word, best) = 1 OR array_contains({_swaps("word")}, best) THEN 1 WHEN levenshtein(word, best) = 2
          OR exists({_swaps("word")}, x -> levenshtein(x, best) = 1) OR exists({_swaps("best")}, x -> levenshtein(word, x) = 1) OR arrays_overlap({_swaps("word")}, {_swaps("best")}) THEN 2 END""")).where("_d IS NOT NULL")
    else:
        near = near.where(F.levenshtein("word", "best") == 1).withColumn("_d", F.lit(1))
    return near.groupBy("word").agg(F.min_by("best", F.struct("_d", -F.col("freq"), F.col("best"))).alias("best"))


def correct_spelling(texts: DataFrame, best: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """texts to (key, text): every blank-parted word that has a correction is replaced; each word is followed by a blank."""
    words = texts.select(F.col(key), F.posexplode(F.split(text, " ")).alias("_at", "_w")).join(best.select(F.col("word").alias("_w"), "best"), "_w", "left")
    rows = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("best", "_w").alias("_w")))).alias("_all"))
    return rows.select(key, F.concat(F.array_join(F.transform("_all", lambda x: x["_w"]), " "), F.lit(" ")).alias("text"))


def preprocessed(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """texts to (key, text) as collocations are looked for in: contractions expanded, then misspelt words replaced.

    A word is a run of letters, whatever stands around it; one that is not in the dictionary (word, lower case) becomes its
    correction, with a capital where it had one. Candidates are weighed by their occurrences in the texts. Words without a
    correction stay, and so does all that parts words. A repeated key gives its texts again; null texts stay null.
    """
    rows = stored(texts.select(F.col(key), expand_contractions(F.col(text)).alias("text")))
    each = rows.select(key, F.explode(words_of(F.col("text"))).alias("word"))
    counts = stored(each.groupBy("word").agg(F.count("*").alias("freq")))
    known = dictionary.select("word").distinct()
    best = stored(corrections(counts.join(known, "word", "left_anti"), known.join(counts, "word", "left").select("word", F.coalesce("freq", F.lit(0)).alias("freq"))))
    swaps = each.join(best, "word").distinct().groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("word", "best"))).alias("_swaps"))
    low, first = lambda x: F.lower(x), lambda x: F.substring(x, 1, 1)

    def swapped(x: F.Column) -> F.Column:
        new = F.element_at("_swaps", low(x))
        return F.coalesce(F.when(first(x) == low(first(x)), new).otherwise(F.concat(F.upper(first(new)), F.substring(new, F.lit(2), F.length(new)))), x)

    runs = F.regexp_extract_all("text", F.lit("\\p{L}+|\\P{L}+"), F.lit(0))
    changed = F.when(F.col("_swaps").isNull(), F.col("text")).otherwise(F.array_join(F.transform(runs, swapped), ""))
    return rows.join(swaps, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, changed.alias("text"))
