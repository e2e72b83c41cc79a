"""Texts with a part left out, and what that does to a score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lexmill.functions.text import sentences
from lexmill.session import stored

#: Tokens of a clause. Fixed value.
CLAUSE = 6
#: Parts of speech whose repetitions are replaced, and synonyms of a lemma that a document gets at first.
CONTENT, FIRST = ("NOUN", "VERB", "ADJ", "ADV"), 20


def leave_one_out(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_id, text): for each sentence the text of the others; a text of n sentences gives n rows, null and blank ones none.

    The result is as large as the texts times their sentences by definition; rows are made in place, without a shuffle.
    """
    rows = texts.select(F.col(key), sentences(F.col(text)).alias("_s"))
    rows = rows.where(F.size("_s") > 0).select(key, "_s", F.explode(F.sequence(F.lit(0), F.size("_s") - 1)).alias("sent_id"))
    return rows.select(key, "sent_id", F.array_join(F.filter("_s", lambda x, i: i != F.col("sent_id")), " ").alias("text"))


def clauses(texts: DataFrame, key: str = "doc_id", text: str = "text", size: int = CLAUSE) -> DataFrame:
    """(key, sent_id, clause_id, clause): whole groups of `size` blank-parted tokens of each sentence.

    Sentences shorter than that give one row with clause_id -1 and no clause.
    """
    rows = texts.select(F.col(key), F.posexplode(sentences(F.col(text))).alias("sent_id", "_s")).withColumn("_w", F.split("_s", " +"))
    n = F.floor(F.size("_w") / size).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array(F.lit(-1)))
    rows = rows.select(key, "sent_id", "_w", F.explode(ids).alias("clause_id"))
    return rows.select(key, "sent_id", "clause_id", F.when(F.col("clause_id") >= 0, F.array_join(F.slice("_w", F.col("clause_id") * size + 1, F.lit(size)), " ")).alias("clause"))


def clause_mutations(texts: DataFrame, key: str = "doc_id", text: str = "text", size: int = CLAUSE) -> DataFrame:
    """(key, sent_id, clause_id, text): the text with one sentence replaced by one of its clauses; no text for short sentences.

    A full stop follows every clause but the last of its sentence.
    """
    parts = clauses(texts, key, text, size)
    last = F.max("clause_id").over(Window.partitionBy(key, "sent_id"))
    parts = parts.withColumn("_c", F.concat("clause", F.when(F.col("clause_id") < last, ".").otherwise("")))
    all_ = texts.select(F.col(key), sentences(F.col(text)).alias("_s"))
    joined = parts.join(all_, key)
    new = F.array_join(F.transform("_s", lambda x, i: F.when(i == F.col("sent_id"), F.col("_c")).otherwise(x)), "")
    return joined.select(key, "sent_id", "clause_id", F.when(F.col("clause_id") >= 0, new).alias("text"))


def rank_sentences(texts: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", worst: int | None = None) -> DataFrame:
    """(key, sent_id, score_diff, rank): score of the text less that without the sentence, lowest first.

    score: DataFrame(key, text) -> DataFrame(key, score). worst keeps the first so many sentences of each text.
    """
    base = score(texts.select(key, text).withColumnRenamed(text, "text")).withColumnRenamed("score", "_base")
    less = leave_one_out(texts, key, text).withColumn("_id", F.struct(key, "sent_id"))
    scored = score(less.select(F.col("_id").alias(key), "text")).select(F.col(f"{key}.{key}").alias(key), F.col(f"{key}.sent_id").alias("sent_id"), "score")
    rows = scored.join(base, key).select(key, "sent_id", (F.col("_base") - F.col("score")).alias("score_diff"))
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("score_diff", "sent_id")))
    return out if worst is None else out.where(F.col("rank") <= worst)


def revise(tokens: DataFrame, synonyms: DataFrame, first: int = FIRST) -> DataFrame:
    """(doc_id, text): all but the last occurrence of each repeated content lemma replaced by synonyms not used in the text so far.

    synonyms(lemma, synonym, score), best first, ties by synonym. A document's choices depend on one another, so each is
    revised as a whole in Python; its synonyms arrive beside its tokens, so that nothing but the document is held. A
    document gets the `first` synonyms of each lemma that it repeats; where they run out it is revised again with more of
    those, until none is short that has more. So the result is that of all synonyms, and `first` is only a measure of effort.
    """
    best = synonyms.groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("synonym")))).alias("_y"))
    best = stored(best.select("lemma", F.array_distinct(F.transform("_y", lambda x: x["synonym"])).alias("_y")))
    tokens = stored(tokens.select("doc_id", "sent_id", "pos", "text", "lemma", "is_punct", (F.col("upos").isin(*CONTENT) & ~F.col("in_coref")).alias("open")))
    docs = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "pos", "text", "lemma", "open", "is_punct"))).alias("w"))
    need = tokens.where("open").groupBy("doc_id", "lemma").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "lemma", F.lit(first).alias("k"))
    done = []
    while True:
        need = stored(need)
        given = need.join(best, "lemma").select("doc_id", F.struct("lemma", F.slice("_y", F.lit(1), F.col("k")).alias("y"), (F.size("_y") > F.col("k")).alias("more")).alias("s"))
        given = given.groupBy("doc_id").agg(F.collect_list("s").alias("s"))
        at = docs.join(given, "doc_id", "left") if not done else docs.join(given, "doc_id")
        made = stored(at.select("doc_id", _rewrite("w", "s").alias("r")).select("doc_id", "r.*"))
        done.append(made.where(F.size("short") == 0).select("doc_id", "text"))
        short = made.where(F.size("short") > 0).select("doc_id", "short")
        if short.isEmpty():
            return reduce(DataFrame.unionByName, done)
        need = need.join(short, "doc_id").select("doc_id", "lemma", F.when(F.array_contains("short", F.col("lemma")), F.col("k") * 8).otherwise(F.col("k")).cast("int").alias("k"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("short", ArrayType(StringType()))]))
def _rewrite(words: pd.Series, synonyms: pd.Series) -> pd.DataFrame:
    """The revised text, and the lemmas whose synonyms ran out though there are more."""
    out = []
    for doc, given in zip(words, synonyms):
        used = {w["text"].lower() for w in doc}
        more = {} if given is None else {g["lemma"]: g["more"] for g in given}
        offers = {} if given is None else {g["lemma"]: iter(g["y"]) for g in given}
        left = Counter(w["lemma"] for w in doc if w["open"])
        short, text = set(), ""
        for w in doc:
            new = w["text"]
            if w["open"] and left[w["lemma"]] > 1:
                # What is passed over is used in this text, now and later on, so the offers are gone through once.
                pick = next((y for y in offers.get(w["lemma"], ()) if y.lower() not in used), None)
                if pick is not None:
                    used.add(pick.lower())
                    new = pick
                    left[w["lemma"]] -= 1
                elif more.get(w["lemma"]):
                    short.add(w["lemma"])
            text += new if not text or w["is_punct"] else " " + new
        out.append((text, sorted(short)))
    return pd.DataFrame(out, columns=["text", "short"])
