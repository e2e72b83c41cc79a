"""Synonyms and how well they fit a context."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import cosine_distance
from lexmill.operators.models import with_prediction

#: Score under which a synonym is not offered. Fixed value.
OFFERED = 0.3
#: The four scores of a pair.
SCORES = ("add", "bal_add", "mult", "bal_mult")


def american(words: DataFrame, mapping: DataFrame, word: str = "word") -> DataFrame:
    """words with `american`: the first American form of a British word, else the word. mapping(rank, british, american)."""
    first = mapping.groupBy(F.col("british").alias(word)).agg(F.min_by("american", "rank").alias("american"))
    return words.join(first, word, "left").withColumn("american", F.coalesce("american", word))


def marked_target(sentence: Column) -> Column:
    """(before, target, after) of a sentence whose target word stands between two marks of the letters c and s with caron."""
    mark = "čš"
    pattern = f"^(.*?){mark}(.*?){mark}(.*)$"
    return F.struct(*(F.regexp_extract(sentence, pattern, i).alias(k) for i, k in ((1, "before"), (2, "target"), (3, "after"))))


def related(relations: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """(word, related) along relations(source, target) up to `depth` steps; depth 0 gives nothing."""
    step = relations.select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    found = near = start.select("word", F.col("word").alias("related"))
    for _ in range(depth):
        near = near.join(step, F.col("related") == F.col("_s")).select("word", F.col("_t").alias("related")).distinct()
        found = found.unionByName(near).distinct()
    return found.where("word <> related")


def candidates(targets: DataFrame, *sources: DataFrame) -> DataFrame:
    """targets(lemma, american, pos) and synonym tables (lemma, pos, synonym) to (lemma, pos, synonym): distinct, for both spellings, without the lemma."""
    keys = targets.select("lemma", "pos", F.explode(F.array_distinct(F.array("lemma", "american"))).alias("_key"))
    all_ = sources[0].select("lemma", "pos", "synonym")
    for s in sources[1:]:
        all_ = all_.union(s.select("lemma", "pos", "synonym"))
    found = keys.join(all_.withColumnRenamed("lemma", "_key"), ["_key", "pos"])
    return found.where(F.col("synonym") != F.col("lemma")).select("lemma", "pos", "synonym").distinct()


def contexts(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent_id, pos, context): for each token its head, as <dep>I_<word>, and its dependents, as <dep of the token>_<word>.

    A token table with the columns of the heads (annotate(heads=True)) is only projected; another one is joined with itself.
    """
    if "head_lower" in tokens.columns:
        t = tokens.where("head_pos <> pos AND head_lower IS NOT NULL")
        one = F.struct("pos", F.concat(F.lower("dep"), F.lit("I_"), F.col("head_lower")).alias("context"))
        two = F.struct(F.col("head_pos").alias("pos"), F.concat(F.lower("head_dep"), F.lit("_"), F.col("lower")).alias("context"))
        return t.select("doc_id", "sent_id", F.explode(F.array(one, two)).alias("x")).select("doc_id", "sent_id", "x.pos", "x.context")
    t = tokens.select("doc_id", "sent_id", "pos", "dep", "head_pos", "lower")
    heads = t.select("doc_id", "sent_id", F.col("pos").alias("head_pos"), F.col("lower").alias("_h"))
    up = t.where("head_pos <> pos").join(heads, ["doc_id", "sent_id", "head_pos"]).select("doc_id", "sent_id", "pos", F.concat(F.lower("dep"), F.lit("I_"), F.col("_h")).alias("context"))
    below = t.where("head_pos <> pos").select("doc_id", "sent_id", F.col("head_pos").alias("pos"), F.col("lower").alias("_c"))
    down = t.select("doc_id", "sent_id", "pos", "dep").join(below, ["doc_id", "sent_id", "pos"]).select("doc_id", "sent_id", "pos", F.concat(F.lower("dep"), F.lit("_"), F.col("_c")).alias("context"))
    return up.unionByName(down)


def substitutability(pairs: DataFrame, word_vectors: DataFrame, context_vectors: DataFrame) -> DataFrame:
    """pairs(pair, synonym, target, contexts array) to (pair, add, bal_add, mult, bal_mult).

    vectors(key, vec). The four scores combine cosine distances of the synonym to the target and to each context, as sums
    or as geometric means of (distance + 1) / 2; -1 where a word or all contexts have no vector. Contexts without a vector
    are left out.
    """
    sides = word_vectors.select(F.col("key"), F.col("vec"))
    base = pairs.join(sides.toDF("synonym", "_s"), "synonym", "left").join(sides.toDF("target", "_t"), "target", "left")
    base = base.select("pair", "_s", "contexts", cosine_distance(F.col("_s"), F.col("_t")).alias("_d"))
    each = base.select("pair", "_s", F.explode("contexts").alias("key")).join(context_vectors.select("key", "vec"), "key")
    each = each.select("pair", cosine_distance(F.col("_s"), F.col("vec")).alias("_c")).where("_c IS NOT NULL")
    sums = each.groupBy("pair").agg(F.count("*").alias("n"), F.sum("_c").alias("sum"), F.sum(F.ln((F.col("_c") + 1) / 2)).alias("logs"), F.min("_c").alias("least"))
    rows = base.select("pair", "_d").join(sums, "pair", "left")
    n, d, log_d = F.col("n"), F.col("_d"), F.ln((F.col("_d") + 1) / 2)
    zero = (F.col("_d") <= -1) | (F.col("least") <= -1)
    score = lambda value: F.when(F.col("_d").isNull() | n.isNull(), -1.0).otherwise(value)
    power = lambda logs: F.when(zero, 0.0).otherwise(F.exp(logs))
    return rows.select(
        "pair", score((d + F.col("sum")) / (n + 1)).alias("add"), score((n * d + F.col("sum")) / (2 * n)).alias("bal_add"),
        score(power((log_d + F.col("logs")) / (n + 1))).alias("mult"), score(power((n * log_d + F.col("logs")) / (2 * n))).alias("bal_mult"),
    )


def offered(scored: DataFrame, by: list[str], score: str = "score", least: float = OFFERED) -> DataFrame:
    """Synonyms of at least the score, best first within `by`."""
    return scored.where(F.col(score) >= least).orderBy(*by, F.desc(score), "synonym")


def ranked_by_model(scored: DataFrame, model: PipelineModel, by: list[str], least: float = OFFERED) -> DataFrame:
    """substitutability() with a synonym each to the pairs offered, best first within `by`: the score is the model's prediction
    from the four scores, -1 where one of them is missing."""
    return offered(with_prediction(scored, model, "score"), by, least=least)
