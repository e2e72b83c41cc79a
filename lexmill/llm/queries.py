"""Queries of the nine problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import folded_name, level_name, typed_number
from lexmill.llm.consensus import Consensus, krippendorff
from lexmill.llm.mixing import Mix
from lexmill.llm.near_duplicates import NearDuplicates
from lexmill.llm.packing import pack
from lexmill.llm.quality import quality
from lexmill.llm.readability import band_number, reading_levels
from lexmill.llm.sampling import proportional_sample, usable_cells
from lexmill.llm.spam import spam_pages
from lexmill.llm.splits import author_groups, split_groups, split_report
from lexmill.llm._tokens import token_count
from lexmill.session import ship, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    """Runs of three words, half of which are shared, in essays of 20 words or more (TESTDATA.md)."""
    return NearDuplicates(table(spark, sf_dir, "flip_final"), "id", "essay", words=3, threshold=0.5, least=20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).pairs().select("id_a", "id_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).groups()


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between the smallest ids of different texts: what p1_found holds, copies aside."""
    return _near(spark, sf_dir).representatives()[0].select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the smallest id of their text, of texts that have a copy or a link."""
    return _near(spark, sf_dir).representatives()[1]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays of which less than half is running prose, by the learned rules."""
    return quality(table(spark, sf_dir, "flip_final")).where("kind = 'junk'").select("id").distinct()


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "flip_final"))
    shares = ("word_length", "symbol_share", "ended_lines", "function_share", "clause_share")
    return out.select("id", F.col("words").cast("long").alias("words"), F.col("lines").cast("long").alias("lines"), *(F.round(c, 6).alias(c) for c in shares), "kind").distinct()


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "flip_final")
    used = ("words", "english_share", "german_share", "sentences", "letters", "syllables", "many_syllables", "long_words", "kind")
    key = F.struct("id", F.substring(level_name(F.col("level")), 1, 2).alias("level"))
    figures = quality(records.select(key.alias("key"), "essay"), "key").select("key.id", "key.level", *used)
    return reading_levels(stored(figures))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose text is typical of a band two or more steps from that of their level."""
    return _levels(spark, sf_dir).where(F.abs(band_number(F.col("text_band")) - band_number(F.col("level"))) >= 2).select("id").distinct()


def p3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _levels(spark, sf_dir).where("text_band IS NOT NULL")
    grades = ("words_per_sentence", "flesch_kincaid", "fog", "smog", "coleman_liau", "automated", "lix")
    return out.select("id", "level", *(F.round(c, 3).alias(c) for c in (*grades, "reading_ease", "sentence_words")), "text_band").distinct()


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by level and band of their text."""
    return p3_levels(spark, sf_dir).groupBy("level", "text_band").agg(F.count_distinct("id").alias("n"))


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(patterns with their number of records, records with their pattern): vocabulary grades of both graders."""
    graders = table(spark, sf_dir, "graders").select(folded_name("grader_name").alias("_key"), "grader_name")
    graders = graders.where("_key <> ''").groupBy("_key").agg(F.min("grader_name").alias("grader_name"))
    wide = table(spark, sf_dir, "flip_final").select("id", *(c for n in ("1st", "2nd") for c in (f"graded_by_{n}", f"vocab_grade_{n}")))
    ends = []
    for n in ("1st", "2nd"):
        name = F.regexp_replace(folded_name(f"graded_by_{n}"), "\\s*(\\(.*\\)|[.,;])$", "")
        grade = typed_number(F.col(f"vocab_grade_{n}"))
        ends += [name.alias(f"r{n}"), F.when((grade >= 0) & (grade <= 4) & (grade == F.floor(grade)), grade.cast("int")).alias(f"l{n}")]
    rows = wide.where("id IS NOT NULL").select("id", *ends).dropDuplicates(["id"])
    # A hash passes over nulls, so that they need a stand-in to tell the first grading from the second.
    pattern = F.xxhash64(*(F.coalesce(F.col(f"{c}{n}").cast("string"), F.lit("?")) for n in ("1st", "2nd") for c in "rl"))
    rows = rows.withColumn("item", pattern)
    counted = rows.groupBy("item", "r1st", "l1st", "r2nd", "l2nd").agg(F.count("*").alias("weight"))
    long = counted.select(
        "item", "weight",
        F.explode(F.array(F.struct(F.col("r1st").alias("_key"), F.col("l1st").alias("label")), F.struct(F.col("r2nd").alias("_key"), F.col("l2nd").alias("label")))).alias("x"),
    ).select("item", "weight", "x._key", "x.label").where("label IS NOT NULL")
    named = long.join(graders, "_key").select("item", F.col("grader_name").alias("rater"), "label", "weight")
    return named, rows.select("id", "item")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graders whose grades do not rise with the others': the 95 % interval of their slope on the true class lies wholly below one half."""
    labels, _ = _labels(spark, sf_dir)
    return Consensus(labels, 5).reliability().where("slope_high < 0.5").select(F.col("rater").alias("grader_name"))


def p4_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, _ = _labels(spark, sf_dir)
    out = Consensus(labels, 5).reliability()
    return out.select("rater", "n", *(F.round(c, 4).alias(c) for c in out.columns[2:]))


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, records = _labels(spark, sf_dir)
    agreed = Consensus(labels, 5).consensus()
    return records.join(agreed, "item").select("id", F.col("label").alias("consensus"), F.round("confidence", 4).alias("confidence"))


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, _ = _labels(spark, sf_dir)
    out = krippendorff(labels)
    return out.select("items", "pairable", F.round("alpha_nominal", 6).alias("alpha_nominal"), F.round("alpha_interval", 6).alias("alpha_interval"))


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets, records = table(spark, sf_dir, "sample_targets"), table(spark, sf_dir, "flip_final")
    # The number of rows, repeated ones among them, bounds that of the usable records; Parquet tells it without reading a column.
    return proportional_sample(usable_cells(records, targets), targets, most=records.count())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose drawn sample falls short of their quota."""
    return _sample(spark, sf_dir)[1].where("exhausted").select("level", "vocab_band")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[0]


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir)[1]


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_groups(*(table(spark, sf_dir, t) for t in ("flip_final", "students", "course_accounts")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


def _labelled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a known author with the band of their level."""
    levels = table(spark, sf_dir, "flip_final").select("id", F.substring(level_name(F.col("level")), 1, 2).alias("label"))
    levels = levels.groupBy("id").agg(F.max("label").alias("label"))
    return stored(_groups(spark, sf_dir).join(levels, "id"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a known author, by group, stratified by the band of their level."""
    return split_groups(_labelled_groups(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the splits and how far their bands are from those of all records."""
    groups, targets = _labelled_groups(spark, sf_dir), table(spark, sf_dir, "split_targets")
    return split_report(split_groups(groups, targets), groups, targets)


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"))


def _capacity(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "packing_spec").agg(F.min("capacity_tokens")).first()[0]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose pieces lie in more than one container."""
    packed = pack(_sizes(spark, sf_dir), _capacity(spark, sf_dir)).groupBy("doc_id").agg(F.min("container").alias("low"), F.max("container").alias("high"))
    return packed.where("low < high").select("doc_id")


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), _capacity(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = _capacity(spark, sf_dir)
    used = pack(_sizes(spark, sf_dir), capacity).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return used.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * F.lit(capacity)), 6).alias("fill"),
    )


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose copies fall short of their share though each document is repeated as often as it may be."""
    return _mix(spark, sf_dir).report().where("NOT reachable").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).copies()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents")).where("is_spam").select("doc_id").distinct()


def p9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}
