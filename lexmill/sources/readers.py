"""Readers. Every one declares its schema or columns; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.python_text import unescape_html
from lexmill.functions.text import frequency, graded, html_text, one_line, plain_essay, without_tags
from lexmill.operators.curation import LEVELS

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV file as strings."""
    return spark.read.options(**_CSV).csv(path)


def graded_csv(spark: SparkSession, path: str, essay: str = "Essay", grade: str = "Vocab_Grade_AVG", level: str | None = "Level", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(text, grade, level): rows with a text, a grade that is a number, and a listed level; line breaks become blanks.

    A grade that begins as a number but is none is dropped. level=None leaves the level out.
    """
    rows = csv_rows(spark, path).where((F.col(essay) != "") & graded(F.col(grade)))
    if level is not None:
        rows = rows.where(F.col(level).isin(*levels))
    out = rows.select(one_line(F.col(essay)).alias("text"), F.col(grade).try_cast("double").alias("grade"), *([F.col(level).alias("level")] if level else []))
    return out.where("grade IS NOT NULL")


def text_and_grade_csv(spark: SparkSession, path: str, text: str = "Essay", grade: str = "Level") -> DataFrame:
    return graded_csv(spark, path, text, grade, level=None)


def essay_csv(spark: SparkSession, path: str, essay: str = "Essay") -> DataFrame:
    return csv_rows(spark, path).select(one_line(F.col(essay)).alias("text"))


def writings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(level, grade, text, file) of every <writing> of one or more XML files; entities are decoded twice, as the files hold them so.

    Writings without a text are left out; a missing grade is null.
    """
    rows = spark.read.format("xml").option("rowTag", "writing").schema("grade STRING, level STRING, text STRING").load(paths)
    return rows.where("text IS NOT NULL").select("level", F.col("grade").try_cast("int").alias("grade"), unescape_html(F.col("text")).alias("text"), F.input_file_name().alias("file"))


def first_writings(spark: SparkSession, paths: str | list[str], per_file: int) -> DataFrame:
    """writings(), at most the first so many of each file. A file is read whole, by one task, and its elements are numbered in it,
    so that the order is the file's however many executors there are. Empty files give no rows."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_extract_all("value", F.lit("(?s)<writing[ >].*?</writing>"), F.lit(0)).alias("_w"))
    parts = files.select("file", F.explode(F.slice(F.filter("_w", lambda x: x.rlike("<text[ >]")), 1, per_file)).alias("_x"))
    value = lambda tag: F.nullif(F.regexp_extract("_x", f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1), F.lit(""))
    return parts.select(value("level").alias("level"), value("grade").try_cast("int").alias("grade"), unescape_html(unescape_html(value("text"))).alias("text"), "file")


def writings_by_level(spark: SparkSession, folder: str) -> DataFrame:
    """writings() of all files level_X.xml of a folder, with X as the level."""
    rows = writings(spark, f"{folder}/level_*.xml")
    return rows.withColumn("level", F.regexp_extract("file", "level_([^/.]+)[.]xml", 1))


def plain_essays(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text): one essay a .txt file, paired tags and the literals URL and FORMULA removed."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.input_file_name().alias("file"), plain_essay(F.col("value")).alias("text"))


def html_essays(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text): one essay an HTML file; the name is the file's up to the first underscore."""
    rows = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    file = F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.select(F.substring_index(file, "_", 1).alias("name"), unescape_html(html_text(F.col("value"))).alias("text"))


def untagged(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn(text, without_tags(F.col(text)))


def word_list(spark: SparkSession, path: str, column: str = "Word") -> DataFrame:
    return csv_rows(spark, path).select(F.lower(F.trim(F.col(column))).alias("word")).where("word <> ''")


def ranked_list(spark: SparkSession, path: str, word: str = "word", tag: str = "SpaCy tag", freq: str = "COCA-Acad") -> DataFrame:
    """(rank, word, tag, freq) of a list in rank order: by its column `rank` where there is one (counted from 1), or else as it stands in
    its one file, which is read as one split for that. Lists of words are small; a folder of several files needs the column."""
    rows = csv_rows(spark, path)
    if "rank" in rows.columns and "rank" not in (word, tag, freq):
        at = F.col("rank").cast("long") - 1
    else:
        rows, at = rows.coalesce(1), F.monotonically_increasing_id()
    rows = rows.select(at.alias("rank"), F.col(f"`{word}`").alias("word"), F.col(f"`{tag}`").alias("tag"), frequency(F.col(f"`{freq}`")).alias("freq"))
    return rows


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(word): one word a line."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(key, vec) of a text file of a word and its coefficients a line."""
    parts = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.get(parts, F.lit(0)).alias("key"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vec"))


def spelling_variants(spark: SparkSession, path: str) -> DataFrame:
    """(rank, british, american)"""
    return csv_rows(spark, path).coalesce(1).select(F.monotonically_increasing_id().alias("rank"), F.col("British").alias("british"), F.col("American").alias("american"))


def threshold_xml(spark: SparkSession, path: str) -> DataFrame:
    """(level, feature_index, mean, std); the level is taken from names like bin_values_level_a1.xml."""
    rows = spark.read.format("xml").option("rowTag", "feature").schema("feature_index INT, mean DOUBLE, std DOUBLE").load(path)
    return rows.select(F.nullif(F.regexp_extract(F.input_file_name(), "level_([^/._]+)", 1), F.lit("")).alias("level"), "feature_index", "mean", "std")


def threshold_json(spark: SparkSession, path: str) -> DataFrame:
    """(feature, mean, std) of a JSON object {"mean": {feature: v}, "std": {feature: v}}."""
    row = spark.read.option("multiLine", True).schema("mean MAP<STRING, DOUBLE>, std MAP<STRING, DOUBLE>").json(path)
    return row.select(F.explode("mean").alias("feature", "mean"), "std").select("feature", "mean", F.element_at("std", F.col("feature")).alias("std"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """The collocation graph as a table: one row an edge. The table stands in for a graph server; all lookups are one step."""
    return spark.read.schema("lempos1 STRING, lempos2 STRING, type STRING, metric DOUBLE, raw_freq LONG").parquet(path)


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lemma STRING, pos STRING, synonym STRING").parquet(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
