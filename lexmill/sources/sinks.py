"""Writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.collocations import rendered
from lexmill.operators.density import is_lexical


def write_matrix(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """A feature matrix as Parquet or CSV."""
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def write_threshold_json(thresholds: DataFrame, path: str) -> None:
    """thresholds(feature, mean, std) as one JSON object; a few dozen rows."""
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", c)))).alias(c) for c in ("mean", "std")]
    thresholds.agg(*maps).coalesce(1).write.mode("overwrite").json(path)


def write_threshold_xml(thresholds: DataFrame, path: str) -> None:
    """thresholds(feature_index, mean, std) as XML."""
    rows = thresholds.select("feature_index", "mean", "std").orderBy("feature_index").coalesce(1)
    rows.write.mode("overwrite").format("xml").option("rootTag", "features").option("rowTag", "feature").save(path)


def write_writings(rows: DataFrame, path: str) -> None:
    """(level, grade, text, ...) as XML writings with their metadata."""
    rows.write.mode("overwrite").format("xml").option("rootTag", "writings").option("rowTag", "writing").save(path)


def write_frequencies(table: DataFrame, path: str, key: str) -> None:
    """A small frequency table as one CSV file in order of its key."""
    table.orderBy(key).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    options = {"header": True, "quote": '"', "escape": '"', "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode("overwrite").options(**options).csv(path)


def threshold_summary(thresholds: DataFrame) -> DataFrame:
    """(feature, summary): one text block a feature, a line for each level."""
    line = F.concat_ws(" ", "level", F.format_string("%.4f", "mean"), F.format_string("%.4f", "std"), F.format_string("%.4f", F.col("mean") - F.col("std")), F.format_string("%.4f", F.col("mean") + F.col("std")))
    return thresholds.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("summary"))


def diagnostics(tokens: DataFrame, errors: DataFrame, measured: DataFrame, matched: DataFrame, lists: list[str], features: DataFrame) -> DataFrame:
    """One row a document with tokens, for a CSV file: doc_id, spelling_mistakes, collocations, collocation_errors (those without an
    edge), lexical_words, named_entities, number_of_words, <list>_words for each of the lists, and the features.

    errors: spelling_errors(); measured: collocations with_metric(); matched: matched_words(). Words stand in order of the
    text, those of lists sorted; what a document has none of is an empty text.
    """
    place = [F.col(c) for c in ("sent_id", "pos")]

    def joined(value: Column, when: Column | None = None, between: str = ", ", more: tuple = ()) -> Column:
        item = F.struct(*place, *more, value.alias("v"))
        return F.array_join(F.array_sort(F.collect_list(item if when is None else F.when(when, item))).v, between)

    m = F.col("metric")
    parts = [
        tokens.groupBy("doc_id").agg(
            joined(F.col("text"), is_lexical(F.col("upos"), F.col("tag"))).alias("lexical_words"), joined(F.col("text"), F.col("ent_type") != "").alias("named_entities"), F.count("*").alias("number_of_words")
        ),
        errors.groupBy("doc_id").agg(joined(F.col("text")).alias("spelling_mistakes")),
        measured.groupBy("doc_id").agg(
            joined(rendered(measured), m.isNotNull(), ",\n", (F.col("ord"),)).alias("collocations"), joined(rendered(measured), m.isNull(), ",\n", (F.col("ord"),)).alias("collocation_errors")
        ),
        matched.groupBy("doc_id").pivot("list", lists).agg(F.array_join(F.first("words"), ", ")).withColumnsRenamed({k: f"{k.lower()}_words" for k in lists}),
    ]
    texts = ["spelling_mistakes", "collocations", "collocation_errors", "lexical_words", "named_entities"]
    own = [f"{k.lower()}_words" for k in lists]
    out = reduce(lambda a, b: a.join(b, "doc_id", "left"), [*parts, features])
    return out.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in texts), "number_of_words", *(F.coalesce(c, F.lit("")).alias(c) for c in own), *(c for c in features.columns if c != "doc_id"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
