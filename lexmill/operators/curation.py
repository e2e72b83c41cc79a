"""Choosing, joining and reshaping corpora."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels that the graded reader keeps by default. Fixed values.
LEVELS = ("A1.1", "A1.2", "A2.1", "B1.1", "B1.2", "B2.1", "C1.1")


def within(rows: DataFrame, **ranges: tuple[float | None, float | None]) -> DataFrame:
    """Rows whose columns lie within the ranges, either end open if None."""
    for c, (low, high) in ranges.items():
        if low is not None:
            rows = rows.where(F.col(c) >= low)
        if high is not None:
            rows = rows.where(F.col(c) <= high)
    return rows


def is_outlier(length: Column, hdd: Column, mattr: Column, duga: Column) -> Column:
    return (length < 5) | (length > 600) | (hdd == 0) | (mattr > 2) | (duga > 300)


def dataset(rows: DataFrame, text: str, graded: tuple[str, ...], session: str, without: tuple[str, ...]) -> DataFrame:
    """Rows with a text and every grade, none of the sessions `without`; null texts, sessions and grades are no rows of it."""
    for c in (text, *graded):
        rows = rows.where(F.col(c) != "")
    return rows.where(~F.col(session).isin(*without))


def positional_split(rows: DataFrame, order: str, held_out: int) -> DataFrame:
    """rows with part: 'test' for the last `held_out` rows in order of a unique key, 'train' for those before; null keys come first.

    Only the held-out rows are sorted out, as a top-k; the key of the first of them divides the rest. No more rows than
    held_out are all 'test'.
    """
    first = rows.orderBy(F.desc_nulls_last(order)).limit(held_out).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    test = (F.col(order) >= F.col("_first")) | (F.col("_n") < held_out)
    return rows.crossJoin(F.broadcast(first)).withColumn("part", F.when(test, "test").otherwise("train")).drop("_first", "_n")  # one row


def closest_to_mean(rows: DataFrame, column: str, key: str, n: int = 10_000) -> DataFrame:
    """The n rows whose value is closest to the mean, ties by key; a top-k without a full sort."""
    mean = rows.agg(F.avg(column).alias("_mean"))
    near = rows.crossJoin(F.broadcast(mean))  # one row
    return near.orderBy(F.abs(F.col(column) - F.col("_mean")), key).limit(n).drop("_mean")


def shuffled(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows in an order that is random but the same at every run: by a hash of the key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key).limit(n)


def first_per_group(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group; Spark prunes to n a group before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rn") <= n).drop("_rn")


def chunks(rows: DataFrame, order: str, n: int) -> DataFrame:
    """rows with chunk: 0 to n - 1, ranges of `order` of about equal size, from approximate quantiles rather than one global window."""
    at = rows.approxQuantile(order, [i / n for i in range(1, n)], 0.001) if n > 1 else []
    return rows.withColumn("chunk", reduce(lambda a, x: a + (F.col(order) > x).cast("int"), at, F.lit(0)))


def averaged_grade(first: list[str], second: list[str]) -> Column:
    """Half of the sum of both graders' sums over the given grade columns."""
    return reduce(lambda a, b: a + b, (F.col(c) for c in [*first, *second])) / 2


def combined_variables(grades: list[str], level: str = "level_number") -> dict[str, Column]:
    """For every non-empty subset of the grades: (level - 1) * 4 * size + their sum."""
    out = {}
    for size in range(1, len(grades) + 1):
        for part in combinations(grades, size):
            out["_".join(part)] = (F.col(level) - 1) * 4 * size + reduce(lambda a, b: a + b, map(F.col, part))
    return out


def level_shift(level: Column, grade: Column) -> Column:
    """Grades of B1, B2 and C1 on one scale: +0, +4, +8; null for A levels."""
    band = F.substring(level, 1, 2)
    return F.when(band == "B1", grade).when(band == "B2", grade + 4).when(band == "C1", grade + 8)


def level_band(level: Column) -> Column:
    return F.substring(level, 1, 2)


def level_number(level: Column) -> Column:
    """A1, A2, B1, B2, C1, C2 to 1..6; null otherwise."""
    place = F.array_position(F.array(*map(F.lit, ("A1", "A2", "B1", "B2", "C1", "C2"))), level_band(level))
    return F.when(place > 0, place.cast("int"))


def score_bin(score: Column) -> Column:
    """Tens of a score, halves to the even side."""
    return F.bround(score / 10).cast("int")


def ten_groups(level: Column, grade: Column, split: float = 3.5) -> Column:
    """1..10: two groups for each of five bands, by whether the grade is under `split`."""
    return 2 * (level_number(level) - 1) + F.when(grade < split, 1).otherwise(2)


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables on the columns they share, in the first one's order."""
    names = [c for c in a.columns if c in set(b.columns)]
    return a.select(*names), b.select(*names)


def stacked(*tables: DataFrame) -> DataFrame:
    """Bag union of the tables on the columns they all share."""
    return reduce(lambda a, b: DataFrame.unionByName(*common_columns(a, b)), tables)


def unique_by(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    n = F.count("*").over(Window.partitionBy(*key))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def enriched(essays: DataFrame, students: DataFrame, prompts: DataFrame, grades: DataFrame | None = None, missing: str = "N/A") -> DataFrame:
    """essays(id, name, session) joined to students(name, level), prompts(level, session, title, text) and grades(name, ...).

    Names match without regard to case. A student must be unique, or the essay is dropped; grades that are not unique, or
    absent, become `missing`; a prompt is looked up by level and session and null where there is none. The tables are
    reduced to unique keys before the joins, so that no join multiplies rows.
    """
    one = unique_by(students.withColumn("_name", F.lower("name")).drop("name"), ["_name"])
    ask = prompts.groupBy("level", "session").agg(F.min_by("title", "title").alias("title"), F.min_by("text", "title").alias("prompt_text"))
    out = essays.withColumn("_name", F.lower("name")).join(one, "_name").join(ask, ["level", "session"], "left")
    if grades is not None:
        graded = unique_by(grades.withColumn("_name", F.lower("name")).drop("name"), ["_name"])
        names = [c for c in graded.columns if c != "_name"]
        out = out.join(graded, "_name", "left").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in names})
    return out.drop("_name")
