"""Agreement of raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_ratings(wide: DataFrame, key: str, dimensions: list[str], least: int = 2) -> DataFrame:
    """Two gradings a row to (target_id, rater, dimension, score); raters of fewer than `least` letters are left out."""
    cells = [
        F.struct(F.col(f"graded_by_{n}").alias("rater"), F.lit(d).alias("dimension"), F.col(f"{d}_grade_{n}").alias("score")) for d in dimensions for n in ("1st", "2nd")
    ]
    rows = wide.select(F.col(key).alias("target_id"), F.explode(F.array(*cells)).alias("x")).select("target_id", "x.*")
    return rows.where(F.length("rater") >= least)


def newest(ratings: DataFrame) -> DataFrame:
    """One row a rating: the one loaded last."""
    return ratings.groupBy("rating_id").agg(*(F.max_by(c, "loaded_at").alias(c) for c in ("target_id", "rater", "dimension", "score", "rated_at")))


def rater_pairs(ratings: DataFrame) -> DataFrame:
    """(target_id, dimension, rater_a, rater_b, a, b), rater_a < rater_b: all pairs of raters of one target and dimension.

    A target has a handful of raters, so the self-join adds a constant factor; null scores are left out.
    """
    known = ratings.where("score IS NOT NULL AND rater IS NOT NULL")
    one = known.select("target_id", "dimension", F.col("rater").alias("rater_a"), F.col("score").alias("a"))
    two = known.select("target_id", "dimension", F.col("rater").alias("rater_b"), F.col("score").alias("b"))
    return one.join(two, ["target_id", "dimension"]).where("rater_a < rater_b")


def rated_twice(ratings: DataFrame) -> DataFrame:
    """Ratings of targets that more than one row rates, in the dimension."""
    n = F.count("*").over(Window.partitionBy("target_id", "dimension"))
    return ratings.withColumn("_n", n).where("_n > 1").drop("_n")


def intraclass(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs(by, a, b) to (by, n, icc2k, icc3k): two-way analysis of variance with two raters a row, from sums alone."""
    s = pairs.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"),
        F.sum(F.col("a") ** 2 + F.col("b") ** 2).alias("q"), F.sum((F.col("a") + F.col("b")) ** 2).alias("qr"),
    )
    n, total = F.col("n"), F.col("sa") + F.col("sb")
    mean = total**2 / (2 * n)
    rows, cols = F.col("qr") / 2 - mean, (F.col("sa") ** 2 + F.col("sb") ** 2) / n - mean
    msr, msc = F.try_divide(rows, n - 1), cols
    mse = F.try_divide(F.col("q") - mean - rows - cols, n - 1)
    s = s.select(*by, n.cast("long").alias("n"), msr.alias("r"), msc.alias("c"), mse.alias("e"))
    return s.select(*by, "n", F.try_divide(F.col("r") - F.col("e"), F.col("r") + (F.col("c") - F.col("e")) / F.col("n")).alias("icc2k"), F.try_divide(F.col("r") - F.col("e"), F.col("r")).alias("icc3k"))


def weighted_kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs(by, a, b) to (by, kappa) with quadratic weights on the index of the category among those in use.

    Works on the contingency table: counts of (a, b), never on pairs of rows.
    """
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").cast("double").alias("n"))
    both = cells.select(*by, F.explode(F.array("a", "b")).alias("v")).distinct()
    index = both.select(*by, "v", F.row_number().over(Window.partitionBy(*by).orderBy("v")).cast("double").alias("i"))
    cells = cells.join(index.withColumnsRenamed({"v": "a", "i": "ia"}), [*by, "a"]).join(index.withColumnsRenamed({"v": "b", "i": "ib"}), [*by, "b"])
    # The expected squared distance follows from the marginals' moments.
    s = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("ia") - F.col("ib")) ** 2).alias("d"),
        F.sum(F.col("n") * F.col("ia")).alias("sa"), F.sum(F.col("n") * F.col("ib")).alias("sb"),
        F.sum(F.col("n") * F.col("ia") ** 2).alias("qa"), F.sum(F.col("n") * F.col("ib") ** 2).alias("qb"),
    )
    expected = F.col("qa") + F.col("qb") - 2 * F.col("sa") * F.col("sb") / F.col("n")
    return s.select(*by, (1.0 - F.try_divide(F.col("d"), expected)).alias("kappa"))


def pair_agreement(pairs: DataFrame) -> DataFrame:
    """rater_pairs() to (dimension, rater_a, rater_b, n, kappa, icc3k), one row for every two raters that share a target.

    Null where the two have too little in common to tell: no variation for kappa, one target for the correlation.
    """
    by = ["dimension", "rater_a", "rater_b"]
    kappa = weighted_kappa(pairs, by)
    return intraclass(pairs, by).select(*by, "n", "icc3k").join(kappa, by).select(*by, "n", "kappa", "icc3k")
