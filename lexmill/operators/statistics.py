"""Statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency_table(rows: DataFrame, column: str) -> DataFrame:
    """(column, n), in order of the value."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, percent): counts and their share of all rows; the total is a sum over the counts, not over the rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def average_per_score(rows: DataFrame, score: str, value: str, low: int = 1, high: int = 100) -> DataFrame:
    """(score, average) for every score from low to high; 0 where no row has it."""
    every = rows.sparkSession.range(low, high + 1).select(F.col("id").alias(score))
    means = rows.groupBy(F.col(score).cast("long").alias(score)).agg(F.avg(value).alias("average"))
    return every.join(means, score, "left").select(score, F.coalesce("average", F.lit(0.0)).alias("average"))


def cross_tab(rows: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of row by column; absent pairs are 0."""
    return rows.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def percentiles(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, p, value) for p = 0..99, exact, by linear interpolation."""
    points = [i / 100 for i in range(100)]
    all_ = rows.groupBy(*(by or [])).agg(F.percentile(column, F.array(*map(F.lit, points))).alias("v"))
    return all_.select(*(by or []), F.posexplode("v").alias("p", "value"))


def describe(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, n, mean, std, min, max, median), the deviation being that of the population."""
    return rows.groupBy(*by).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"),
        F.percentile(column, F.lit(0.5)).alias("median"),
    )


def described_totals(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """describe() with subtotals: a rollup over `by`; null marks a total."""
    return rows.rollup(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are known; null where either does not vary (the built-in one fails there in ANSI mode)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(long: DataFrame, target: str, by: list[str] | None = None) -> DataFrame:
    """(by, feature, r): correlation of each feature's value with the target."""
    return long.groupBy(*(by or []), "feature").agg(correlation("value", target).alias("r"))


def average_ranks(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Ranks within `by`, ties at their mean.

    Ranked are the distinct values with their counts, by a running sum; so ties, however many, cost one row.
    """
    for c in columns:
        counts = rows.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(c))
        ranks = counts.select(*by, c, (upto - F.col("_n") / 2 + 0.5).alias(f"{c}_rank"))
        rows = rows.join(ranks, [*by, c], "left")
    return rows


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, rho) over rows where both are known."""
    ranked = average_ranks(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b], by)
    return ranked.groupBy(*by).agg(correlation(f"{a}_rank", f"{b}_rank").alias("rho"))


def linear_fit(rows: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def correlation_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for each pair of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs))
    long = one.unpivot([], [F.col(f"`{c}`") for c in one.columns], "pair", "r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def strongest(correlations: DataFrame, n: int = 10) -> DataFrame:
    """The n features of the largest |r|; a top-k report."""
    return correlations.orderBy(F.desc(F.abs("r")), "feature").limit(n)


def histogram_2d(rows: DataFrame, x: str, y: str, x_range: tuple, y_range: tuple, bins: tuple[int, int] = (50, 10)) -> DataFrame:
    """(x_bin, y_bin, n); bins from 1, the last closed on the right; values outside the ranges are left out."""

    def place(c: str, low: float, high: float, n: int) -> Column:
        return F.least(F.floor((F.col(c) - low) / ((high - low) / n)) + 1, F.lit(n)).cast("int")

    inside = F.col(x).between(*x_range) & F.col(y).between(*y_range)
    return rows.where(inside).groupBy(place(x, *x_range, bins[0]).alias("x_bin"), place(y, *y_range, bins[1]).alias("y_bin")).agg(F.count("*").alias("n"))


def holistic_averages(tokens: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """(n, words, sentences): mean words and sentences of a text."""
    docs = tokens.groupBy("doc_id").agg(F.count_if(~F.col("is_punct")).alias("w"), F.count_distinct("sent_id").alias("s"))
    return docs.agg(F.count("*").alias("n"), F.avg("w").alias("words"), F.avg("s").alias("sentences"))


def sentence_lengths(tokens: DataFrame) -> DataFrame:
    """(tokens, n): how many sentences have so many tokens."""
    return tokens.groupBy("doc_id", "sent_id").agg(F.count("*").alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n"))


def first_example(rows: DataFrame, by: str, example: str, order: str) -> DataFrame:
    """(by, n, mean, example): the example is that of the smallest `order`."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min_by(example, order).alias("example"))
