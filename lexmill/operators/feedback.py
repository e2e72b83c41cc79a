"""Thresholds of the features and the feedback they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of the feature vector. Fixed values.
VECTOR = (
    "LV_W LV_WT LV_WT1 LV_TTR LV_CTTR LV_RTTR LV_HDD LV_DUGA LV_MAAS LV_SUMM LV_YULEK LV_MTLD LV_MSTTR LV_MATTR LS_FPC_NG LS_FPC_NA LS_FPC_TC LS_FPC_BS "
    "LS_FPC_CA LS_FPC_CT LS_FPC_CGA1 LS_FPC_CGA2 LS_FPC_CGA3 LS_FOMN_NG LS_FOMN_NA LS_FOMN_TC LS_FOMN_BS LS_FOMN_CA LA_ER LA_COL_ERR_R CA_BIN1_R CA_BIN2_R "
    "CA_BIN3_R LD_LXUR LD_GRUR"
).split()
#: Places of the features that have thresholds. Fixed values.
THRESHOLDS = (6, 18, 19, 20, 21, 22, 28, 29, 30, 31, 32, 33)
#: Features of which less is better.
NEGATED = ("LA_ER", "LA_COL_ERR_R", "CA_BIN1_R")


def long_features(wide: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    """(key, feature, value), one row for each feature of each row."""
    return wide.unpivot(key, [F.col(n).cast("double").alias(n) for n in names], "feature", "value")


def wide_features(long: DataFrame, names: list[str], key: list[str]) -> DataFrame:
    return long.groupBy(*key).pivot("feature", names).agg(F.first("value"))


def thresholds(long: DataFrame, by: list[str], population: bool = False) -> DataFrame:
    """(by, feature, mean, std): sample deviation, or that of the population; null values are left out."""
    std = F.stddev_pop if population else F.stddev_samp
    return long.groupBy(*by, "feature").agg(F.avg("value").alias("mean"), std("value").alias("std"))


def bin_values(long: DataFrame, by: list[str]) -> DataFrame:
    """Population thresholds of the twelve threshold features with their place in the vector."""
    place = F.create_map(*(x for i in THRESHOLDS for x in (F.lit(VECTOR[i]), F.lit(i))))
    rows = long.withColumn("feature_index", F.element_at(place, F.col("feature"))).where("feature_index IS NOT NULL")
    return rows.groupBy(*by, "feature", "feature_index").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def label(value: Column, mean: Column, std: Column, negated: Column) -> Column:
    """'positive' at or under mean - std, 'negative' at or over mean + std (the other way round for negated features), else 'none'."""
    low, high = F.when(negated, "negative").otherwise("positive"), F.when(negated, "positive").otherwise("negative")
    return F.when(value <= mean - std, low).when(value >= mean + std, high).otherwise("none")


def code(value: Column, mean: Column, std: Column, negated: Column, guard: bool = True) -> Column:
    """1 at or over mean + std, -1 at or under mean - std, else 0; turned for negated features. guard: 0 where mean and std are 0."""
    sign = F.when(value >= mean + std, 1).when(value <= mean - std, -1).otherwise(0)
    sign = F.when(negated, -sign).otherwise(sign)
    return F.when((mean == 0) & (std == 0), 0).otherwise(sign) if guard else sign


def feedback(long: DataFrame, known: DataFrame, by: list[str], negated: tuple[str, ...] = NEGATED, size: int | None = None, guard: bool = True) -> DataFrame:
    """long(by, key..., feature, value) with thresholds(by, feature, mean, std): adds feedback and code.

    Features without a threshold give no row. guard=False is the older evaluator, which codes thresholds of mean and deviation
    0 like all others. Thresholds are one row for each feature and group; they are broadcast where
    their counted number (or the given size) is under 100,000.
    """
    n = known.count() if size is None else size
    rows = long.join(F.broadcast(known) if n < 100_000 else known, [*by, "feature"])
    turned = F.col("feature").isin(*negated)
    args = (F.col("value"), F.col("mean"), F.col("std"), turned)
    return rows.withColumns({"feedback": label(*args), "code": code(*args, guard=guard)})


def occupancy(long: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """(by, feature, bin1..bin4): values under mean - std, up to mean, up to mean + std, and above."""
    rows = long.join(known, [*by, "feature"])
    v, m, s = F.col("value"), F.col("mean"), F.col("std")
    return rows.groupBy(*by, "feature").agg(
        F.count_if(v < m - s).alias("bin1"), F.count_if((v >= m - s) & (v < m)).alias("bin2"), F.count_if((v >= m) & (v < m + s)).alias("bin3"), F.count_if(v >= m + s).alias("bin4")
    )


def threshold_table(known: DataFrame) -> DataFrame:
    """mean, std, mean - std and mean + std, rounded to four places."""
    cells = {"mean": F.col("mean"), "std": F.col("std"), "low": F.col("mean") - F.col("std"), "high": F.col("mean") + F.col("std")}
    others = [c for c in known.columns if c not in cells]
    return known.select(*others, *(F.round(v, 4).alias(k) for k, v in cells.items()))
