"""Models over feature rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.statistics import correlation


def _pipeline(model, names: list[str], scale: bool = False) -> Pipeline:
    stages = [VectorAssembler(inputCols=names, outputCol="_x" if scale else "features", handleInvalid="skip")]
    if scale:
        stages.append(StandardScaler(inputCol="_x", outputCol="features", withMean=True))
    return Pipeline(stages=[*stages, model])


def forest_regressor(names: list[str], label: str, trees: int = 100, seed: int = 1) -> Pipeline:
    return _pipeline(RandomForestRegressor(labelCol=label, numTrees=trees, seed=seed), names)


def forest_classifier(names: list[str], label: str, trees: int = 100, seed: int = 1) -> Pipeline:
    return _pipeline(RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed), names)


def linear(names: list[str], label: str) -> Pipeline:
    return _pipeline(LinearRegression(labelCol=label, solver="normal"), names)


def elastic_net(names: list[str], label: str) -> Pipeline:
    return _pipeline(LinearRegression(labelCol=label, elasticNetParam=0.5, regParam=1.0), names)


def linear_classifier(names: list[str], label: str, rounds: int = 20) -> Pipeline:
    """One linear margin classifier a class; stands for stochastic gradient descent."""
    return _pipeline(OneVsRest(classifier=LinearSVC(maxIter=rounds), labelCol=label), names, scale=True)


def perceptron(names: list[str], label: str, classes: int, seed: int = 1) -> Pipeline:
    return _pipeline(MultilayerPerceptronClassifier(labelCol=label, layers=[len(names), classes], seed=seed), names, scale=True)


def with_prediction(rows: DataFrame, model: PipelineModel, column: str, default: float = -1.0) -> DataFrame:
    """rows with the model's prediction; `default` where features are missing."""
    names = model.stages[0].getInputCols()
    known = rows.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names))
    missing = rows.where(" OR ".join(f"`{n}` IS NULL" for n in names)).withColumn(column, F.lit(default))
    out = model.transform(known).withColumnRenamed("prediction", column).select(*rows.columns, column)
    return out.unionByName(missing)


def cross_validated(rows: DataFrame, make: Callable[[], Pipeline], label: str, key: str, folds: int = 10) -> DataFrame:
    """(fold, r): correlation of prediction and label on each held-out fold; folds by a hash of the key."""
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    parts = []
    for k in range(folds):
        model = make().fit(rows.where(F.col("_fold") != k))
        parts.append(model.transform(rows.where(F.col("_fold") == k)).agg(F.lit(k).alias("fold"), correlation("prediction", label).alias("r")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validation_summary(scores: DataFrame) -> DataFrame:
    """(mean, twice_std) of fold scores."""
    return scores.agg(F.avg("r").alias("mean"), (2 * F.stddev_pop("r")).alias("twice_std"))


def significance(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    """(feature, r, p): Pearson correlation with the label and its two-sided p-value, one least-squares fit a feature."""
    out = []
    for n in names:
        part = rows.where(F.col(n).isNotNull() & F.col(label).isNotNull())
        spread = part.agg(F.stddev_pop(n), correlation(n, label)).first()
        if not spread[0] or spread[1] is None:
            out.append((n, None, None))
            continue
        out.append((n, float(spread[1]), float(linear([n], label).fit(part).stages[-1].summary.pValues[0])))
    return rows.sparkSession.createDataFrame(out, "feature string, r double, p double")
