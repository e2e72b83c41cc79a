"""Models against closed forms and held-out rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import curation, models, substitution


def rows(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = 1.5 * x[:, 0] - 0.5 * x[:, 1] + 2 + rng.normal(size=n) * 0.3
    data = [(i, float(a), float(b), float(c), float(c > 2)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data, "id long, a double, b double, grade double, y double")


def test_linear_regression_is_least_squares(spark):
    x, y, table = rows(spark)
    extra = spark.createDataFrame([(900, None, 1.0, 1.0, 0.0)], table.schema)
    model = models.linear(["a", "b"], "grade").fit(table)
    got = {r.id: r.p for r in models.with_prediction(table.union(extra), model, "p").collect()}
    want = np.c_[x, np.ones(len(x))] @ np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-6) and got[900] == -1


@pytest.mark.parametrize("make", (models.linear_classifier, models.forest_classifier, lambda n, c: models.perceptron(n, c, 2)))
def test_classifiers_hold_on_rows_they_have_not_seen(spark, make):
    _, _, table = rows(spark)
    model = make(["a", "b"], "y").fit(table.where("id % 3 <> 0"))
    assert models.with_prediction(table.where("id % 3 = 0"), model, "p").agg(F.avg((F.col("p") == F.col("y")).cast("int"))).first()[0] > 0.85


@pytest.mark.parametrize("make", (models.forest_regressor, models.elastic_net))
def test_regressors_rise_with_what_they_predict(spark, make):
    _, _, table = rows(spark)
    model = make(["a", "b"], "grade").fit(table.where("id % 3 <> 0"))
    assert models.with_prediction(table.where("id % 3 = 0"), model, "p").agg(F.corr("p", "grade")).first()[0] > 0.8


def test_significance_by_the_t_distribution(spark):
    x, y, table = rows(spark, 30)
    got = {r.feature: r for r in models.significance(table.withColumn("flat", F.lit(1.0)), ["a", "b", "flat"], "grade").collect()}
    for k, name in enumerate("ab"):
        r = np.corrcoef(x[:, k], y)[0, 1]
        t, v = abs(r) * math.sqrt(28 / (1 - r * r)), 28
        grid = np.linspace(0, t, 200_001)
        density = math.gamma((v + 1) / 2) / math.sqrt(v * math.pi) / math.gamma(v / 2) * (1 + grid**2 / v) ** (-(v + 1) / 2)
        assert got[name].r == pytest.approx(r) and got[name].p == pytest.approx(1 - 2 * float(((density[1:] + density[:-1]) / 2).sum() * grid[1]), abs=1e-6)
    assert got["flat"].r is None and got["flat"].p is None


def test_folds_hold_each_row_once(spark):
    _, _, table = rows(spark)
    got = models.cross_validated(table, lambda: models.linear(["a", "b"], "grade"), "grade", "id", folds=4)
    assert sorted(r.fold for r in got.collect()) == [0, 1, 2, 3] and all(r.r > 0.9 for r in got.collect())
    assert models.validation_summary(got).first()["mean"] > 0.9


def test_synonyms_are_ranked_by_a_model_over_four_scores(spark):
    scored = spark.createDataFrame([("x", i / 10, 0.1, i / 20, 0.2, i / 10) for i in range(10)] + [("y", None, 1.0, 1.0, 1.0, 1.0)], "lemma string, `add` double, bal_add double, mult double, bal_mult double, good double")
    model = models.linear(list(substitution.SCORES), "good").fit(scored.where("lemma = 'x'"))
    got = substitution.ranked_by_model(scored.withColumn("synonym", F.col("good").cast("string")), model, ["lemma"]).collect()
    assert [round(r.score, 4) for r in got] == pytest.approx([i / 10 for i in range(9, 2, -1)], abs=0.02)


def test_positional_split_and_data_set(spark):
    table = spark.createDataFrame([(i, "t" if i % 2 else "", "S 1" if i == 3 else "S 2", "1" if i != 5 else None) for i in range(10)], "id long, essay string, session string, g string")
    parts = {r.id: r.part for r in curation.positional_split(table, "id", 3).collect()}
    assert [i for i in range(10) if parts[i] == "test"] == [7, 8, 9]
    assert {r.part for r in curation.positional_split(table, "id", 50).collect()} == {"test"} and curation.positional_split(table.limit(0), "id", 3).count() == 0
    assert sorted(r.id for r in curation.dataset(table, "essay", ("g",), "session", ("S 1",)).collect()) == [1, 7, 9]


def test_chunks_are_even(spark):
    n = {r.chunk: r["count"] for r in curation.chunks(spark.range(1000).select(F.col("id").alias("k")), "k", 8).groupBy("chunk").count().collect()}
    assert sorted(n) == list(range(8)) and all(abs(x - 125) <= 3 for x in n.values())
