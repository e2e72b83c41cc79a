"""Problem 4: consensus labels, agreement and annotator reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import checkpoint

#: Labels of patterns up to this number (some 10 MB) are worked on in one partition.
ONE_TASK = 200_000


def digamma(x: str) -> str:
    """SQL of psi(x) for x > 0: six steps of the recurrence, then the asymptotic series."""
    y = f"({x} + 6)"
    inner = f"(1D / 12 - (1D / 120 - (1D / 252 - 1D / 240 / pow({y}, 2)) / pow({y}, 2)) / pow({y}, 2)) / pow({y}, 2)"
    return f"ln({y}) - 0.5D / {y} - {inner} - 1 / {x} - " + " - ".join(f"1 / ({x} + {k})" for k in range(1, 6))


def log_gamma(x: str) -> str:
    """SQL of the log of the gamma function for x > 0: six steps of the recurrence, then Stirling's series."""
    y = f"({x} + 6)"
    return f"({y} - 0.5D) * ln({y}) - {y} + 0.5D * ln(2 * pi()) + 1D / 12 / {y} - 1D / 360 / pow({y}, 3) - ln({x} * " + " * ".join(f"({x} + {k})" for k in range(1, 6)) + ")"


class Consensus:
    """Mean-field variational confusion model.

    labels(item, rater, label, weight): label is a class number from 0 to classes - 1; weight counts items with the same
    labels (pre-aggregated patterns). Dirichlet priors: `flat` on the class shares; on the rows of an annotator's
    confusion matrix `base` on every cell, `hit` more on the diagonal and `near` on its neighbours, which names the
    classes. Updates are group-bys over item and over (rater, label); what is collected is one row of sums a round. Rounds end
    when the evidence lower bound grows by less than `tolerance` an item.
    Rows with a null or with a label out of range are dropped; items with one label follow the priors; of repeated
    (item, rater) rows each counts; no rows give empty results.
    """

    def __init__(self, labels: DataFrame, classes: int, rounds: int = 25, tolerance: float = 1e-3, flat: float = 1.0, base: float = 0.5, hit: float = 4.0, near: float = 1.0) -> None:
        self.classes = k = range(classes)
        self.flat = flat
        ok = (F.col("label") >= 0) & (F.col("label") < classes) & F.col("item").isNotNull() & F.col("rater").isNotNull()
        self.labels = checkpoint(labels.where(ok).select("item", "rater", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight")))
        if self.labels.count() <= ONE_TASK:
            # Patterns that one task holds with ease need no exchanges: a round is then one stage. More keep their partitions; the results are the same.
            self.labels = self.labels.coalesce(1)
        self.prior = lambda c, l: base + (hit if c == l else near if abs(c - l) == 1 else 0.0)
        self._columns()
        # Start: each item's class follows the labels themselves.
        start = [F.sum(F.when(F.col("label") == c, 1.0).otherwise(0.0)) + 0.1 for c in k]
        q = self.labels.groupBy("item").agg(F.first("weight").alias("weight"), F.array(*start).alias("q"))
        q = q.select("item", "weight", F.transform("q", lambda x: x / F.aggregate("q", F.lit(0.0), lambda a, b: a + b)).alias("q"))
        self._totals = checkpoint(self._class_totals(q.withColumn("z", F.lit(0.0))))
        before = None
        for self.rounds in range(1, rounds + 1):
            self.counts = checkpoint(self._confusions(q))
            full = checkpoint(self._items())
            q = full.select("item", "weight", "q")
            # What a rater's posterior adds to the bound, constants of the priors aside.
            raters = self.counts.groupBy("rater").agg((F.sum("cells") - F.first("ends")).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("k"))
            self._totals = checkpoint(self._class_totals(full).crossJoin(F.broadcast(raters)))  # one row each
            now = self._totals.first()
            if not now["w"]:
                break
            bound = (now["z"] + now["k"] + now["s"]) / now["w"]
            if before is not None and abs(bound - before) < tolerance:
                break
            before = bound
        self.items, self.shares = q, list(self._totals.first()["a"])

    def _class_totals(self, items: DataFrame) -> DataFrame:
        """One row: a, expected items of each class and the prior; their expected log shares; sums of the bound. It stays a
        table, as literals of it would have each round compiled anew."""
        sums = [F.coalesce(F.sum(F.col("weight") * F.col("q")[c]), F.lit(0.0)) + self.flat for c in self.classes]
        out = items.agg(F.array(*sums).alias("a"), F.sum(F.col("weight") * F.col("z")).alias("z"), F.sum("weight").alias("w"))
        for step in self._share_steps:
            out = out.select(*step)
        return out

    def _prior_of(self, c: int) -> Column:
        return F.element_at(F.array(*(F.lit(self.prior(c, l)) for l in self.classes)), F.col("label") + 1)

    def _confusions(self, q: DataFrame) -> DataFrame:
        """(rater, label, n, e, cells, ends): expected labels of each annotator by true class, their expected log confusions, and
        the cell's and the rater's parts of the bound."""
        k = self.classes
        rows = self.labels.join(q.select("item", "q"), "item")
        rows = rows.groupBy("rater", "label").agg(F.array(*(F.sum(F.col("weight") * F.col("q")[c]) for c in k)).alias("n"))
        rows = rows.join(rows.groupBy("rater").agg(F.array(*(F.sum(F.col("n")[c]) for c in k)).alias("t")), "rater")
        for step in self._cell_steps:
            rows = rows.select("rater", "label", "n", *step)
        return rows

    def _items(self) -> DataFrame:
        """(item, weight, q, z): class probabilities, the softmax of the expected log shares and confusions, and its normaliser's log."""
        of = self.labels.join(self.counts.select("rater", "label", "e"), ["rater", "label"]).groupBy("item").agg(*self._sums)
        of = of.crossJoin(F.broadcast(self._totals.select("shares")))  # one row
        for step in self._softmax:
            of = of.select(*step)
        return of

    def _columns(self) -> None:
        """The expressions of a round, built once and in small steps: they are the same every time."""
        k = self.classes
        psi, gamma = (f"transform({{}}, v -> {f('v')})" for f in (digamma, log_gamma))
        by_label = "array(" + ", ".join("array(" + ", ".join(f"{self.prior(c, l)}D" for c in k) + ")" for l in k) + ")"
        own = "array(" + ", ".join(f"{sum(self.prior(c, l) for l in k)}D" for c in k) + ")"
        whole = "aggregate({}, 0D, (x, y) -> x + y)"
        steps = lambda *rows: [[F.expr(f"{v} AS {n}") for n, v in row.items()] for row in rows]
        self._cell_steps = steps(
            {"cell": f"zip_with(n, element_at({by_label}, label + 1), (x, y) -> x + y)", "row": f"zip_with(t, {own}, (x, y) -> x + y)"},
            {"pc": psi.format("cell"), "pr": psi.format("row"), "gc": whole.format(gamma.format("cell")), "ends": whole.format(gamma.format("row"))},
            {"e": "zip_with(pc, pr, (x, y) -> x - y)", "gc": "gc", "ends": "ends"},
            {"e": "e", "cells": f"gc - {whole.format('zip_with(n, e, (x, y) -> x * y)')}", "ends": "ends"},
        )
        self._share_steps = steps(
            {"a": "a", "b": whole.format("a"), "z": "z", "w": "w"},
            {"a": "a", "b": "b", "pa": psi.format("a"), "pb": digamma("b"), "z": "z", "w": "w"},
            {"a": "a", "b": "b", "shares": "transform(pa, x -> x - pb)", "z": "z", "w": "w"},
            {"a": "a", "shares": "shares", "z": "z", "w": "w", "s": f"{whole.format(gamma.format('a'))} - ({log_gamma('b')}) - {whole.format(f'zip_with(a, shares, (x, y) -> (x - {self.flat}D) * y)')}"},
        )
        self._sums = [F.first("weight").alias("weight"), F.array(*(F.sum(F.col("e")[c]) for c in k)).alias("l")]
        self._softmax = steps(
            {"item": "item", "weight": "weight", "l": "zip_with(l, shares, (x, y) -> x + y)"},
            {"item": "item", "weight": "weight", "m": "array_max(l)", "x": "transform(l, v -> exp(v - array_max(l)))"},
            {"item": "item", "weight": "weight", "m": "m", "x": "x", "s": whole.format("x")},
            {"item": "item", "weight": "weight", "q": "transform(x, v -> v / s)", "z": "m + ln(s)"},
        )

    def posterior(self) -> DataFrame:
        """(rater, class, label, alpha, alpha_row): every cell of every annotator's Dirichlet posterior."""
        spark = self.labels.sparkSession
        grid = spark.createDataFrame([(l,) for l in self.classes], "label int")
        raters = self.counts.select("rater").distinct().crossJoin(F.broadcast(grid))  # classes rows
        full = raters.join(self.counts, ["rater", "label"], "left")
        cells = [
            F.struct(
                F.lit(c).alias("class"),
                (F.coalesce(F.col("n")[c], F.lit(0.0)) + self._prior_of(c)).alias("alpha"),
            )
            for c in self.classes
        ]
        long = full.select("rater", "label", F.explode(F.array(*cells)).alias("x")).select("rater", "x.class", "label", "x.alpha")
        rows = long.groupBy("rater", "class").agg(F.sum("alpha").alias("alpha_row"))
        return long.join(rows, ["rater", "class"])

    def consensus(self) -> DataFrame:
        """(item, label, confidence): the most likely class of each item; ties take the lower class."""
        best = F.array_max("q")
        return self.items.select("item", (F.array_position("q", best) - 1).cast("int").alias("label"), best.alias("confidence"))

    def reliability(self) -> DataFrame:
        """(rater, n, accuracy, accuracy_low, accuracy_high, slope, slope_low, slope_high), one row an annotator.

        accuracy: expected share of labels equal to the true class; slope: regression of the expected label on the true
        class. Both carry 95 % intervals of the Dirichlet posterior. Weights of the classes are the model's shares.
        """
        total = sum(self.shares)
        p = [x / total for x in self.shares]
        centre = sum(c * x for c, x in zip(self.classes, p))
        spread = sum(x * (c - centre) ** 2 for c, x in zip(self.classes, p))
        by_class = F.element_at(F.array(*(F.lit(x) for x in p)), F.col("class") + 1)
        m, a0 = F.col("alpha") / F.col("alpha_row"), F.col("alpha_row")
        cell = self.posterior().withColumn("w", by_class).groupBy("rater", "class").agg(
            F.first("w").alias("w"), F.first("alpha_row").alias("a0"),
            F.sum(F.when(F.col("label") == F.col("class"), m).otherwise(0.0)).alias("hit"),
            F.sum(m * F.col("label")).alias("mean"), F.sum(m * F.col("label") * F.col("label")).alias("square"),
        )
        lean = F.col("w") * (F.col("class") - F.lit(centre)) / spread
        out = cell.groupBy("rater").agg(
            F.sum(F.col("w") * F.col("hit")).alias("accuracy"),
            F.sqrt(F.sum(F.col("w") ** 2 * F.col("hit") * (1 - F.col("hit")) / (F.col("a0") + 1))).alias("_sa"),
            F.sum(lean * F.col("mean")).alias("slope"),
            F.sqrt(F.sum(lean**2 * (F.col("square") - F.col("mean") ** 2) / (F.col("a0") + 1))).alias("_ss"),
        )
        n = self.labels.groupBy("rater").agg(F.sum("weight").cast("long").alias("n"))
        return n.join(out, "rater").select(
            "rater", "n", "accuracy", (F.col("accuracy") - 1.96 * F.col("_sa")).alias("accuracy_low"), (F.col("accuracy") + 1.96 * F.col("_sa")).alias("accuracy_high"),
            "slope", (F.col("slope") - 1.96 * F.col("_ss")).alias("slope_low"), (F.col("slope") + 1.96 * F.col("_ss")).alias("slope_high"),
        )


def krippendorff(labels: DataFrame) -> DataFrame:
    """labels(item, rater, label, weight) to one row (items, pairable, alpha_nominal, alpha_interval).

    Items with fewer than two labels are not pairable. alpha is null where there is nothing to compare or no variation.
    Sums run over label counts of each item, so no pairs of labels are formed.
    """
    cells = labels.where("item IS NOT NULL AND label IS NOT NULL").groupBy("item", "label").agg(F.count("*").cast("double").alias("c"), F.first("weight").cast("double").alias("w"))
    each = cells.groupBy("item").agg(
        F.first("w").alias("w"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc"),
        F.sum(F.col("c") * F.col("label")).alias("s"), F.sum(F.col("c") * F.col("label") * F.col("label")).alias("ss"),
    ).where("m >= 2")
    do = each.agg(
        F.sum("w").cast("long").alias("items"), F.sum(F.col("w") * F.col("m")).alias("n"),
        F.sum(F.col("w") * (F.col("m") ** 2 - F.col("cc")) / (F.col("m") - 1)).alias("nom"),
        F.sum(F.col("w") * 2 * (F.col("m") * F.col("ss") - F.col("s") ** 2) / (F.col("m") - 1)).alias("int"),
        F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("ss")).alias("ss"),
    )
    values = cells.join(each.select("item"), "item").groupBy("label").agg(F.sum(F.col("w") * F.col("c")).alias("v"))
    sq = values.agg(F.sum(F.col("v") ** 2).alias("vv"))
    n = F.col("n")
    return do.crossJoin(F.broadcast(sq)).select(  # both sides are one row
        "items", n.cast("long").alias("pairable"),
        (1 - (n - 1) * F.try_divide(F.col("nom"), n * n - F.col("vv"))).alias("alpha_nominal"),
        (1 - (n - 1) * F.try_divide(F.col("int"), 2 * (n * F.col("ss") - F.col("s") ** 2))).alias("alpha_interval"),
    )
