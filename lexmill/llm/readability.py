"""Problem 3: reading level from classic formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands in rising order.
BANDS = ("A1", "A2", "B1", "B2", "C1")


def english_prose(least: int = 40) -> Column:
    """Condition on the columns of quality(): running prose of at least `least` words whose function words are English."""
    return (F.col("kind") == "prose") & (F.col("words") >= least) & (F.col("english_share") >= 0.2) & (F.col("english_share") > 1.5 * F.col("german_share"))


def _formulas(wps: Column) -> dict[str, Column]:
    """Grade estimates from words a sentence and the figures of a text; the constants are the published ones."""
    words = F.nullif(F.col("words"), F.lit(0.0))
    spw, cpw, hard, long_ = (F.col(c) / words for c in ("syllables", "letters", "many_syllables", "long_words"))
    return {
        "flesch_kincaid": 0.39 * wps + 11.8 * spw - 15.59,
        "reading_ease": -(206.835 - 1.015 * wps - 84.6 * spw),
        "fog": 0.4 * (wps + 100.0 * hard),
        "smog": 1.043 * F.sqrt(30.0 * hard * wps) + 3.1291,
        "coleman_liau": 5.88 * cpw - 29.6 / wps - 15.8,
        "automated": 4.71 * cpw + 0.5 * wps - 21.43,
        "lix": wps + 100.0 * long_,
    }


#: Width of the bins of syllables a word, in which the usual words a sentence are looked up; texts beyond the ends fall into the last bins.
BIN, LOW_BIN, HIGH_BIN = 0.05, 20, 50


def reading_levels(figures: DataFrame, level: str = "level") -> DataFrame:
    """figures: columns of quality() and a band name `level`, to the same rows with words_per_sentence, each formula's grade,
    sentence_words and text_band.

    The seven grades are the published formulas of the text as it stands. The band is voted on another footing: missing or
    excess stops must not move a text, so that `sentence_words` keeps words_per_sentence within a fifth of the usual, and the
    formulas of that, not the grades shown, are compared. The usual is a straight line through the medians of words a sentence
    over bins of syllables a word, weighted by their texts; all prose takes part, and medians are not moved by texts without
    stops. Every formula is put on the scale of bands by its medians of the records of each band; a text's band is the
    median of the seven estimates. So sentence_words and text_band depend on the other texts, the grades do not. Rows that
    are not English prose of 40 words have null grades; bands without records take no part. All statistics cover all rows.
    """
    ok = english_prose()
    seen = F.col("words") / F.greatest(F.col("sentences"), F.lit(1.0))
    spw = F.try_divide(F.col("syllables"), F.col("words"))
    bins = F.least(F.greatest(F.floor(spw / BIN), F.lit(LOW_BIN)), F.lit(HIGH_BIN))
    usual = figures.where(ok).groupBy(bins.alias("bin")).agg(F.percentile_approx(seen, 0.5, 10_000).alias("y"), F.avg(spw).alias("x"), F.count("*").alias("n"))
    slope, start = _line([(r["x"], r["y"], r["n"]) for r in usual.collect()])  # at most HIGH_BIN - LOW_BIN + 1 rows
    line = F.greatest(F.lit(start) + F.lit(slope) * spw, F.lit(3.0))
    rows = figures.withColumns({"words_per_sentence": F.when(ok, seen), "sentence_words": F.when(ok, F.greatest(F.least(seen, line * 1.2), line * 0.8))})
    rows = rows.withColumns(_formulas(F.col("words_per_sentence")))
    held = _formulas(F.col("sentence_words"))
    centre = rows.where(ok & F.col(level).isin(*BANDS)).groupBy(level).agg(*(F.percentile_approx(v, 0.5, 10_000).alias(n) for n, v in held.items()))
    known = {r[level]: r for r in centre.collect()}  # at most five rows
    bands = [b for b in BANDS if b in known]
    if not bands:
        return rows.withColumn("text_band", F.lit(None).cast("string"))
    votes = []
    for n, v in held.items():
        at = [known[b][n] for b in bands]
        votes.append(sum(((v >= (x + y) / 2).cast("int") for x, y in zip(at, at[1:])), F.lit(0)))
    middle = F.element_at(F.array_sort(F.array(*votes)), len(votes) // 2 + 1)
    return rows.withColumn("text_band", F.when(ok, F.element_at(F.array(*map(F.lit, bands)), middle + 1)))


def _line(points: list[tuple[float, float, int]]) -> tuple[float, float]:
    """Slope and start of the least-squares line through weighted points; flat through their mean where they do not tell."""
    n = sum(w for _, _, w in points)
    if not n:
        return 0.0, 12.0
    mx, my = (sum(p[k] * p[2] for p in points) / n for k in (0, 1))
    spread = sum(w * (x - mx) ** 2 for x, _, w in points)
    slope = sum(w * (x - mx) * (y - my) for x, y, w in points) / spread if spread > 1e-12 else 0.0
    return slope, my - slope * mx


def band_number(band: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BANDS)), band)
