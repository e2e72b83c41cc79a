"""Lexical variation: 14 indices of a word sequence, one row a text, without a shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lexmill.functions.text import words

NAMES = ("LV_W", "LV_WT", "LV_WT1", "LV_TTR", "LV_CTTR", "LV_RTTR", "LV_HDD", "LV_DUGA", "LV_MAAS", "LV_SUMM", "LV_YULEK", "LV_MTLD", "LV_MSTTR", "LV_MATTR")
#: Draws of the hypergeometric index, words of a segment or window, and the ratio that closes an MTLD segment. Fixed values.
DRAWS, SEGMENT, THRESHOLD = 35, 25, 0.72


def closed_form(n: Column, t: Column) -> dict[str, Column]:
    """Indices that follow from the numbers of words and of distinct words; zeros where they are not defined."""
    n, t = n.cast("double"), t.cast("double")
    ok = lambda when, value: F.when(when, value).otherwise(F.lit(0.0))
    some, apart = n > 0, (n > t)
    return {
        "LV_TTR": ok(some, F.try_divide(t, n)), "LV_CTTR": ok(some, F.try_divide(t, F.sqrt(2.0 * n))), "LV_RTTR": ok(some, F.try_divide(t, F.sqrt(n))),
        "LV_DUGA": ok(apart, F.try_divide(F.ln(n) ** 2, F.ln(n) - F.ln(t))), "LV_MAAS": ok(apart, F.try_divide(F.ln(n) - F.ln(t), F.ln(n) ** 2)),
        "LV_SUMM": ok((n > 1) & (t > 1), F.try_divide(F.ln(F.ln(t)), F.ln(F.ln(n)))),
    }


@lru_cache(maxsize=200_000)
def unseen(n: int, f: int, draws: int = DRAWS) -> float:
    """Probability that none of `draws` words of n is the type that occurs f times."""
    p = 1.0
    for i in range(draws):
        p *= (n - f - i) / (n - i)
        if p <= 0:
            return 0.0
    return p


def hdd(counts: list[int], n: int) -> float:
    if n < DRAWS:
        return 0.0
    return sum(times * (1 - unseen(n, f)) for f, times in Counter(counts).items()) / DRAWS


def factors(w: list[str], threshold: float = THRESHOLD, inclusive: bool = False) -> float:
    """MTLD of one pass: words over the number of segments whose type-token ratio holds the threshold."""
    seen: set[str] = set()
    size, full, ratio = 0, 0.0, 1.0
    for x in w:
        size += 1
        seen.add(x)
        ratio = len(seen) / size
        if ratio < threshold or inclusive and ratio == threshold:
            full += 1
            size, ratio = 0, 1.0
            seen.clear()
    if size:
        full += (1 - ratio) / (1 - threshold)
    return len(w) / full if full else float(len(w))


def mtld(w: list[str], threshold: float = THRESHOLD, inclusive: bool = False) -> float:
    """Mean of the passes forwards and backwards; an all-distinct text is one segment; 0 without words."""
    return (factors(w, threshold, inclusive) + factors(w[::-1], threshold, inclusive)) / 2 if w else 0.0


def msttr(w: list[str], size: int = SEGMENT) -> float:
    if len(w) <= size:
        return float(len(w))
    whole = len(w) // size
    return sum(len(set(w[i * size : (i + 1) * size])) for i in range(whole)) / (size * whole)


def mattr(w: list[str], size: int = SEGMENT) -> float:
    if len(w) <= size:
        return float(len(w))
    inside = Counter(w[:size])
    total = distinct = len(inside)
    for out, new in zip(w, w[size:]):
        if inside[out] == 1:
            del inside[out]
            distinct -= 1
        else:
            inside[out] -= 1
        if new not in inside:
            distinct += 1
        inside[new] += 1
        total += distinct
    return total / (size * (len(w) - size + 1))


_SEQUENCE = StructType([StructField("once", LongType()), *(StructField(c, DoubleType()) for c in ("hdd", "yulek", "mtld", "msttr", "mattr"))])


@F.pandas_udf(_SEQUENCE)
def _sequence(joined: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in joined:
        rows = []
        for line in part:
            w = line.split(" ") if line else []
            counts = list(Counter(w).values())
            n = len(w)
            yulek = (sum(f * f for f in counts) - n) / (n * n) if n else 0.0
            rows.append((counts.count(1), hdd(counts, n), yulek, mtld(w), msttr(w), mattr(w)))
        yield pd.DataFrame(rows, columns=["once", "hdd", "yulek", "mtld", "msttr", "mattr"])


def lexical_variation(texts: DataFrame, key: str = "doc_id", text: str | None = "text", sequence: Column | None = None) -> DataFrame:
    """(key, *NAMES), one row for each row of texts.

    The words are runs of letters in lower case, or the given array (lexical tokens of an annotated text). Counts and ratios
    stay in the JVM; indices that depend on order or on frequencies share one Arrow pass over the joined words. Null and
    blank texts have zeros throughout; repeated rows give a row each; other columns are left out.
    """
    w = F.coalesce(words(F.col(text)) if sequence is None else sequence, F.array().cast("array<string>"))
    rows = texts.select(F.col(key).alias("_key"), w.alias("_w"))
    rows = rows.select("_key", F.size("_w").cast("long").alias("LV_W"), F.size(F.array_distinct("_w")).cast("long").alias("LV_WT"), F.array_join("_w", " ").alias("_j"))
    rows = rows.withColumn("_q", _sequence("_j")).drop("_j").withColumns(closed_form(F.col("LV_W"), F.col("LV_WT")))
    seq = {"LV_WT1": "once", "LV_HDD": "hdd", "LV_YULEK": "yulek", "LV_MTLD": "mtld", "LV_MSTTR": "msttr", "LV_MATTR": "mattr"}
    return rows.select(F.col("_key").alias(key), *((F.col(f"_q.{seq[c]}") if c in seq else F.col(c)).alias(c) for c in NAMES))


def variation_basic(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, W, WT, ratios and log indices) alone: no Python at all. Null and blank texts have zeros."""
    w = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))
    rows = texts.select(F.col(key), F.size(w).cast("long").alias("LV_W"), F.size(F.array_distinct(w)).cast("long").alias("LV_WT"))
    return rows.withColumns(closed_form(F.col("LV_W"), F.col("LV_WT")))
