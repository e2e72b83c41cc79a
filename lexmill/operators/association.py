"""Association scores of a document's collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to every observed frequency, against zeros. Fixed value.
TINY = 1e-33
MEASURES = ("mi", "mi3", "t", "z", "chi2")


def scored(found: DataFrame, edges: DataFrame, standard_contingency: bool = False, cells: bool = False) -> DataFrame:
    """Distinct collocations of each document with their scores: (doc_id, lempos1, lempos2, type, o11, mi, mi3, t, z, chi2).

    Frequencies come from the edge table whatever the type, from marginals summed once; a pair without edges has only the
    tiny constant. Like the original, the fourth cell is the total less the pair's frequency unless standard_contingency.
    A collocation that a document repeats is scored once. cells adds the other observed and the expected frequencies.
    """
    pair = edges.groupBy("lempos1", "lempos2").agg(F.sum("raw_freq").cast("double").alias("_f"))
    row = edges.groupBy("lempos1").agg(F.sum("raw_freq").cast("double").alias("_r"))
    col = edges.groupBy("lempos2").agg(F.sum("raw_freq").cast("double").alias("_c"))
    total = edges.agg(F.coalesce(F.sum("raw_freq"), F.lit(0)).cast("double").alias("_n"))
    rows = found.select("doc_id", "lempos1", "lempos2", "type").distinct()
    rows = rows.join(pair, ["lempos1", "lempos2"], "left").join(row, "lempos1", "left").join(col, "lempos2", "left").crossJoin(F.broadcast(total))  # total is one row
    f, r, c = (F.coalesce(x, F.lit(0.0)) for x in ("_f", "_r", "_c"))
    rest = F.col("_n") - r - c + f if standard_contingency else F.col("_n") - f
    rows = rows.withColumns({"o11": f + TINY, "_o12": r - f + TINY, "_o21": c - f + TINY, "_o22": rest + TINY})
    o = {k: F.col(k) for k in ("o11", "_o12", "_o21", "_o22")}
    n = o["o11"] + o["_o12"] + o["_o21"] + o["_o22"]
    r1, r2, c1, c2 = o["o11"] + o["_o12"], o["_o21"] + o["_o22"], o["o11"] + o["_o21"], o["_o12"] + o["_o22"]
    rows = rows.withColumns({"_e11": r1 * c1 / n, "_e12": r1 * c2 / n, "_e21": r2 * c1 / n, "_e22": r2 * c2 / n})
    e = F.col("_e11")
    chi = sum(((o[a] - F.col(b)) ** 2 / F.col(b) for a, b in (("o11", "_e11"), ("_o12", "_e12"), ("_o21", "_e21"), ("_o22", "_e22"))), F.lit(0.0))
    return rows.select(
        "doc_id", "lempos1", "lempos2", "type", "o11", F.ln(o["o11"] / e).alias("mi"), (3 * F.ln(o["o11"]) - F.ln(e)).alias("mi3"),
        ((o["o11"] - e) / F.sqrt("o11")).alias("t"), ((o["o11"] - e) / F.sqrt(e)).alias("z"), chi.alias("chi2"),
        *([F.col(f"_{k}").alias(k) for k in ("o12", "o21", "o22", "e11", "e12", "e21", "e22")] if cells else []),
    )


def association_indices(scores: DataFrame) -> DataFrame:
    """(doc_id, <measure>_mean, _min, _max): each of the five measures over a document's collocations, NaN left out."""
    clean = {m: F.when(~F.isnan(m), F.col(m)) for m in MEASURES}
    return scores.groupBy("doc_id").agg(*(f(clean[m]).alias(f"{m}_{name}") for m in MEASURES for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))


def log_likelihood(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """G2 = 2 * sum of o * ln(o / e) over the four cells, each distinct pair of a document once: (doc_id, lempos1, lempos2, type, g2).

    Cells are those of the standard table; an empty cell adds nothing. A pair without edges has 0.
    """
    base = scored(scores, edges, standard_contingency=True, cells=True)
    part = lambda o, e: F.when(F.col(o) > 1e-9, F.col(o) * (F.ln(o) - F.ln(e))).otherwise(0.0)
    g2 = 2 * sum((part(f"o{k}", f"e{k}") for k in ("12", "21", "22")), part("o11", "e11"))
    return base.select("doc_id", "lempos1", "lempos2", "type", F.when(F.col("o11") > 1e-9, g2).otherwise(0.0).alias("g2"))
