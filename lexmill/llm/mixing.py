"""Problem 8: mixing sources to target weights of tokens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.packing import ranked
from lexmill.session import stored


class Mix:
    """Entropy balancing of documents under one token constraint a source.

    items(doc_id, source, n_tokens); targets(source, target_permille, max_repeats). The wanted rates minimise the relative
    entropy to the uniform rate subject to: tokens of each source = its share of the total size, rates at most
    max_repeats. The solution is rate = min(max_repeats, exp(lambda * tokens)) with one lambda a source; the dual is convex
    and is solved by Newton steps, each one aggregation over the histogram (source, tokens, documents). size: tokens of
    the whole mix; those of all documents by default. Sources without a target, and documents without tokens or with a
    null source, are not in the mix but count in the default size; no documents give an empty mix.
    """

    def __init__(self, items: DataFrame, targets: DataFrame, size: int | None = None, steps: int = 40) -> None:
        goals = targets.where("source IS NOT NULL").groupBy("source").agg(
            F.sum("target_permille").alias("target_permille"), F.max("max_repeats").alias("max_repeats")
        )
        # Stored once, as the sizes are dear to count and are read by the histogram, the ranks and the copies.
        self.items = stored(items.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0"))
        self.histogram = histogram = stored(self.items.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
        self.size = size if size is not None else histogram.agg(F.sum(F.expr("n * n_tokens"))).first()[0] or 0
        have = histogram.groupBy("source").agg(F.sum(F.expr("n * n_tokens")).alias("have"), F.max("n_tokens").alias("longest"), F.sum("n").alias("documents"))
        rows = goals.join(have, "source", "left").fillna({"have": 0, "longest": 1, "documents": 0}).collect()  # one row a source of the targets
        self.goals = {r["source"]: r for r in rows}
        self.tilt = self._solve(histogram, steps)

    def _solve(self, histogram: DataFrame, steps: int) -> dict[str, float]:
        """lambda of each source, by Newton steps kept within a shrinking bracket."""
        want = {s: self.size * g["target_permille"] / 1000 for s, g in self.goals.items()}
        tilt, low, high = {}, {}, {}
        for s, g in self.goals.items():
            cap = math.log(max(1, g["max_repeats"]))
            if want[s] <= 0 or not g["have"]:
                tilt[s] = -math.inf
            elif want[s] >= g["have"] * g["max_repeats"]:
                tilt[s] = math.inf
            else:
                mean = math.log(want[s] / g["have"])
                tilt[s] = min(cap, mean) / max(1.0, g["longest"] / 4)
                low[s], high[s] = -60.0, max(1e-9, cap) + 1e-9
        open_ = set(low)
        spark = histogram.sparkSession
        for _ in range(steps):
            if not open_:
                break
            now = spark.createDataFrame([(s, tilt[s], float(self.goals[s]["max_repeats"])) for s in sorted(open_)], "source string, l double, cap double")
            rate = F.exp(F.least(F.col("l") * F.col("n_tokens"), F.log("cap")))
            mass = F.col("n") * F.col("n_tokens") * rate
            sums = histogram.join(F.broadcast(now), "source").groupBy("source").agg(
                F.sum(mass).alias("g"), F.sum(F.when(F.col("l") * F.col("n_tokens") < F.log("cap"), mass * F.col("n_tokens")).otherwise(0.0)).alias("h")
            )
            for r in sums.collect():
                s, gap = r["source"], r["g"] - want[r["source"]]
                if abs(gap) <= max(0.5, 1e-9 * want[s]):
                    open_.discard(s)
                    continue
                (high if gap > 0 else low)[s] = tilt[s]
                step = tilt[s] - gap / r["h"] if r["h"] > 0 else math.nan
                tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
        return tilt

    def copies(self, seed: int = 7) -> DataFrame:
        """(doc_id, source, n_tokens, copies): rates rounded to whole copies, at most max_repeats; zero copies are left out.

        Rounding is systematic: along a source's documents in order of size the copies follow the running sum of the rates,
        from a random start, so that the tokens of the mix stay within about one document of the target. Documents of one
        source and size share a rate, and so only need their rank among their equals.
        """
        rows = [(s, self.tilt[s], int(g["max_repeats"])) for s, g in self.goals.items()]
        known = self.items.sparkSession.createDataFrame(rows, "source string, _l double, _cap long")
        rate = (
            F.when(F.col("_l") == float("inf"), F.col("_cap").cast("double"))
            .when(F.col("_l") == float("-inf"), 0.0)
            .otherwise(F.exp(F.least(F.col("_l") * F.col("n_tokens"), F.log(F.greatest(F.col("_cap"), F.lit(1))))))
        )
        sizes = self.histogram.join(F.broadcast(known), "source").withColumn("_r", rate)  # known: one row a source of the targets
        upto = F.sum(F.col("n") * F.col("_r")).over(Window.partitionBy("source").orderBy("n_tokens"))
        start = F.shiftrightunsigned(F.xxhash64(F.col("source"), F.lit(seed)), 11) / float(1 << 53)
        sizes = sizes.select("source", "n_tokens", "_r", "_cap", (upto - F.col("n") * F.col("_r") + start).alias("_at"))
        out = ranked(self.items, ["source", "n_tokens"], ["doc_id"]).join(sizes, ["source", "n_tokens"])
        steps = F.floor(F.col("_at") + (F.col("_rank") + 1) * F.col("_r")) - F.floor(F.col("_at") + F.col("_rank") * F.col("_r"))
        whole = F.col("_r") == F.floor("_r")  # exact, whatever the running sum's last digits
        out = out.withColumn("copies", F.when(whole, F.floor("_r")).otherwise(F.least(steps, F.col("_cap"))).cast("long"))
        return out.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")

    def report(self) -> DataFrame:
        """(source, target_permille, have_tokens, mix_tokens, mix_documents, actual_permille, reachable), one row a source of the targets.

        Everything about the mix is counted from its copies. A source is not reachable where every document of it is used
        max_repeats times and its tokens still fall short of its share.
        """
        rows = [(s, int(g["target_permille"]), int(g["have"]), int(g["documents"]), int(g["max_repeats"])) for s, g in self.goals.items()]
        goals = self.items.sparkSession.createDataFrame(rows, "source string, target_permille long, have_tokens long, _documents long, _most long")
        got = self.copies().groupBy("source").agg(F.sum(F.expr("n_tokens * copies")).alias("mix_tokens"), F.sum("copies").alias("mix_documents"))
        out = goals.join(got, "source", "left").fillna({"mix_tokens": 0, "mix_documents": 0})
        short = F.col("mix_tokens") * 1000 < F.lit(self.size) * F.col("target_permille")
        spent = F.col("mix_documents") >= F.col("_documents") * F.col("_most")
        return out.select(
            "source", "target_permille", "have_tokens", "mix_tokens", "mix_documents",
            F.round(F.col("mix_tokens") * 1000.0 / max(1, self.size), 3).alias("actual_permille"), (~(short & spent)).alias("reachable"),
        )
