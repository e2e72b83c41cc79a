"""Problem 5: a sample whose cells match target shares."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import level_name, typed_number
from lexmill.session import stored

#: Priorities have 60 bits; their upper ten give the slice, so that trimming ranks no whole cell.
SLICES = 1024


def priority(key: Column, seed: int = 1) -> Column:
    """A fixed random number of 60 bits from a key: the first fifteen hexadecimal digits of an MD5 sum."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key)), 1, 15), 16, 10).cast("long")


def usable_cells(records: DataFrame, targets: DataFrame) -> DataFrame:
    """records(id, level, vocab_grade_avg) to (id, level, vocab_band): one row per usable record.

    Usable: the level, however spelled, is one of the targets' and the grade is a number from 0 to 4. Others give no row.
    """
    grade = typed_number(F.col("vocab_grade_avg"))
    rows = records.select("id", level_name(F.col("level")).alias("level"), grade.alias("_g")).where(
        "id IS NOT NULL AND level IS NOT NULL AND _g BETWEEN 0 AND 4"
    )
    rows = rows.select("id", "level", F.when(F.col("_g") < 2, "low").when(F.col("_g") < 3, "mid").otherwise("high").alias("vocab_band"))
    listed = targets.select("level").distinct()
    return rows.join(listed, "level", "left_semi").dropDuplicates(["id"])


class Reservoirs:
    """Mergeable bottom-k reservoirs of each cell over rows(id, *cell), filled in one pass.

    Each row has a fixed random priority from its id; a cell's sample of any size k is its k smallest priorities. Every task
    keeps of each cell the `most` smallest it meets and counts all it meets; the union of the tasks' reservoirs holds the
    cell's `most` smallest, and the counts add up. bounds(*cell, most) must reach every quota asked for afterwards; cells
    without a bound are counted only. A task holds at most 2 x `most` rows a cell, and never more than it reads. Kept rows
    carry their slice of the priority range, so that trimming drops whole slices and ranks one, never a whole cell.
    """

    def __init__(self, rows: DataFrame, cell: list[str], bounds: DataFrame, seed: int = 1) -> None:
        self.cell = cell
        most = {tuple(str(r[c]) for c in cell): int(r["most"]) for r in bounds.collect()}  # one row a cell of the targets

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple, list[np.ndarray]] = {}
            met: Counter = Counter()

            def smallest(key: tuple) -> np.ndarray:
                both = np.concatenate(held[key], axis=1)
                k = most[key]
                return both if both.shape[1] <= k else both[:, np.lexsort((both[1], both[0]))[:k]]

            for batch in batches:
                names = [batch.column(i + 2).cast(pa.string()).dictionary_encode() for i in range(len(cell))]
                code = np.zeros(batch.num_rows, np.int64)
                for n in names:
                    code = code * len(n.dictionary) + n.indices.to_numpy()
                both = np.stack([batch.column(1).to_numpy(), batch.column(0).to_numpy()])
                for c in np.unique(code):
                    at = np.flatnonzero(code == c)
                    key = tuple(n[int(at[0])].as_py() for n in names)
                    met[key] += len(at)
                    if most.get(key):
                        held.setdefault(key, []).append(both[:, at])
                        if sum(x.shape[1] for x in held[key]) > 2 * most[key]:
                            held[key] = [smallest(key)]
            for key, n in met.items():
                kept = smallest(key) if key in held else np.zeros((2, 0), np.int64)
                cells = [pa.array([x] * kept.shape[1], pa.string()) for x in key]
                yield pa.RecordBatch.from_arrays([pa.array(kept[1]), pa.array(kept[0]), *cells, pa.nulls(kept.shape[1], pa.int64())], names=columns)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *(pa.array([x], pa.string()) for x in key), pa.array([n], pa.int64())], names=columns)

        columns = ["id", "_p", *cell, "_met"]
        schema = "id long, _p long, " + ", ".join(f"{c} string" for c in cell) + ", _met long"
        out = stored(rows.select(F.col("id").cast("long"), priority(F.col("id"), seed).alias("_p"), *cell).dropna(subset=cell).mapInArrow(fill, schema))
        self.counts = out.where("_met IS NOT NULL").groupBy(*cell).agg(F.sum("_met").alias("have"))
        self.rows = out.where("_met IS NULL").select("id", *cell, "_p", F.shiftright("_p", 50).cast("int").alias("_slice"))

    def trim(self, quotas: DataFrame) -> DataFrame:
        """quotas(*cell, quota) to the kept rows (id, *cell): uniform within each cell, exactly min(quota, have) rows."""
        w = Window.partitionBy(*self.cell).orderBy("_slice")
        slices = self.rows.groupBy(*self.cell, "_slice").agg(F.count("*").alias("_n"))
        upto = slices.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).join(quotas, self.cell)
        upto = upto.where("_before < quota").select(*self.cell, "_slice", (F.col("quota") - F.col("_before")).alias("_left"), "_n")
        # At most SLICES rows a cell of the targets.
        rows = self.rows.join(F.broadcast(upto), [*self.cell, "_slice"])
        whole = rows.where("_left >= _n")
        part = rows.where("_left < _n").withColumn(
            "_rank", F.row_number().over(Window.partitionBy(*self.cell, "_slice").orderBy("_p", "id"))
        )
        return whole.select("id", *self.cell).unionByName(part.where("_rank <= _left").select("id", *self.cell))


def proportional_sample(rows: DataFrame, targets: DataFrame, size: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows(id, level, vocab_band) and targets(level, vocab_band, target_permille, min_rows) to (sample, report).

    size: rows of the sample; half of all rows, rounded down, by default. most: an upper bound of the number of rows, from
    which the reservoirs' bounds follow before the pass; counted when not given. A cell's quota is the greater of min_rows
    and its share of the size, rounded down; cells with fewer rows give all they have. report(level, vocab_band, have, quota,
    taken, exhausted) has every target cell; `taken` is counted from the sample drawn, and a cell whose sample falls short of
    its quota is exhausted. Null cells are left out; empty inputs give an empty sample and a report of empty cells.
    """
    cell = ["level", "vocab_band"]
    goals = targets.groupBy(*cell).agg(F.sum("target_permille").alias("target_permille"), F.max("min_rows").alias("min_rows"))
    limit = size if size is not None else (most if most is not None else rows.count()) // 2
    share = F.expr("_size * target_permille div 1000")
    kept = Reservoirs(rows, cell, goals.withColumn("_size", F.lit(limit)).select(*cell, F.greatest("min_rows", share).alias("most")))
    n = F.lit(size) if size is not None else F.floor(F.coalesce(F.sum("have"), F.lit(0)) / 2)
    n = kept.counts.agg(n.alias("_size"))
    quotas = goals.crossJoin(F.broadcast(n)).select(*cell, F.greatest("min_rows", share).alias("quota"))  # n is one row
    sample = kept.trim(quotas)
    taken = sample.groupBy(*cell).agg(F.count("*").alias("taken"))
    zero = F.lit(0).cast("long")
    report = quotas.join(kept.counts, cell, "left").join(taken, cell, "left").select(
        *cell, F.coalesce("have", zero).alias("have"), "quota", F.coalesce("taken", zero).alias("taken"), (F.coalesce("taken", zero) < F.col("quota")).alias("exhausted"),
    )
    return sample, report
