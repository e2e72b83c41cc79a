"""Connected components by minimum labels, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import checkpoint


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of long node ids to (node, root), root being the smallest id of the component.

    Every round hands each node the smallest grandparent label among its neighbours, hooks the node's parent to it as
    well, and shortcuts the node to its own grandparent; so chains shrink geometrically. Labels are combined before the
    shuffle, so a node with very many links is no bottleneck; each round is checkpointed, so lost executors cost one
    round. Loops and repeated edges are harmless; null ends are dropped; no edges give no rows.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    )
    links = checkpoint(links.select("e.u", "e.v").distinct())
    parent = checkpoint(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("f")))
    before = None
    for _ in range(rounds):
        up = parent.select(F.col("node").alias("f"), F.col("f").alias("g"))
        known = parent.join(up, "f").select("node", "f", "g")
        near = links.join(known.select(F.col("node").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        hooked = known.join(near.withColumnRenamed("u", "node"), "node").select(
            F.explode(
                F.array(
                    F.struct("node", F.least("m", "g").alias("f")),
                    F.struct(F.col("f").alias("node"), F.col("m").alias("f")),
                )
            ).alias("x")
        )
        parent = checkpoint(hooked.select("x.node", "x.f").groupBy("node").agg(F.min("f").alias("f")))
        now = parent.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return parent.select("node", F.col("f").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle within {rounds} rounds")
