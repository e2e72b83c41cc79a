"""Problem 1: near-duplicate records."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import _minhash as M
from lexmill.llm._graph import components
from lexmill.session import stored

#: Candidate nodes beyond this number are joined by shuffle instead of a broadcast of their ids (some 64 bytes each in a hashed relation: 20 MB).
BROADCAST_IDS = 300_000
#: A band of more nodes is compared block by block, each two blocks of so many nodes in a task of their own.
BLOCK = 2000


def normal_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits, underscores and apostrophes, parted by single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_']+", " "))


def band_plan(threshold: float, miss: float = 0.02) -> tuple[int, int]:
    """(bands, rows): a pair at the threshold itself shares no band with probability `miss`, one above it far less often."""
    rows = max(1, round(math.log(0.13) / math.log(threshold)))
    return max(math.ceil(64 / rows), math.ceil(math.log(miss) / math.log(1 - threshold**rows))), rows


class NearDuplicates:
    """Groups of records whose word shingles have a Jaccard similarity of `threshold` or more.

    records: a table with columns `key` and `text` named. Texts equal in their words form one node. SuperMinHash
    signatures of the nodes' shingles are cut into bands; nodes that share a band and whose two-bit sketches agree are
    candidates; candidates are verified exactly on their whole texts; components of the verified links are the groups.
    Null and blank texts, and texts of fewer than `least` words, are in no group; a record delivered twice counts once;
    texts shorter than a shingle only have their equals. Hot copies collapse to one node in each task before any shuffle.
    Bands are counted with map-side combining; those of one node alone are dropped, and the others are compared in blocks,
    so that a band of very many nodes is divided over tasks. The joins on bands are by shuffle, whatever the optimizer
    estimates. No records give empty results.
    """

    def __init__(self, records: DataFrame, key: str = "id", text: str = "text", words: int = 5, threshold: float = 0.8, least: int = 1) -> None:
        self.words, self.threshold = words, threshold
        rows = records.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")).where("id IS NOT NULL AND _text IS NOT NULL")
        norm = normal_words(F.col("_text"))
        signed = stored(self._signed(rows.select("id", F.xxhash64(norm).alias("node"), norm.alias("_norm")), max(1, least)))
        self.members = signed.where(F.col("n") >= max(1, least)).select("id", "node").distinct()
        self.links = self._verified(rows, self._candidates(signed.where("keys IS NOT NULL").drop("id", "n")))

    def _signed(self, rows: DataFrame, least: int) -> DataFrame:
        """(id, node, n, s1, s2, keys): words, sketch and band keys; keys are null for texts seen before in the task and for short ones."""
        words, (bands, size) = self.words, band_plan(self.threshold)
        lanes = max(64, bands * size)

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            np.seterr(over="ignore")
            for batch in batches:
                for low, high in M.portions(batch.column(2), 512, 1 << 20):
                    part = batch.slice(low, high - low)
                    texts = part.column(2).cast(pa.large_string())
                    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
                    fresh = np.array([n not in seen and not seen.add(n) for n in part.column(1).to_pylist()], bool)
                    hashes, of, counts = M.shingles(data, bounds, words)
                    has = fresh & (counts >= max(least, words))
                    kept = has[of]
                    at = np.cumsum(has) - 1
                    table = M.signatures(hashes[kept], at[of[kept]], int(has.sum()), lanes)
                    one, two = (np.zeros(len(has), np.int64) for _ in range(2))
                    one[has], two[has] = M.sketch(table)
                    keys = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(has * bands)]), pa.int32()), pa.array(M.band_keys(table, bands, size).ravel()), mask=pa.array(~has)
                    )
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(counts, pa.int32()), pa.array(one), pa.array(two), keys], names=["id", "node", "n", "s1", "s2", "keys"]
                    )

        return rows.mapInArrow(sign, "id long, node long, n int, s1 long, s2 long, keys array<long>")

    def _candidates(self, nodes: DataFrame) -> DataFrame:
        """nodes(node, s1, s2, keys) to (a, b) of nodes, a < b, that share a band and agree in their sketches."""
        by_band = nodes.select("node", F.explode("keys").alias("key"))
        # A text that several tasks have signed counts once for each; the distinct rows below make it one again.
        sizes = by_band.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key", F.expr(f"cast((_n - 1) div {BLOCK} as int)").alias("_last"))
        shared = by_band.hint("merge").join(sizes.hint("merge"), "key").distinct()
        # Sketches come back by node, once the bands that only one text has are gone.
        sketches = nodes.select("node", "s1", "s2").dropDuplicates(["node"])
        shared = stored(shared.hint("merge").join(sketches.hint("merge"), "node"))
        block = F.pmod(F.xxhash64("node"), F.col("_last") + 1).cast("int")
        mine = shared.select("key", "node", "s1", "s2", "_last", block.alias("_block"))
        left = mine.select("key", "node", "s1", "s2", F.col("_block").alias("_i"), F.explode(F.sequence("_block", "_last")).alias("_j"))
        right = mine.select("key", "node", "s1", "s2", F.explode(F.sequence(F.lit(0), "_block")).alias("_i"), F.col("_block").alias("_j"))
        # Lanes agree in both bits with probability 1/4 + 3/4 J; two deviations below that of the threshold pass.
        p = 0.25 + 0.75 * self.threshold
        enough = int(64 * p - 2.1 * math.sqrt(64 * p * (1 - p)))
        differ = F.expr("bit_count((x.s1 ^ y.s1) | (x.s2 ^ y.s2))")
        both = left.alias("x").hint("merge").join(right.alias("y").hint("merge"), F.expr("x.key = y.key AND x._i = y._i AND x._j = y._j"))
        both = both.where(F.expr("(x._i < x._j OR x.node < y.node) AND x.node <> y.node") & (differ <= 64 - enough))
        return both.select(F.expr("least(x.node, y.node) AS a"), F.expr("greatest(x.node, y.node) AS b")).distinct()

    def _verified(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the candidates that hold on their whole texts."""
        pairs = stored(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        one = stored(self.members.join(wanted, "node").groupBy("node").agg(F.min("id").alias("id")))
        ids = F.broadcast(one) if one.count() <= BROADCAST_IDS else one
        texts = rows.join(ids, "id").select("node", "_text").dropDuplicates(["node"])
        size = self.words
        words = F.split(normal_words(F.col("_text")), " ")
        runs = F.when(
            F.size("_w") >= size,
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - (size - 1)), lambda i: F.array_join(F.slice("_w", i, size), " "))),
        ).otherwise(F.array().cast("array<string>"))
        texts = texts.select("node", words.alias("_w")).select("node", F.transform(runs, lambda x: F.xxhash64(x)).alias("_s"))
        texts = texts.hint("merge")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("_s").alias("_x")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("_s").alias("_y")), "b"
        )
        common = F.size(F.array_intersect("_x", "_y"))
        return stored(
            both.select("a", "b", (common / (F.size("_x") + F.size("_y") - common)).alias("similarity")).where(F.col("similarity") >= self.threshold)
        )

    def pairs(self) -> DataFrame:
        """(id_a, id_b, similarity), id_a < id_b: all pairs of records, those of equal words included."""
        other = self.members.select(F.col("id").alias("_o"), F.col("node").alias("b"))
        linked = self.links.join(self.members.withColumnRenamed("node", "a"), "a").join(other, "b").select("id", "_o", "similarity")
        again = self.members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
        copies = self.members.join(again, "node")
        same = copies.join(copies.select(F.col("id").alias("_o"), "node"), "node").where("id < _o").select("id", "_o", F.lit(1.0).alias("similarity"))
        return linked.unionByName(same).select(F.least("id", "_o").alias("id_a"), F.greatest("id", "_o").alias("id_b"), "similarity")

    def representatives(self) -> tuple[DataFrame, DataFrame]:
        """(links, members) without any pairs of copies: (id_a, id_b, similarity), id_a < id_b, between the smallest ids of
        different texts, and (id, representative) of every record that has a link or a copy. It grows with the links, not with the copies."""
        least = self.members.groupBy("node").agg(F.min("id").alias("representative"), F.count("*").alias("_n"))
        ends = self.links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("_linked", F.lit(True))
        least = stored(least.join(ends, "node", "left").where("_n > 1 OR _linked").select("node", "representative"))
        links = self.links.join(least.toDF("a", "_x"), "a").join(least.toDF("b", "_y"), "b")
        links = links.select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"), "similarity")
        return links, self.members.join(least, "node").select("id", "representative")

    def groups(self) -> DataFrame:
        """(id, group_id, links): every record in a group of two or more; group_id is its smallest id, links its linked texts, copies aside."""
        roots = components(self.links)
        ends = self.links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        known = self.members.join(roots, "node", "left").join(ends, "node", "left").select(
            "id", F.coalesce("root", "node").alias("_root"), F.coalesce("links", F.lit(0)).alias("links")
        )
        whole = known.groupBy("_root").agg(F.min("id").alias("group_id"), F.count("*").alias("_n")).where("_n > 1")
        return known.join(whole, "_root").select("id", "group_id", "links")
