"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.session import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b: BIGINT); label is the component's smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones and itself, onto the smallest
    neighbour; edges stay at most as many as before. Rounds end when no edge changes, after about
    log2(n) of them. Only minima are aggregated, so no neighbourhood is ever gathered. Loops and repeated
    edges do no harm; an empty table gives no rows.
    """
    now = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{name}0"
    )
    before, k = None, 0
    while True:
        k += 1
        both = now.select("hi", "lo").union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        large = scratch.write(large.where("hi <> lo"), f"{name}{k}a")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        small = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", F.col("m").alias("lo")))
        now = scratch.write(small.where("hi <> lo").distinct(), f"{name}{k}b")
        # What earlier rounds wrote isn't read again.
        scratch.drop(f"{name}{k}a")
        scratch.drop(f"{name}{k - 1}b" if k > 1 else f"{name}0")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
    labels = now.groupBy("hi").agg(F.min("lo").alias("label")).withColumnRenamed("hi", "node")
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())
