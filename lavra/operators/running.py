"""Ranks and running sums within groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.session import Scratch

#: About so many rows of a group are worked on in one task.
PART_ROWS = 50_000


def running_sum(rows: DataFrame, groups: DataFrame, by: list[str], order: Column, weight: str, out: str, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``weight`` over the rows before, within ``by``, in the order of ``order``.

    ``groups`` has one row for each value of ``by`` with its number of rows ``n``; its size must have a bound that
    doesn't grow with the data, as it is broadcast. ``order`` must be a BIGINT that spreads evenly and is nearly unique, as a
    hash does: a group is cut into ranges of it, the ranges' sums are added up, and only within a range rows
    are sorted. Rows of equal ``order`` come in the order of their ``weight``; they should be told apart by ``order``.
    """
    sized = rows.withColumn("_o", order).join(F.broadcast(groups.select(*by, "n")), by)
    parts = F.ceil(F.col("n") / PART_ROWS)
    # The position of the hash in its whole range, as a part number.
    share = F.col("_o") / F.lit(2.0**64) + 0.5
    sized = sized.withColumn("_part", F.least(F.floor(share * parts), parts - 1).cast("int"))
    sized = scratch.write(sized, name)
    sums = sized.groupBy(*by, "_part").agg(F.sum(weight).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("_off", F.coalesce(before, F.lit(0))).drop("_s")
    within = F.sum(weight).over(Window.partitionBy(*by, "_part").orderBy("_o", weight).rowsBetween(Window.unboundedPreceding, -1))
    done = sized.withColumn("_in", F.coalesce(within, F.lit(0))).join(offsets, [*by, "_part"])
    return done.withColumn(out, F.col("_in") + F.col("_off")).drop("_o", "_part", "_in", "_off", "n")
