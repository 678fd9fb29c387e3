"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this part of all rows on, so there are at most so many hot keys, whatever the data.
HOT_PART = 1000
#: Into so many tasks the rows of a hot key are spread.
SALTS = 64


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``count`` the key's rows in ``left``.

    Keys with a thousandth of all rows or more are spread over :data:`SALTS` tasks by a hash of the columns
    ``by`` of ``left`` (not at random: a task that runs again must send its rows to the same places); the list of them has at
    most :data:`HOT_PART` rows by arithmetic and is the only thing broadcast. Null keys join nothing.
    ``right`` is read three times, so it should be a written table.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.where(F.col(count) >= max(2, total / HOT_PART)).select(*on, F.lit(True).alias("_hot"))
    spread = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    ).drop("_hot")
    is_hot = F.col(count) >= max(2, total / HOT_PART)
    copies = right.withColumn(
        "_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
