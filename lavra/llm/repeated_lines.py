"""Problem 7: lines repeated across the documents of one source.

Normalized lines are hashed (96 bits), the distinct documents of each (source, hash) are counted with partial
aggregation before the shuffle, frequent lines are joined back, and documents are rebuilt without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.operators.skew import join_counted
from lavra.session import Scratch

#: White space as Unicode has it, with the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def normal_line(line: Column) -> Column:
    """Lower case, white space collapsed to one blank, trimmed."""
    return F.trim(F.lower(F.regexp_replace(line, SPACE, " ")))


def line_table(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """One row (key, source, line_no, h1, h2) for each line with a letter; line_no counts from 1."""
    lines = docs.where(F.col(source).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")
    )
    normal = lines.where(F.col("line").rlike(r"\p{L}")).withColumn("line", normal_line(F.col("line")))
    return normal.select("key", "source", (F.col("pos") + 1).alias("line_no"), F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def repeated_lines(docs: DataFrame, key: str = "md_id", source: str = "source", text: str = "body", min_docs: int = 5) -> DataFrame:
    """The lines (key, line_no) that stand in at least ``min_docs`` distinct documents of their source.

    Null or empty texts have no lines; documents of a NULL source belong to no site and are left alone; a line
    repeated within one document counts once; lines without a letter are never cases. Keys must be unique;
    other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.write(line_table(docs, key, source, text), "lines")
    own = ["source", "h1", "h2"]
    per_doc = lines.groupBy(*own, "key").agg(F.count("*").alias("n"))
    counts = per_doc.groupBy(*own).agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    frequent = scratch.write(counts, "frequent")
    return join_counted(lines, frequent, own, "n", ["key", "line_no"]).select(F.col("key").alias(key), F.col("line_no"))


def without_repeated_lines(docs: DataFrame, key: str = "md_id", source: str = "source", text: str = "body", min_docs: int = 5) -> DataFrame:
    """(key, text, removed): each document rebuilt without the lines of :func:`repeated_lines`.

    A NULL text stays NULL, with 0 removed.
    """
    found = repeated_lines(docs, key, source, text, min_docs)
    gone = found.groupBy(key).agg(F.sort_array(F.collect_list("line_no")).alias("_gone"))
    lines = F.split(F.col(text), "\n", -1)
    # The lines between those that go, so long texts with many such lines take one pass.
    before = F.concat(F.array(F.lit(0)), F.col("_gone"))
    after = F.concat(F.col("_gone"), F.array(F.size(lines) + 1))
    kept = F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 1, b - a - 1))), "\n")
    return docs.select(key, text).join(gone, key, "left").select(
        key,
        F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept).alias(text),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("removed"),
    )
