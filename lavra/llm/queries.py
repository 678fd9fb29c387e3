"""The queries p1 to p10 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.repeated_lines import repeated_lines

    return repeated_lines(table(spark, d, "md"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.repeated_lines import without_repeated_lines

    return without_repeated_lines(table(spark, d, "md"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.best_record import best_records

    best = best_records(table(spark, d, "validation_results"), table(spark, d, "origins"))
    return best.select("survivor_id", "act_type", "act_number", "act_year")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.hash_forest import rejected_entries

    return rejected_entries(table(spark, d, "manifest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.shared_spans import shared_spans

    return shared_spans(table(spark, d, "documents"))


def p10_amounts(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.shared_spans import shared_amounts

    return shared_amounts(table(spark, d, "documents"))


def _sizes(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """(doc_id, tokens) of ``docs``, written once."""
    from lavra.llm.tokens import token_counts
    from lavra.session import Scratch

    return Scratch(spark, name).write(token_counts(docs, "doc_id", "text"), "sizes")


def _specs(spark: SparkSession, d: str) -> dict[int, int]:
    # A table of settings, one row for each kind of container.
    return {r.spec_id: r.capacity_tokens for r in table(spark, d, "pack_specs").collect()}


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.packing import pack

    return pack(_sizes(spark, table(spark, d, "documents"), "p8"), _specs(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.packing import fill_report

    return fill_report(p8_packing(spark, d), _specs(spark, d))


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing: (spec_id, documents placed, containers over capacity, small items that are split, items with gaps)."""
    from lavra.session import Scratch

    packed = Scratch(spark, "valid").write(p8_packing(spark, d), "packed")
    specs = table(spark, d, "pack_specs").select("spec_id", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    size = F.col("token_end") - F.col("token_start")
    load = packed.groupBy("spec_id", "container_id").agg(F.sum(size).alias("load")).join(F.broadcast(specs), "spec_id")
    over = load.groupBy("spec_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("over_capacity"))
    items = packed.groupBy("spec_id", "doc_id").agg(F.count("*").alias("parts"), F.max("token_end").alias("tokens"), F.sum(size).alias("placed"), F.min("token_start").alias("first"))
    items = items.join(F.broadcast(specs), "spec_id").groupBy("spec_id").agg(
        F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("split"),
        F.count_if((F.col("placed") != F.col("tokens")) | (F.col("first") != 0)).alias("gaps"),
    )
    return items.join(over, "spec_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.mixing import mix, read_targets

    docs, targets = table(spark, d, "documents"), read_targets(table(spark, d, "mix_targets"))
    wanted = docs.where(docs.source.isin([t.source for t in targets]))
    return mix(docs, _sizes(spark, wanted, "p9"), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.mixing import read_targets, shares

    return shares(p9_mix(spark, d), read_targets(table(spark, d, "mix_targets")))


def p9_valid(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a mixture: (source, whether it has texts and gives some, rows over its repeats, rows of other sources, rows that
    come twice)."""
    from lavra.session import Scratch

    mixed = Scratch(spark, "valid").write(p9_mix(spark, d), "mixed")
    targets = table(spark, d, "mix_targets").select("source", "max_repeats")
    own = table(spark, d, "documents").select("doc_id", F.col("source").alias("of"))
    rows = mixed.join(own, "doc_id").groupBy("source", "doc_id", "of").agg(F.count("*").alias("n"), F.sum("repeats").alias("repeats"))
    rows = rows.join(F.broadcast(targets), "source").groupBy("source").agg(
        F.lit(True).alias("gives"), F.count_if(F.col("repeats") > F.col("max_repeats")).alias("over_repeats"), F.count_if(F.col("of") != F.col("source")).alias("foreign"),
        F.count_if(F.col("n") > 1).alias("twice"),
    )
    return targets.select("source").join(rows, "source", "left").na.fill(0).na.fill(False)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.main_body import main_bodies

    return main_bodies(table(spark, d, "pages")).select("page_id", F.md5("block").alias("block_md5")).distinct()


def p4_bodies(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.main_body import main_bodies

    body = main_bodies(table(spark, d, "pages")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "block"))).alias("b"))
    return body.select("page_id", F.array_join("b.block", "\n\n").alias("body"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.markup import structure

    content = F.trim(F.regexp_replace("content", r"(?U)[\s\x1c-\x1f]+", " "))
    return structure(table(spark, d, "menu_items")).select("item_id", "kind", content.alias("content")).distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.scan_repair import scan_faults

    return scan_faults(table(spark, d, "pdf_conversions"), table(spark, d, "lexicon"))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.scan_repair import repaired

    return repaired(table(spark, d, "pdf_conversions"), table(spark, d, "lexicon"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.residue import residue

    return residue(table(spark, d, "md"))


def p1_validation(spark: SparkSession, d: str) -> DataFrame:
    from lavra.llm.residue import validation

    return validation(table(spark, d, "md"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("p") and k.split("_")[0][1:].isdigit()}


def oracle_sql() -> dict[str, str]:
    from lavra.llm import sql

    return {k: v for k, v in vars(sql).items() if k.startswith("p") and k.split("_")[0][1:].isdigit()}
