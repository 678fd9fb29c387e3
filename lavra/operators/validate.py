"""Audit of the metadata of normative acts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.legal import act_type, first_heading, legal_metadata
from lavra.functions.text import strip
from lavra.functions.yaml_map import mapping_of
from lavra.operators.skew import join_counted
from lavra.session import Scratch

# The issues, in the order in which they are noted, and the sentences of the report.
ISSUES = (
    "MISSING_FRONTMATTER", "MISSING_ACT_TYPE", "MISSING_ACT_NUMBER", "MISSING_ACT_YEAR", "MISSING_ACT_DATE", "TYPE_MISMATCH", "SUBDIR_MISMATCH(portarias!=act_type)",
    "SUBDIR_MISMATCH(resolucoes!=act_type)", "PUBLICATION_TEXT_BUT_NO_METADATA", "PUBLICATION_METADATA_BUT_NO_TEXT", "ALIASES_EMPTY",
)
REPORT_HEAD = ("# Relatório de validação de metadados", "")
REPORT_SUMMARY = ("", "## Resumo por problema", "")
REPORT_TAIL = (
    "", "## Recomendações", "", "- Preencher tipo, número, ano e data no front matter.", "- Conferir a coerência entre o H1 e os metadados.",
    "- Registrar os dados de publicação quando constarem no texto.", "- Remover chaves lógicas ou conteúdos duplicados.", "", "## Itens problemáticos", "",
)
_FIELDS = ("act_type", "act_number", "act_year", "act_date", "publication_page", "heading_type", "issues", "content_hash")


def validated(docs: DataFrame, path: str = "path", meta: str = "meta", body: str = "body") -> DataFrame:
    """``docs`` with a column ``result``: the fields of a validation result and its issues, in the fixed order.

    ``meta`` is a MAP<STRING, STRING> of :func:`lavra.functions.yaml_map.read_yaml`; a NULL or empty one counts as no front matter.
    Only a mapping at ``doe`` that isn't empty is a publication; its ``pagina`` is the publication page.
    """

    def given(key: str) -> Column:
        return F.coalesce(F.element_at(meta, key), F.lit(""))

    text = F.coalesce(F.col(body), F.lit(""))
    # Columns of their own, as they are used many times.
    docs = docs.withColumns({"_inferred": legal_metadata(text), "_head": act_type(first_heading(text)), "_kind": strip(given("act_type"))})
    inferred, kind, head = F.col("_inferred"), F.col("_kind"), F.col("_head")
    value = {k: F.coalesce(F.nullif(given(k), F.lit("")), inferred[k]) for k in ("act_number", "act_year", "act_date")}
    low = F.lower(F.col(path))
    publication = mapping_of(F.col(meta), "doe")
    has_page = F.size(publication) > 0
    found = [
        F.when(F.coalesce(F.size(meta), F.lit(0)) <= 0, ISSUES[0]),
        F.when(kind == "", ISSUES[1]),
        F.when(value["act_number"] == "", ISSUES[2]),
        F.when(value["act_year"] == "", ISSUES[3]),
        F.when(value["act_date"] == "", ISSUES[4]),
        F.when((kind != "") & (head != "") & (kind != head), F.concat(F.lit(ISSUES[5] + "("), kind, F.lit("!="), head, F.lit(")"))),
        F.when(low.contains("portarias") & (kind != "") & (kind != "Portaria"), ISSUES[6]),
        F.when(low.contains("resolucoes") & (kind != "") & (kind != "Resolução"), ISSUES[7]),
        F.when(inferred["doe"].isNotNull() & ~has_page, ISSUES[8]),
        F.when(inferred["doe"].isNull() & has_page, ISSUES[9]),
        F.when(F.coalesce(F.element_at(meta, "aliases") == "[]", F.lit(False)) & (kind != "") & (value["act_number"] != ""), ISSUES[10]),
    ]
    return docs.withColumn(
        "result",
        F.struct(
            kind.alias("act_type"), *[v.alias(k) for k, v in value.items()], F.coalesce(F.element_at(publication, "pagina"), F.lit("")).alias("publication_page"),
            head.alias("heading_type"), F.array_compact(F.array(*found)).alias("issues"), F.sha1(text).alias("content_hash"),
        ),
    ).drop("_inferred", "_head", "_kind")


def logical_key(kind: Column, heading: Column, number: Column, year: Column) -> Column:
    """(lower-case type, number, year), '' for what is missing."""
    empty = F.lit("")
    return F.struct(
        F.lower(F.coalesce(F.nullif(kind, empty), heading, empty)).alias("t"), F.coalesce(number, empty).alias("n"), F.coalesce(year, empty).alias("y")
    )


def with_duplicates(results: DataFrame, key: str) -> DataFrame:
    """``results`` with the issues of repeated logical keys (all empty ones aside) and repeated contents appended.

    Needs act_type, heading_type, act_number, act_year, issues and content_hash; counts are aggregated before they are
    joined back, and keys that hold a large part of the rows are spread.
    """
    scratch = Scratch(results.sparkSession, "audit")
    own = results.withColumn("_k", logical_key(F.col("act_type"), F.col("heading_type"), F.col("act_number"), F.col("act_year"))).select("*", "_k.*").drop("_k")
    own = scratch.write(own.withColumnsRenamed({"t": "_t", "n": "_n", "y": "_y"}), "results")
    keys = own.where("_t <> '' OR _n <> '' OR _y <> ''").groupBy("_t", "_n", "_y").agg(F.count("*").alias("_kn"))
    keys = scratch.write(keys.where("_kn > 1"), "keys")
    hashes = own.where("content_hash <> ''").groupBy("content_hash").agg(F.count("*").alias("_hn"))
    hashes = scratch.write(hashes.where("_hn > 1"), "hashes")
    both = join_counted(join_counted(own, keys, ["_t", "_n", "_y"], "_kn", [key], "left"), hashes, ["content_hash"], "_hn", [key], "left")
    name = F.concat(F.lit("DUPLICATE_KEY("), F.col("_t"), F.lit("-"), F.col("_n"), F.lit("/"), F.col("_y"), F.lit(")"))
    more = F.array_compact(F.array(F.when(F.col("_kn").isNotNull(), name), F.when(F.col("_hn").isNotNull(), F.lit("DUPLICATE_CONTENT"))))
    issues = F.concat(F.coalesce("issues", F.array().cast("array<string>")), more)
    return both.withColumn("issues", issues).drop("_t", "_n", "_y", "_kn", "_hn")


def issue_summary(results: DataFrame) -> DataFrame:
    """(issue, documents): how often each issue occurs, OK where there is none."""
    issues = F.when(F.coalesce(F.size("issues"), F.lit(0)) <= 0, F.array(F.lit("OK"))).otherwise(F.col("issues"))
    return results.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("documents"))


def valid_counts(results: DataFrame) -> DataFrame:
    """(documents, valid, invalid, failed): how many documents have no issue, how many have, and whether any has."""
    ok = F.coalesce(F.size("issues"), F.lit(0)) <= 0
    return results.agg(F.count("*").alias("documents"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.coalesce(F.bool_or(~ok), F.lit(False)).alias("failed"))


def report_rows(results: DataFrame) -> DataFrame:
    """The nine columns of the CSV report."""
    return results.select(
        "path", "act_type", "act_number", "act_year", "act_date", "publication_page", "heading_type",
        F.array_join("issues", ";").alias("issues"), F.when(F.size("issues") == 0, "TRUE").otherwise("FALSE").alias("ok"),
    )


def markdown_report(results: DataFrame, root: str) -> DataFrame:
    """The lines (section, position, line) of the Markdown report: the summary by issue, recommendations, the items.

    Items are one row a document and never gathered: written sorted, the rows are the report.
    """
    head, tail = [*REPORT_HEAD, f"Raiz analisada: `{root}`", *REPORT_SUMMARY], REPORT_TAIL
    spark = results.sparkSession
    fixed = spark.createDataFrame([(s, f"{k:09d}", x) for s, part in ((1, head), (3, tail)) for k, x in enumerate(part)], "section INT, position STRING, line STRING")
    summary = issue_summary(results)
    order = F.concat(F.lpad((F.lit(10**15) - F.col("documents")).cast("string"), 16, "0"), F.col("issue"))
    counts = summary.select(F.lit(2).alias("section"), order.alias("position"), F.concat(F.lit("- **"), F.col("issue"), F.lit("**: "), F.col("documents")).alias("line"))
    items = results.where(F.size("issues") > 0).select(
        F.lit(4).alias("section"), F.col("path").alias("position"), F.concat(F.lit("- `"), F.col("path"), F.lit("` → "), F.array_join("issues", ", ")).alias("line")
    )
    return fixed.union(counts).union(items)
