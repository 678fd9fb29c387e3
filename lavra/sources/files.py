"""Scans of Markdown trees, PDFs and manifests."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import front_matter
from lavra.functions.yaml_map import read_document

# Subtrees that are never input.
EXCLUDED = ("_processados", "_com_erro", "log")
MANIFEST = "ts STRING, `in` STRING, out STRING, simhash64_hex STRING, llm_applied BOOLEAN, provider STRING, model STRING"


def read_bytes(spark: SparkSession, folder: str, pattern: str, recursive: bool = True) -> DataFrame:
    """(path, content): the files of a folder whose names match; Spark leaves out files of no bytes."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


@F.pandas_udf(T.StringType())
def _without_bad_bytes(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def markdown_texts(spark: SparkSession, folder: str, pattern: str = "*.md", everything: bool = False, recursive: bool = True, only: str | None = None, ignore_bad: bool = False) -> DataFrame:
    """(path, raw): Markdown files as texts, in no order; '' if they are no UTF-8, or without the bad bytes with ``ignore_bad``.

    The excluded subtrees are left out unless ``everything``. ``only`` is a file, a path below the folder or a pattern of names; with it
    nothing is excluded.
    """
    if only:
        direct = next((p for p in (only, f"{folder.rstrip('/')}/{only}") if os.path.isfile(p)), None)
        files = read_bytes(spark, direct, "*", False) if direct else read_bytes(spark, folder, only.rsplit("/", 1)[-1], True)
        if direct is None and "/" in only:
            files = files.where(F.col("path").rlike(_glob(only)))
    else:
        files = read_bytes(spark, folder, pattern, recursive)
    if not everything and not only:
        for part in EXCLUDED:
            files = files.where(~F.col("path").contains(f"/{part}/"))
    text = _without_bad_bytes("content") if ignore_bad else F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    return files.select("path", text.alias("raw"))


def _glob(pattern: str) -> str:
    """A path pattern as a regular expression for the end of a path."""
    return "/" + "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in pattern.replace("**/", "")) + "$"


def markdown_documents(spark: SparkSession, folder: str, pattern: str = "*.md", trim: bool = True, everything: bool = False, recursive: bool = True, only: str | None = None, ignore_bad: bool = False) -> DataFrame:
    """(path, yaml, meta, body): front matter as text and as a MAP, and the body, stripped as the refiner does or as the validator does."""
    raw = markdown_texts(spark, folder, pattern, everything, recursive, only, ignore_bad)
    return raw.select("path", front_matter(F.col("raw")).alias("yaml"), read_document(F.col("raw"), trim).alias("d")).select("path", "yaml", "d.*")


def refined_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The refined files right in a folder."""
    return markdown_documents(spark, folder, "*__REF.md", everything=True, recursive=False)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON Lines manifest; malformed lines and those without an output are left out."""
    return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).where("out <> ''")


def pdf_texts(spark: SparkSession, folder: str, extract=None) -> DataFrame:
    """(path, text) of the PDFs right in a folder. ``extract`` turns bytes into text; by default pdfminer, where installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = extract or _pdfminer()
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append(call(content) or "")
                except Exception:
                    texts.append("")
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return read_bytes(spark, folder, "*.pdf", False).mapInPandas(run, "path STRING, text STRING")


def _pdfminer():
    import io

    from pdfminer.high_level import extract_text

    return lambda content: extract_text(io.BytesIO(content))
