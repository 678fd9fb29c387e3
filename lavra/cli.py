"""Command line: ``python -m lavra.cli COMMAND``. Exit codes: 0 all well, 1 some documents failed or have issues, 2 wrong input, 130 interrupted."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.config import Settings
from lavra.operators import validate as audit
from lavra.plans import refine as plan
from lavra.session import Scratch, build_session
from lavra.sources import files, sinks

OK, ISSUES, WRONG, STOPPED = 0, 1, 2, 130


def _documents(spark: SparkSession, folder: str, only: str | None = None, trim: bool = False) -> DataFrame:
    return files.markdown_documents(spark, folder, trim=trim, only=only, ignore_bad=not trim, everything=not trim)


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Audits a tree and writes the CSV and the Markdown report; 1 if any document has an issue."""
    results = audit.validated(_documents(spark, args.root)).select("path", "result.*")
    results = Scratch(spark, "validate").write(audit.with_duplicates(results, "path"), "results")
    total = results.agg(F.count("*").alias("n"), F.count_if(F.size("issues") == 0).alias("ok")).first()
    if not total.n:
        print(f"no Markdown files in {args.root}")
        return OK
    sinks.write_reports(results, args.csv, args.report, args.root)
    print(f"documents: {total.n}, valid: {total.ok}, with issues: {total.n - total.ok}")
    return ISSUES if total.ok != total.n else OK


def enrich(spark: SparkSession, args: argparse.Namespace) -> int:
    """Writes the documents that gain metadata to another folder, under their paths below the root."""
    own = _documents(spark, args.root)
    made = plan.enriched_files(own, "path", "yaml", "body", source=args.source, institution=args.institution, owner=args.owner)
    root = os.path.abspath(args.root).rstrip("/") + "/"
    made = Scratch(spark, "enrich").write(made.withColumn("name", F.regexp_replace("name", f"^{root}", "")), "files")
    sinks.write_files(made, args.out)
    print(f"documents changed: {made.count()}")
    return OK


def refine(spark: SparkSession, args: argparse.Namespace) -> int:
    """Refines and deduplicates a tree; writes documents, manifest and events; 1 if any document failed."""
    scratch = Scratch(spark, "refine")
    docs = scratch.write(_documents(spark, args.root, args.only, True), "docs")
    done = scratch.write(plan.refine(docs, "path", "path", "body", args.refiner), "done")
    sinks.write_files(plan.refined_files(done.join(docs.select("path", "yaml"), "path"), "path", "yaml"), args.out)
    records = plan.manifest_records(done, "path").withColumn("out", F.concat(F.lit(args.out.rstrip("/") + "/"), "out"))
    if os.path.exists(args.manifest):
        records = plan.new_records(records, files.read_manifest(spark, args.manifest))
    sinks.write_manifest(records, args.manifest)
    sinks.write_events(plan.event_log(done, "path"), args.log)
    c = plan.run_counters(done).first()
    print(f"documents: {c.input_files}, refined: {c.refined_files}, duplicates: {c.duplicates}, failed: {c.failed_files}")
    return ISSUES if c.failed_files else OK


def rebuild(spark: SparkSession, args: argparse.Namespace) -> int:
    """Writes the manifest again from refined documents."""
    made = plan.rebuilt_manifest(files.refined_documents(spark, args.refined), files.markdown_texts(spark, args.root, everything=True).select("path"))
    sinks.write_manifest(made.withColumn("model", F.lit("")), args.manifest, append=False)
    return OK


def convert(spark: SparkSession, args: argparse.Namespace) -> int:
    """Writes the PDFs of a folder as Markdown; 1 if any has no text."""
    texts = Scratch(spark, "convert").write(files.pdf_texts(spark, args.root, args.extract), "texts")
    made = plan.pdf_files(texts, "path", "text")
    for folder in (args.out, args.audit):
        if folder:
            sinks.write_files(made, folder)
    failed = plan.converted_pdfs(texts, "path", "text").where("failed").count()
    print(f"PDFs: {texts.count()}, failed: {failed}")
    return ISSUES if failed else OK


def parser(settings: Settings) -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lavra", description="A corpus engine on PySpark.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable[[SparkSession, argparse.Namespace], int], root: str, **options: str | None) -> None:
        one = commands.add_parser(name, help=(run.__doc__ or "").split(";")[0])
        one.set_defaults(run=run, refiner=None, extract=None)
        one.add_argument("--root", default=root)
        for option, default in options.items():
            one.add_argument(f"--{option}", default=default)

    raw = settings.output_dir
    add("validate", validate, raw, csv="relatorio_validacao.csv", report="relatorio_validacao.md")
    add("enrich", enrich, raw, out="data/0_enriquecidos", source="", institution="", owner="")
    add("refine", refine, raw, only=None, out="data/1_markdowns_limpos", manifest="data/manifest.jsonl", log="data/log")
    add("rebuild", rebuild, raw, refined="data/1_markdowns_limpos", manifest="data/manifest.jsonl")
    add("convert", convert, settings.pdf_dir, out="pdf/markdown", audit="")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **given) -> int:
    """Runs a command. ``given`` may bring a ``refiner`` or an ``extract`` callable, which a command line can't."""
    try:
        args = parser(Settings.load(env_file=".env")).parse_args(argv)
    except SystemExit as e:
        return OK if not e.code else WRONG
    for name, value in given.items():
        setattr(args, name, value)
    # Spark's own working folder may be another one.
    for name in ("root", "out", "csv", "report", "manifest", "log", "refined", "audit"):
        if getattr(args, name, None):
            setattr(args, name, os.path.abspath(getattr(args, name)))
    if not os.path.isdir(args.root):
        print(f"no such folder: {args.root}", file=sys.stderr)
        return WRONG
    try:
        return args.run(spark or build_session(), args)
    except KeyboardInterrupt:
        return STOPPED


if __name__ == "__main__":
    sys.exit(main())
