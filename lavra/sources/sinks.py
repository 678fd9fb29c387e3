"""Writers: manifests, event logs, reports and one file a document."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.html import plain_text, to_markdown
from lavra.functions.text import yaml_front_matter
from lavra.functions.url import output_filename
from lavra.operators.validate import markdown_report, report_rows


def saved_pages(pages: DataFrame, url: Column, title: Column, language: Column, modified: Column, content: Column, ext: str) -> DataFrame:
    """(name, content): pages as the crawler saves them, as Markdown with front matter or as plain text."""
    if ext == "md":
        body = to_markdown(content)
        body = F.when((title != "") & ~F.ltrim(body).startswith("# "), F.concat(F.lit("# "), title, F.lit("\n\n"), body)).otherwise(body)
        head = yaml_front_matter([("url", url), ("title", title), ("lang", language), ("last_modified", modified)])
        text = F.concat(head, body, F.lit("\n"))
    else:
        head = F.when(title != "", F.concat(title, F.lit("\n"), F.repeat(F.lit("="), F.length(title)), F.lit("\n\n"))).otherwise("")
        text = F.concat(head, F.lit("Fonte: "), url, F.lit("\n\n"), plain_text(content), F.lit("\n"))
    return pages.select(output_filename(url, ext).alias("name"), text.alias("content"))


def write_manifest(records: DataFrame, path: str, append: bool = True) -> None:
    """JSON Lines with a time; the commit protocol makes each write whole or nothing."""
    stamped = records.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"), "*")
    stamped.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_events(events: DataFrame, path: str) -> None:
    events.select(F.current_timestamp().alias("ts"), "*").write.mode("append").json(path)


def write_reports(results: DataFrame, csv: str, markdown: str, root: str) -> None:
    """The CSV report, sorted by path, and the Markdown report."""
    report_rows(results).orderBy("path").write.mode("overwrite").option("header", True).csv(csv)
    markdown_report(results, root).orderBy("section", "position").select("line").write.mode("overwrite").text(markdown)


def write_files(files: DataFrame, folder: str) -> None:
    """One file for each (name, content), through a temporary name. For folders all executors share; names may have folders."""

    def put(rows) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in rows:
            to = os.path.join(folder, r.name)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with open(f"{to}.tmp", "w", encoding="utf-8") as f:
                f.write(r.content)
            os.replace(f"{to}.tmp", to)

    files.select("name", "content").foreachPartition(put)
