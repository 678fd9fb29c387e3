"""Refinement of documents end to end, manifests, enrichment and PDF conversion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.legal import legal_metadata
from lavra.functions.text import collapse_newlines, content_hash, is_low_quality, llm_is_useful, merge_metadata, pdf_body, strip
from lavra.functions.url import refined_name
from lavra.functions.yaml_map import with_metadata
from lavra.operators.chunks import cut
from lavra.operators.simhash import bits_of, greedy_kept, simhashes
from lavra.session import Scratch

LLM_MAX_CHARS = 20_000


@dataclass(frozen=True)
class Refiner:
    """A pluggable text refiner: called for each chunk of a text where it is useful (or always, without the heuristic).

    A failed chunk keeps its text unless ``required``. As in the tool this follows, only the first 20,000 characters of a
    refined text are kept.
    """

    provider: str
    model: str
    call: Callable[[str], str]
    heuristic: bool = True
    required: bool = False

    def refine(self, text: str) -> tuple[str, int, int]:
        """The refined text, its chunks and how many of them failed."""
        parts, failed = cut(text[:LLM_MAX_CHARS]), 0
        out = []
        for p in parts:
            try:
                out.append(self.call(p).strip() or p)
            except Exception:
                if self.required:
                    raise
                failed += 1
                out.append(p)
        return "\n\n".join(out), len(parts), failed


def refine(docs: DataFrame, key: str, path: str, body: str, refiner: Refiner | None = None) -> DataFrame:
    """(key, path, outcome, reason, out, simhash64_hex, llm_applied, provider, model, chunks, chunk_errors, content_hash, text) for each
    document.

    ``outcome`` is 'ok', 'duplicate' (a kept document before it, in the order of ``key``, is within 3 bits) or 'error' (empty,
    of low quality, without terms, or a required refiner failed on it: that one document, not the run). A document that fails in the
    refiner still shadows its duplicates. Inputs stay where they are; the outcome takes the place of moving files.
    """
    scratch = Scratch(docs.sparkSession, "refine")
    text = F.coalesce(collapse_newlines(F.col(body)), F.lit(""))
    own = docs.select(F.col(key).alias("id"), F.col(path).alias("path"), F.col(body).isNull().alias("none"), text.alias("text"))
    own = own.withColumn("bad", F.when(F.col("none") | (F.col("text") == ""), "empty").when(is_low_quality(F.col("text")), "low quality"))
    own = scratch.write(own, "own")
    hashed = scratch.write(simhashes(own.where("bad IS NULL"), "id", "text"), "hashes")
    kept = greedy_kept(hashed.select("id", bits_of(F.col("simhash")).alias("bits")), "id")
    done = own.join(hashed, "id", "left").join(kept.withColumn("kept", F.lit(True)), "id", "left")
    outcome = F.when(F.col("bad").isNotNull() | F.col("simhash").isNull(), "error").when(F.col("kept"), "ok").otherwise("duplicate")
    done = done.withColumn("outcome", outcome)
    done = done.withColumn("reason", F.coalesce("bad", F.when(F.col("simhash").isNull(), "no terms"), F.when(F.col("outcome") == "duplicate", "hamming<=3"), F.lit("")))
    ok = F.col("outcome") == "ok"
    if refiner is None:
        done = done.withColumn("applied", F.lit(False)).withColumns({"chunks": F.lit(0), "chunk_errors": F.lit(0)})
    else:
        use = ok & (llm_is_useful(F.col("text")) if refiner.heuristic else F.lit(True))
        done = _refined(done.withColumn("applied", use), refiner)
        # The work is done once, whatever is read of it.
        done = scratch.write(done, "refined")
    return done.select(
        *([] if key == path else [F.col("id").alias(key)]), F.col("path").alias(path), "outcome", "reason", F.when(ok, refined_name(F.col("path"))).otherwise("").alias("out"),
        F.when(F.col("simhash").isNotNull(), F.concat(F.lit("0x"), F.regexp_replace("simhash", "^0+(?=.)", ""))).otherwise("").alias("simhash64_hex"),
        F.col("applied").alias("llm_applied"), F.when(F.col("applied"), refiner.provider if refiner else "").otherwise("").alias("provider"),
        F.when(F.col("applied"), refiner.model if refiner else "").otherwise("").alias("model"), F.col("chunks"), F.col("chunk_errors"), F.when(ok, content_hash(F.col("text"))).otherwise("").alias("content_hash"),
        F.when(ok, F.col("text")).otherwise("").alias("text"),
    )


def _refined(done: DataFrame, refiner: Refiner) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for applied, text, outcome, reason in zip(batch["applied"], batch["text"], batch["outcome"], batch["reason"], strict=True):
                try:
                    rows.append((*(refiner.refine(text) if applied else (text, 0, 0)), applied, outcome, reason))
                except Exception as e:
                    rows.append((text, 0, 0, False, "error", f"refiner: {e}"))
            new = pd.DataFrame(rows, columns=["text", "chunks", "chunk_errors", "applied", "outcome", "reason"])
            yield batch.drop(columns=list(new.columns)).reset_index(drop=True).join(new)[names]

    own = done.withColumns({"chunks": F.lit(0), "chunk_errors": F.lit(0)})
    names = own.columns
    return own.mapInPandas(run, own.schema)


def refined_files(refined: DataFrame, path: str, yaml: str) -> DataFrame:
    """(name, content): the refined documents as files. ``refined`` has the columns of :func:`refine` and, in ``yaml``, each document's
    own front matter, whose keys stay in their order; those of the refinement are set."""
    by = F.when(F.col("provider") == "google", "gemini").when(F.col("provider") == "ollama", "ollama").otherwise("local")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    applied = F.col("llm_applied")
    updates = F.to_json(
        F.struct(
            by.alias("refined_by"), F.when(applied, F.col("model")).alias("refined_model"), F.when(applied, now).alias("refined_at"),
            F.when(applied, F.col("chunks")).alias("llm_chunks"), F.when(applied, F.col("chunk_errors")).alias("llm_chunk_errors"), F.col("content_hash"),
        )
    )
    ok = refined.where("outcome = 'ok'")
    return ok.select(F.col("out").alias("name"), F.concat(with_metadata(F.col(yaml), updates, True), F.col("text"), F.lit("\n")).alias("content"))


def enriched_files(docs: DataFrame, path: str, yaml: str, body: str, **constants: str) -> DataFrame:
    """(name, content) of the documents that enrichment changes: their own front matter with what the body says of missing keys."""
    text = F.coalesce(F.col(body), F.lit(""))
    read = docs.withColumn("_m", legal_metadata(text))
    head = with_metadata(F.col(yaml), inferred_json(F.col("_m"), constants), False, True)
    made = read.select(F.col(path).alias("name"), head.alias("_head"), F.concat(strip(text), F.lit("\n")).alias("_body")).where("_head IS NOT NULL")
    return made.select("name", F.concat("_head", "_body").alias("content"))


def inferred_json(m: Column, constants: dict[str, str] | None = None) -> Column:
    """What a body says of its act (a result of ``legal_metadata``), as a JSON object without what is missing; ``constants`` come last."""
    keep = [F.nullif(m[k], F.lit("")).alias(k) for k in ("act_type", "act_number", "act_year", "act_date")]
    more = [F.lit(v).alias(k) for k, v in (constants or {}).items() if v]
    aliases = F.when(F.size(m["aliases"]) > 0, m["aliases"]).alias("aliases")
    return F.to_json(F.struct(*keep, m["doe"].alias("doe"), F.nullif(m["status"], F.lit("")).alias("status"), aliases, *more))


def pdf_files(pdfs: DataFrame, path: str, text: str, extracted: Column | None = None) -> DataFrame:
    """(name, content) of the converted PDFs: source, time of extraction and what the text says, which wins over both, then the body."""
    done = converted_pdfs(pdfs, path, text).where("NOT failed").withColumn("_m", legal_metadata(F.col("body")))
    now = F.date_format(extracted if extracted is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    base = F.to_json(F.struct(F.col(path).alias("source_pdf"), now.alias("extracted_at")))
    # JSON is YAML: the base is read as the document's own front matter.
    return done.select(F.col("out").alias("name"), F.concat(with_metadata(base, inferred_json(F.col("_m")), True), F.col("body"), F.lit("\n")).alias("content"))


def manifest_records(refined: DataFrame, path: str) -> DataFrame:
    """The manifest's columns but the time, of the documents that came through."""
    return refined.where("outcome = 'ok'").select(F.col(path).alias("in"), "out", "simhash64_hex", "llm_applied", "provider", "model")


def new_records(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """The records whose output the manifest lacks; of several for one output, the one with the least input."""
    known = manifest.where("out <> ''").select("out").distinct()
    new = records.join(known, "out", "left_anti")
    names = [c for c in records.columns if c not in ("out", "in")]
    return new.groupBy("out").agg(F.min(F.struct("in", *names)).alias("r")).select("r.in", "out", *[f"r.{c}" for c in names])


def run_counters(refined: DataFrame) -> DataFrame:
    """(input_files, refined_files, duplicates, failed_files)."""
    return refined.agg(
        F.count("*").alias("input_files"), F.count_if(F.col("outcome") == "ok").alias("refined_files"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"), F.count_if(F.col("outcome") == "error").alias("failed_files"),
    )


def event_log(refined: DataFrame, path: str) -> DataFrame:
    """(event, fields): one structured event for each document."""
    fields = F.map_filter(
        F.create_map(
            F.lit("file"), F.col(path), F.lit("output"), F.nullif("out", F.lit("")), F.lit("reason"), F.nullif("reason", F.lit("")),
            F.lit("simhash64_hex"), F.when(F.col("outcome") == "ok", F.col("simhash64_hex")), F.lit("llm_applied"), F.when(F.col("outcome") == "ok", F.col("llm_applied").cast("string")),
            F.lit("provider"), F.when(F.col("outcome") == "ok", F.col("provider")), F.lit("model"), F.when(F.col("outcome") == "ok", F.col("model")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return refined.select(F.col("outcome").alias("event"), fields.alias("fields"))


def rebuilt_manifest(files: DataFrame, raw: DataFrame) -> DataFrame:
    """(in, out, simhash64_hex, llm_applied, provider): a manifest made again from refined files.

    ``files`` has (path, meta MAP, body), ``raw`` has (path). The input is ``source_in`` of the metadata, or the first raw path (by
    name) with the file's stem, or ''. The hash is that of the refined body, all ones without terms.
    """
    stem = F.regexp_extract("path", r"([^/]*)__REF\.md$", 1)
    own = files.where(stem != "").withColumn("stem", stem)
    originals = raw.select(F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("stem"), "path").groupBy("stem").agg(F.min("path").alias("original"))
    hashed = simhashes(own, "path", "body", empty_is_ones=True)
    by = F.lower(F.trim(F.coalesce(F.element_at("meta", "refined_by"), F.lit(""))))
    return own.join(originals, "stem", "left").join(hashed, "path").select(
        F.coalesce(F.nullif(F.element_at("meta", "source_in"), F.lit("")), "original", F.lit("")).alias("in"), F.col("path").alias("out"),
        F.concat(F.lit("0x"), F.regexp_replace("simhash", "^0+(?=.)", "")).alias("simhash64_hex"), by.isin("gemini", "ollama").alias("llm_applied"),
        F.when(by == "gemini", "google").when(by == "ollama", "ollama").otherwise("").alias("provider"),
    )


def enriched(docs: DataFrame, meta: str, body: str, **constants: str) -> DataFrame:
    """``docs`` with ``meta`` completed by what the body says (and ``constants``), and ``changed``; existing keys win."""
    # A column of its own, as it is used many times.
    docs = docs.withColumn("_found", legal_metadata(F.coalesce(F.col(body), F.lit(""))))
    found = F.col("_found")
    pairs = []
    for k in ("act_type", "act_number", "act_year", "act_date", "status"):
        pairs += [F.lit(k), F.nullif(found[k], F.lit(""))]
    pairs += [F.lit("doe"), F.when(found["doe"].isNotNull(), F.to_json(found["doe"]))]
    pairs += [F.lit("aliases"), F.when(F.size(found["aliases"]) > 0, F.to_json(found["aliases"]))]
    for k, v in constants.items():
        if v:
            pairs += [F.lit(k), F.lit(v)]
    before = F.coalesce(F.col(meta), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    after = merge_metadata(before, F.create_map(*pairs))
    return docs.withColumn("_before", before).withColumn(meta, after).withColumn("changed", F.size(meta) > F.size("_before")).drop("_before", "_found")


def converted_pdfs(pdfs: DataFrame, path: str, text: str) -> DataFrame:
    """(path, out, body, failed): extracted texts as Markdown; a text without letters fails. ``text`` is what an extractor gave."""
    body = pdf_body(F.col(text))
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return pdfs.select(
        F.col(path), F.when(body != "", F.concat(stem, F.lit("__"), F.substring(F.sha1(body), 1, 10), F.lit(".md"))).otherwise("").alias("out"),
        body.alias("body"), (body == "").alias("failed"),
    )
