"""The queries over the reference operators. Their SQL is in :mod:`lavra.catalogue_sql`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions import html, legal, text, url
from lavra.functions.yaml_map import read_document, read_yaml
from lavra.operators import chunks, crawl, simhash, validate
from lavra.plans import refine as plan
from lavra.session import Scratch, table
from lavra.streaming import incremental

c = F.col
# A site of six pages with a cycle, another host, a PDF and a missing page, and its links.
GRAPH = [
    ("https://a.example/", "https://a.example/w"), ("https://a.example/w", "https://a.example/zz"), ("https://a.example/x", "https://a.example/b2"), ("https://a.example/b2", "https://a.example/w"), ("https://a.example/zz", "https://a.example/"),
    ("https://a.example/", "https://a.example/x"), ("https://a.example/", "https://a.example/y"), ("https://a.example/", "https://b.example/"),
    ("https://a.example/x", "https://a.example/"), ("https://a.example/x", "https://a.example/z"), ("https://a.example/y", "https://a.example/z"),
    ("https://a.example/y", "https://a.example/doc.pdf"), ("https://a.example/z", "https://a.example/deep"), ("https://a.example/z", "https://sub.a.example/w"),
    ("https://a.example/y", "https://a.example/foto.jpg"), ("https://b.example/", "https://a.example/from-b"), ("https://a.example/deep", "https://a.example/deeper"),
]


_LONG = "Texto corrido da página, com palavras bastantes para passar do limite. " * 8
#: Pages with what the tables lack: canonical links, dates of change, regions of several kinds, too little text. (url, html).
PAGES = [
    ("https://h.example/a?utm_source=x", f'<html lang="pt"><head><title> Um </title><link rel="canonical" href="/b//c/"><meta property="article:modified_time" content="2020-01-02"></head><body><nav>menu</nav><main>{_LONG}</main></body></html>'),
    ("https://h.example/d", f'<html lang="en"><head><title>Dois</title><link rel="canonical" href="mailto:x"><meta name="last-modified" content="ontem"></head><body><article>{_LONG}</article></body></html>'),
    ("https://h.example/e", f'<html><head><title>Três</title><meta name="modified" content="m3"></head><body><main>curto</main><p>{_LONG}</p></body></html>'),
    ("https://h.example/f", f'<html><head><meta itemprop="dateModified" content="m4"><title>Quatro</title></head><body><div id="main"><p>{_LONG}</p></div></body></html>'),
    ("https://h.example/g", "<html><body><main>pouco texto</main></body></html>"),
]
#: Documents with what the tables lack: (path, text).
DOCUMENTS = [
    ("extra/resolucoes/pub.md", "---\nact_type: Portaria\ndoe:\n  numero: 77-A\n  pagina: 14\naliases: []\n---\n# Portaria nº\u00a0031/2019, de 3\u00a0de\u00a0maio de 2019\n\nTexto sem nota."),
    ("extra/portarias/vazia.md", "---\nact_type: Ato\ndoe:\nact_number: '9'\n---\n\n# Ato no. 9-2001\n\nFica revogado o ato anterior. Pub. DOE nº 5, de 01/02/2001, p. 3"),
    ("extra/texto.md", "---\nact_type: Comunicado\ndoe: nenhum\nact_date: 2003-04-05\n---\nComunicado n. 4, de 5/4/2003\n\nPub.\u00a0DOE n\u00ba 12-B, de 06/04/2003, p. 8. Normas vigente."),
    ("extra/quebrado.md", "---\nact_type: [Ato\nact_number: 8\n---\n# Instrucao nº 8/1999\n"),
    ("extra/lista.md", "---\n- act_type: Ato\n---\n# Deliberação nº 6, de 30 de fevereiro de 2010"),
    ("extra/nada.md", ""),
    ("extra/completo.md", "---\nowner: outro\n---\nsem cabeçalho"),
    ("extra/refinado.md", "---\nrefined_by: Gemini\nsource_in: bruto/origem.md\nowner: ''\nact_type: Ato\nact_number: 5\naliases:\n- Ato 5\n---\n# Ato nº 5\n\nTexto refinado aqui."),
    ("extra/local.md", "---\nrefined_by: ollama\n---\nTexto do modelo local."),
]


def _raw(s: SparkSession, d: str) -> DataFrame:
    """The md files as texts with front matter between fences, and :data:`DOCUMENTS` with keys from -1 down."""
    raw = F.when(c("front_matter").isNull(), F.coalesce("body", F.lit(""))).otherwise(F.concat(F.lit("---\n"), "front_matter", F.lit("\n---\n"), F.coalesce("body", F.lit(""))))
    extra = s.createDataFrame([(-k - 1, p, t) for k, (p, t) in enumerate(DOCUMENTS)], "md_id BIGINT, path STRING, raw STRING")
    return table(s, d, "md").select("md_id", "path", raw.alias("raw")).union(extra)


def _meta(s: SparkSession, d: str) -> DataFrame:
    return _raw(s, d).select("md_id", "path", text.front_matter(c("raw")).alias("yaml"), read_document(c("raw"), False).alias("d")).select("md_id", "path", "yaml", "d.*")


def quality_gate(s, d):
    return table(s, d, "documents").select("doc_id", text.marker_count(c("text")).cast("int").alias("markers"), text.is_low_quality(c("text")).alias("low"))


def quality_gate_md(s, d):
    return table(s, d, "md").select("md_id", text.is_low_quality(text.collapse_newlines(c("body"))).alias("low"))


def llm_useful(s, d):
    provider = F.element_at(F.array(F.lit("google"), F.lit("ollama"), F.lit("none")), (c("doc_id") % 3 + 1).cast("int"))
    docs = table(s, d, "documents").withColumns({"provider": provider, "heuristic": c("doc_id") % 2 == 0})
    return docs.select("doc_id", text.llm_is_useful(c("text")).alias("useful"), text.should_apply_llm(c("provider"), c("heuristic"), c("text")).alias("applied"))


def normalized_hash(s, d):
    return table(s, d, "documents").select("doc_id", text.content_hash(c("text")).alias("content_hash"), F.length(text.normalize_text(c("text"))).alias("chars"))


def exact_dups(s, d):
    from lavra.operators.skew import join_counted

    own = table(s, d, "documents").select("doc_id", text.content_hash(c("text")).alias("content_hash"))
    scratch = Scratch(s, "dups")
    own = scratch.write(own, "own")
    counts = scratch.write(own.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1"), "counts")
    return join_counted(own, counts, ["content_hash"], "copies", ["doc_id"]).select("doc_id", "first_id", "copies")


def token_freq(s, d):
    return simhash.term_frequencies(table(s, d, "documents"), "doc_id", "text", 20).select("doc_id", "token", c("weight").cast("bigint").alias("weight"), c("rank").cast("bigint").alias("rank"))


def simhash64(s, d):
    return simhash.simhashes(table(s, d, "documents"), "doc_id", "text")


def _bits(s, d):
    hashed = simhash.simhashes(table(s, d, "documents"), "doc_id", "text").where("simhash IS NOT NULL")
    return Scratch(s, "bits").write(hashed.select("doc_id", simhash.bits_of(c("simhash")).alias("bits")), "bits")


def near_dup_pairs(s, d):
    pairs = simhash.near_pairs(_bits(s, d))
    as_hex = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return pairs.select(F.least(as_hex(c("a")), as_hex(c("b"))).alias("a"), F.greatest(as_hex(c("a")), as_hex(c("b"))).alias("b"), c("distance").cast("int").alias("distance"))


def greedy_dedup(s, d):
    return simhash.greedy_kept(_bits(s, d), "doc_id")


def _urls(s, d):
    own = table(s, d, "pages").select("url").union(table(s, d, "menu_items").select("url")).union(table(s, d, "documents").select("url")).where("url IS NOT NULL").distinct()
    extra = ["https://H.Example/avisos/?gclid=q&id=7#fim", "https://h.example/b?id=50%&lang=p%C3%A3o+x&page=~*", "https://h.example/c?i%64=a%20b", "HTTP://A.example:80//x///y/?lang=pt&ID=1&page=#!/rota//a/", "mailto:a@b.c", "ftp://h/x", "", "https://h.example", "https://h.example/a;p=1?page=2&page=3", "https://h.example/f.tar.GZ#/x/", "/relative"]
    return own.union(s.createDataFrame([(x,) for x in extra], "url STRING"))


def url_normalize(s, d):
    return _urls(s, d).select("url", url.normalize_url(c("url")).alias("normal"))


def url_parts(s, d):
    return _urls(s, d).select("url", url.host(c("url")).alias("host"), url.extension(c("url")).alias("ext"), url.is_pdf(c("url")).alias("pdf"), url.is_other_binary(c("url")).alias("binary"))


def url_scope(s, d):
    base = F.lit("h.example")
    return _urls(s, d).select("url", url.in_scope(c("url"), base).alias("same"), url.in_scope(c("url"), base, False).alias("any"), url.blocked_request(F.lit("script"), c("url")).alias("blocked"))


def output_names(s, d):
    return table(s, d, "pages").select("page_id", url.output_filename(c("url"), "md").alias("name"), url.sanitize(F.coalesce("title", F.lit("")), 40).alias("title_name"), url.sanitize(F.coalesce("title", F.lit("")), 150, False).alias("menu_name"))


def refined_names(s, d):
    return table(s, d, "md").select("md_id", url.refined_name(c("path")).alias("out"))


def short_hashes(s, d):
    return table(s, d, "menu_items").select("item_id", F.substring(F.sha1("label"), 1, 10).alias("h10"), F.substring(F.sha1("label"), 1, 8).alias("h8"), F.sha1("label").alias("h"))


def page_links(s, d):
    return table(s, d, "pages").select("page_id", F.explode(html.links(c("html"), c("url"))).alias("link"))


def link_scope_counts(s, d):
    links = table(s, d, "pages").select("source", F.explode(html.links(c("html"), c("url"))).alias("link"))
    return links.groupBy("source").agg(F.count("*").alias("links"), F.count_if(url.in_scope(c("link"), c("source"))).alias("inside"), F.count_if(url.is_pdf(c("link"))).alias("pdfs"))


def new_links(s, d):
    pages = table(s, d, "pages")
    links = pages.select(F.explode(html.links(c("html"), c("url"))).alias("url")).distinct()
    return links.join(pages.select(url.normalize_url(c("url")).alias("url")), "url", "left_anti")


def page_heads(s, d):
    extra = s.createDataFrame([(-k - 1, u, h) for k, (u, h) in enumerate(PAGES)], "page_id BIGINT, url STRING, html STRING")
    return table(s, d, "pages").select("page_id", "url", "html").union(extra).select("page_id", html.language(c("html")).alias("lang"), html.title(c("html")).alias("title"), html.modified(c("html")).alias("modified"), html.canonical(c("html"), c("url")).alias("canonical"))


def page_text(s, d):
    return table(s, d, "pages").select("page_id", html.plain_text("html").alias("text"))


def _gated(s, d):
    """The pages with their main content, those with enough text; :data:`PAGES` among them."""
    pages = table(s, d, "pages").select("page_id", "url", "html")
    extra = s.createDataFrame([(-k - 1, u, h) for k, (u, h) in enumerate(PAGES)], "page_id BIGINT, url STRING, html STRING")
    own = pages.union(extra).withColumn("main", html.main_content("html"))
    return own.withColumn("text", html.plain_text("main")).where(F.length("text") >= html.MIN_CONTENT_CHARS)


def page_gate(s, d):
    return _gated(s, d).select("page_id", F.length("text").alias("chars"), F.sha1("text").alias("h"))


def page_markdown(s, d):
    return table(s, d, "pages").select("page_id", html.to_markdown(html.main_content("html")).alias("markdown"))


def page_saves(s, d):
    from lavra.sources.sinks import saved_pages

    # Columns of their own, as names and heads use them many times.
    head = {"_url": html.canonical(c("html"), c("url")), "_title": html.title(c("html")), "_lang": html.language(c("html")), "_time": html.modified(c("html"))}
    own = _gated(s, d).withColumns(head)
    return saved_pages(own, c("_url"), c("_title"), c("_lang"), c("_time"), c("main"), "txt").select("name", F.sha1("content").alias("h"))


def menu_scan(s, d):
    """The lower headings of each page, as a menu."""
    from lavra.operators import menu

    return menu.menu_items(table(s, d, "pages"), "page_id", "html", "h2")


def panel_pdfs(s, d):
    from lavra.operators import menu

    extra = s.createDataFrame([(-1, "https://h.example/m/x", '<a href="d/Ato 1.PDF">a</a><a class=k href="/e.html">b</a><a href=\'https://o.example/q.pdf?x=1&amp;y=2\'>c</a>')], "item_id BIGINT, url STRING, html STRING")
    return menu.linked_pdfs(table(s, d, "menu_items").select("item_id", "url", "html").union(extra), "item_id", "url", "html")


def changed_panels(s, d):
    return crawl.changed_panels(table(s, d, "menu_items")).select("item_id", "changed")


def act_metadata(s, d):
    found = table(s, d, "md").select("md_id", legal.legal_metadata(F.coalesce("body", F.lit(""))).alias("m"))
    return found.select("md_id", "m.act_type", "m.act_number", "m.act_year", "m.act_date", F.coalesce("m.doe.numero", F.lit("")).alias("doe_number"), "m.status", F.array_join("m.aliases", "|").alias("aliases"))


def act_dates(s, d):
    rows = ["3\u00a0de agosto\u00a0de 2011", "30 de fevereiro de 2011", "1 de MARCO de 2001, 2/3/2004", "5 de foo de 2001 e 3/4/2005", "em 09-11-1999", "31/02/2020", "sem data", ""]
    own = s.createDataFrame([(x,) for x in rows], "t STRING").union(table(s, d, "pdf_conversions").select(F.coalesce(F.regexp_extract("body", "^([^\n]*)", 1), F.lit("")).alias("t")).distinct())
    return own.select("t", legal.portuguese_date(c("t")).alias("iso"))


def front_matter_split(s, d):
    raw = _raw(s, d)
    return raw.select("md_id", text.front_matter(c("raw")).alias("yaml"), F.sha1(text.front_matter_body(c("raw"))).alias("refiner_body"), F.sha1(text.front_matter_body(c("raw"), False)).alias("reader_body"))


def front_matter_yaml(s, d):
    raw = _raw(s, d).select("md_id", read_yaml(text.front_matter(c("raw"))).alias("meta"))
    return raw.select("md_id", F.size("meta").alias("keys"), F.to_json("meta").alias("meta"))


def enrich_merge(s, d):
    own = plan.enriched(_meta(s, d), "meta", "body", owner="arquivo")
    pick = [F.coalesce(F.element_at("meta", k), F.lit("")).alias(k) for k in ("act_type", "act_number", "act_year", "act_date", "owner")]
    return own.select("md_id", *pick, F.coalesce(F.element_at("meta", "doe"), F.lit("")).alias("doe"), "changed")


def validate_rules(s, d):
    own = validate.validated(_meta(s, d))
    return own.select("md_id", "result.act_type", "result.act_number", "result.act_year", "result.act_date", "result.heading_type", F.array_join("result.issues", ";").alias("issues"), "result.content_hash")


def _audit(s, d):
    own = validate.validated(_meta(s, d))
    return validate.with_duplicates(own.select("md_id", "path", "result.*"), "md_id")


def audit(s, d):
    return validate.report_rows(_audit(s, d))


def audit_summary(s, d):
    return validate.issue_summary(_audit(s, d))


def audit_counts(s, d):
    return validate.valid_counts(_audit(s, d))


def audit_results(s, d):
    own = table(s, d, "validation_results")
    return validate.with_duplicates(own, "result_id").select("result_id", F.array_join("issues", ";").alias("issues"))


def audit_report(s, d):
    return validate.markdown_report(_audit(s, d), "dados").select("section", "line")


def chunk_text(s, d):
    return chunks.chunks(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.sha1("chunk").alias("h"))


def strip_wrappers(s, d):
    note = F.lit("Here is the rewritten text in markdown format:\n")
    body = F.coalesce("html", F.lit(""))
    made = F.when(c("item_id") % 3 == 0, F.concat(note, body)).when(c("item_id") % 3 == 1, F.concat(F.lit("```md\n"), body, F.lit("\n```"))).otherwise(body)
    return table(s, d, "menu_items").select("item_id", F.sha1(text.strip_model_wrappers(made)).alias("h"))


def pdf_bodies(s, d):
    pdfs = table(s, d, "pdf_conversions")
    own = plan.converted_pdfs(pdfs.select("pdf_id", "source_pdf", "body"), "source_pdf", "body")
    return own.select("source_pdf", "out", F.sha1("body").alias("h"), "failed")


def bfs_crawl(s, d):
    links = s.createDataFrame(GRAPH + [("https://sub.a.example/w", None)], "src STRING, dst STRING")
    policy = crawl.robots_policy("User-agent: *\nDisallow: /y\nAllow: /")
    return crawl.crawl(links, crawl.CrawlOptions("https://a.example/", max_depth=3, max_pages=4), policy)


def crawl_counters(s, d):
    return crawl.crawl_counters(bfs_crawl(s, d))


def site_crawl(s, d):
    pages = table(s, d, "pages").where("html <> ''")
    own = pages.select(url.normalize_url(c("url")).alias("src"), F.explode_outer(html.links(c("html"), c("url"))).alias("dst"))
    seed = own.agg(F.min("src")).first()[0] or "https://a.example/"
    return crawl.crawl(own, crawl.CrawlOptions(seed, max_depth=2)).groupBy("depth", "outcome").agg(F.count("*").alias("urls"))


class _Capitals:
    """A stand-in for a model: capitals, and an error where a text has a 7 among its first 40 characters."""

    def __call__(self, part: str) -> str:
        if "7" in part[:40]:
            raise ValueError("sete")
        return part.upper()


def refine_pipeline(s, d):
    return plan.refine(table(s, d, "md"), "md_id", "path", "body").drop("text", "chunks", "chunk_errors")


def refine_by_model(s, d):
    """The pipeline with a required refiner that fails on some documents."""
    done = plan.refine(table(s, d, "md"), "md_id", "path", "body", plan.Refiner("google", "m-1", _Capitals(), heuristic=True, required=True))
    return done.select("md_id", "outcome", "llm_applied", "provider", "model", F.sha1("text").alias("h"))


def refine_counters(s, d):
    return plan.run_counters(plan.refine(table(s, d, "md"), "md_id", "path", "body"))


def refine_events(s, d):
    done = plan.event_log(plan.refine(table(s, d, "md"), "md_id", "path", "body"), "path")
    return done.select("event", *[F.coalesce(F.element_at("fields", k), F.lit("")).alias(k) for k in ("file", "output", "reason", "simhash64_hex", "llm_applied")])


def _read_again(files: DataFrame) -> DataFrame:
    """(name, meta, body) of written documents."""
    return files.select("name", read_document(c("content")).alias("d")).select("name", "d.*")


def refined_documents(s, d):
    md = table(s, d, "md")
    done = plan.refine(md, "md_id", "path", "body").join(md.select("md_id", "front_matter"), "md_id")
    read = _read_again(plan.refined_files(done, "path", "front_matter"))
    pick = [F.coalesce(F.element_at("meta", k), F.lit("")).alias(k) for k in ("source_url", "act_year", "refined_by", "refined_model", "content_hash")]
    return read.select("name", *pick, F.sha1("body").alias("h"))


def enriched_documents(s, d):
    read = _read_again(plan.enriched_files(_meta(s, d), "path", "yaml", "body", source="acervo"))
    pick = [F.coalesce(F.element_at("meta", k), F.lit("")).alias(k) for k in ("act_type", "act_number", "act_year", "act_date", "source")]
    return read.select("name", *pick, F.sha1("body").alias("h"))


def pdf_documents(s, d):
    pdfs = table(s, d, "pdf_conversions")
    read = _read_again(plan.pdf_files(pdfs.select("pdf_id", "source_pdf", "body"), "source_pdf", "body"))
    pick = [F.coalesce(F.element_at("meta", k), F.lit("")).alias(k) for k in ("source_pdf", "act_type", "act_number")]
    return read.select("name", *pick, F.sha1("body").alias("h"))


def manifest_append(s, d):
    made = plan.manifest_records(plan.refine(table(s, d, "md"), "md_id", "path", "body"), "path")
    out = F.concat(F.lit("data/1_markdowns_limpos/"), "out")
    return plan.new_records(made.withColumn("out", out), table(s, d, "manifest")).select("in", "out", "simhash64_hex")


def manifest_anti_join(s, d):
    outs = table(s, d, "md").select(F.concat(F.lit("data/1_markdowns_limpos/"), url.refined_name(c("path"))).alias("out"))
    return outs.join(table(s, d, "manifest").where("out <> ''").select("out"), "out", "left_anti")


def manifest_rebuild(s, d):
    md = _meta(s, d)
    files = md.select(F.concat(F.lit("data/1_markdowns_limpos/"), F.regexp_extract("path", r"([^/]*)\.md$", 1), F.lit("__REF.md")).alias("path"), "meta", text.strip(c("body")).alias("body"))
    return plan.rebuilt_manifest(files, md.select("path"))


def event_windows(s, d):
    return incremental.windowed_counts(table(s, d, "events"), "ts", "event_type")


def stream_gate(s, d):
    scratch = Scratch(s, "stream")
    docs = table(s, d, "documents")
    to = f"{scratch.path}/gated"
    s.createDataFrame([], docs.select("doc_id").schema).write.mode("overwrite").parquet(to)

    def work(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure writes to the same place.
        incremental.gate_stream(batch, "text").select("doc_id").write.mode("overwrite").parquet(f"{to}/batch={number}")

    incremental.run_new_files(s, d, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{scratch.path}/state", work, "documents.parquet")
    return s.read.option("recursiveFileLookup", "true").schema("doc_id BIGINT").parquet(to)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        quality_gate, quality_gate_md, llm_useful, normalized_hash, exact_dups, token_freq, simhash64, near_dup_pairs, greedy_dedup, url_normalize, url_parts,
        url_scope, output_names, refined_names, short_hashes, page_links, link_scope_counts, new_links, page_heads, page_text, page_gate, page_markdown, page_saves,
        menu_scan, panel_pdfs, changed_panels, act_metadata, act_dates, front_matter_split, front_matter_yaml, enrich_merge, validate_rules, audit, audit_summary, audit_counts, audit_results, audit_report,
        chunk_text, strip_wrappers, pdf_bodies, bfs_crawl, crawl_counters, site_crawl, refine_pipeline, refine_by_model, refined_documents, enriched_documents, pdf_documents, refine_counters, refine_events, manifest_append, manifest_anti_join,
        manifest_rebuild, event_windows, stream_gate,
    )
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    from lavra.catalogue_sql import SQL

    return SQL
