import random

import pytest
from pyspark.sql import functions as F

from lavra import cli
from lavra.config import Settings, least_interval
from lavra.functions import html, legal, text, url
from lavra.functions.yaml_map import read_document, read_yaml, with_metadata
from lavra.operators import chunks, crawl, menu, simhash, validate
from lavra.operators.components import components
from lavra.operators.running import running_sum
from lavra.operators.skew import join_counted
from lavra.plans import refine, remote
from lavra.session import Scratch, shared_dir
from lavra.sources import files, sinks
from lavra.streaming import incremental


def one(spark, value, call):
    return spark.createDataFrame([(value,)], "x STRING").select(call(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("https://Arquivo.Example/leis/?gclid=z&page=3#meio", "https://arquivo.example/leis?page=3"), ("https://a.example/b?id=50%&lang=p%C3%A3o+x&page=~*", "https://a.example/b?id=50%25&lang=p%C3%A3o+x&page=~%2A"),
        ("https://a.example/c?i%64=%zz", "https://a.example/c?id=%25zz"),
        ("https://a.example//x///", "https://a.example/x"), ("https://a.example", "https://a.example/"), ("mailto:x@y.z", ""), ("", ""), (None, ""),
        ("https://a.example/#!/rota//b/", "https://a.example/#!/rota/b"), ("https://a.example/?ID=1&page=", "https://a.example/"),
        ("https://a.example/x;p=1?lang=pt&lang=en", "https://a.example/x?lang=pt&lang=en"),
    ],
)
def test_normalize_url(spark, raw, want):
    assert one(spark, raw, url.normalize_url) == want
    assert one(spark, want, url.normalize_url) == want


def test_scope_and_names(spark):
    inside = lambda x: url.in_scope(x, F.lit("casa.example"))
    assert one(spark, "https://atas.casa.example:8443/q", inside) and one(spark, "https://CASA.example/edital.pdf", inside)
    assert not one(spark, "https://minhacasa.example/q", inside) and not one(spark, "https://casa.example/logo.WebP", inside) and not one(spark, "", inside)
    assert one(spark, "https://casa.example/edital.PDF#p3", url.is_pdf)
    assert one(spark, "x", lambda x: url.blocked_request(F.lit("image"), x))
    name = one(spark, "https://casa.example:81/leis//2001/#!/art/5", lambda x: url.output_filename(x, "md"))
    assert name.startswith("casa.example_81_leis_2001_FRAG_art_5__") and len(name) == len("casa.example_81_leis_2001_FRAG_art_5__") + 11
    assert one(spark, "...", url.sanitize) == "documento" and one(spark, None, url.sanitize) == "documento"
    assert one(spark, "https://a.example/x/y?q", lambda x: url.resolve(x, F.lit("z"))) == "https://a.example/x/z"
    assert one(spark, "https://a.example/x/y/w", lambda x: url.resolve(x, F.lit("../.././b?c#d"))) == "https://a.example/b?c#d"


@pytest.mark.parametrize(("x", "want"), [("1 de Março de 1987", "1987-03-01"), ("3\u00a0de agosto\u00a0de 2011", "2011-08-03"), ("31 de abril de 2003", ""), ("5 de foo de 2001 e 3/4/2005", ""), ("em 3-4-2005", "2005-04-03"), (None, "")])
def test_dates(spark, x, want):
    assert one(spark, x, legal.portuguese_date) == want


def test_legal_metadata(spark):
    for space in (" ", "\u00a0"):
        text_ = f"# Ato nº{space}0081/1994, de 9{space}de maio de 1994\n\nFicam revogadas as normas. Pub.{space}DOE nº 6-C, de{space}11/05/1994, p.{space}72"
        m = one(spark, text_, legal.legal_metadata)
        assert (m.act_type, m.act_number, m.act_year, m.act_date, m.status, m.aliases) == ("Ato", "81", "1994", "1994-05-09", "Revogada", ["Ato 81/1994"])
        assert (m.doe.numero, m.doe.data, m.doe.pagina) == ("6-C", "11/05/1994", "72")
    assert one(spark, "Deliberacao no. 3", legal.act_type) == "Deliberação"
    assert one(spark, "formato", legal.act_type) == ""
    assert one(spark, "", legal.legal_metadata).aliases == []


def test_text(spark):
    assert one(spark, None, text.is_low_quality) and one(spark, "a" * 499, text.is_low_quality) and not one(spark, "a" * 500, text.is_low_quality)
    assert one(spark, "pesquisar buscar" + "a" * 500, text.is_low_quality)
    assert one(spark, "1" * 1300, text.llm_is_useful) and not one(spark, "1" * 1100, text.llm_is_useful)
    assert one(spark, "  A\u00a0 B\x1c c ", text.normalize_text) == "a b c"
    assert one(spark, "---\na: 1\n---\n\ncorpo\n", text.front_matter_body) == "corpo"
    assert one(spark, "--- só um", text.front_matter_body) == "--- só um"
    assert one(spark, "```md\ntexto\n```", text.strip_model_wrappers) == "texto"
    assert one(spark, "\n \n Título \n\nresto ", text.pdf_body) == "# Título\n\nresto"
    assert one(spark, " \n", text.pdf_body) == "" and one(spark, None, text.pdf_body) == ""
    got = spark.range(1).select(text.yaml_front_matter([("t", F.lit('a"b\nc'))], [("l", F.array(F.lit("x")))]).alias("y")).first().y
    assert got == '---\nt: "a\\"b c"\nl:\n  - "x"\n---\n'


def test_yaml(spark):
    assert one(spark, "a: 1\nb: 2024-01-02\nc:", read_yaml) == {"a": "1", "b": "2024-01-02", "c": None}
    assert one(spark, "a: [", read_yaml) == {} and one(spark, "- x", read_yaml) == {} and one(spark, None, read_yaml) == {}


def test_merge_keeps_existing_keys(spark):
    made = spark.range(1).select(text.merge_metadata(F.create_map(F.lit("a"), F.lit(None).cast("string")), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("m"))
    assert made.first().m == {"a": None, "b": "2"}


def test_html():
    page = "<html><body><script>x</script><main><h1>T</h1><p>Olá <b>m</b></p><ul><li>a<li>b</ul></main></body></html>"
    assert html.text_of(page) == "T\nOlá\nm\na\nb"
    assert html.markdown_of(page) == "# T\n\nOlá **m**\n\n* a\n* b"
    assert html.main_region("<main>" + "x" * 500 + "</main>") == "x" * 500
    assert html.main_region("<main>x</main>") == "" and html.main_region(None) == "" and html.text_of(None) == ""


def test_chunks(spark):
    for t in ("", "a" * 5000, "a" * 12001, ("b" * 3000 + "\n\n" + "c" * 3000) * 3, "d" * 2999 + "\n\n" + "e" * 9000):
        parts = chunks.cut(t)
        assert "".join(parts) == t.strip() and all(len(p) <= 5000 for p in parts)
    assert len(chunks.cut("a" * 3000 + "\n\n" + "b" * 4000)[0]) == 3002
    assert chunks.chunks(spark.createDataFrame([(1, None)], "id INT, t STRING"), "id", "t").collect()[0].chunk == ""


def test_simhash_and_greedy(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(3)] + values[:10]
    rng.shuffle(values)
    kept, want = [], []
    for k, v in enumerate(values):
        if all((v ^ x).bit_count() > 3 for x in kept):
            kept.append(v)
            want.append(k)
    rows = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "id BIGINT, bits BIGINT")
    assert sorted(r.id for r in simhash.greedy_kept(rows, "id").collect()) == want
    texts = spark.createDataFrame([(1, "um dois dois"), (2, "um dois dois"), (3, ""), (4, None), (5, "...")], "id BIGINT, t STRING")
    got = {r.id: r.simhash for r in simhash.simhashes(texts, "id", "t").collect()}
    assert got[1] == got[2] and len(got[1]) == 16 and got[3] is None and got[4] is None and got[5] is None
    assert simhash.greedy_kept(rows.limit(0), "id").count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a BIGINT, b BIGINT")
    got = {r.node: r.label for r in components(edges, Scratch(spark, "t")).collect()}
    assert {got[k] for k in range(41)} == {0} and got[101] == got[100] == 100
    assert components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_join_counted_and_running_sum(spark, monkeypatch):
    import lavra.operators.running as running

    left = spark.createDataFrame([(k, "h" if k % 3 else f"c{k % 7}") for k in range(300)] + [(999, None)], "id INT, key STRING")
    right = Scratch(spark, "t").write(left.dropna().groupBy("key").agg(F.count("*").alias("n")), "right")
    got = join_counted(left, right, ["key"], "n", ["id"], "left").collect()
    assert len(got) == 301 and sum(r.n is None for r in got) == 1
    monkeypatch.setattr(running, "PART_ROWS", 7)
    out = running_sum(left.dropna().withColumn("w", F.col("id") % 5), right, ["key"], F.xxhash64("id"), "w", "before", Scratch(spark, "t"), "r").collect()
    for key in {r.key for r in out}:
        own = sorted((r for r in out if r.key == key), key=lambda r: (r.before, r.w))
        assert sorted(r.before + r.w for r in own)[-1] == sum(r.w for r in own)
        assert len({(r.before) for r in own if r.w}) == sum(1 for r in own if r.w)


def test_audit(spark):
    rows = spark.createDataFrame([(1, "a/portarias/x.md", {"act_type": "Ato"}, "# Portaria nº 1/2020"), (2, "b.md", {}, ""), (3, "c.md", None, None), (4, "d.md", {"act_type": "Ato"}, "# Portaria nº 1/2020")], "id BIGINT, path STRING, meta MAP<STRING,STRING>, body STRING")
    done = validate.with_duplicates(validate.validated(rows).select("id", "path", "result.*"), "id")
    issues = {r.id: r.issues for r in done.collect()}
    assert "SUBDIR_MISMATCH(portarias!=act_type)" in issues[1] and "DUPLICATE_KEY(ato-1/2020)" in issues[1] and "DUPLICATE_CONTENT" in issues[4]
    assert "MISSING_FRONTMATTER" in issues[3] and not any(x.startswith("DUPLICATE_KEY") for x in issues[2])
    assert validate.issue_summary(done.limit(0)).count() == 0
    assert validate.markdown_report(done, "raiz").where("section = 4").count() == 4


def test_crawl(spark):
    from lavra.catalogue import GRAPH

    links = spark.createDataFrame(GRAPH, "src STRING, dst STRING")
    got = {r.url: (r.depth, r.outcome) for r in crawl.crawl(links, crawl.CrawlOptions("https://a.example/", 1)).collect()}
    assert got == {"https://a.example/": (0, "visited"), "https://a.example/w": (1, "visited"), "https://a.example/x": (1, "visited"), "https://a.example/y": (1, "visited")}
    # What w leads to comes before what x leads to, whatever its name.
    got = {r.url: r.outcome for r in crawl.crawl(links, crawl.CrawlOptions("https://a.example/", 2, 5)).collect()}
    assert got["https://a.example/zz"] == "visited" and got["https://a.example/b2"] == "over_budget"
    assert crawl.crawl(links, crawl.CrawlOptions("https://a.example/"), stop=lambda: True).count() == 0
    with pytest.raises(ValueError):
        crawl.CrawlOptions("a.example")
    assert crawl.robots_policy(None, 403).can_fetch("*", "https://a.example/") is False and crawl.robots_policy("", 500) is None


def test_settings(tmp_path):
    got = Settings.load({"MAX_PAGES": "0", "MAX_DEPTH": "7", "SAME_DOMAIN_ONLY": "Sim", "HEADLESS": "não", "OUTPUT_FORMAT": " MD ", "CRAWLER_USER_AGENT": " "})
    assert (got.max_pages, got.max_depth, got.same_domain_only, got.headless, got.output_format, got.user_agent) == (1, 7, True, False, "md", "lavra/1.0")
    (tmp_path / ".env").write_text("# nota\nMAX_DEPTH = '5'\nPOLITENESS_DELAY=1.5\nsem valor\nREQUEST_TIMEOUT_MS=abc\nOUTPUT_FORMAT=html\n")
    got = Settings.load({"MAX_DEPTH": "3"}, tmp_path / ".env")
    assert (got.max_depth, got.politeness_delay, got.request_timeout_ms, got.output_format) == (3, 1.5, 60_000, "txt") and got.delay(2.0) == 2.0
    assert Settings.load({}, tmp_path / "none") == Settings() and least_interval() == 3.0 and least_interval(0) == 0.0


def test_refine(spark):
    words = "palavra outra mais texto comum " * 30
    rows = spark.createDataFrame([(1, "data/0_extracao_bruta/p/a.md", words), (2, "data/0_extracao_bruta/b.md", words), (3, "c.md", "curto"), (4, "d.md", None), (5, "e.md", "." * 600)], "id BIGINT, path STRING, body STRING")
    done = refine.refine(rows, "id", "path", "body", refine.Refiner("ollama", "m", str.upper, heuristic=False))
    got = {r.id: r for r in done.collect()}
    assert [got[k].outcome for k in range(1, 6)] == ["ok", "duplicate", "error", "error", "error"]
    assert got[1].text.startswith("PALAVRA") and got[1].llm_applied and got[1].out.startswith("a__") and got[5].reason == "no terms"
    assert refine.run_counters(done).first().asDict() == {"input_files": 5, "refined_files": 1, "duplicates": 1, "failed_files": 3}
    must = refine.Refiner("google", "m", lambda t: 1 / 0, heuristic=False, required=True)
    failed = {r.id: r for r in refine.refine(rows, "id", "path", "body", must).collect()}
    assert failed[1].outcome == "error" and failed[1].reason.startswith("refiner:") and failed[2].outcome == "duplicate" and not failed[1].llm_applied
    bad = refine.Refiner("x", "m", lambda t: 1 / 0)
    assert bad.refine("abc") == ("abc", 1, 1)


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in" / "_processados").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("---\nact_type: Ato\n---\ncorpo\n")
    (tmp_path / "in" / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "_processados" / "c.md").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.markdown_documents(spark, str(tmp_path / "in")).collect()}
    assert set(got) == {"a.md", "b.md"} and got["a.md"].meta == {"act_type": "Ato"} and got["a.md"].body == "corpo" and got["b.md"].body == ""
    records = spark.createDataFrame([("i", "o1", "0x1", False, "", "")], "`in` STRING, out STRING, simhash64_hex STRING, llm_applied BOOLEAN, provider STRING, model STRING")
    sinks.write_manifest(records, str(tmp_path / "m"))
    with open(tmp_path / "m" / "bad.json", "w") as f:
        f.write('{"out": \n{"in": "x", "out": ""}\n')
    manifest = files.read_manifest(spark, str(tmp_path / "m"))
    assert [r.out for r in manifest.collect()] == ["o1"] and refine.new_records(records, manifest).count() == 0
    sinks.write_files(spark.createDataFrame([("n.txt", "olá")], "name STRING, content STRING"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "n.txt").read_text() == "olá"
    spark.createDataFrame([(1, "a")], "id INT, t STRING").write.parquet(str(tmp_path / "s"))
    seen = []
    run = lambda: incremental.run_new_files(spark, str(tmp_path / "s"), "id INT, t STRING", str(tmp_path / "ck"), lambda df, n: seen.append(df.count()))
    run()
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "id INT, t STRING").write.mode("append").parquet(str(tmp_path / "s"))
    run()
    assert sum(seen) == 3
    pdf = tmp_path / "pdf"
    pdf.mkdir()
    (pdf / "x.pdf").write_bytes(b"abc")
    assert files.pdf_texts(spark, str(pdf), lambda b: b.decode()).first().text == "abc"


def test_scratch_is_in_the_named_folder(spark):
    s = Scratch(spark, "t")
    df = s.write(spark.range(3), "x")
    assert df.count() == 3 and s.path.startswith(shared_dir(spark))
    s.drop()


def test_front_matter_of_all_kinds(spark):
    doc = lambda t: one(spark, t, lambda x: read_document(x, False))
    assert doc("---\na: {b: 2}\nc: []\n---\n\nx").meta == {"a": '{"b": 2}', "c": "[]"} and doc("---\na: {b: 2}\n---\n\nx ").body == "x "
    assert doc("---\na: [\n---\nx") == ({}, "x") and doc("---\n- a\n---\nx") == ({}, "---\n- a\n---\nx") and doc(None) == ({}, None)
    made = lambda t, o: one(spark, t, lambda x: with_metadata(x, F.lit('{"b": "07", "c": 1}'), o))
    assert made("a: 1\nb: 2", True) == "---\na: 1\nb: '07'\nc: 1\n---\n" and made("a: 1\nb:", False) == "---\na: 1\nb: null\nc: 1\n---\n"
    assert made("- x", True) == made(None, True) == "---\nb: '07'\nc: 1\n---\n"


def test_publication(spark):
    rows = [(1, '{"pagina": 8}'), (2, "{}"), (3, None), (4, "texto")]
    docs = spark.createDataFrame([(k, "p", {"doe": v}, "Pub. DOE nº 1, de 01/02/2003, p. 4" if k == 4 else "") for k, v in rows], "id INT, path STRING, meta MAP<STRING,STRING>, body STRING")
    got = {r.id: r.result for r in validate.validated(docs).collect()}
    assert got[1].publication_page == "8" and "PUBLICATION_METADATA_BUT_NO_TEXT" in got[1].issues
    assert all(got[k].publication_page == "" and "PUBLICATION_METADATA_BUT_NO_TEXT" not in got[k].issues for k in (2, 3, 4))
    assert "PUBLICATION_TEXT_BUT_NO_METADATA" in got[4].issues


def test_near_pairs_have_few_candidates(spark):
    """Hashes that share their first 16 bits, and those of two blocks, are no candidates of each other; near ones all are."""
    rng = random.Random(6)
    values = [rng.getrandbits(48) for _ in range(1500)] + [rng.getrandbits(43) | 5 << 43 for _ in range(1500)]
    near = [values[0] ^ 0b111, values[1] ^ (1 << 63 | 1 << 30 | 1), values[2] ^ 1 << 40]
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in [*values, *near]], "bits BIGINT")
    assert simhash.near_candidates(rows).count() < 3 * len(values)
    assert simhash.near_pairs(rows).count() == sum((a ^ b).bit_count() <= 3 for k, a in enumerate([*values, *near]) for b in [*values, *near][:k])


def test_menu(spark):
    page = "<div class='arvore x'><ul><li> Um </li><li></li><li><a href='/b'>Dois</a></li></ul></div><div id=corpo><h2>T</h2><p>texto</div>"
    assert menu.select(page, "div.arvore li") == [" Um ", "", "<a href='/b'>Dois</a>"] and menu.select(page, "a[href]") == ["Dois"] and menu.select(None, "a") == []
    own = spark.createDataFrame([(1, page), (2, None), (3, "")], "id INT, html STRING")
    assert sorted(map(tuple, menu.menu_items(own, "id", "html", ".arvore li").collect())) == [(1, 0, "Um"), (1, 2, "Dois")]
    got = own.select("id", menu.container(F.col("html"), "#corpo").alias("c"), menu.item_title(F.col("html"), "#corpo h2", F.lit(" item ")).alias("t")).collect()
    assert got[0].c.text == "T\ntexto" and got[0].t == "T" and got[1].c.html == "" and got[1].t == "item"
    assert [r.position for r in menu.numbered(own, "id", "html", 1).collect()] == [1, 1, 1]
    with pytest.raises(ValueError):
        menu.read_selector("li > a")


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    raw = tmp_path / "raw"
    (raw / "p").mkdir(parents=True)
    long = "Palavras do texto corrido que bastam para o documento passar. " * 12
    (raw / "a.md").write_text(f"---\nlang: pt\n---\n# Ato nº 5/2001\n\n{long}")
    (raw / "p" / "b.md").write_text(f"# Ato nº 5/2001\n\n{long}")
    (raw / "c.md").write_bytes(b"curto \xff")
    run = lambda *a, **k: cli.main([*a], spark, **k)
    assert run("validate", "--root", str(raw)) == 1 and run("validate", "--root", str(tmp_path / "no")) == 2 and run("other") == 2
    report = "".join(p.read_text() for p in (tmp_path / "relatorio_validacao.csv").glob("*.csv"))
    assert report.count("MISSING_FRONTMATTER") == 2 and report.startswith("path,")
    assert run("enrich", "--root", str(raw), "--owner", "x") == 0
    assert "owner: x" in (tmp_path / "data/0_enriquecidos/p/b.md").read_text()
    assert run("refine", "--root", str(raw)) == 1
    out = sorted((tmp_path / "data/1_markdowns_limpos").iterdir())
    assert len(out) == 1 and out[0].read_text().startswith("---\nlang: pt\nrefined_by: local\ncontent_hash: ")
    assert run("refine", "--root", str(raw), "--only", "p/b.md") == 0 and run("rebuild", "--root", str(raw)) == 0
    assert len(files.read_manifest(spark, str(tmp_path / "data/manifest.jsonl")).collect()) == 2
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "x.pdf").write_bytes(b"Portaria n. 4\ncorpo")
    (tmp_path / "pdf" / "y.pdf").write_bytes(b" \n")
    assert run("convert", "--root", str(tmp_path / "pdf"), "--audit", "copias", extract=lambda b: bytes(b).decode()) == 1
    made = next((tmp_path / "pdf/markdown").iterdir())
    assert "act_number: '4'" in made.read_text() and (tmp_path / "copias" / made.name).exists()


def test_remote_calls():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    paced = remote.Paced(str.upper, 30, lambda: now[0], sleep)
    assert [paced("a"), paced("b")] == ["A", "B"] and slept == [2.0]
    now[0] += 5
    assert paced("c") == "C" and len(slept) == 1
    answers = iter([ValueError("x"), "", " ok "])

    def call(_):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    slept.clear()
    assert remote.Retried(call, sleep=sleep)("t") == " ok " and [int(x) // 5 for x in slept] == [1, 2]
    with pytest.raises(ZeroDivisionError):
        remote.Retried(lambda t: 1 / 0, 2, sleep)("t")
    assert remote.available("m", ["z", "m:8b", "m:8b"]) == (True, ["m:8b", "z"]) and remote.available("q", [])[0] is False


def test_options():
    with pytest.raises(ValueError):
        crawl.CrawlOptions("https://a.example/", output_format="pdf")
    for bad in (dict(url="x"), dict(items="a > b"), dict(max_items=0)):
        with pytest.raises(ValueError):
            menu.MenuOptions(**{"url": "https://a.example/", "items": "li", "content": "#c", **bad})
