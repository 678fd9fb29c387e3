"""SQL for DuckDB that says the same as the queries of :mod:`lavra.catalogue`."""

from __future__ import annotations

from lavra.catalogue import DOCUMENTS, GRAPH, PAGES
from lavra.functions import legal, text, url
from lavra.operators.validate import REPORT_HEAD, REPORT_SUMMARY, REPORT_TAIL

# White space as Python has it; RE2's own class is ASCII only.
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x0b\x1c-\x1f]"
_B, _E = "(^|[^0-9A-Za-zÀ-ÖØ-öø-ÿ_])", "($|[^0-9A-Za-zÀ-ÖØ-öø-ÿ_])"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def normal(x: str) -> str:
    return f"substr(lower(trim(regexp_replace({x}, '{WS}+', ' ', 'g'))), 1, {text.TEXT_LIMIT})"


def markers(x: str) -> str:
    return " + ".join(f"contains(lower({x}), '{m}')::INT" for m in text.LOW_QUALITY_MARKERS)


def low_quality(x: str) -> str:
    return f"coalesce(length({x}) < 500 OR ({markers(x)}) >= 2, true)"


def collapsed(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10)||chr(10), 'g')")


def useful(x: str) -> str:
    digits = f"length({x}) - length(regexp_replace({x}, '[0-9]', '', 'g'))"
    lines = rf"len(list_filter(regexp_split_to_array({x}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: length(l) > 180))"
    return f"coalesce(length({x}) >= 1200 AND (({digits}) / length({x}) > 0.12 OR {lines} >= 4), false)"


_TOKENS = f"regexp_extract_all({normal('text')}, '{text.TOKEN}')"
_COUNTS = f"""
tok AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)),
cnt AS (SELECT doc_id, token, count(*) AS n, min(pos) AS f FROM tok GROUP BY ALL),
top AS (SELECT doc_id, token, least(n, 255) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM cnt)"""


def _simhash(src: str, key: str = "doc_id") -> str:
    """``src`` has (key, token, w): (key, h UBIGINT)."""
    return f"""
sgn AS (SELECT {key}, w, ('0x' || substr(sha1(token), 1, 16))::UBIGINT AS h FROM {src}),
bits AS (SELECT {key}, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN w ELSE -w END) >= 0 AS one FROM sgn, range(64) r(b) GROUP BY {key}, b),
hashed AS MATERIALIZED (SELECT {key}, sum(CASE WHEN one THEN (1::UBIGINT << b)::HUGEINT ELSE 0 END)::UBIGINT AS h FROM bits GROUP BY {key})"""


def _greedy(src: str, key: str) -> str:
    """Keeps from ``src`` (key, h), in order of key, what is more than 3 bits from all kept before."""
    return f"""
seq AS MATERIALIZED (SELECT {key} AS id, h, row_number() OVER (ORDER BY {key}) AS r FROM {src}),
walk AS (
  SELECT 0::BIGINT AS r, []::UBIGINT[] AS kept, NULL::BIGINT AS id
  UNION ALL
  SELECT seq.r, CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, h)) <= 3)) = 0 THEN list_append(kept, h) ELSE kept END,
         CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, h)) <= 3)) = 0 THEN seq.id END
  FROM walk JOIN seq ON seq.r = walk.r + 1
)"""


def part(x: str, n: int) -> str:
    return f"regexp_extract({x}, '{url._URL}', {n})"


def host(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({part(x, 2)}, '^.*@', ''), ':\d*$', ''))"


def _decoded(x: str) -> str:
    """Escapes read, other % signs kept."""
    marked = f"regexp_replace(replace({x}, '+', ' '), '%([0-9A-Fa-f]{{2}})', chr(1) || '\\1', 'g')"
    return f"url_decode(replace(replace({marked}, '%', '%25'), chr(1), '%'))"


def _encoded(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def normal_url(x: str) -> str:
    raw = f"regexp_replace(regexp_replace({part(x, 3)}, ';[^/;]*$', ''), '/{{2,}}', '/', 'g')"
    path = f"CASE WHEN {raw} IN ('', '/') THEN '/' ELSE regexp_replace({raw}, '/+$', '') END"
    kept = f"list_filter(string_split({part(x, 4)}, '&'), lambda p: {_decoded("regexp_extract(p, '^([^=]*)=.', 1)")} IN ('id', 'page', 'lang'))"
    query = f"array_to_string(list_transform({kept}, lambda p: {_decoded("regexp_extract(p, '^([^=]*)=', 1)")} || '=' || {_encoded(_decoded("regexp_extract(p, '^[^=]*=(.*)$', 1)"))}), '&')"
    route = f"CASE WHEN regexp_matches({part(x, 5)}, '^!?/') THEN regexp_replace(regexp_replace({part(x, 5)}, '/{{2,}}', '/', 'g'), '/+$', '') ELSE '' END"
    return (
        f"coalesce(CASE WHEN lower({part(x, 1)}) IN ('http', 'https') AND {part(x, 2)} <> '' THEN lower({part(x, 1)}) || '://' || lower({part(x, 2)}) || {path} || "
        f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END || CASE WHEN {route} <> '' THEN '#' || {route} ELSE '' END END, '')"
    )


def ext(x: str) -> str:
    return f"lower(regexp_extract(regexp_extract({part(x, 3)}, '([^/]*)/*$', 1), '^.+?(\\.[^.]+)$', 1))"


def is_binary(x: str) -> str:
    return f"{ext(x)} IN ({', '.join(repr(e) for e in url.BINARY_EXTENSIONS)})"


def in_scope(x: str, base: str) -> str:
    return f"coalesce({x} <> '' AND NOT {is_binary(x)} AND ({host(x)} = {base} OR ends_with({host(x)}, '.' || {base})), false)"


def sanitize(x: str, most: int = 200, collapse: bool = True) -> str:
    out = f"""regexp_replace(regexp_replace({x}, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '{WS}+', '_', 'g')"""
    if collapse:
        out = f"regexp_replace({out}, '_+', '_', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '^[._]+', ''), '[._]+$', '')"
    return f"coalesce(nullif(regexp_replace(substr({out}, 1, {most}), '[._]+$', ''), ''), 'documento')"


def out_name(x: str, e: str) -> str:
    inner = f"regexp_replace(regexp_replace({part(x, 3)}, '^/+', ''), '/+$', '')"
    path = f"replace(CASE WHEN {inner} = '' THEN 'index' ELSE {inner} END, '/', '_')"
    route = f"regexp_replace(replace({part(x, 5)}, '!/', ''), '^/+', '')"
    server = sanitize(f"replace({part(x, 2)}, ':', '_')", 80)
    whole = f"({server} || '_' || {path} || CASE WHEN {route} <> '' THEN '__FRAG_' || replace({route}, '/', '_') ELSE '' END)"
    return f"regexp_replace(substr({sanitize(whole)}, 1, {240 - 11 - len(e)}), '[._]+$', '') || '__' || substr(sha1({x}), 1, 8) || '.{e}'"


_STEM = "regexp_extract(path, '([^/]*?)(?:\\.[^./]*)?$', 1)"
_FOLDER = "regexp_replace(regexp_extract(path, '^(.*)/[^/]*$', 1), '^data/0_extracao_bruta/?', '')"
REF = f"({_STEM} || CASE WHEN {_FOLDER} <> '' THEN '__' || substr(sha1({_FOLDER}), 1, 8) ELSE '' END || '__REF.md')"

_HREF = "list_transform(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1), lambda h: replace(h, '&amp;', '&'))"


def resolved(base: str, h: str) -> str:
    root = f"{part(base, 1)} || '://' || {part(base, 2)}"
    folder = f"regexp_replace(CASE WHEN {part(base, 3)} = '' THEN '/' ELSE {part(base, 3)} END, '[^/]*$', '')"
    return (
        f"CASE WHEN regexp_matches(trim({h}), '^[A-Za-z][A-Za-z0-9+.-]*:') THEN trim({h}) WHEN starts_with(trim({h}), '//') THEN {part(base, 1)} || ':' || trim({h}) "
        f"WHEN starts_with(trim({h}), '/') THEN {root} || trim({h}) WHEN starts_with(trim({h}), '#') THEN regexp_replace({base}, '#.*$', '') || trim({h}) "
        f"WHEN starts_with(trim({h}), '?') THEN {root} || {part(base, 3)} || trim({h}) ELSE {root} || {folder} || trim({h}) END"
    )


_LINKS = f"""
href AS (SELECT page_id, source, url, unnest({_HREF}) AS h FROM pages),
abs AS (SELECT page_id, source, {resolved('url', 'h')} AS a FROM href),
links AS (SELECT DISTINCT page_id, source, link FROM (SELECT page_id, source, {normal_url('a')} AS link FROM abs) WHERE link <> '')"""

def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_EXTRA_DOCS = ", ".join(f"({-k - 1}, {_quoted(p)}, {_quoted(t)})" for k, (p, t) in enumerate(DOCUMENTS))
_RAW = f"""raw AS (SELECT md_id, path, CASE WHEN front_matter IS NULL THEN coalesce(body, '') ELSE '---' || chr(10) || front_matter || chr(10) || '---' || chr(10) || coalesce(body, '') END AS raw FROM md
  UNION ALL SELECT * FROM (VALUES {_EXTRA_DOCS}) v(md_id, path, raw)),
cut AS (SELECT *, strpos(substr(raw, 4), '---') AS p, starts_with(raw, '---') AND strpos(substr(raw, 4), '---') > 0 AS has FROM raw),
parts AS (SELECT md_id, path, raw, CASE WHEN has THEN substr(raw, 4, p - 1) ELSE '' END AS yaml, CASE WHEN has THEN substr(raw, p + 6) ELSE raw END AS rest, has FROM cut),
docs AS (SELECT md_id, path, yaml, has, rest, CASE WHEN has THEN regexp_replace(rest, '^\\n+', '') ELSE rest END AS plain, regexp_matches(yaml, '^\\s*- ') AS list,
  CASE WHEN has AND NOT regexp_matches(yaml, '^\\s*- ') THEN regexp_replace(rest, '^\\n+', '') ELSE raw END AS body FROM parts)"""
# YAML as these documents have it: flat keys, a bracket that isn't closed, a list, and one nested mapping.
_META = """meta AS (SELECT md_id, path, body, CASE WHEN list OR regexp_matches(yaml, '(?m)[[][^]\\n]*$') THEN '' ELSE yaml END AS y FROM docs),
metas AS (SELECT *, list_filter(string_split(y, chr(10)), lambda x: regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*:( |$)')) AS kv, regexp_matches(y, '(?m)^doe:\\n +[a-z]+:') AS doe,
  regexp_extract(y, '(?m)^ +pagina: *(.*)$', 1) AS page, regexp_extract(y, '(?m)^ +numero: *(.*)$', 1) AS doe_no FROM meta)"""


def given(key: str) -> str:
    """The last value of a key in kv."""
    line = f"list_filter(kv, lambda x: starts_with(x, '{key}:'))[-1]"
    return f"""coalesce(regexp_replace(regexp_replace(trim(substr({line}, {len(key) + 2})), '^[''"]', ''), '[''"]$', ''), '')"""


def has_key(key: str) -> str:
    return f"(len(list_filter(kv, lambda x: starts_with(x, '{key}:'))) > 0)"


_LONG = f"([0-9]{{1,2}}){WS}+de{WS}+([A-Za-zçãáéíóúôêÇÃÁÉÍÓÚÔÊ]+){WS}+de{WS}+([0-9]{{4}})"
_SHORT = "([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"


def iso(x: str) -> str:
    month = "CASE " + f"lower(regexp_extract({x}, '(?i){_LONG}', 2)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in legal.MONTHS.items()) + " ELSE 0 END"

    def date(y: str, m: str, d: str) -> str:
        return f"coalesce(strftime(try_cast(lpad({y}, 4, '0') || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE), '%Y-%m-%d'), '')"

    long_date = date(f"regexp_extract({x}, '(?i){_LONG}', 3)", month, f"regexp_extract({x}, '(?i){_LONG}', 1)")
    short = date(*[f"regexp_extract({x}, '{_SHORT}', {k})" for k in (3, 2, 1)])
    return f"CASE WHEN regexp_matches({x}, '(?i){_LONG}') THEN {long_date} WHEN regexp_matches({x}, '{_SHORT}') THEN {short} ELSE '' END"


def h1(x: str) -> str:
    return strip(f"regexp_extract({x}, '(?m)^{WS}*#{WS}+([^\\n]+?){WS}*$', 1)")


def act_type(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){_B}{p}{_E}') THEN '{n}'" for n, p in legal.ACT_TYPES.items()) + " ELSE '' END"


_NUM = f"(?i)(?:n[ºo]{WS}*|no[.]{WS}*|n[.]{WS}*)([0-9]{{1,5}})(?:[/-]([0-9]{{4}}))?"
_DOE = f"(?i)Pub[.]{WS}*DOE{WS}*n[ºo]?{WS}*([A-Za-z0-9-]+){WS}*,{WS}*de{WS}*([0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}){WS}*,{WS}*p[.]{WS}*([0-9]+)"
_INFER = f"""
heads AS (SELECT *, {h1('body')} AS h1, {strip(f"regexp_extract(body, '^{WS}*([^{chr(92)}n]*)', 1)")} AS line1 FROM {{src}}),
inf0 AS (SELECT *, CASE WHEN h1 <> '' THEN h1 ELSE line1 END AS hd FROM heads),
inf AS (SELECT *, {act_type('hd')} AS i_type, coalesce(nullif(regexp_extract(hd, '{_NUM}', 1), '')::INT::VARCHAR, '') AS i_number, regexp_extract(hd, '{_NUM}', 2) AS i_year,
  {iso('hd')} AS i_date, regexp_matches(body, '{_DOE}') AS i_doe, regexp_extract(body, '{_DOE}', 1) AS i_doen, regexp_extract(body, '{_DOE}', 2) AS i_doed, regexp_extract(body, '{_DOE}', 3) AS i_doep,
  CASE WHEN regexp_matches(body, '(?i){_B}revogad[ao]s?{_E}') THEN 'Revogada' WHEN regexp_matches(body, '(?i){_B}vigent[ea]{_E}') THEN 'Vigente' ELSE '' END AS i_status FROM inf0)"""

_VALID = f"""{_RAW}, {_META}, {_INFER.replace('{src}', 'metas')},
val0 AS (SELECT md_id, path, kv, body, {strip(given('act_type'))} AS act_type, coalesce(nullif({given('act_number')}, ''), i_number) AS act_number,
  coalesce(nullif({given('act_year')}, ''), i_year) AS act_year, coalesce(nullif({given('act_date')}, ''), i_date) AS act_date, {act_type('h1')} AS heading_type, i_doe,
  doe, page, {given('aliases')} AS aliases, sha1(body) AS content_hash FROM inf),
val AS (SELECT *, list_filter([
  CASE WHEN len(kv) = 0 THEN 'MISSING_FRONTMATTER' END, CASE WHEN act_type = '' THEN 'MISSING_ACT_TYPE' END, CASE WHEN act_number = '' THEN 'MISSING_ACT_NUMBER' END,
  CASE WHEN act_year = '' THEN 'MISSING_ACT_YEAR' END, CASE WHEN act_date = '' THEN 'MISSING_ACT_DATE' END,
  CASE WHEN act_type <> '' AND heading_type <> '' AND act_type <> heading_type THEN 'TYPE_MISMATCH(' || act_type || '!=' || heading_type || ')' END,
  CASE WHEN contains(lower(path), 'portarias') AND act_type NOT IN ('', 'Portaria') THEN 'SUBDIR_MISMATCH(portarias!=act_type)' END,
  CASE WHEN contains(lower(path), 'resolucoes') AND act_type NOT IN ('', 'Resolução') THEN 'SUBDIR_MISMATCH(resolucoes!=act_type)' END,
  CASE WHEN i_doe AND NOT doe THEN 'PUBLICATION_TEXT_BUT_NO_METADATA' END, CASE WHEN doe AND NOT i_doe THEN 'PUBLICATION_METADATA_BUT_NO_TEXT' END,
  CASE WHEN aliases = '[]' AND act_type <> '' AND act_number <> '' THEN 'ALIASES_EMPTY' END], lambda x: x IS NOT NULL) AS found FROM val0)"""


_DOE_TEXT = f"""CASE WHEN doe THEN '{{"numero": "' || doe_no || '", "pagina": ' || page || '}}' WHEN {has_key('doe')} THEN {given('doe')}
  WHEN i_doe THEN '{{"numero":"' || i_doen || '","data":"' || i_doed || '","pagina":"' || i_doep || '"}}' ELSE '' END"""
_CHANGED, _CHANGED_SOURCE = (
    " OR ".join(f"(NOT {has_key(k)} AND {v})" for k, v in (("act_type", "i_type <> ''"), ("act_number", "i_number <> ''"), ("act_year", "i_year <> ''"), ("act_date", "i_date <> ''"), ("doe", "i_doe"),
                 ("status", "i_status <> ''"), ("aliases", "i_type <> '' AND i_number <> ''"), (last, "true")))
    for last in ("owner", "source")
)


def duplicates(src: str) -> str:
    return f"""keyed AS (SELECT *, lower(coalesce(nullif(act_type, ''), heading_type, '')) AS t, coalesce(act_number, '') AS n, coalesce(act_year, '') AS y FROM {src}),
counted AS (SELECT *, count(*) OVER (PARTITION BY t, n, y) AS kn, count(*) OVER (PARTITION BY content_hash) AS hn FROM keyed),
dup AS (SELECT *, list_concat(coalesce(found, []), list_filter([CASE WHEN kn > 1 AND (t <> '' OR n <> '' OR y <> '') THEN 'DUPLICATE_KEY(' || t || '-' || n || '/' || y || ')' END,
  CASE WHEN hn > 1 AND coalesce(content_hash, '') <> '' THEN 'DUPLICATE_CONTENT' END], lambda x: x IS NOT NULL)) AS issues FROM counted)"""


_REFINE = f"""
clean AS (SELECT md_id, path, body IS NULL AS none, coalesce({collapsed('body')}, '') AS text FROM md),
judged AS (SELECT *, CASE WHEN none OR text = '' THEN 'empty' WHEN {low_quality('text')} THEN 'low quality' END AS bad FROM clean),
tok AS (SELECT md_id, unnest(regexp_extract_all({normal('text')}, '{text.TOKEN}')) AS token FROM judged WHERE bad IS NULL),
top AS (SELECT md_id, token, least(count(*), 255) AS w FROM tok GROUP BY ALL),
{_simhash('top', 'md_id')}, {_greedy('hashed', 'md_id')},
outc AS (SELECT j.md_id, path, text, h, CASE WHEN bad IS NOT NULL OR h IS NULL THEN 'error' WHEN w.id IS NOT NULL THEN 'ok' ELSE 'duplicate' END AS outcome,
  bad FROM judged j LEFT JOIN hashed USING (md_id) LEFT JOIN (SELECT id FROM walk WHERE id IS NOT NULL) w ON w.id = j.md_id),
refined AS (SELECT md_id, path, outcome, coalesce(bad, CASE WHEN h IS NULL THEN 'no terms' WHEN outcome = 'duplicate' THEN 'hamming<=3' ELSE '' END) AS reason,
  CASE WHEN outcome = 'ok' THEN {REF} ELSE '' END AS out, CASE WHEN h IS NULL THEN '' ELSE '0x' || lower(to_hex(h)) END AS simhash64_hex, false AS llm_applied,
  '' AS provider, '' AS model, CASE WHEN outcome = 'ok' THEN sha1({normal('text')}) ELSE '' END AS content_hash FROM outc)"""

_EXTRA = [
    "https://H.Example/avisos/?gclid=q&id=7#fim", "https://h.example/b?id=50%&lang=p%C3%A3o+x&page=~*", "https://h.example/c?i%64=a%20b", "HTTP://A.example:80//x///y/?lang=pt&ID=1&page=#!/rota//a/",
    "mailto:a@b.c", "ftp://h/x", "", "https://h.example", "https://h.example/a;p=1?page=2&page=3", "https://h.example/f.tar.GZ#/x/", "/relative",
]
_URLS = "urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT url FROM menu_items UNION ALL SELECT url FROM documents) WHERE url IS NOT NULL UNION ALL VALUES " + ", ".join(f"('{x}')" for x in _EXTRA) + ")"
_DATES = ["3\u00a0de agosto\u00a0de 2011", "30 de fevereiro de 2011", "1 de MARCO de 2001, 2/3/2004", "5 de foo de 2001 e 3/4/2005", "em 09-11-1999", "31/02/2020", "sem data", ""]
_NOTE = "'Here is the rewritten text in markdown format:' || chr(10)"
_FENCE = f"(?s)^{text.FENCE}$"


def _wrapped(x: str) -> str:
    first = strip(f"regexp_extract({x}, '^([^\\n]*)', 1)")
    rest = strip(f"CASE WHEN regexp_matches({first}, '(?i)^here\\s+is\\s+the\\s+rewritten\\s+text\\s+in\\s+markdown\\s+format:?:?$') THEN regexp_replace({x}, '^[^\\n]*\\n?', '') ELSE {x} END")
    return f"CASE WHEN regexp_matches({rest}, '{_FENCE}') THEN {strip(f'regexp_extract({rest}, {chr(39)}{_FENCE}{chr(39)}, 1)')} ELSE {rest} END"


def _pdf(x: str) -> str:
    t = f"regexp_replace({x}, '^({WS}*\\n)+', '')"
    title, rest = strip(f"regexp_extract({t}, '^([^\\n]*)', 1)"), strip(f"regexp_replace({t}, '^[^\\n]*\\n?', '')")
    return f"CASE WHEN coalesce({strip(x)}, '') = '' THEN '' ELSE {strip(f'{chr(39)}# {chr(39)} || {title} || chr(10) || chr(10) || {rest}')} END"


_LEVELS = ", ".join(f"('{a}', '{b}')" for a, b in GRAPH)



def _bfs(depth: int, budget: int) -> str:
    """The crawl level by level: each ranks what it visits by the rank of the page before, then by name."""
    ctes = [
        f"g(src, dst) AS (VALUES {_LEVELS})", "site AS (SELECT * FROM g WHERE contains(dst, 'a.example/') AND NOT ends_with(dst, '.jpg'))",
        "known AS (SELECT DISTINCT src FROM g UNION SELECT 'https://sub.a.example/w')", "found0 AS (SELECT 'https://a.example/' AS url, 0 AS parent)", "before0 AS (SELECT 0 AS n)",
    ]
    for k in range(depth + 1):
        outcome = "CASE WHEN starts_with(url, 'https://a.example/y') THEN 'blocked' WHEN ends_with(url, '.pdf') THEN 'pdf' WHEN url NOT IN (SELECT src FROM known) THEN 'missing' ELSE 'visited' END"
        ctes.append(f"judged{k} AS (SELECT url, parent, {outcome} AS outcome FROM found{k})")
        ctes.append(f"rank{k} AS (SELECT url, row_number() OVER (ORDER BY parent, url) AS r FROM judged{k} WHERE outcome = 'visited' QUALIFY r <= {budget} - (SELECT n FROM before{k}))")
        ctes.append(f"level{k} AS (SELECT url, {k}::INT AS depth, CASE WHEN outcome = 'visited' AND url NOT IN (SELECT url FROM rank{k}) THEN 'over_budget' ELSE outcome END AS outcome FROM judged{k} WHERE (SELECT n FROM before{k}) < {budget})")
        ctes.append(f"before{k + 1} AS (SELECT n + (SELECT count(*) FROM rank{k}) AS n FROM before{k})")
        seen = " UNION ALL ".join(f"SELECT url FROM found{j}" for j in range(k + 1))
        ctes.append(f"found{k + 1} AS (SELECT dst AS url, min(r) AS parent FROM site JOIN rank{k} ON src = rank{k}.url WHERE dst NOT IN ({seen}) GROUP BY dst)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT * FROM level{k}" for k in range(depth + 1))


# The entities that the pages have.
_ENTITIES = {"&nbsp;": "chr(160)", "&#xE1;": "'á'", "&atilde;": "'ã'", "&ccedil;": "'ç'", "&#237;": "'í'", "&eacute;": "'é'", "&oacute;": "'ó'", "&otilde;": "'õ'", "&gt;": "'>'", "&lt;": "'<'", "&quot;": "chr(34)", "&copy;": "'©'", "&middot;": "'·'", "&amp;": "'&'"}
_DROPPED = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>"


def _plain(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({x}, '{_DROPPED}', '', 'g'), '<[^>]*>', chr(10), 'g')"
    for entity, char in _ENTITIES.items():
        bare = f"replace({bare}, '{entity}', {char})"
    lines = f"list_transform(regexp_split_to_array({bare}, '[\\n\\r\\x0b\\x0c]'), lambda l: {strip('l')})"
    return f"coalesce(array_to_string(list_filter({lines}, lambda l: l <> ''), chr(10)), '')"


_PAGES = ", ".join(f"({-k - 1}, {_quoted(u)}, {_quoted(h)})" for k, (u, h) in enumerate(PAGES))
_ALL_PAGES = f"p AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM (VALUES {_PAGES}) v(page_id, url, html))"


def _meta_date(name: str, value: str) -> str:
    element = f"regexp_extract(html, '(?i)(<meta\\b[^>]*?\\b{name}\\s*=\\s*\"{value}\"[^>]*>)', 1)"
    return f"nullif({strip(f'regexp_extract({element}, {_quoted(_CONTENT)}, 1)')}, '')"


_CONTENT = r'(?i)\bcontent\s*=\s*"([^"]*)"'
_LINK = r'(?i)(<link\b[^>]*?\brel="canonical"[^>]*>)'
_HREF_OF = r'(?i)\bhref="([^"]+)"'
_HREFS = f"regexp_extract(regexp_extract(html, {_quoted(_LINK)}, 1), {_quoted(_HREF_OF)}, 1)"

SQL: dict[str, str] = {
    "quality_gate": f"SELECT doc_id, {markers('text')} AS markers, {low_quality('text')} AS low FROM documents",
    "quality_gate_md": f"SELECT md_id, {low_quality(collapsed('body'))} AS low FROM md",
    "llm_useful": f"WITH u AS (SELECT doc_id, {useful('text')} AS useful FROM documents) SELECT doc_id, useful, doc_id % 3 < 2 AND (doc_id % 2 <> 0 OR useful) AS applied FROM u",
    "normalized_hash": f"SELECT doc_id, sha1({normal('text')}) AS content_hash, length({normal('text')})::INT AS chars FROM documents",
    "exact_dups": f"WITH h AS (SELECT doc_id, sha1({normal('text')}) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id, count(*) OVER (PARTITION BY h) AS copies FROM h QUALIFY copies > 1",
    "token_freq": f"WITH {_COUNTS} SELECT doc_id, token, w::BIGINT AS weight, rank FROM top WHERE rank <= 20",
    "simhash64": f"WITH {_COUNTS}, {_simhash('top')} SELECT doc_id, CASE WHEN h IS NULL THEN NULL ELSE lpad(lower(to_hex(h)), 16, '0') END AS simhash FROM documents LEFT JOIN hashed USING (doc_id)",
    "near_dup_pairs": f"WITH {_COUNTS}, {_simhash('top')}, d AS (SELECT DISTINCT h, lpad(lower(to_hex(h)), 16, '0') AS x FROM hashed) SELECT p.x AS a, q.x AS b, bit_count(xor(p.h, q.h))::INT AS distance FROM d p JOIN d q ON p.x < q.x AND bit_count(xor(p.h, q.h)) <= 3",
    "greedy_dedup": f"WITH RECURSIVE {_COUNTS}, {_simhash('top')}, {_greedy('hashed', 'doc_id')} SELECT id AS doc_id FROM walk WHERE id IS NOT NULL",
    "url_normalize": f"WITH {_URLS} SELECT url, {normal_url('url')} AS normal FROM urls",
    "url_parts": f"WITH {_URLS} SELECT url, {host('url')} AS host, {ext('url')} AS ext, {ext('url')} = '.pdf' AS pdf, {is_binary('url')} AS \"binary\" FROM urls",
    "url_scope": f"WITH {_URLS} SELECT url, {in_scope('url', repr('h.example'))} AS same, url <> '' AND NOT {is_binary('url')} AS \"any\", " + " OR ".join(f"contains(lower(url), '{t}')" for t in url.TRACKERS) + " AS blocked FROM urls",
    "output_names": f"SELECT page_id, {out_name('url', 'md')} AS name, {sanitize('coalesce(title, ' + repr('') + ')', 40)} AS title_name, {sanitize('coalesce(title, ' + repr('') + ')', 150, False)} AS menu_name FROM pages",
    "refined_names": f"SELECT md_id, {REF} AS out FROM md",
    "short_hashes": "SELECT item_id, substr(sha1(label), 1, 10) AS h10, substr(sha1(label), 1, 8) AS h8, sha1(label) AS h FROM menu_items",
    "page_links": f"WITH {_LINKS} SELECT page_id, link FROM links",
    "link_scope_counts": f"WITH {_LINKS} SELECT source, count(*) AS links, count(*) FILTER (WHERE {in_scope('link', 'source')}) AS inside, count(*) FILTER (WHERE {ext('link')} = '.pdf') AS pdfs FROM links GROUP BY source",
    "new_links": f"WITH {_LINKS} SELECT DISTINCT link AS url FROM links WHERE link NOT IN (SELECT {normal_url('url')} FROM pages WHERE url IS NOT NULL)",
    "page_heads": f"""WITH {_ALL_PAGES}, h AS (SELECT *, {_HREFS} AS href FROM p), r AS (SELECT *, {resolved('url', 'href')} AS absolute FROM h)
        SELECT page_id, {strip("regexp_extract(html, '(?i)<html\\b[^>]*?\\blang\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)")} AS lang, {strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
        coalesce({', '.join(_meta_date(*m) for m in (('property', 'article:modified_time'), ('name', 'last-modified'), ('name', 'modified'), ('itemprop', 'dateModified')))}, '') AS modified,
        CASE WHEN coalesce(href, '') = '' THEN url ELSE coalesce(nullif({normal_url('absolute')}, ''), url) END AS canonical FROM r""",
    "page_text": f"SELECT page_id, {_plain('html')} AS text FROM pages",
    "menu_scan": f"""WITH e AS (SELECT page_id, regexp_extract_all(html, '(?is)<h2\\b[^>]*>(.*?)</h2>', 1) AS l FROM pages), x AS (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM e)
        SELECT page_id, i::INT AS dom_index, {_plain('x')} AS label FROM x WHERE {_plain('x')} <> ''""",
    "panel_pdfs": f"""WITH m AS (SELECT item_id, url, html FROM menu_items UNION ALL SELECT -1, 'https://h.example/m/x', '<a href="d/Ato 1.PDF">a</a><a class=k href="/e.html">b</a><a href=''https://o.example/q.pdf?x=1&amp;y=2''>c</a>'),
        h AS (SELECT item_id, url, replace(unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)), '&amp;', '&') AS h FROM m), r AS (SELECT item_id, {resolved('url', 'h')} AS pdf_url FROM h)
        SELECT item_id, pdf_url, {sanitize(f"coalesce(nullif(regexp_extract({part('pdf_url', 3)}, '([^/]*)[.][^./]*$', 1), ''), 'documento')", 150, False)} || '__' || substr(sha1(pdf_url), 1, 10) || '.pdf' AS name FROM r WHERE {ext('pdf_url')} = '.pdf'""",
    "changed_panels": "SELECT item_id, coalesce(html, '') <> coalesce(lag(html) OVER (PARTITION BY url ORDER BY captured_at NULLS FIRST, item_id), '') AS changed FROM menu_items",
    "act_metadata": f"WITH src AS (SELECT md_id, coalesce(body, '') AS body FROM md), {_INFER.replace('{src}', 'src')} SELECT md_id, i_type AS act_type, i_number AS act_number, i_year AS act_year, i_date AS act_date, i_doen AS doe_number, i_status AS status, CASE WHEN i_type <> '' AND i_number <> '' THEN i_type || ' ' || i_number || CASE WHEN i_year <> '' THEN '/' || i_year ELSE '' END ELSE '' END AS aliases FROM inf",
    "act_dates": "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _DATES) + f") v(t) UNION ALL (SELECT DISTINCT coalesce(regexp_extract(body, '^([^\\n]*)', 1), '') FROM pdf_conversions)) SELECT t, {iso('t')} AS iso FROM t",
    "front_matter_split": f"WITH {_RAW} SELECT md_id, yaml, sha1({strip('rest')}) AS refiner_body, sha1(plain) AS reader_body FROM docs",
    "enrich_merge": f"WITH {_RAW}, {_META}, {_INFER.replace('{src}', 'metas')} SELECT md_id, " + ", ".join(f"CASE WHEN {has_key(k)} THEN {given(k)} ELSE {v} END AS {k}" for k, v in (("act_type", "i_type"), ("act_number", "i_number"), ("act_year", "i_year"), ("act_date", "i_date"))) + f", CASE WHEN {has_key('owner')} THEN {given('owner')} ELSE 'arquivo' END AS owner, {_DOE_TEXT} AS doe, {_CHANGED} AS changed FROM inf",
    "validate_rules": f"WITH {_VALID} SELECT md_id, act_type, act_number, act_year, act_date, heading_type, array_to_string(found, ';') AS issues, content_hash FROM val",
    "audit": f"WITH {_VALID}, {duplicates('val')} SELECT path, act_type, act_number, act_year, act_date, page AS publication_page, heading_type, array_to_string(issues, ';') AS issues, CASE WHEN len(issues) = 0 THEN 'TRUE' ELSE 'FALSE' END AS ok FROM dup",
    "audit_summary": f"WITH {_VALID}, {duplicates('val')}, e AS (SELECT unnest(CASE WHEN len(issues) = 0 THEN ['OK'] ELSE issues END) AS issue FROM dup) SELECT issue, count(*) AS documents FROM e GROUP BY issue",
    "audit_counts": f"WITH {_VALID}, {duplicates('val')} SELECT count(*) AS documents, count(*) FILTER (WHERE len(issues) = 0) AS valid, count(*) FILTER (WHERE len(issues) > 0) AS invalid, bool_or(len(issues) > 0) AS failed FROM dup",
    "audit_results": f"WITH v AS (SELECT * RENAME (issues AS found) FROM validation_results), {duplicates('v')} SELECT result_id, array_to_string(issues, ';') AS issues FROM dup",
    "audit_report": f"""WITH {_VALID}, {duplicates('val')}, e AS (SELECT unnest(CASE WHEN len(issues) = 0 THEN ['OK'] ELSE issues END) AS issue FROM dup),
        fixed AS (SELECT * FROM (VALUES {', '.join(f"({n}, {_quoted(x)})" for n, part in ((1, [*REPORT_HEAD, "Raiz analisada: `dados`", *REPORT_SUMMARY]), (3, REPORT_TAIL)) for x in part)}) v(section, line))
        SELECT section::INT AS section, line FROM fixed UNION ALL SELECT 2, '- **' || issue || '**: ' || count(*) FROM e GROUP BY issue
        UNION ALL SELECT 4, '- `' || path || '` → ' || array_to_string(issues, ', ') FROM dup WHERE len(issues) > 0""",
    "chunk_text": f"""WITH RECURSIVE d AS (SELECT doc_id, {strip('text')} AS t FROM documents), w AS (
        SELECT doc_id, t, -1 AS chunk_no, 0 AS a, 0 AS b FROM d UNION ALL
        SELECT doc_id, t, chunk_no + 1, b, CASE WHEN length(t) <= 5000 THEN greatest(length(t), 1) WHEN strpos(reverse(substr(t, b + 1, 5000)), chr(10) || chr(10)) > 0
            AND length(substr(t, b + 1, 5000)) - strpos(reverse(substr(t, b + 1, 5000)), chr(10) || chr(10)) - 1 >= 3000
          THEN b + length(substr(t, b + 1, 5000)) - strpos(reverse(substr(t, b + 1, 5000)), chr(10) || chr(10)) + 1 ELSE least(b + 5000, length(t)) END
        FROM w WHERE b < length(t) OR chunk_no < 0)
        SELECT doc_id, chunk_no, length(substr(t, a + 1, b - a))::INT AS chars, sha1(substr(t, a + 1, b - a)) AS h FROM w WHERE chunk_no >= 0""",
    "strip_wrappers": f"WITH m AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN {_NOTE} || coalesce(html, '') WHEN 1 THEN '```md' || chr(10) || coalesce(html, '') || chr(10) || '```' ELSE coalesce(html, '') END AS x FROM menu_items) SELECT item_id, sha1({_wrapped('x')}) AS h FROM m",
    "pdf_bodies": f"WITH b AS (SELECT source_pdf AS path, {_pdf('body')} AS b FROM pdf_conversions) SELECT path AS source_pdf, CASE WHEN b <> '' THEN {_STEM} || '__' || substr(sha1(b), 1, 10) || '.md' ELSE '' END AS out, sha1(b) AS h, b = '' AS failed FROM b",
    "refine_pipeline": f"WITH RECURSIVE {_REFINE} SELECT * FROM refined",
    "refine_by_model": f"""WITH RECURSIVE {_REFINE}, u AS (SELECT md_id, outcome, text, outcome = 'ok' AND {useful('text')} AS used, contains(substr({strip('text')}, 1, 40), '7') AS fails FROM outc)
        SELECT md_id, CASE WHEN used AND fails THEN 'error' ELSE outcome END AS outcome, used AND NOT fails AS llm_applied, CASE WHEN used AND NOT fails THEN 'google' ELSE '' END AS provider,
        CASE WHEN used AND NOT fails THEN 'm-1' ELSE '' END AS model, sha1(CASE WHEN outcome <> 'ok' OR used AND fails THEN '' WHEN used THEN upper({strip('text')}) ELSE text END) AS h FROM u""",
    "refine_events": f"WITH RECURSIVE {_REFINE} SELECT outcome AS event, path AS file, out AS output, reason, CASE WHEN outcome = 'ok' THEN simhash64_hex ELSE '' END AS simhash64_hex, CASE WHEN outcome = 'ok' THEN 'false' ELSE '' END AS llm_applied FROM refined",
    "refined_documents": f"""WITH RECURSIVE {_RAW}, {_META}, {_REFINE} SELECT out AS name, {given('source_url')} AS source_url, {given('act_year')} AS act_year, 'local' AS refined_by, '' AS refined_model, content_hash, sha1(text) AS h
        FROM refined JOIN metas USING (md_id) JOIN (SELECT md_id, text FROM outc) t USING (md_id) WHERE outcome = 'ok'""",
    "enriched_documents": f"WITH {_RAW}, {_META}, {_INFER.replace('{src}', 'metas')} SELECT path AS name, "
    + ", ".join(f"CASE WHEN {has_key(k)} THEN {given(k)} ELSE {v} END AS {k}" for k, v in (("act_type", "i_type"), ("act_number", "i_number"), ("act_year", "i_year"), ("act_date", "i_date"), ("source", "'acervo'")))
    + f", sha1({strip('body')}) AS h FROM inf WHERE {_CHANGED_SOURCE}",
    "pdf_documents": f"WITH b AS (SELECT source_pdf AS path, {_pdf('body')} AS body FROM pdf_conversions), {_INFER.replace('{src}', 'b')} SELECT {_STEM} || '__' || substr(sha1(body), 1, 10) || '.md' AS name, path AS source_pdf, i_type AS act_type, i_number AS act_number, sha1(body) AS h FROM inf WHERE body <> ''",
    "refine_counters": f"WITH RECURSIVE {_REFINE} SELECT count(*) AS input_files, count(*) FILTER (WHERE outcome = 'ok') AS refined_files, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'error') AS failed_files FROM refined",
    "manifest_append": f"WITH RECURSIVE {_REFINE}, r AS (SELECT path AS \"in\", 'data/1_markdowns_limpos/' || out AS out, simhash64_hex FROM refined WHERE outcome = 'ok') SELECT * FROM r WHERE out NOT IN (SELECT out FROM manifest WHERE out IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY out ORDER BY \"in\") = 1",
    "manifest_anti_join": f"SELECT out FROM (SELECT 'data/1_markdowns_limpos/' || {REF} AS out FROM md) WHERE out NOT IN (SELECT out FROM manifest WHERE out <> '')",
    "manifest_rebuild": f"""WITH {_RAW}, {_META}, f AS (SELECT md_id, regexp_extract(path, '([^/]*)\\.md$', 1) AS stem, path, kv, {strip('body')} AS text FROM metas),
        tok AS (SELECT md_id, unnest(regexp_extract_all({normal('text')}, '{text.TOKEN}')) AS token FROM f), top AS (SELECT md_id, token, least(count(*), 255) AS w FROM tok GROUP BY ALL), {_simhash('top', 'md_id')},
        o AS (SELECT stem, min(path) AS original FROM f GROUP BY stem), named AS (SELECT *, lower(trim({given('refined_by')})) AS who FROM f)
        SELECT coalesce(nullif({given('source_in')}, ''), original, '') AS "in", 'data/1_markdowns_limpos/' || stem || '__REF.md' AS out, CASE WHEN h IS NULL THEN '0xffffffffffffffff' ELSE '0x' || lower(to_hex(h)) END AS simhash64_hex,
        who IN ('gemini', 'ollama') AS llm_applied, CASE who WHEN 'gemini' THEN 'google' WHEN 'ollama' THEN 'ollama' ELSE '' END AS provider
        FROM named LEFT JOIN o USING (stem) LEFT JOIN hashed USING (md_id)""",
    "bfs_crawl": _bfs(3, 4),
    "crawl_counters": "SELECT " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {n}_urls" for o, n in (("visited", "visited"), ("pdf", "pdf"), ("missing", "failed"), ("blocked", "blocked"))) + f" FROM ({_bfs(3, 4)}) AS b",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_gate": f"SELECT doc_id FROM documents WHERE NOT {low_quality('text')}",
}
