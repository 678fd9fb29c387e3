"""Column functions on texts: normalizing, quality, front matter, wrappers, PDF bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MIN_CONTENT_CHARS = 500
TEXT_LIMIT = 200_000
LOW_QUALITY_MARKERS = ("resultados da busca", "sem resultados", "pesquisar", "buscar", "posts recentes", "arquivos do mês")
TOKEN = "[0-9A-Za-zÀ-ÖØ-öø-ÿ_]+"
# What a model puts around its answer.
ANNOUNCEMENT = r"here\s+is\s+the\s+rewritten\s+text\s+in\s+markdown\s+format:?:?"
FENCE = r"```(?:markdown|md)?\s*(.*?)\s*```"
#: White space as Python has it.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Line ends as Python's splitlines has them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_text(x: Column) -> Column:
    """White space collapsed, trimmed, lower case, the first 200,000 characters."""
    return F.substring(F.lower(F.trim(F.regexp_replace(x, f"{SPACE}+", " "))), 1, TEXT_LIMIT)


def content_hash(x: Column) -> Column:
    return F.sha1(normalize_text(x))


def tokens(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(f"({TOKEN})"), F.lit(1))


def marker_count(x: Column) -> Column:
    low = F.lower(x)
    return sum((low.contains(m).cast("int") for m in LOW_QUALITY_MARKERS), F.lit(0))


def is_low_quality(x: Column) -> Column:
    """Shorter than 500 characters, or two navigation markers or more; a NULL text is of low quality."""
    return F.coalesce((F.length(x) < MIN_CONTENT_CHARS) | (marker_count(x) >= 2), F.lit(True))


def llm_is_useful(x: Column) -> Column:
    """From 1,200 characters on, if more than 12 % are digits or four lines have more than 180 characters."""
    digits = F.length(x) - F.length(F.regexp_replace(x, r"[0-9]", ""))
    long_lines = F.size(F.filter(F.split(x, LINE_END), lambda line: F.length(line) > 180))
    return F.coalesce((F.length(x) >= 1200) & ((digits / F.length(x) > 0.12) | (long_lines >= 4)), F.lit(False))


def should_apply_llm(provider: Column, heuristic: Column, body: Column) -> Column:
    """Remote and local models run where useful, or always without the heuristic; other providers never."""
    return F.when(provider.isin("google", "ollama"), ~heuristic | llm_is_useful(body)).otherwise(False)


def collapse_newlines(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def _parts(raw: Column) -> Column:
    return F.split(raw, "---", 3)


def has_front_matter(raw: Column) -> Column:
    return F.coalesce(raw.startswith("---") & (F.size(_parts(raw)) == 3), F.lit(False))


def front_matter(raw: Column) -> Column:
    """The YAML between the first two fences, '' without them."""
    return F.when(has_front_matter(raw), F.element_at(_parts(raw), 2)).otherwise("")


def front_matter_body(raw: Column, trim: bool = True) -> Column:
    """The text after the front matter: stripped as the refiner does, or only without leading line ends."""
    after = F.element_at(_parts(raw), 3)
    if trim:
        return F.when(has_front_matter(raw), strip(after)).otherwise(strip(raw))
    return F.when(has_front_matter(raw), F.regexp_replace(after, r"^\n+", "")).otherwise(raw)


def simple_yaml(yaml: Column) -> Column:
    """The ``key: value`` lines of a YAML text as a MAP, values without quotes; a repeated key's last value holds.

    For nested or typed YAML use :func:`lavra.functions.yaml_map.read_yaml`.
    """
    lines = F.filter(F.split(yaml, r"\n"), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*:( |$)"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.regexp_extract(x, r"^([A-Za-z_][A-Za-z0-9_]*):", 1).alias("key"),
            F.regexp_replace(F.trim(F.regexp_extract(x, r"^[A-Za-z_][A-Za-z0-9_]*:(.*)$", 1)), "^['\"]|['\"]$", "").alias("value"),
        ),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def merge_metadata(meta: Column, inferred: Column) -> Column:
    """``meta`` with the keys of ``inferred`` that it lacks; an existing key wins even if its value is NULL."""
    return F.map_concat(meta, F.map_filter(inferred, lambda k, v: ~F.map_contains_key(meta, k) & v.isNotNull()))


def strip_model_wrappers(x: Column) -> Column:
    """Without a leading announcement line and a fence around all of the text."""
    first = strip(F.regexp_extract(x, r"^([^\n]*)", 1))
    announced = first.rlike(f"(?i)^{ANNOUNCEMENT}$")
    rest = strip(F.when(announced, F.regexp_replace(x, r"^[^\n]*\n?", "")).otherwise(x))
    inner = F.regexp_extract(rest, f"(?s)^{FENCE}$", 1)
    return F.when(rest.rlike(f"(?s)^{FENCE}$"), strip(inner)).otherwise(rest)


def pdf_body(x: Column) -> Column:
    """The first line that isn't blank as a title, the rest below; '' without text."""
    text = F.regexp_replace(x, rf"^({SPACE}*\n)+", "")
    title = strip(F.regexp_extract(text, r"^([^\n]*)", 1))
    rest = strip(F.regexp_replace(text, r"^[^\n]*\n?", ""))
    return F.when(F.coalesce(strip(x), F.lit("")) == "", "").otherwise(strip(F.concat(F.lit("# "), title, F.lit("\n\n"), rest)))


def yaml_front_matter(entries: list[tuple[str, Column]], lists: list[tuple[str, Column]] = ()) -> Column:
    """Quoted scalars, then lists, between fences."""

    def quoted(x: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    rows = [F.concat(F.lit(f"{k}: "), quoted(v)) for k, v in entries]
    rows += [F.concat(F.lit(f"{k}:"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("\n  - "), quoted(x))), "")) for k, v in lists]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n"))
