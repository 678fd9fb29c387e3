"""Column functions that read the metadata of normative acts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lavra.functions.text import SPACE, strip

# Fixed values.
MONTHS = {"janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12}
ACT_TYPES = {"Resolução": "resolu[cç][aã]o", "Portaria": "portaria", "Ato": "ato", "Deliberação": "delibera[cç][aã]o", "Instrução": "instru[cç][aã]o", "Comunicado": "comunicado"}
_LONG = r"(?iuU)(\d{1,2})\s+de\s+([A-Za-zçãáéíóúôê]+)\s+de\s+(\d{4})"
_SHORT = r"(?U)(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
_NUMBER = r"(?iuU)(?:n[ºo]\s*|no\.\s*|n\.\s*)(\d{1,5})(?:[/\-](\d{4}))?"
_GAZETTE = r"(?iuU)Pub\.\s*DOE\s*n[ºo]?\s*([A-Za-z0-9\-]+)\s*,\s*de\s*(\d{1,2}/\d{1,2}/\d{4})\s*,\s*p\.\s*(\d+)"


def portuguese_date(x: Column) -> Column:
    """ISO date of the first long date, or else of the first short one; '' if there is none or it doesn't exist."""
    months = F.create_map(*[F.lit(v) for kv in MONTHS.items() for v in kv])
    month = F.coalesce(months[F.lower(F.regexp_extract(x, _LONG, 2))], F.lit(0))

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.date_format(F.try_to_date(F.concat_ws("-", y, m.cast("string"), d), "y-M-d"), "yyyy-MM-dd")

    long_date = date(F.regexp_extract(x, _LONG, 3), month, F.regexp_extract(x, _LONG, 1))
    short = date(F.regexp_extract(x, _SHORT, 3), F.regexp_extract(x, _SHORT, 2), F.regexp_extract(x, _SHORT, 1))
    return F.coalesce(F.when(x.rlike(_LONG), long_date).when(x.rlike(_SHORT), short), F.lit(""))


def first_heading(x: Column) -> Column:
    """The text of the first H1 line, ''."""
    return F.coalesce(strip(F.regexp_extract(x, rf"(?m)^{SPACE}*#{SPACE}+(.+?){SPACE}*$", 1)), F.lit(""))


def first_line(x: Column) -> Column:
    """The first line that isn't blank, ''."""
    return F.coalesce(strip(F.regexp_extract(x, rf"({SPACE}*[^\n]*)", 1)), F.lit(""))


def heading(x: Column) -> Column:
    return F.coalesce(F.nullif(first_heading(x), F.lit("")), first_line(x))


def act_type(x: Column) -> Column:
    """The first type, in fixed order, that stands in ``x`` as a word; ''."""
    found = F.lit("")
    for name, pattern in reversed(ACT_TYPES.items()):
        found = F.when(x.rlike(rf"(?iuU)\b{pattern}\b"), F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(""))


def act_number(x: Column) -> Column:
    """Up to five digits after 'nº', without leading zeros; ''."""
    return F.coalesce(F.nullif(F.regexp_extract(x, _NUMBER, 1), F.lit("")).cast("int").cast("string"), F.lit(""))


def act_year(x: Column) -> Column:
    return F.coalesce(F.regexp_extract(x, _NUMBER, 2), F.lit(""))


def gazette(x: Column) -> Column:
    """(numero, data, pagina) of the publication in the official gazette, NULL without one."""
    return F.when(
        x.rlike(_GAZETTE),
        F.struct(*[F.regexp_extract(x, _GAZETTE, k + 1).alias(n) for k, n in enumerate(("numero", "data", "pagina"))]),
    )


def act_status(x: Column) -> Column:
    return F.coalesce(F.when(x.rlike(r"(?iuU)\brevogad[ao]s?\b"), "Revogada").when(x.rlike(r"(?iuU)\bvigent[ea]\b"), "Vigente"), F.lit(""))


def act_alias(kind: Column, number: Column, year: Column) -> Column:
    """'Tipo N/Y' where type and number are known; ''."""
    name = F.concat(kind, F.lit(" "), number, F.when(year != "", F.concat(F.lit("/"), year)).otherwise(""))
    return F.when((kind != "") & (number != ""), name).otherwise("")


def legal_metadata(body: Column) -> Column:
    """All of it as a STRUCT with '' for what is missing, and aliases as an ARRAY."""

    def of(h: Column, kind: Column, number: Column, year: Column) -> Column:
        alias = act_alias(kind, number, year)
        return F.struct(
            kind.alias("act_type"), number.alias("act_number"), year.alias("act_year"), portuguese_date(h).alias("act_date"),
            gazette(body).alias("doe"), act_status(body).alias("status"),
            F.when(alias != "", F.array(alias)).otherwise(F.array().cast("array<string>")).alias("aliases"),
        )

    # The lambda's variables hold the heading and its parts, which else would be read again for every use.
    parts = F.transform(F.array(heading(body)), lambda h: F.struct(h.alias("h"), act_type(h).alias("t"), act_number(h).alias("n"), act_year(h).alias("y")))
    return F.transform(parts, lambda p: of(p["h"], p["t"], p["n"], p["y"]))[0]
