"""Column functions on URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ALLOWED_PARAMS = ("id", "page", "lang")
BINARY_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp", ".zip", ".rar", ".7z", ".tar", ".gz", ".mp4", ".mp3", ".ogg", ".wav", ".webm",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
)
TRACKERS = ("google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.net", "hotjar.com", "segment.io", "newrelic", "nr-data.net", "matomo", "cloudflareinsights.com")
BLOCKED_TYPES = ("image", "media", "font")
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 4 query, 5 fragment; '' if missing."""
    return F.regexp_extract(url, _URL, n)


def host(url: Column) -> Column:
    """The host in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def decoded(value: Column) -> Column:
    """A part of a query without its escapes; a % that begins no escape stands for itself."""
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def encoded(value: Column) -> Column:
    """Escaped for a query: letters, digits and ``_.-~`` as they are, a blank as ``+``."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """'' for what is no http(s) URL; lower-case host, clean path, allowed parameters and hash routes kept."""
    raw_path = F.regexp_replace(F.regexp_replace(part(url, 3), r";[^/;]*$", ""), "/{2,}", "/")
    path = F.when(raw_path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(raw_path, "/+$", ""))
    pairs = F.transform(
        F.split(part(url, 4), "&"), lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)=.", 1)).alias("n"), decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))
    )
    params = F.filter(pairs, lambda p: p["n"].isin(*ALLOWED_PARAMS))
    query = F.array_join(F.transform(params, lambda p: F.concat(p["n"], F.lit("="), encoded(p["v"]))), "&")
    route = F.regexp_replace(F.regexp_replace(part(url, 5), "/{2,}", "/"), "/+$", "")
    fragment = F.when(part(url, 5).rlike("^!?/"), route).otherwise("")
    good = F.lower(part(url, 1)).isin("http", "https") & (part(url, 2) != "")
    made = F.concat(
        F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.coalesce(F.when(good, made), F.lit(""))


def _no_dots(url: Column) -> Column:
    """Without the segments ``.`` and ``..`` of the path."""

    def step(done: Column, x: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
        return F.when(x == ".", done).when(x == "..", up).otherwise(F.concat(done, F.array(x)))

    segments = F.split(part(url, 3), "/")
    path = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    head, tail = F.regexp_extract(url, "^([^:]*://[^/?#]*)", 1), F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    return F.when(part(url, 3).rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(head, path, tail)).otherwise(url)


def resolve(base: Column, link: Column) -> Column:
    """An absolute link; relative ones against the base, without dot segments."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")
    clean = F.trim(link)
    return (
        F.when(clean.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), clean)
        .when(clean.startswith("//"), F.concat(part(base, 1), F.lit(":"), clean))
        .when(clean.startswith("/"), _no_dots(F.concat(root, clean)))
        .when(clean.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), clean))
        .when(clean.startswith("?"), F.concat(root, part(base, 3), clean))
        .otherwise(_no_dots(F.concat(root, folder, clean)))
    )


def extension(url: Column) -> Column:
    """The lower-case suffix of the path's last part, '' without one."""
    name = F.regexp_extract(part(url, 3), "([^/]*)/*$", 1)
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1))


def is_pdf(url: Column) -> Column:
    return extension(url) == ".pdf"


def is_other_binary(url: Column) -> Column:
    return extension(url).isin(*BINARY_EXTENSIONS)


def same_domain(url: Column, base: Column) -> Column:
    """The host itself or one below it."""
    return (host(url) == base) | F.endswith(host(url), F.concat(F.lit("."), base))


def in_scope(url: Column, base: Column, same_only: bool = True) -> Column:
    ok = (url != "") & ~is_other_binary(url)
    return F.coalesce(ok & same_domain(url, base) if same_only else ok, F.lit(False))


def blocked_request(kind: Column, url: Column) -> Column:
    """Heavy resources and trackers."""
    low = F.lower(url)
    tracked = F.lit(False)
    for t in TRACKERS:
        tracked = tracked | low.contains(t)
    return kind.isin(*BLOCKED_TYPES) | tracked


def sanitize(name: Column, most: int = 200, collapse: bool = True) -> Column:
    """A portable file name; 'documento' if nothing is left."""
    out = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    out = F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", "_")
    if collapse:
        out = F.regexp_replace(out, "_+", "_")
    out = F.regexp_replace(out, "^[._]+|[._]+$", "")
    out = F.regexp_replace(F.substring(out, 1, most), "[._]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("documento"))


def output_filename(url: Column, ext: str) -> Column:
    """Stable: host, path and hash route, and eight digits of the URL's SHA-1; at most 240 characters."""
    server = sanitize(F.replace(part(url, 2), F.lit(":"), F.lit("_")), 80)
    inner = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    path = F.replace(F.when(inner == "", "index").otherwise(inner), F.lit("/"), F.lit("_"))
    route = F.regexp_replace(F.replace(part(url, 5), F.lit("!/"), F.lit("")), "^/+", "")
    frag = F.when(route != "", F.concat(F.lit("__FRAG_"), F.replace(route, F.lit("/"), F.lit("_")))).otherwise("")
    name = sanitize(F.concat(server, F.lit("_"), path, frag), 200)
    suffix = F.concat(F.lit("__"), F.substring(F.sha1(url), 1, 8), F.lit(f".{ext}"))
    return F.concat(F.regexp_replace(F.substring(name, 1, 240 - 11 - len(ext)), "[._]+$", ""), suffix)


def refined_name(path: Column, raw_dir: str = "data/0_extracao_bruta") -> Column:
    """The refined file of an input: its stem, a hash of its folder below the raw one, and ``__REF.md``."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    folder = F.regexp_replace(F.regexp_extract(path, "^(.*)/[^/]*$", 1), f"^{raw_dir}/?", "")
    digest = F.when(folder != "", F.concat(F.lit("__"), F.substring(F.sha1(folder), 1, 8))).otherwise("")
    return F.concat(stem, digest, F.lit("__REF.md"))
