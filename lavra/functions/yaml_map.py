"""YAML front matter as a MAP, and written again, through PyYAML where it is installed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.functions.text import front_matter, front_matter_body, has_front_matter, strip

_DOCUMENT = T.StructType([T.StructField("mapping", T.BooleanType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])


def _load(text: str | None):
    """The value of a YAML text; malformed and empty ones give an empty mapping."""
    import yaml

    try:
        # The C loader is several times as fast, where PyYAML has it.
        return (yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) if text else None) or {}
    except (yaml.YAMLError, ValueError):  # a date such as 2020-02-31 is a ValueError
        return {}


def _text(value) -> str | None:
    if value is None:
        return None
    return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, dict | list) else str(value)


@F.pandas_udf(_DOCUMENT)
def _read(texts: pd.Series) -> pd.DataFrame:
    values = [_load(t) for t in texts]
    mapping = [isinstance(v, dict) for v in values]
    return pd.DataFrame({"mapping": mapping, "meta": [{str(k): _text(x) for k, x in v.items()} if m else {} for v, m in zip(values, mapping, strict=True)]})


def read_yaml(text: Column) -> Column:
    """Keys and values as strings, mappings and lists among the values as JSON; malformed YAML, other than mappings and NULL give an
    empty MAP."""
    return _read(text)["meta"]


def read_document(raw: Column, trim: bool = True) -> Column:
    """STRUCT<meta, body> of a text with front matter: malformed YAML gives no metadata, and YAML that is no mapping makes all of the
    text the body. ``trim``: the body stripped, as the refiner has it, or only without leading line ends."""
    read = _read(front_matter(raw))
    whole = strip(raw) if trim else raw
    body = F.when(has_front_matter(raw) & read["mapping"], front_matter_body(raw, trim)).otherwise(whole)
    return F.struct(read["meta"].alias("meta"), body.alias("body"))


def mapping_of(meta: Column, key: str) -> Column:
    """The mapping that a MAP of :func:`read_yaml` has at ``key``; an empty one where the value is anything else."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    value = F.element_at(meta, key)
    return F.coalesce(F.when(value.startswith("{"), F.from_json(value, T.MapType(T.StringType(), T.StringType()))), none)


def with_metadata(yaml_text: Column, updates: Column, override: bool, only_changed: bool = False) -> Column:
    """Front matter with fences: the mapping of ``yaml_text`` with the keys of ``updates`` (a JSON object), which win if
    ``override``, and else only fill in keys that are missing. Keys keep their order and values their types. ``only_changed``: NULL where
    the mapping stays as it is."""

    @F.pandas_udf(T.StringType())
    def dump(texts: pd.Series, more: pd.Series) -> pd.Series:
        import yaml

        def one(text: str | None, new: str | None) -> str | None:
            old = _load(text)
            old = old if isinstance(old, dict) else {}
            given = json.loads(new) if new else {}
            made = old | given if override else old | {k: v for k, v in given.items() if k not in old}
            if only_changed and made == old:
                return None
            return f"---\n{yaml.dump(made, Dumper=getattr(yaml, 'CSafeDumper', yaml.SafeDumper), sort_keys=False, allow_unicode=True).strip()}\n---\n"

        return pd.Series([one(t, n) for t, n in zip(texts, more, strict=True)])

    return dump(yaml_text, updates)
