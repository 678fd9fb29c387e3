"""Texts cut into chunks at paragraph ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
CHUNK_CHARS, EARLIEST = 5_000, 0.6


def cut(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """The stripped text in pieces of at most ``size`` characters; a piece ends at its last blank line if that is at 60 % or later."""
    rest, out = text.strip(), []
    if len(rest) <= size:
        return [rest]
    at = 0
    while at < len(rest):
        end = min(at + size, len(rest))
        blank = rest.rfind("\n\n", at, end)
        if blank >= at + int(size * EARLIEST):
            end = blank + 2
        out.append(rest[at:end])
        at = end
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: cut(t or ""))


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_no, chunk): every document's pieces from 0; an empty or NULL text is one empty piece."""
    return docs.select(key, F.posexplode(_chunks(text)).alias("chunk_no", "chunk"))
