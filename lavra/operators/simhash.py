"""64-bit SimHash over weighted terms, near-duplicate pairs and the greedy choice among near duplicates."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.text import TEXT_LIMIT, TOKEN
from lavra.session import Scratch, spread

# Fixed values.
MAX_FEATURES, MAX_WEIGHT, MAX_DISTANCE = 20_000, 255, 3
_TOKEN = re.compile(TOKEN)
_CACHE = 200_000


def _counts(text: str) -> list[tuple[str, int]]:
    """The most frequent tokens of a text; of equally frequent ones those that came first."""
    normal = re.sub(r"\s+", " ", text).strip().lower()[:TEXT_LIMIT]
    return Counter(_TOKEN.findall(normal)).most_common(MAX_FEATURES)


def term_frequencies(docs: DataFrame, key: str, text: str, top: int = MAX_FEATURES) -> DataFrame:
    """(key, token, weight, rank): the most frequent tokens of each document, frequencies up to 255, ties by first place.

    A document is counted where it is, so nothing is shuffled. NULL texts have no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, t, min(n, MAX_WEIGHT), r) for k, x in zip(batch["k"], batch["t"], strict=True) if x for r, (t, n) in enumerate(_counts(x)[:top], 1)]
            yield pd.DataFrame(rows, columns=["k", "token", "weight", "rank"])

    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(run, f"k {kind}, token STRING, weight INT, rank INT")
    return rows.withColumnRenamed("k", key)


class TokenSigns:
    """The bits of tokens' hashes as +1 and -1, one row a token; starts anew when it has too many."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.signs = np.zeros((1024, 64), dtype=np.int8)

    def rows(self, found: list[str]) -> np.ndarray:
        if len(self.row) > _CACHE:
            self.__init__()
        at = []
        for token in found:
            k = self.row.get(token)
            if k is None:
                k = self.row[token] = len(self.row)
                if k == len(self.signs):
                    self.signs = np.concatenate([self.signs, np.zeros_like(self.signs)])
                digest = hashlib.sha1(token.encode("utf-8", "surrogatepass")).digest()[:8]
                self.signs[k] = np.unpackbits(np.frombuffer(digest, dtype=np.uint8)).astype(np.int8) * 2 - 1
            at.append(k)
        return self.signs[at]


def simhash_bits(text: str, signs: TokenSigns) -> int | None:
    """The SimHash of one text, NULL without tokens."""
    most = _counts(text)
    if not most:
        return None
    weights = np.minimum(np.array([n for _, n in most], dtype=np.float64), MAX_WEIGHT)
    votes = weights @ signs.rows([t for t, _ in most])
    return int.from_bytes(np.packbits(votes >= 0).tobytes(), "big")


def simhashes(docs: DataFrame, key: str, text: str, empty_is_ones: bool = False) -> DataFrame:
    """(key, simhash): 16 hex digits. Texts without tokens have NULL, or all ones as a rebuilt manifest has."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = TokenSigns()
        none = "f" * 16 if empty_is_ones else None
        for batch in batches:
            found = (simhash_bits(t, signs) if t else None for t in batch["t"])
            yield pd.DataFrame({"k": batch["k"], "simhash": [none if v is None else f"{v:016x}" for v in found]})

    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(run, f"k {kind}, simhash STRING")
    return rows.withColumnRenamed("k", key)


def bits_of(simhash: Column) -> Column:
    """16 hex digits as BIGINT."""
    hi, lo = F.conv(F.substring(simhash, 1, 8), 16, 10).cast("bigint"), F.conv(F.substring(simhash, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two BIGINT hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def block_keys(bits: Column, distance: int = MAX_DISTANCE, blocks: int = 6) -> tuple[Column, list[int]]:
    """An ARRAY of keys of a hash, one for each choice of ``blocks - distance`` of its blocks, and the choices' bit masks.

    Two hashes within ``distance`` bits agree in as many blocks at least, so in some key. With six blocks keys have 32 bits: hashes
    that differ at random share one by a chance of one in four billion, so candidates stay few beyond a billion hashes.
    """
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys, masks = [], []
    for chosen in itertools.combinations(range(blocks), blocks - distance):
        key, mask = F.lit(0).cast("bigint"), 0
        for k in chosen:
            width = cuts[k + 1] - cuts[k]
            part = F.shiftrightunsigned(bits, 64 - cuts[k + 1]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
            mask |= ((1 << width) - 1) << (64 - cuts[k + 1])
        keys.append(key)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.array(*keys), masks


def near_candidates(hashes: DataFrame, bits: str = "bits", distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) for distinct hashes a < b with a key of :func:`block_keys` in common, each pair once: in the first key that they share.

    Where many hashes share a key, AQE's skew join splits its rows."""
    keys, masks = block_keys(F.col(bits), distance)
    rows = hashes.select(bits).distinct().select(F.col(bits).alias("x"), F.posexplode(keys).alias("choice", "key"))
    two = rows.alias("p").join(rows.alias("q"), ["choice", "key"]).where(F.col("p.x") < F.col("q.x"))
    apart = F.col("p.x").bitwiseXOR(F.col("q.x"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("bigint")) == 0, F.lit(k)) for k, m in enumerate(masks)])
    return two.where(first == F.col("choice")).select(F.col("p.x").alias("a"), F.col("q.x").alias("b"))


def near_pairs(hashes: DataFrame, bits: str = "bits", distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b, distance) for distinct hashes a < b within ``distance`` bits. Equal hashes are one row before and make no pairs."""
    apart = hamming(F.col("a"), F.col("b"))
    return near_candidates(hashes, bits, distance).where(apart <= distance).select("a", "b", apart.alias("distance"))


def greedy_kept(hashes: DataFrame, key: str, distance: int = MAX_DISTANCE) -> DataFrame:
    """(key): in the order of ``key``, each row without an earlier kept row within ``distance`` bits.

    ``hashes`` has (key BIGINT, bits BIGINT). Of equal hashes only the first can be kept; the rest is the
    lexicographically first independent set: in rounds, rows without an undecided earlier neighbour are kept and their
    neighbours dropped. Rounds are as many as the longest chain of decisions, each of a few shuffles of what is open.
    """
    scratch = Scratch(hashes.sparkSession, "greedy")
    first = scratch.write(hashes.where("bits IS NOT NULL").groupBy("bits").agg(F.min(key).alias("id")), "first")
    pairs = near_pairs(first, "bits", distance)
    ids_a, ids_b = first.select(F.col("bits").alias("a"), F.col("id").alias("ia")), first.select(F.col("bits").alias("b"), F.col("id").alias("ib"))
    edges = pairs.join(ids_a, "a").join(ids_b, "b").select(F.least("ia", "ib").alias("early"), F.greatest("ia", "ib").alias("late"))
    edges = scratch.write(edges, "edges0")
    kept = first.select("id").join(edges.select(F.col("late").alias("id")), "id", "left_anti")
    k = 0
    kept = scratch.write(kept, "kept0")
    now, open_ = kept, edges
    while True:
        k += 1
        gone = scratch.write(open_.join(now.select(F.col("id").alias("early")), "early", "left_semi").select(F.col("late").alias("id")).distinct(), f"gone{k}")
        rest = open_.join(gone.select(F.col("id").alias("early")), "early", "left_anti").join(gone.select(F.col("id").alias("late")), "late", "left_anti")
        later = open_.select(F.col("late").alias("id")).distinct().join(gone, "id", "left_anti")
        rest = scratch.write(rest.select("early", "late"), f"edges{k}")
        now = scratch.write(later.join(rest.select(F.col("late").alias("id")).distinct(), "id", "left_anti"), f"kept{k}")
        kept = kept.union(now)
        scratch.drop(f"edges{k - 1}")
        scratch.drop(f"gone{k}")
        if rest.limit(1).count() == 0:
            break
        open_ = rest
    return kept.select(F.col("id").alias(key))
