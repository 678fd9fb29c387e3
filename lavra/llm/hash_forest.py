"""Problem 5: new batches against all history, with a prefix-tree hash forest.

The forest keeps the accepted signatures in several permutations, as runs sorted by (permutation, permuted signature), so that
what lies below a node of a prefix tree is one range of a run. A run's files have fence keys, and their row groups
statistics: a search opens only the row groups that its ranges touch. It starts at full depth (equal signatures) and widens
the prefix of what is still undecided, up to the depth at which the recall target is met; for recall 1 that is the depth of
the pigeonhole principle. What it finds is verified. Accepted entries are appended as a run; four runs of like size are
merged into one. Paths are one more permutation, searched at full depth only.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.session import Scratch

#: So many runs of like size (powers of this number) are merged into one.
TIER = 4
#: About so many rows are in a file of a run, and so many bytes in one of its row groups.
FILE_ROWS, GROUP_BYTES = 2_000_000, 1 << 17
#: About so many rows of queries are searched for in one task.
QUERY_ROWS = 50_000
#: Candidates are verified so many at a time.
STEP = 1 << 20
_RUN = "perm INT, key BIGINT, more BIGINT"
_TOP = -(2**63)


def read_signature(hexadecimal: Column) -> Column:
    """A 64-bit hash as BIGINT; NULL if it is empty, no hexadecimal number of up to 64 bits, or all ones."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(hexadecimal, r"(?U)^\s+|\s+$", "")), "^0x", "")
    digits = F.lpad(F.regexp_replace(bare, "^0+(?=.)", ""), 16, "0")
    sig = F.shiftleft(F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint"), 32).bitwiseOR(F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint"))
    return F.when(bare.rlike("^0*[0-9a-f]{1,16}$") & (sig != -1), sig)


def read_path(path: Column) -> Column:
    r"""``\`` as ``/``, runs of ``/`` as one, without a leading ``./``; NULL if nothing is left."""
    even = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.nullif(F.regexp_replace(even, r"^\./", ""), F.lit(""))


def depths(widths: list[list[int]], distance: int, recall: float, seed: int = 1) -> list[int]:
    """For each permutation (the widths of its blocks, and how many of them come first to be whole) the prefix's depth.

    At recall 1 the blocks of the pigeonhole principle; below, the longest prefixes that still meet the target for
    signatures with ``distance`` random bits flipped (20,000 trials).
    """
    whole = [sum(w[: len(w) - distance]) for w in widths]
    if recall >= 1:
        return whole
    places = np.random.default_rng(seed).integers(0, 64, (20_000, distance))
    orders = [np.argsort(np.concatenate([np.arange(a, a + n) for a, n in o])) for o in _orders(len(widths[0]), distance)]
    for more in range(64, -1, -1):
        d = [min(64, w + more) for w in whole]
        hit = np.zeros(len(places), dtype=bool)
        for place, depth in zip(orders, d, strict=True):
            hit |= (place[places] >= depth).all(axis=1)
        if hit.mean() >= recall:
            return d
    return whole


def _orders(blocks: int, distance: int) -> list[list[tuple[int, int]]]:
    """For each permutation its blocks as (offset from the top, width)."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    out = []
    for first in itertools.combinations(range(blocks), blocks - distance):
        order = [*first, *[k for k in range(blocks) if k not in first]]
        out.append([(cuts[k], cuts[k + 1] - cuts[k]) for k in order])
    return out


@dataclass
class Run:
    """``files``: (path, lowest perm, lowest key, highest perm, highest key)."""

    path: str
    rows: int
    files: list[tuple[str, int, int, int, int]] = field(default_factory=list)

    def tier(self) -> int:
        return int(math.log(max(self.rows, 1), TIER))


def _opened(uri: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(where.open_input_file(path))


@lru_cache(maxsize=256)
def _fences(uri: str) -> list[tuple[int, int, int, int]]:
    """(lowest perm, lowest key, highest perm, highest key) of a file's row groups. Where a group has more than one permutation,
    its keys count as all keys."""
    meta, out = _opened(uri).metadata, []
    for g in range(meta.num_row_groups):
        perm, key = (meta.row_group(g).column(k).statistics for k in (0, 1))
        one = perm.min == perm.max
        out.append((perm.min, key.min if one else _TOP, perm.max, key.max if one else -_TOP - 1))
    return out


def _ranges(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    low = (1 << (64 - depth)) - 1
    return keys & np.int64(~low), keys | np.int64(low) if depth else np.full(len(keys), -_TOP - 1)


def _below(files: list[str], perm: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys of a permutation (and what goes with them) in the row groups that a range [lo, hi] touches."""
    keys, more = [], []
    for uri in files:
        wanted = []
        for g, (p, a, q, b) in enumerate(_fences(uri)):
            if p <= perm <= q and np.any((hi >= a) & (lo <= b)):
                wanted.append(g)
        if wanted:
            t = _opened(uri).read_row_groups(wanted)
            own = t["perm"].to_numpy() == perm
            keys.append(t["key"].to_numpy()[own])
            more.append(t["more"].to_numpy()[own])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(keys), np.concatenate(more)) if keys else (none, none)


def _candidates(at: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, place) of ranges that begin at ``at``, about :data:`STEP` at a time."""
    ends = np.cumsum(count)
    begin = 0
    while begin < len(count):
        base = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, base + STEP, side="right")))
        n = count[begin:stop]
        q = np.repeat(np.arange(begin, stop), n)
        yield q, np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + at[q]
        begin = stop


def permuted(sigs: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The blocks (offset from the top, width) of signatures in another order, with the top bit flipped."""
    x, out, at = sigs.view(np.uint64), np.zeros(len(sigs), dtype=np.uint64), 64
    for offset, width in order:
        at -= width
        bits = (x >> np.uint64(64 - offset - width)) & np.uint64((1 << width) - 1)
        out |= bits << np.uint64(at)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def restored(keys: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The signatures of which ``keys`` are the permutations."""
    x, out, at = keys.view(np.uint64) ^ np.uint64(1 << 63), np.zeros(len(keys), dtype=np.uint64), 64
    for offset, width in order:
        at -= width
        out |= ((x >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(64 - offset - width)
    return out.view(np.int64)


def permuted_rows(orders: list[list[tuple[int, int]]]):
    """mapInPandas over (id, sig, has, h, g, named): (perm, key, more, id) of what each has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, at = batch[batch["has"]], batch[batch["named"]]
            sigs, ids, zero = own["sig"].to_numpy(), own["id"].to_numpy(), np.zeros(len(own), dtype=np.int64)
            for k, o in enumerate(orders):
                yield pd.DataFrame({"perm": np.full(len(own), k, dtype=np.int32), "key": permuted(sigs, o), "more": zero, "id": ids})
            yield pd.DataFrame({"perm": np.full(len(at), -1, dtype=np.int32), "key": at["h"], "more": at["g"], "id": at["id"]})

    return run


def searched(runs: list[Run], final: list[int], distance: int, pairs: bool):
    """mapInPandas over queries (perm, key, more, id) sorted by perm and key: (id, other).

    Without ``pairs`` each found id comes once a permutation, and what an earlier depth found isn't widened; with them, every other
    signature within the distance comes, as its key in the same permutation. ``final``: the depth of each permutation.
    """

    def one(perm: int, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values("key")
        key, more, ids = (rows[c].to_numpy() for c in ("key", "more", "id"))
        steps = [64] if perm < 0 else [final[perm]] if pairs else [d for d in (64, 48, 36) if d > final[perm]] + [final[perm]]
        lo, hi = _ranges(key, steps[-1])
        open_ = np.ones(len(key), dtype=bool)
        for run in runs:
            first, last = (perm, int(lo.min())), (perm, int(hi.max()))
            files = [f for f, p, a, q, b in run.files if (p, a) <= last and (q, b) >= first]
            held, extra = _below(files, perm, lo, hi)
            for depth in steps if len(held) else ():
                own = np.flatnonzero(open_)
                a, b = _ranges(key[own], depth)
                begin = np.searchsorted(held, a)
                for q, place in _candidates(begin, np.searchsorted(held, b, side="right") - begin):
                    mine = own[q]
                    if perm < 0:
                        near = more[mine] == extra[place]
                    else:
                        near = np.bitwise_count((key[mine] ^ held[place]).view(np.uint64)) <= distance
                    if pairs:
                        near &= key[mine] != held[place]
                        yield pd.DataFrame({"id": ids[mine[near]], "other": held[place[near]]})
                    else:
                        open_[mine[near]] = False
        if not pairs:
            yield pd.DataFrame({"id": ids[~open_], "other": np.zeros(int((~open_).sum()), dtype=np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for perm, rows in batch.groupby("perm"):
                yield from one(int(perm), rows)

    return run


class HashForest:
    """Accepted signatures and paths in a folder that all executors see, as runs; a later session goes on with the same folder.

    ``distance``: bits that may differ. ``blocks``: the signature is cut into so many blocks, and each permutation brings
    another choice of ``blocks - distance`` of them to the front; more blocks mean longer prefixes, so fewer false
    candidates, and more permutations. Tasks open the runs' files through pyarrow's file systems.
    """

    def __init__(self, spark: SparkSession, folder: str, distance: int = 3, blocks: int = 5, recall: float = 1.0):
        self.spark, self.folder, self.distance = spark, folder.rstrip("/"), distance
        self.orders = _orders(blocks, distance)
        self.depths = depths([[w for _, w in o] for o in self.orders], distance, recall)
        self.scratch = Scratch(spark, "batch")
        self.runs: list[Run] = []
        self.written = 0
        self.passing: list[str] = []  # scratch tables of the batch at hand
        if (text := self._text("forest.json")) is not None:
            kept = json.loads(text)
            if (kept["distance"], kept["blocks"]) != (distance, blocks):
                raise ValueError("the folder holds a forest of another distance or number of blocks")
            self.written = kept["written"]
            self.runs = [Run(r["path"], r["rows"], [tuple(f) for f in r["files"]]) for r in kept["runs"]]
        self.blocks = blocks

    # -- files -------------------------------------------------------------------------------------------

    def _fs(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _text(self, name: str) -> str | None:
        fs, path = self._fs(name)
        if not fs.exists(path):
            return None
        return "\n".join(r.value for r in self.spark.read.text(str(path.toString())).collect())

    def _keep(self) -> None:
        """The list of runs, written beside and then moved to its place."""
        text = json.dumps({"distance": self.distance, "blocks": self.blocks, "written": self.written, "runs": [asdict(r) for r in self.runs]})
        fs, new = self._fs("forest.new")
        out = fs.create(new, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        _, old = self._fs("forest.json")
        fs.delete(old, False)
        fs.rename(new, old)

    def _name(self, what: str) -> str:
        self.written += 1
        if what in ("new", "sigs", "pairs", "self", "open"):
            self.passing.append(f"{what}{self.written}")
        return f"{what}{self.written}"

    def _write_run(self, rows: DataFrame, number: int, to: str) -> Run:
        """(perm, key, more) sorted; ``number``: about how many rows."""
        parts = max(1, -(-number // FILE_ROWS))
        rows.repartitionByRange(parts, "perm", "key").sortWithinPartitions("perm", "key").write.option("parquet.block.size", GROUP_BYTES).option(
            "parquet.page.row.count.limit", 4000).parquet(to)
        fs, path = self._fs()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
        run = Run(to, number)
        for s in fs.listStatus(path):
            uri = s.getPath().toString()
            if uri.endswith(".parquet"):
                fences = _fences(_uri(uri))
                if fences:
                    run.files.append((_uri(uri), fences[0][0], fences[0][1], fences[-1][2], fences[-1][3]))
        return run

    # -- signatures --------------------------------------------------------------------------------------

    def _rows(self, entries: DataFrame, named: bool) -> DataFrame:
        """(perm, key, more, id) of each signature and path of (id, sig, path), without id unless ``named``; keys' signed order
        is the unsigned order of what they stand for."""
        # A nullable BIGINT would reach pandas as a float and lose bits.
        path = F.col("path")
        own = entries.select(
            F.coalesce(F.col("id") if named else F.lit(0), F.lit(0)).cast("bigint").alias("id"), F.coalesce("sig", F.lit(0)).alias("sig"), F.col("sig").isNotNull().alias("has"),
            F.xxhash64("path").alias("h"), F.xxhash64(F.lit(7), path).alias("g"), path.isNotNull().alias("named"),
        )
        return own.mapInPandas(permuted_rows(self.orders), _RUN + ", id BIGINT")

    def _search(self, entries: DataFrame, number: int, runs: list[Run], pairs: bool) -> DataFrame:
        queries = self._rows(entries, True)
        parts = max(1, -(-number * (len(self.orders) + 1) // QUERY_ROWS))
        # Equal keys may come from a large part of all entries; by id they go to several tasks.
        queries = queries.repartitionByRange(parts, "perm", "key", "id")
        return queries.mapInPandas(searched(runs, self.depths, self.distance, pairs), "id BIGINT, other BIGINT")

    def found(self, entries: DataFrame) -> DataFrame:
        """(id) of those of ``entries`` (id, sig, path) whose path equals an accepted one or whose signature lies near one."""
        return self._search(entries, entries.count(), self.runs, False).select("id").distinct()

    def append(self, accepted: DataFrame) -> None:
        """Adds accepted entries (sig, path) as a run; runs of like size are merged."""
        rows = self._rows(accepted, False).drop("id")
        number = accepted.count() * (len(self.orders) + 1)
        if not number:
            return
        self.runs.append(self._write_run(rows, number, f"{self.folder}/{self._name('run')}"))
        gone = []
        while True:
            by: dict[int, list[Run]] = {}
            for r in self.runs:
                by.setdefault(r.tier(), []).append(r)
            like = next((x for _, x in sorted(by.items()) if len(x) >= TIER), None)
            if like is None:
                break
            merged = self.spark.read.schema(_RUN).parquet(*[r.path for r in like])
            self.runs = [r for r in self.runs if r not in like] + [self._write_run(merged, sum(r.rows for r in like), f"{self.folder}/{self._name('run')}")]
            gone += like
        self._keep()
        for r in gone:
            fs, _ = self._fs()
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(r.path), True)

    # -- one batch ---------------------------------------------------------------------------------------

    def accept(self, batch: DataFrame) -> DataFrame:
        """The accepted ids of ``batch`` (id, sig, path), whose entries are taken by id; they join the history.

        NULL signatures and paths match nothing. History is only searched, never decided again.
        """
        # Of entries equal in both, only the first can be accepted; those without either stand alone.
        alone = F.when(F.col("sig").isNull() & F.col("path").isNull(), F.col("id"))
        rest = batch.groupBy("sig", "path", alone.alias("alone")).agg(F.min("id").alias("id")).drop("alone")
        if self.runs:
            rest = self.scratch.write(rest, self._name("new"))
            rest = rest.join(self.found(rest), "id", "left_anti")
        rest = self.scratch.write(rest.select("id", "sig", "path"), self._name("rest"))
        taken = self._within(rest)
        self.append(taken)
        for name in self.passing:
            self.scratch.drop(name)
        self.passing.clear()
        return taken.select("id")

    def _within(self, rest: DataFrame) -> DataFrame:
        """The greedy choice by id among entries that history lets through, in rounds: those first among all they conflict with
        are taken, what conflicts with them is out, the others go on."""
        pairs = self._pairs(rest)
        some = "sig IS NOT NULL OR path IS NOT NULL"
        taken, open_ = rest.where(f"NOT ({some})"), rest.where(some)
        while True:
            chosen = self.scratch.write(self._round(open_, pairs), self._name("chosen"))
            taken = taken.union(chosen)
            sigs = chosen.where("sig IS NOT NULL").select("sig")
            shut = sigs.union(pairs.join(sigs, "sig", "left_semi").select("other")).distinct()
            # A taken entry is itself out by its signature or its path.
            open_ = open_.join(shut, "sig", "left_anti").join(chosen.where("path IS NOT NULL").select("path"), "path", "left_anti")
            open_ = self.scratch.write(open_.select("id", "sig", "path"), self._name("open"))
            if open_.isEmpty():
                return taken

    def _pairs(self, rest: DataFrame) -> DataFrame:
        """(sig, other): signatures of ``rest`` within the distance of each other, both ways; found as in history."""
        sigs = rest.where("sig IS NOT NULL").select("sig").distinct().select("sig", F.lit(None).cast("string").alias("path"))
        own = self._write_run(self._rows(sigs, False).drop("id"), rest.count() * len(self.orders), f"{self.scratch.path}/{self._name('self')}")
        if not own.files:
            return self.spark.createDataFrame([], "sig BIGINT, other BIGINT")
        # The run's rows are the queries, in its order.
        queries = self.spark.read.schema(_RUN).parquet(own.path).withColumn("id", F.col("key"))
        search = searched([own], self.depths, self.distance, True)
        orders = self.orders

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for perm, rows in batch.groupby("perm"):
                    for hit in search(iter([rows])):
                        yield pd.DataFrame({c: restored(hit[x].to_numpy(), orders[perm]) for c, x in (("sig", "id"), ("other", "other"))})

        return self.scratch.write(queries.mapInPandas(run, "sig BIGINT, other BIGINT").distinct(), self._name("pairs"))

    def _round(self, open_: DataFrame, pairs: DataFrame) -> DataFrame:
        """The entries that come first among all they conflict with."""
        entry = F.struct("id", "sig", "path")
        heads = open_.where("sig IS NOT NULL").groupBy("sig").agg(F.min(entry).alias("e"))
        near = pairs.join(heads.select(F.col("sig").alias("other"), F.col("e.id").alias("least")), "other").groupBy("sig").agg(F.min("least").alias("near"))
        by_sig = heads.join(near, "sig", "left").where("near IS NULL OR near > e.id").select("e.*")
        by_path = open_.where("path IS NOT NULL").groupBy("path").agg(F.min(entry).alias("e")).select("e.*")
        both = by_sig.union(by_path).groupBy("id", "sig", "path").agg(F.count("*").alias("c"))
        needs = F.col("sig").isNotNull().cast("int") + F.col("path").isNotNull().cast("int")
        return both.where(F.col("c") == needs).drop("c")


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def rejected_entries(manifest: DataFrame) -> DataFrame:
    """(manifest_id) of the entries that are rejected when batches come one after the other.

    An entry is rejected if its normalized path equals that of an accepted entry before, or its hash lies
    within 3 bits of one. Rejected entries are no history. NULL, empty, malformed and all-ones hashes, and
    NULL and empty paths, match nothing; a NULL batch comes first. manifest_id must be unique; other columns are ignored.
    """
    spark = manifest.sparkSession
    scratch = Scratch(spark, "forest")
    entries = manifest.select(
        F.coalesce(F.col("batch_no"), F.lit(-(2**31))).alias("batch"),
        F.col("manifest_id").alias("id"),
        read_signature(F.col("simhash64_hex")).alias("sig"),
        read_path(F.col("in")).alias("path"),
    )
    to = f"{scratch.path}/entries"
    entries.write.partitionBy("batch").parquet(to)
    entries = spark.read.schema("id BIGINT, sig BIGINT, path STRING, batch INT").parquet(to)
    forest = HashForest(spark, f"{scratch.path}/runs")
    # One number for each batch, which is one load of data: the list grows with time, not with the rows.
    batches = sorted(r[0] for r in entries.select("batch").distinct().collect())
    accepted = None
    for b in batches:
        ids = forest.accept(entries.where(F.col("batch") == b).drop("batch"))
        accepted = ids if accepted is None else accepted.union(ids)
    if accepted is None:
        return entries.select(F.col("id").alias("manifest_id"))
    return entries.join(accepted, "id", "left_anti").select(F.col("id").alias("manifest_id"))
