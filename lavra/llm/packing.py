"""Problem 8: items into containers of fixed capacity, by the linear grouping scheme.

The plan is made on the driver from the histogram of sizes, which has at most ``capacity`` entries however many items
there are. Large sizes are rounded up within groups of equal cardinality; configurations of the few rounded sizes
come from a linear program with column generation. Real items then take the slots in order of size, which
tells exactly what each container has left; containers that keep more room than a tolerance are given up, and what has no
place goes, largest first, where it fits best. Of several tolerances, the last of which gives up all containers and so is
plain best fit, the one with the fewest containers is taken. All of it is
arithmetic on ranges of ranks and of containers; documents get their places by their rank among those of
their size.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.operators.running import running_sum
from lavra.session import Scratch

#: Large sizes are rounded up to so many.
GROUPS = 32
#: Sizes above this part of the capacity are large.
LARGE = 0.125
#: The parts of the capacity that a planned container may have left; a negative one leaves all to best fit.
TOLERANCES = (1.0, 0.05, 0.02, 0.01, 0.004, 0.0, -1.0)


@dataclass
class Plan:
    """``places``: (size, first rank, number, first container); containers are numbered from 0."""

    capacity: int
    containers: int = 0
    places: list[tuple[int, int, int, int]] = field(default_factory=list)


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value of a container, and how many of each size it takes."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    order = np.array(sizes)
    for c in range(min(sizes), capacity + 1):
        k = np.searchsorted(order, c, side="right")
        gains = best[c - order[:k]] + values[:k]
        j = int(gains.argmax())
        if gains[j] > best[c - 1] + 1e-12:
            best[c], last[c] = gains[j], j
        else:
            best[c] = best[c - 1]
    take = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            take[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), take


def configurations(sizes: list[int], needs: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many containers get each, rounded down; ``sizes`` ascend and are distinct.

    The simplex method with column generation. A basis is never taken twice, so it ends; every basis is feasible.
    """
    g = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(needs, dtype=float)
    inverse = np.linalg.inv(basis)
    seen: set[bytes] = set()
    while (sign := basis.tobytes()) not in seen:
        seen.add(sign)
        worth, column = _knapsack(sizes, np.ones(g) @ inverse, capacity)
        if worth <= 1 + 1e-7:
            break
        x, step = inverse @ need, inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
    x = np.maximum(inverse @ need, 0)
    return [(basis[:, k].astype(int), int(x[k] + 1e-6)) for k in range(g) if int(x[k] + 1e-6) > 0]


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Places for all items of ``histogram`` (size: number), with sizes from 1 to ``capacity``."""
    large = sorted(s for s in histogram if s > capacity * LARGE)
    total = sum(histogram[s] for s in large)
    groups: list[list[int]] = [[]]
    found: list[tuple[np.ndarray, int]] = []
    if large:
        # Groups of equal cardinality, by ranges of sizes.
        seen = 0
        for s in large:
            if groups[-1] and seen >= total * len(groups) / GROUPS:
                groups.append([])
            groups[-1].append(s)
            seen += histogram[s]
        found = configurations([x[-1] for x in groups], [sum(histogram[s] for s in x) for x in groups], capacity)
    plans = (_filled(histogram, capacity, groups, found, int(t * capacity) if t >= 0 else -1) for t in TOLERANCES)
    return min(plans, key=lambda p: p.containers)


def _filled(histogram: dict[int, int], capacity: int, groups: list[list[int]], found: list[tuple[np.ndarray, int]], tolerance: int) -> Plan:
    """The plan in which configurations keep the containers that have at most ``tolerance`` left."""
    plan = Plan(capacity)
    used = dict.fromkeys(histogram, 0)  # ranks of the size that have a place
    left: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space: ranges of containers (first, number)
    # A group's items in order of size, largest first: a queue of [size, number].
    queues = [[[s, histogram[s]] for s in reversed(x)] for x in groups]
    for counts, n in found if tolerance >= 0 else ():
        # Slot by slot, n containers take the next n items of the slot's group.
        cuts, slots = {0, n}, []
        for k, many in enumerate(counts):
            for _ in range(many):
                at, parts = 0, []
                while at < n and queues[k]:
                    head = queues[k][0]
                    take = min(n - at, head[1])
                    parts.append((at, take, head[0]))
                    head[1], at = head[1] - take, at + take
                    cuts.add(at)
                    if not head[1]:
                        queues[k].pop(0)
                slots.append(parts)
        edges = sorted(cuts)
        inside: list[list[int]] = [[] for _ in edges[1:]]
        for parts in slots:
            for at, take, s in parts:
                for i in range(bisect.bisect_left(edges, at), bisect.bisect_left(edges, at + take)):
                    inside[i].append(s)
        for a, b, sizes in zip(edges, edges[1:], inside, strict=False):
            room = capacity - sum(sizes)
            if room > tolerance or not sizes:
                continue
            for s in sizes:
                plan.places.append((s, used[s], b - a, plan.containers))
                used[s] += b - a
            if room:
                left[room].append((plan.containers, b - a))
            plan.containers += b - a
    # The rest, largest first, where it fits best.
    rooms = sorted(left)
    for s in sorted(histogram, reverse=True):
        n = histogram[s] - used[s]
        while n:
            k = bisect.bisect_left(rooms, s)
            if k == len(rooms):
                first, many, room = plan.containers, -(-n // (capacity // s)), capacity
                plan.containers += many
            else:
                room = rooms[k]
                first, many = left[room].pop()
                if not left[room]:
                    rooms.pop(k)
            take = min(n, many)
            plan.places.append((s, used[s], take, first))
            used[s] += take
            n -= take
            for r, at, m in ((room - s, first, take), (room, first + take, many - take)):
                if r and m:
                    if not left[r]:
                        bisect.insort(rooms, r)
                    left[r].append((at, m))
    return plan


def placed(plans: dict[int, Plan]):
    """mapInPandas: the container of each (spec_id, size, rank)."""
    tables = {}
    for spec, plan in plans.items():
        p = pd.DataFrame(plan.places, columns=["size", "rank", "n", "container"]).sort_values(["size", "rank"])
        wide = int(p["rank"].max() + p["n"].max() + 1) if len(p) else 1
        tables[spec] = (p["size"].to_numpy() * wide + p["rank"].to_numpy(), p["container"].to_numpy(), wide)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.int64)
            for spec, (keys, container, wide) in tables.items():
                mine = (batch["spec_id"] == spec).to_numpy()
                own = batch["size"].to_numpy()[mine].astype(np.int64) * wide + batch["rank"].to_numpy()[mine]
                at = np.searchsorted(keys, own, side="right") - 1
                out[mine] = container[at] + own - keys[at] if len(keys) else 0
            yield batch.assign(container=out)[["spec_id", "key", "part_no", "size", "tokens", "container"]]

    return run


def pack(items: DataFrame, specs: dict[int, int], key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(spec_id, container_id, key, part_no, token_start, token_end): where each item goes, for each capacity.

    ``specs``: spec id and capacity. An item larger than the capacity is cut at multiples of it: its
    full parts fill containers of their own, its last part is packed as an item. Smaller items stay whole.
    Items of 0 or NULL tokens take no place and have no row. Keys must be unique BIGINTs. The driver sees
    the histogram of sizes only: at most ``capacity`` numbers for each spec.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "pack")
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for k, c in specs.items()]))
    rows = items.where(F.col(tokens) > 0).select(F.col(key).alias("key"), F.col(tokens).cast("bigint").alias("tokens"), each.alias("e")).select("key", "tokens", "e.*")
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("bigint")
    last = rows.select("spec_id", "key", full.cast("int").alias("part_no"), "tokens", (F.col("tokens") % F.col("capacity")).cast("int").alias("size")).where("size > 0")
    last = last.withColumn("one", F.lit(1))
    sizes = scratch.write(last.groupBy("spec_id", "size").agg(F.count("*").alias("n")), "sizes")
    histograms: dict[int, dict[int, int]] = {k: {} for k in specs}
    for r in sizes.collect():
        histograms[r.spec_id][r["size"]] = r.n
    plans = {k: make_plan(h, specs[k]) for k, h in histograms.items()}
    order = F.xxhash64("key")
    ranked = running_sum(last, sizes, ["spec_id", "size"], order, "one", "rank", scratch, "last")
    kind = "spec_id INT, key BIGINT, part_no INT, size INT, tokens BIGINT, container BIGINT"
    found = ranked.select("spec_id", "key", "part_no", "size", "tokens", F.col("rank").cast("bigint").alias("rank")).mapInPandas(placed(plans), kind)
    ends = found.select(
        "spec_id", F.concat(F.lit("s"), F.col("container")).alias("container_id"), F.col("key").alias(key), "part_no",
        (F.col("tokens") - F.col("size")).alias("token_start"), F.col("tokens").alias("token_end"),
    )
    wholes = rows.where(full > 0).select("spec_id", "key", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("p")).select(
        "spec_id", F.concat_ws("-", F.concat(F.lit("f"), F.col("key")), F.col("p")).alias("container_id"), F.col("key").alias(key), F.col("p").cast("int").alias("part_no"),
        (F.col("p") * F.col("capacity")).alias("token_start"), ((F.col("p") + 1) * F.col("capacity")).alias("token_end"),
    )
    return ends.union(wholes)


def fill_report(packed: DataFrame, specs: dict[int, int]) -> DataFrame:
    """(spec_id, containers, items, tokens, fill): how full the containers of each spec are."""
    per = packed.groupBy("spec_id", "container_id").agg(F.count("*").alias("items"), F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    caps = F.create_map(*[F.lit(x) for kv in specs.items() for x in kv])
    return per.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens")).withColumn(
        "fill", F.round(F.col("tokens") / F.col("containers") / caps[F.col("spec_id")], 6)
    )
