"""Problem 9: sources mixed to target weights, as a minimum-cost flow.

Texts are aggregated by their membership pattern: the set of target sources that hold them. Token capacity flows from the
patterns to the sources' quotas; the first use of a pattern's tokens costs nothing and each further use one more
than the one before. The total is the largest at which every source that has texts gets its quota, or a given one. The flow
tells how much of each pattern goes to each source; a seeded order of the texts tells which.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.operators.running import running_sum
from lavra.session import Scratch

#: The driver sees the patterns that occur, at most so many; sources overlap in few of the sets they could form.
MOST_PATTERNS = 100_000


@dataclass
class Target:
    source: str
    share: float
    repeats: int


def read_targets(targets: DataFrame) -> list[Target]:
    """The rows of mix_targets, which is a setting: one row for each source that someone gave a share."""
    rows = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect()
    return [Target(r.source, r.target_share, r.max_repeats) for r in sorted(rows, key=lambda r: r.source)]


def min_cost_flow(edges: list[tuple[str, str, int, int]], start: str, end: str) -> dict[tuple[str, str], int]:
    """The flow on each (from, to) of a cheapest maximum flow; ``edges`` have a capacity and a cost, and may repeat."""
    names = {n: k for k, n in enumerate(dict.fromkeys(x for e in edges for x in e[:2]))}
    if start not in names or end not in names:
        return {}
    to, room, cost, out = [], [], [], [[] for _ in names]
    for a, b, c, w in edges:
        for u, v, cap, price in ((a, b, c, w), (b, a, 0, -w)):
            out[names[u]].append(len(to))
            to.append(names[v])
            room.append(cap)
            cost.append(price)
    s, t = names[start], names[end]
    while True:
        far = [float("inf")] * len(names)
        via = [-1] * len(names)
        far[s] = 0
        queue, waiting = deque([s]), {s}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for e in out[u]:
                if room[e] > 0 and far[u] + cost[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[u] + cost[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if via[t] < 0:
            break
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = to[via[v] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most
    flow: dict[tuple[str, str], int] = {}
    for k, (a, b, _, _) in enumerate(edges):
        flow[a, b] = flow.get((a, b), 0) + room[2 * k + 1]
    return flow


def members(pattern: str) -> list[int]:
    return [int(k) for k in pattern.split(",")]


def route(patterns: dict[str, int], targets: list[Target], total: int) -> dict[str, list[tuple[int, int]]]:
    """For each pattern (numbers of targets, by commas; tokens) the tokens that go to each target, as (target, tokens)."""
    edges = []
    for p, tokens in patterns.items():
        own = members(p)
        for use in range(max(targets[k].repeats for k in own)):
            edges.append(("", f"p{p}", tokens, use))
        edges += [(f"p{p}", f"s{k}", tokens * targets[k].repeats, 0) for k in own]
    edges += [(f"s{k}", "end", _quota(t, total), 0) for k, t in enumerate(targets)]
    flow = min_cost_flow(edges, "", "end")
    return {p: [(k, f) for k in members(p) if (f := flow.get((f"p{p}", f"s{k}"), 0))] for p in patterns}


def _quota(target: Target, total: int) -> int:
    return round(target.share * total)


def largest_total(patterns: dict[str, int], targets: list[Target]) -> int:
    """The largest total, up to the tokens of all distinct texts, at which every source that has texts gets its quota."""
    held = {k for p in patterns for k in members(p)}

    def reached(total: int) -> bool:
        got = dict.fromkeys(held, 0)
        for parts in route(patterns, targets, total).values():
            for k, f in parts:
                got[k] += f
        return all(got[k] >= _quota(targets[k], total) for k in held)

    low, high = 0, sum(patterns.values())
    if reached(high):
        return high
    # To a thousandth of the tokens there are.
    while high - low > max(1, sum(patterns.values()) // 1000):
        mid = (low + high) // 2
        low, high = (mid, high) if reached(mid) else (low, mid)
    return low


def mix(docs: DataFrame, sizes: DataFrame, targets: list[Target], seed: int = 42, total: int | None = None) -> DataFrame:
    """(source, doc_id, tokens, repeats): the chosen documents and how often each is taken for its source.

    ``sizes`` has (doc_id, tokens). ``total`` is the wanted size of the mixture in tokens; without it, the
    largest at which every source that has texts gets its share (:func:`largest_total`). A text goes at most ``repeats`` times to a source; copies within
    a source count as one text, whose smallest doc_id stands for it. With a larger total, sources too small for their share,
    repeated as often as allowed, give all they have. Texts without tokens, of NULL sources or of others than the targets are
    left out. What a source gets differs from its flow by less than one text for each pattern.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mix")
    none = spark.createDataFrame([], "source STRING, doc_id BIGINT, tokens BIGINT, repeats INT")
    if not targets:
        return none
    index = F.create_map(*[F.lit(x) for k, t in enumerate(targets) for x in (t.source, k)])
    held = docs.where(F.col("source").isin([t.source for t in targets])).select(
        "doc_id", index[F.col("source")].alias("k"), F.xxhash64("text").alias("h"), F.md5("text").alias("m")
    ).join(sizes.where("tokens > 0"), "doc_id")
    # One row a text: its pattern, and in each source its smallest document.
    firsts = held.groupBy("h", "m", "k").agg(F.max("tokens").alias("tokens"), F.min("doc_id").alias("doc"))
    texts = firsts.groupBy("h", "m").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("k", "doc"))).alias("docs"))
    texts = scratch.write(texts.withColumn("pattern", F.array_join(F.col("docs.k").cast("array<string>"), ",")), "texts")
    by_pattern = scratch.write(texts.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")), "patterns")
    if by_pattern.count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources")
    patterns = {r.pattern: r.tokens for r in by_pattern.collect()}
    if not patterns:
        return none
    routes = route(patterns, targets, total if total is not None else largest_total(patterns, targets))
    # The pattern's texts, laid end to end again and again, are a tape; each source gets a stretch of it.
    stretches = []
    for p, parts in routes.items():
        at = 0
        for k, f in parts:
            stretches.append((p, k, at, at + f, patterns[p]))
            at += f
    if not stretches:
        return none
    tape = spark.createDataFrame(stretches, "pattern STRING, k INT, a BIGINT, b BIGINT, length BIGINT")
    laid = running_sum(texts, by_pattern, ["pattern"], F.xxhash64(F.lit(seed), "m"), "tokens", "x", scratch, "laid")
    # Copies of the text start at x, x + length, ...: count those in [a, b).
    def below(limit: str):
        return F.greatest(F.lit(0), F.ceil((F.col(limit) - F.col("x")) / F.col("length")))

    taken = laid.join(F.broadcast(tape), "pattern").withColumn("repeats", (below("b") - below("a")).cast("int")).where("repeats > 0")
    name = F.array(*[F.lit(t.source) for t in targets])
    doc = F.filter("docs", lambda x: x["k"] == F.col("k"))[0]["doc"]
    return taken.select(name[F.col("k")].alias("source"), doc.alias("doc_id"), "tokens", "repeats")


def shares(mixed: DataFrame, targets: list[Target]) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_repeats, tokens, actual_share): what the mixture reached."""
    spark = mixed.sparkSession
    own = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens")
    )
    rows = spark.createDataFrame([(t.source, t.share, t.repeats) for t in targets], "source STRING, target_share DOUBLE, max_repeats INT")
    own = rows.join(own, "source", "left").na.fill(0, ["documents", "most_repeats", "tokens"])
    all_tokens = own.agg(F.sum("tokens").alias("all"))
    return own.join(F.broadcast(all_tokens)).withColumn("actual_share", F.round(F.col("tokens") / F.col("all"), 6)).drop("all")
