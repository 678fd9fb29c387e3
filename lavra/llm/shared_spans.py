"""Problem 10: long spans that stand verbatim in more than one document, by compaction of a de Bruijn graph.

The graph's nodes are 64-grams of characters, of which only minimizers are kept: one of them lies in every window of 200
characters, and equal windows have the same one. Its edges are the stretches of text from one kept node to the next. Nodes
and edges that stand in two documents or more are repeated. An edge goes on without branching where it, the node it leads to
and the edge after that occur equally often; such edges are joined into paths, and the occurrences of a path are
compared at their source coordinates by 128-bit hashes of all their text. What lies at the paths' ends and at branchings is
verified window by window where its node brings it together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.llm.rolling import Texts, minimizers
from lavra.operators.skew import join_counted
from lavra.session import Scratch, spread

GRAM = 64
#: Texts are worked on about so many characters at a time, which fit a core's cache; longer ones in pieces that overlap.
CHUNK = 50_000
#: The distinct contexts of a node, up to so many, are verified in one task; those of others by an aggregation over window hashes.
FEW = 2_000


def _blocks(texts, span: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Texts]]:
    """Texts of ``span`` characters or more, about ``chunk`` characters at a time: index of the text, place of the
    piece in it, the first window that the piece is for, and the pieces.

    A piece is for ``chunk`` windows; it has one window before them and those of two spans after them.
    """
    who, offs, first, parts, n = [], [], [], [], 0
    for i, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        for at in range(0, len(text), chunk):
            begin = max(0, at - 1)
            piece = text[begin : at + chunk + 2 * span]
            if len(piece) < span:
                break
            who.append(i)
            offs.append(begin)
            first.append(at)
            parts.append(piece)
            n += len(piece)
            if n >= chunk:
                yield np.array(who), np.array(offs), np.array(first), Texts(parts)
                who, offs, first, parts, n = [], [], [], [], 0
    if parts:
        yield np.array(who), np.array(offs), np.array(first), Texts(parts)


def node_rows(span: int, chunk: int):
    """mapInPandas: (doc, pos, h, step, to): each kept node, and the edge to the next one: a hash of all its text and the next
    node's hash and place; 0, 0 and -1 at the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc"].to_numpy()
            for who, offs, first, t in _blocks(batch["text"], span, chunk):
                node = minimizers(t, GRAM, span)
                begins = np.flatnonzero((node >= 0) & np.r_[True, node[1:] != node[:-1]])
                pos = node[begins]
                piece = np.searchsorted(t.end, begins, side="right")
                h = t.hashes(pos, GRAM)
                step, to, after = np.zeros(len(pos), dtype=np.uint64), np.zeros(len(pos), dtype=np.uint64), np.full(len(pos), -1)
                at = np.flatnonzero(piece[1:] == piece[:-1])
                step[at] = t.hashes(pos[at], pos[at + 1] - pos[at] + GRAM)
                to[at] = h[at + 1]
                shift = offs[piece] - t.start[piece]
                after[at] = pos[at + 1] + shift[at]
                window = begins + shift
                own = (window >= first[piece]) & (window < first[piece] + chunk)
                yield pd.DataFrame({
                    "doc": ids[who[piece[own]]], "pos": (pos + shift)[own].astype(np.int32), "h": h[own].view(np.int64), "step": step[own].view(np.int64),
                    "to": to[own].view(np.int64), "after": after[own].astype(np.int32),
                })

    return run


def _first_of_runs(at: np.ndarray, *others: np.ndarray) -> np.ndarray:
    new = np.r_[True, at[1:] != at[:-1] + 1]
    for x in others:
        new |= np.r_[True, x[1:] != x[:-1]]
    return np.flatnonzero(new)


def stretch_rows(span: int, chunk: int):
    """mapInPandas over (doc, text, nodes, paths): (s, doc, start, size, g1, g2, context).

    Occurrences of paths (s and context NULL), and stretches of windows of one repeated node that no path holds, with all their text;
    each with two hashes of its text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc"].to_numpy(), batch["text"].tolist()
            nodes, paths = batch["nodes"].tolist(), batch["paths"].tolist()
            yield from _path_rows(ids, texts, paths, chunk)
            for who, offs, first, t in _blocks(texts, span, chunk):
                node = minimizers(t, GRAM, span)
                repeated = np.zeros(t.n + 1, dtype=bool)
                known = np.zeros(t.n + 1, dtype=np.int32)
                at, k = _flat(nodes, who)
                at -= offs[k]
                ok = (at >= 0) & (at < t.sizes[k])
                repeated[(t.start[k] + at)[ok]] = True
                ends, k = _flat(paths, who)
                a, b, k = ends[::2] - offs[k[::2]], ends[1::2] - offs[k[1::2]], k[::2]
                # The first and the last window of a path may have its outermost node, which elsewhere may lie in no path; they are verified by it.
                on_first, on_last = _has_node(node, a, 0, k, t), _has_node(node, b - span, span - GRAM, k, t)
                a, b = np.maximum(a, 0) + on_first, np.minimum(b, t.sizes[k]) - span + 1 - on_last
                np.add.at(known, (t.start[k] + a)[a < b], 1)
                np.add.at(known, (t.start[k] + b)[a < b], -1)
                piece = np.repeat(np.arange(len(who)), t.sizes)
                window = np.arange(t.n) + (offs - t.start)[piece]
                own = (window >= first[piece]) & (window < first[piece] + chunk)
                at = np.flatnonzero(own & (node >= 0) & repeated[node] & (np.cumsum(known[:-1]) == 0))
                if not len(at):
                    continue
                begin = _first_of_runs(at, node[at], piece[at])
                last = np.r_[begin[1:], len(at)] - 1
                start, p = at[begin], piece[at[begin]]
                size = at[last] - start + span
                place = start + (offs - t.start)[p]
                context = [texts[i][a : a + z] for i, a, z in zip(who[p].tolist(), place.tolist(), size.tolist(), strict=True)]
                yield _stretches(t.hashes(node[start], GRAM).view(np.int64), ids[who[p]], place, size, t, start, context)

    return run


def _has_node(node: np.ndarray, window: np.ndarray, place: int, k: np.ndarray, t: Texts) -> np.ndarray:
    """Whether the node of each ``window`` of piece ``k`` stands at ``place`` in it; not so of windows outside of the piece."""
    inside = (window >= 0) & (window < t.sizes[k])
    at = t.start[k] + np.where(inside, window, 0)
    return inside & (node[at] == at + place)


def _flat(lists: list, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the lists of ``who``, end to end, and whose they are, by its place in ``who``."""
    own = [lists[w] if lists[w] is not None else () for w in who.tolist()]
    k = np.repeat(np.arange(len(own)), [len(x) for x in own])
    return (np.concatenate(own) if len(k) else np.zeros(0)).astype(np.int64), k


def _path_rows(ids: np.ndarray, texts: list[str], paths: list, chunk: int) -> Iterator[pd.DataFrame]:
    """The occurrences of paths with the hashes of their texts, about ``chunk`` characters at a time."""
    who, begins, parts, n = [], [], [], 0
    for i, own in enumerate(paths):
        ends = own.tolist() if own is not None else ()
        for a, b in zip(ends[::2], ends[1::2], strict=True):
            who.append(i)
            begins.append(a)
            parts.append(texts[i][a:b])
            n += b - a
            if n >= chunk:
                t = Texts(parts)
                yield _stretches(None, ids[who], np.array(begins), t.sizes, t, t.start, None)
                who, begins, parts, n = [], [], [], 0
    if parts:
        t = Texts(parts)
        yield _stretches(None, ids[who], np.array(begins), t.sizes, t, t.start, None)


def _stretches(s, doc, place, size, t: Texts, start, context) -> pd.DataFrame:
    g1, g2 = t.hashes(start, size).view(np.int64), t.hashes(start, size, 1).view(np.int64)
    s = np.zeros(len(doc), dtype=np.int64) if s is None else s
    return pd.DataFrame({"s": s, "doc": doc, "start": place.astype(np.int32), "size": size.astype(np.int32), "g1": g1, "g2": g2, "context": context})


def shared_windows(span: int):
    """mapInPandas over contexts sorted by s, each of documents from a to b: (doc, start, end) of what another has too.

    All contexts of a node come together; equal windows have equal nodes. Contexts of two documents or more only bear witness.
    """

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        t = Texts(rows["context"].tolist())
        count = t.sizes - span + 1
        row = np.repeat(np.arange(len(rows)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + t.start[row]
        h, g = t.hashes(at, span), t.hashes(at, span, 1)
        order = np.argsort(h)
        x, y, r = h[order], g[order], row[order]
        begin = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        both = np.minimum.reduceat(a[r], begin) < np.maximum.reduceat(b[r], begin)
        shared = np.zeros(len(x), dtype=bool)
        shared[order] = np.repeat(both, np.diff(np.r_[begin, len(x)]))
        shared &= (a == b)[row]
        at, row = at[shared], row[shared]
        if not len(at):
            return pd.DataFrame({"doc": [], "start": [], "end": []})
        first = _first_of_runs(at, row)
        last = np.r_[first[1:], len(at)] - 1
        r = row[first]
        start = at[first] - t.start[r] + rows["start"].to_numpy()[r]
        return pd.DataFrame({"doc": a[r], "start": start, "end": start + at[last] - at[first] + span})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            s = rows["s"].to_numpy()
            # Nodes are settled some hundred rows at a time; the last one may go on in the next batch.
            edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, dtype=int)
            at = 0
            for k, e in enumerate(edges):
                if e > at and (e - at >= 300 or k == len(edges) - 1):
                    yield settle(rows.iloc[at:e])
                    at = e
            held = rows.iloc[at:]
        if held is not None and len(held):
            yield settle(held)

    return run


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, chunk: int = CHUNK) -> DataFrame:
    """(key, span_start, span_end): the longest stretches of characters that lie in passages of at least ``span``
    characters standing verbatim in another document too.

    Positions count code points from 0, the end is exclusive. NULL texts and texts shorter than ``span`` have no
    rows; copies of a text share all of it; a passage repeated only within one document is not shared. ``span`` is
    at least 128. Keys must be unique BIGINTs; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    own = docs.where(F.length(text) >= span).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = "doc BIGINT, pos INT, h BIGINT, step BIGINT, to BIGINT, after INT"
    nodes = scratch.write(spread(own).mapInPandas(node_rows(span, chunk), kind), "nodes")
    repeated = nodes.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    repeated = scratch.write(repeated.select("h", "n"), "repeated")
    marked = scratch.write(join_counted(nodes, repeated, ["h"], "n", ["doc", "pos"]), "marked")
    scratch.drop("nodes")
    paths = _paths(marked, repeated, span, scratch)
    found = marked.groupBy("doc").agg(F.collect_list("pos").alias("nodes"))
    # As long as one document at most.
    found = found.join(paths.groupBy("doc").agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("paths")), "doc", "left")
    kind = "s BIGINT, doc BIGINT, start INT, size INT, g1 BIGINT, g2 BIGINT, context STRING"
    read = own.join(scratch.write(found, "found"), "doc")
    stretches = scratch.write(read.mapInPandas(stretch_rows(span, chunk), kind), "stretches")
    return _merged(_verified(stretches, span, scratch), key)


def _paths(marked: DataFrame, repeated: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """(doc, start, end): every occurrence of the nonbranching paths of ``span`` characters or more.

    An edge is joined with the node it leads to; where both and the edge after occur equally often, all occurrences go on
    together, so they do in the edge's first occurrence too, in whose document the paths are put together.
    """
    rep = F.min(F.struct("doc", "pos", "after"))
    edges = marked.where("after >= 0").groupBy("step", "h", "to", "n").agg(F.count("*").alias("m"), F.max("doc").alias("b"), rep.alias("rep"))
    edges = scratch.write(edges.where("rep.doc < b").select("step", "to", "n", "m", "rep.*"), "edges")
    leads = edges.groupBy("to").agg(F.count("*").alias("k"))
    ends = scratch.write(leads.join(repeated.select(F.col("h").alias("to"), F.col("n").alias("n_to")), "to"), "ends")
    linked = join_counted(edges, ends, ["to"], "k", ["step"]).withColumn("goes", F.col("m") == F.col("n_to"))
    in_doc = Window.partitionBy("doc").orderBy("pos")
    before = F.lag(F.struct("goes", "after", "m")).over(in_doc)
    on = F.coalesce(before["goes"] & (before["after"] == F.col("pos")) & (before["m"] == F.col("m")) & (F.col("m") == F.col("n")), F.lit(False))
    numbered = linked.withColumn("new", (~on).cast("int")).withColumn("path", F.sum("new").over(in_doc))
    whole = numbered.groupBy("doc", "path").agg(
        F.min(F.struct("pos", "step", "m")).alias("first"), (F.max("after") + GRAM).alias("end")
    ).where(F.col("end") - F.col("first.pos") >= span)
    whole = scratch.write(whole.select("first.step", "first.m", (F.col("end") - F.col("first.pos")).alias("length")), "paths")
    begun = join_counted(marked.where("after >= 0").select("doc", "pos", "step"), whole, ["step"], "m", ["doc", "pos"])
    return begun.select("doc", F.col("pos").alias("start"), (F.col("pos") + F.col("length")).alias("end"))


def _verified(stretches: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """(doc, start, end) of what two documents have."""
    on = ["s", "g1", "g2"]
    texts = stretches.groupBy(*on).agg(
        F.count("*").alias("k"), F.min("doc").alias("a"), F.max("doc").alias("b"), F.min(F.struct("doc", "start")).alias("rep")
    )
    texts = scratch.write(texts.select(*on, "k", "a", "b", F.col("rep.start").alias("at")), "texts")
    # Stretches that stand in two documents as they are.
    whole = join_counted(stretches.drop("context"), texts.where("a < b"), on, "k", ["doc", "start"])
    found = whole.select("doc", "start", (F.col("start") + F.col("size")).alias("end"))
    # The others, window by window; of equal ones in two documents, one bears witness for all.
    sizes = scratch.write(texts.where("s <> 0").groupBy("s").agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(F.col("k"))).alias("rows")), "sizes")
    single = sizes.where("rows = 1").select("s")
    open_ = texts.where("s <> 0").join(single, "s", "left_anti")
    contexts = join_counted(stretches.where("s <> 0"), scratch.write(open_, "open"), on, "k", ["doc", "start"])
    contexts = contexts.where("a = b OR (doc = a AND start = at)").select("s", "a", "b", "start", "context")
    hot = sizes.where(F.col("rows") > FEW).select("s")
    kind = "doc BIGINT, start INT, end INT"
    if not hot.limit(1).count():
        return found.union(_by_node(contexts).mapInPandas(shared_windows(span), kind))
    contexts = scratch.write(contexts, "contexts")
    # There are at most one in FEW as many such nodes as contexts, and more rows than that of each.
    rest = contexts.join(hot, "s", "left_anti")
    found = found.union(_by_node(rest).mapInPandas(shared_windows(span), kind))
    windows = contexts.join(hot, "s", "left_semi").select("a", "b", "start", "context", F.explode(F.sequence(F.lit(1), F.length("context") - span + 1)).alias("i"))
    part = F.substring(F.col("context"), F.col("i"), F.lit(span))
    windows = windows.select("a", "b", (F.col("start") + F.col("i") - 1).alias("pos"), F.xxhash64(part).alias("h"), F.xxhash64(F.lit(1), part).alias("g"))
    windows = scratch.write(windows, "windows")
    counts = windows.groupBy("h", "g").agg(F.count("*").alias("k"), F.min("a").alias("lo"), F.max("b").alias("hi")).where("lo < hi")
    warm = join_counted(windows.where("a = b"), scratch.write(counts.select("h", "g", "k"), "hot"), ["h", "g"], "k", ["a", "pos"])
    return found.union(warm.select(F.col("a").alias("doc"), F.col("pos").alias("start"), (F.col("pos") + span).alias("end")))


def _by_node(contexts: DataFrame) -> DataFrame:
    """All contexts of a node in one task, sorted by node.

    The key is hashed: after a join on ``s`` the planner would drop ``repartition("s")`` as done, and adaptive execution may then turn that join
    into one whose tasks hold parts of a node.
    """
    return contexts.repartition(F.xxhash64("s")).sortWithinPartitions("s")


def _merged(found: DataFrame, key: str) -> DataFrame:
    """Intervals that touch or overlap as one."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy("doc", "island").agg(F.min("start").cast("bigint").alias("span_start"), F.max("end").cast("bigint").alias("span_end"))
    return spans.select(F.col("doc").alias(key), "span_start", "span_end")


def shared_amounts(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200) -> DataFrame:
    """(key, chars, shared_chars, spans): how much of each document is shared elsewhere; 0 where nothing is."""
    found = shared_spans(docs, key, text, span).groupBy(key).agg(
        F.sum(F.col("span_end") - F.col("span_start")).alias("s"), F.count("*").alias("k")
    )
    return docs.select(key, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("chars")).join(found, key, "left").select(
        key, "chars", F.coalesce("s", F.lit(0)).alias("shared_chars"), F.coalesce("k", F.lit(0)).alias("spans")
    )
