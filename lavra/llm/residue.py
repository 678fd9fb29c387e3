"""Problem 1: template residue, filler and error pages in place of content.

Each line of a text is one instance for an L2-regularized logistic regression on hashed character n-grams, with length and
title features. Weak labels come from response statuses and general phrases, and from where they stand: a phrase among full
sentences, or in quotes, is only spoken of. A first fit, in which the wordings of mentions and of messages are told apart
by which label most of them have, cleans these labels; then the lines beside messages, which have no phrase but stand in no
record without one, are positive too, and the model is fitted again. So it learns wordings that no phrase lists. It is
validated on hosts that gave no training line, and with whole families of phrases left out. A record is found if
one of its lines is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.llm.rolling import Texts, mix
from lavra.session import Scratch, spread

#: At most about so many lines of each of four kinds (positive, mention, without a phrase, beside positive ones) are fitted, and as
#: many again validated.
SAMPLE = 6_000
#: One host of so many is kept for validation.
HELD_OUT = 5
GRAMS = (3, 6)
BITS = 18
CHUNK = 100_000
#: From so many characters in sentences without a phrase on, a record has real content. A sentence is a line of at least so many
#: characters that ends in a stop.
REAL_CHARS, SENTENCE_CHARS = 500, 70
#: See :func:`learn`.
BESIDE = 0.02
# What weak labels go by, in lower case. General wordings of servers, frameworks and templates.
FAMILIES = {
    "fields": r"\{\{[^}]*\}\}|\$\{[^}]*\}|#\{[^}]*\}|\{%[^%]*%\}|<<[^>]+>>|@@\w+@@|%[^\W\d]{3,}%|\[(?:inserir|preencher|informar|digitar)\b[^\]]*\]|\[[^\]]* aqui\]|x{4,}",
    "filler": r"(?:\b(?:lorem|ipsum|dolore?|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|magna|aliqua)\b\W+){4}|texto de exemplo|sample text|clique para editar|click to edit|em construção|under construction|conteúdo em breve|coming soon",
    "status": r"^[#\s]*(?:(?:http|erro|error|status)\s*)?[45][0-9]{2}\b|server error|página (?:inexistente|não encontrada)|not found|não foi encontrad|acesso negado|access denied|forbidden|(?:sessão|session)\b.{0,40}\bexpir|temporariamente indisponível|temporarily unavailable|em manutenção|under maintenance",
    "traces": r"traceback|stack trace|fatal error|^warning:|\w(?:error|exception):|\bundefined\b|\[object object\]|\bnan\b",
    "scripts": r"javascript|noscript|\bscripts\b|checking your browser",
}
#: A phrase in quotes is spoken of.
_QUOTED = r"[`“”«»]"
#: Every match of a family has one of these.
SEEDS = (
    "{{", "${", "#{", "{%", "<<", "@@", "%", "[inserir", "[preencher", "[informar", "[digitar", " aqui]", "xxxx", "lorem", "ipsum", "dolor", "sit ", "amet", "consectetur", "adipisc", "eiusmod", "tempor ", "incididunt", "labore", "magna ", "aliqua",
    "texto de exemplo", "sample text", "clique para editar", "click to edit", "em construção", "under construction", "conteúdo em breve", "coming soon",
    "40", "41", "42", "43", "44", "45", "50", "51", "52", "53", "server error", "página inexistente", "não encontrada", "not found", "não foi encontrad", "acesso negado", "access denied",
    "forbidden", "expir", "temporariamente", "temporarily", "manutenção", "maintenance", "traceback", "stack trace", "fatal error", "warning:", "error:", "exception:",
    "undefined", "[object", "nan", "javascript", "noscript", "scripts", "checking your browser",
)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for s in SEEDS:
        found.add_word(s, 1)
    found.make_automaton()
    return found


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    return {k: re.compile(v) for k, v in FAMILIES.items()}


def families(line: str) -> list[str]:
    """The families whose phrases ``line`` (lower case) has."""
    if next(_automaton().iter(line), None) is None:
        return []
    text = " ".join(line.split())
    return [k for k, p in _patterns().items() if p.search(text)]


def weak_labels(text: str) -> list[tuple[int, str, int | None]]:
    """(line number, line, kind) of a text's lines in lower case: kind 1 positive, 0 a mention, 3 beside positive lines, NULL without a
    phrase.

    Fields that nobody filled in are positive wherever they stand unquoted; messages and filler only in a record that has
    less than :data:`REAL_CHARS` of sentences without a phrase.
    """
    lines = [(k, x) for k, x in enumerate(text.lower().split("\n")) if x and not x.isspace()]
    if next(_automaton().iter(text.lower()), None) is None:
        return [(k, x, None) for k, x in lines]
    held = {k: f for k, x in lines if (f := families(x))}
    real = sum(len(x) for k, x in lines if len(x) >= SENTENCE_CHARS and x.rstrip().endswith(".") and k not in held) >= REAL_CHARS
    out: list[tuple[int, str, int | None]] = []
    for k, x in lines:
        if k in held:
            out.append((k, x, 0 if re.search(_QUOTED, x) or (real and "fields" not in held[k]) else 1))
        else:
            out.append((k, x, None))
    # Only whole messages make their neighbours positive.
    if not real and any(kind == 1 and "fields" not in held[k] for k, _, kind in out):
        out = [(k, x, 3 if kind is None else kind) for k, x, kind in out]
    return out


def masked(line: str) -> str:
    """The line without what differs from record to record: numbers and hexadecimal codes."""
    return re.sub(r"[0-9a-f]*[0-9][0-9a-f]*", "0", " ".join(line.split()))


def labelled(rate: float):
    """mapInPandas over (key, host, text): (key, line, kind, held, draw): lines with a kind of :func:`weak_labels`, and the part ``rate``
    of the lines without (kind 2). ``draw`` is even in [0, 1) and depends on key and line only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, host, text in zip(batch["key"], batch["host"], batch["text"], strict=True):
                held = zlib.crc32((host or "").encode()) % HELD_OUT == 0
                for k, line, kind in weak_labels(text):
                    draw = zlib.crc32(b"%d %d" % (key, k)) / 2**32
                    if kind is not None:
                        rows.append((key, line, kind, held, draw))
                    elif draw < rate:
                        rows.append((key, line, 2, held, draw / rate))
            yield pd.DataFrame(rows, columns=["key", "line", "kind", "held", "draw"])

    return run


class Features:
    """Hashed n-grams of many lines: for each gram its line and its place in the weights."""

    def __init__(self, lines: list[str]):
        t = Texts([f"\n{x}\n" for x in lines])
        digit = (t.chars >= 48) & (t.chars <= 57)
        t.chars = np.where(digit, 48, np.where(t.chars == 160, 32, t.chars)).astype(np.uint32)
        row = np.repeat(np.arange(len(lines)), t.sizes)
        mask = np.uint64((1 << BITS) - 1)
        rows, places = [], []
        for n in GRAMS:
            at = np.flatnonzero(np.arange(t.n) + n <= t.end_at)
            places.append((t.hashes(at, n) & mask).astype(np.int64))
            rows.append(row[at])
        # Length and title features take places of their own.
        size = np.minimum(np.log2(t.sizes).astype(np.int64), 9)
        title = np.array([1 if x.lstrip().startswith("#") else 0 for x in lines], dtype=np.int64)
        extra = mix((size * 2 + title + 77).astype(np.uint64)) & mask
        self.rows = np.concatenate([*rows, np.arange(len(lines))])
        self.places = np.concatenate([*places, extra.astype(np.int64)])
        self.n = len(lines)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=weights[self.places], minlength=self.n) + weights[-1]


def fit(lines: list[str], labels: np.ndarray, l2: float = 1e-4, rounds: int = 120) -> np.ndarray:
    """Weights of a logistic regression with an L2 penalty, the intercept last; Adam over the whole sample."""
    x = Features(lines)
    w = np.zeros((1 << BITS) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    # Both classes weigh the same.
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for k in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(x.scores(w), -30, 30))) - labels) * share
        g = np.bincount(x.places, weights=error[x.rows], minlength=len(w))
        g[-1] = error.sum()
        g += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return w


def learn(own: pd.DataFrame) -> np.ndarray | None:
    """The weights from a sample (key, line, kind, times); NULL without a positive or a negative line.

    Labels are cleaned by models that didn't see them: each half of the records is scored by a fit on the other half. A positive
    line that scores as a negative one is taken as a mention. A line beside messages is positive if it scores higher than all but
    :data:`BESIDE` of the lines without a phrase, and no record without a phrase has it.
    """
    own = own.reset_index(drop=True)
    kind, lines = own["kind"].to_numpy(), own["line"].tolist()
    fitted = kind != 3
    labels = (kind == 1).astype(float)
    if not 0 < labels.sum() < fitted.sum():
        return None
    half = own["key"].map(lambda k: zlib.crc32(b"half %d" % k) % 2).to_numpy()

    def unseen(used: np.ndarray) -> np.ndarray:
        """The score of each line by a fit on those of the other half that are ``used``."""
        scores = np.where(labels == 1, 1.0, -1.0)
        for h in (0, 1):
            at, seen = np.flatnonzero(half == h), np.flatnonzero(used & (half != h))
            if len(at) and 0 < labels[seen].sum() < len(seen):
                scores[at] = Features([lines[k] for k in at]).scores(fit([lines[k] for k in seen], labels[seen]))
        return scores

    scores = unseen(fitted)
    labels *= scores > 0
    if not labels.sum():
        return None
    common = {masked(x) for x, k in zip(lines, kind, strict=True) if k == 2}
    least = np.quantile(scores[kind == 2], 1 - BESIDE) if (kind == 2).any() else 0.0
    confirmed = own["key"].isin(own.loc[labels > 0, "key"]).to_numpy()
    beside = (kind == 3) & confirmed & (scores > least) & ~own["line"].map(masked).isin(common).to_numpy()
    labels[beside] = 1.0
    # A line without a phrase that stands once and scores as a positive one tells nothing.
    used = fitted | beside
    used &= (kind != 2) | (unseen(used) <= 0) | (own["times"] > 1).to_numpy()
    chosen = np.flatnonzero(used)
    return fit([lines[k] for k in chosen], labels[chosen])


def sampled(docs: DataFrame, key: str, text: str, host: str, scratch: Scratch) -> pd.DataFrame:
    """The sample of labelled lines (key, line, kind, held: of unseen hosts, times), which is all that comes to the driver."""
    own = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    # Of the lines without a phrase some from each of so many documents are enough.
    rate = min(1.0, SAMPLE / max(1, docs.count()))
    lines = scratch.write(spread(own).mapInPandas(labelled(rate), "key BIGINT, line STRING, kind INT, held BOOLEAN, draw DOUBLE"), "labelled")
    rate = F.lit(0.0)
    for r in lines.groupBy("kind", "held").agg(F.count("*").alias("n")).collect():
        rate = F.when((F.col("kind") == r.kind) & (F.col("held") == r.held), F.lit(min(1.0, SAMPLE / r.n))).otherwise(rate)
    sample = lines.where(F.col("draw") < rate).groupBy("line", "kind", "held").agg(F.min("key").alias("key"), F.count("*").alias("times")).toPandas()
    return sample.sort_values(["kind", "line"], ignore_index=True)


def _found(weights: np.ndarray | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, hit = batch["key"].to_numpy(), np.zeros(len(batch), dtype=bool)
            who, lines, n = [], [], 0

            def settle() -> None:
                if lines and weights is not None:
                    hit[np.array(who)[Features(lines).scores(weights) > 0]] = True
                who.clear()
                lines.clear()

            for k, text in enumerate(batch["text"]):
                for line in text.lower().split("\n"):
                    if line and not line.isspace():
                        who.append(k)
                        lines.append(line)
                        n += len(line)
                if n > CHUNK:
                    settle()
                    n = 0
            settle()
            yield pd.DataFrame({"key": keys[hit]})

    return run


def residue(docs: DataFrame, key: str = "md_id", text: str = "body", host: str = "source") -> DataFrame:
    """(key): the records whose text has template residue, filler, an error or access message or a notice that scripts
    are required.

    NULL and empty texts are no cases. If the weak labels give no positive or no negative line, there is nothing to
    learn from and no record is found. Keys must be unique BIGINTs; other columns are ignored.
    """
    sample = sampled(docs, key, text, host, Scratch(docs.sparkSession, "residue"))
    weights = learn(sample[~sample["held"]])
    small = None if weights is None else weights.astype(np.float32)
    own = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return spread(own).mapInPandas(_found(small), "key BIGINT").withColumnRenamed("key", key)


def validation(docs: DataFrame, key: str = "md_id", text: str = "body", host: str = "source") -> DataFrame:
    """(left_out, held_out, label, prediction, lines): the model against the weak labels.

    ``left_out`` '' is the model itself, on its own hosts and on unseen ones. Otherwise it is a model that saw no line with a phrase of
    that family (nor lines beside such), and the lines are the positive ones of the family.
    """
    spark = docs.sparkSession
    sample = sampled(docs, key, text, host, Scratch(spark, "validation"))
    sample["label"] = (sample["kind"] == 1).astype(int)

    def compare(names: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = sample[sample["kind"] != 3]
        kinds = plain["line"].map(families)
        for name in (n for batch in names for n in batch["name"]):
            if name:
                has = kinds.map(lambda f, name=name: name in f).astype(bool)
                own, rest = plain[has & (plain["label"] == 1)], sample.drop(plain.index[has])
                # Lines beside the family's own ones stay only if another family stands there too.
                seen = rest[(rest["kind"] != 3) | rest["key"].isin(rest.loc[rest["kind"] == 1, "key"])]
            else:
                own, seen = plain, sample[~sample["held"]]
            weights = learn(seen)
            guess = np.zeros(len(own), dtype=int) if weights is None or not len(own) else (Features(own["line"].tolist()).scores(weights) > 0).astype(int)
            counts = pd.DataFrame({"held": own["held"].to_numpy(dtype=bool), "label": own["label"].to_numpy(), "guess": guess}).value_counts()
            rows = [(name, bool(h), int(a), int(b), int(n)) for (h, a, b), n in counts.items()]
            yield pd.DataFrame(rows, columns=["left_out", "held_out", "label", "prediction", "lines"])

    # The models are fitted side by side; the sample, which has a bound, goes to each task.
    names = spark.range(0, 1 + len(FAMILIES), 1, 1 + len(FAMILIES)).select(F.element_at(F.array(*[F.lit(n) for n in ("", *FAMILIES)]), (F.col("id") + 1).cast("int")).alias("name"))
    return names.mapInPandas(compare, "left_out STRING, held_out BOOLEAN, label INT, prediction INT, lines BIGINT")
