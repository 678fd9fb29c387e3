"""Problem 3: repair of text from scanned pages.

Skip-gram vectors are trained on running text, and with them a linear map from the mean vector of the words around a place to the
vector of the word that stands there. So a word that the lexicon lacks, however rare, has a place in the vector space: its
neighbours there are the lexicon's words nearest to what its context calls for. It is linked to the nearest of its neighbours that
plausible glyph edits make of it (both have the same skeleton); a word without such a neighbour stays as it is. Running headers, footers and page numbers are found by how large a share of all
documents, or of those of their source, has the line (numbers aside), and by their place. What is left is joined
where words are cut, corrected and reflowed into paragraphs.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lavra.operators.skew import join_counted
from lavra.session import Scratch, spread

#: A line that this share of all documents has, or of the documents of its source, is a running line.
SHARE_ALL, SHARE_SOURCE = 0.01, 0.04
#: The lexicon is sent to every task; it is a language's word list and has at most so many words.
MOST_WORDS = 500_000
#: Neighbours of a place are this share of the lexicon's words, the nearest; known words are hardly ever outside of it.
NEAR = 0.9
# Glyphs that scans confuse, each written as what all of its readings have in common.
_GLYPHS = str.maketrans({"0": "o", "1": "l", "i": "l", "2": "z", "5": "s", "6": "o", "8": "b", "h": "b", "ﬁ": "tl", "ﬂ": "tl", "9": "g", "c": "e", "f": "t", "q": "g", "m": "rrl", "n": "rl", "u": "ll", "d": "el", "|": "l", "!": "l"})
_CUT = re.compile(r"([^\W\d_][\w|!]*(?:-[\w|!]+)*)([-­¬‐‑])\s*$")
_CUT_SIGNS = "-\xad¬\u2010\u2011"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER_LINE = re.compile(r"^(?:\W*(?:p[aá]g(?:ina)?|fls?|folhas?|fol)\b\W*)?[\[(–—-]*\s*(\d{1,5})\s*(?:(?:/|de)\s*\d{1,5})?\s*[\])–—-]*$", re.I)
_WORD2 = re.compile(r"[^\W\d_]{2,}")
_ROMAN_LINE = re.compile(r"^[ivxlc]+$", re.I)


def bare(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@lru_cache(maxsize=1 << 17)
def skeleton(word: str) -> str:
    """What a word has in common with all words that plausible glyph edits make of it."""
    return bare(word).translate(_GLYPHS)


@lru_cache(maxsize=1 << 17)
def core(token: str) -> str:
    """The token in lower case without punctuation at its ends."""
    return _EDGE.sub("", token).lower()


@lru_cache(maxsize=1 << 17)
def has_letter(token: str) -> bool:
    return re.search(r"[^\W\d_]", token) is not None


def cut_word(line: str) -> re.Match | None:
    """The last word of a line with the sign that cuts it; NULL if it isn't cut."""
    end = line.rstrip()
    return _CUT.search(end.rsplit(None, 1)[-1]) if end[-1:] in _CUT_SIGNS and end else None


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Lexicon:
    """Words, their skeletons, unit vectors, and the map from the mean vector of a context to a word's vector."""

    def __init__(self, words: dict[str, int], vectors: dict[str, np.ndarray] | None = None, context: np.ndarray | None = None):
        self.words, self.vectors, self.context = words, vectors or {}, context
        self.by_skeleton: dict[str, list[str]] = {}
        for w in sorted(words):
            self.by_skeleton.setdefault(skeleton(w), []).append(w)
        self.place = {w: k for k, w in enumerate(sorted(self.vectors))}
        self.all = np.array([self.vectors[w] for w in self.place], dtype=np.float32)
        self._held: dict[str, bool] = {}

    def nearness(self, around: list[str]) -> np.ndarray | None:
        """The cosine of each word of :attr:`place` with what the context calls for; NULL without a known word in it."""
        near = [self.place[w] for w in around if w in self.place]
        if not near or self.context is None:
            return None
        wanted = self.all[near].mean(axis=0) @ self.context
        return self.all @ (wanted / (np.linalg.norm(wanted) or 1))

    def correct(self, word: str, around: list[str]) -> str | None:
        """The neighbour, of those with the skeleton of ``word``, that is nearest to what the words ``around`` call for; NULL if it has none.

        Words too seldom for a vector, and places without a known word around, are judged by frequency alone.
        """
        found = self.by_skeleton.get(skeleton(word), ())
        if not found:
            return None
        cosines = self.nearness(around)
        if cosines is None:
            return max(found, key=lambda w: self.words[w])
        least = np.partition(cosines, int((1 - NEAR) * len(cosines)))[int((1 - NEAR) * len(cosines))]
        fits = [(float(cosines[self.place[w]]) if w in self.place else float(least), self.words[w], w) for w in found]
        best = max(fits)
        return best[2] if best[0] >= least else None

    def holds(self, word: str) -> bool:
        """Whether the word is in the lexicon or may be misread from one of its words."""
        known = self._held.get(word)
        if known is None:
            if len(self._held) > 1 << 17:
                self._held.clear()
            known = self._held[word] = word in self.words or skeleton(word) in self.by_skeleton
        return known

    def shape(self, line: str) -> str:
        """The line with numbers masked and the lexicon's words as ``w``, others by their skeleton."""
        out = []
        for t in line.split():
            if not has_letter(t):
                out.append(re.sub(r"\d+", "#", t))
            else:
                out.append("w" if self.holds(core(t)) else skeleton(t))
        return re.sub(r"\bw(?: w\b)+", "w", " ".join(out))


def line_signs(line: str, lexicon: Lexicon) -> list[int]:
    """Signatures under which a line is counted: itself with numbers masked, and its shape."""
    text = line.strip("\x0c \t\r ")
    if not text or text[-1] in ".,;:" or cut_word(text) or not has_letter(text) or _ROMAN_LINE.match(text):
        return []
    masked = " ".join(skeleton(t) if has_letter(t) else re.sub(r"\d+", "#", t) for t in text.split())
    signs = [_hash(masked)]
    shape = lexicon.shape(text) if re.search(r"[–—|]", text) else ""
    if re.search(r"[^\W\d_]{3,}", re.sub(r"\bw\b", "", shape)) and re.search(r"[–—|]", shape):
        signs.append(_hash("shape " + shape))
    return signs


def is_foreign(text: str, lexicon: Lexicon) -> bool:
    """Whether two of a line's words or more, and a quarter of them, are none of the lexicon's: names, not running text."""
    if text[-1:] in ".,;:" or cut_word(text):
        return False
    words = [w for w in map(core, text.split()) if _WORD2.search(w)]
    alien = sum(not lexicon.holds(w) for w in words)
    return alien >= 2 and alien >= 0.25 * len(words)


def _alike(a: str, b: str) -> bool:
    match = SequenceMatcher(None, a, b, autojunk=False)
    return match.quick_ratio() > 0.85 and match.ratio() > 0.85


def running_lines(lines: list[str], known: set[int], lexicon: Lexicon) -> list[bool]:
    """For each line whether it is a running header, a footer or a page number."""
    clean = [x.strip("\x0c \t\r ") for x in lines]
    drop = [False] * len(lines)
    title = skeleton(clean[0].lstrip("# ")) if clean else ""
    for k in range(1, len(lines)):
        if not clean[k]:
            continue
        again = abs(len(clean[k]) - len(clean[0].lstrip("# "))) <= 3 and _alike(skeleton(clean[k]), title)
        drop[k] = again or is_foreign(clean[k], lexicon) or any(s in known for s in line_signs(lines[k], lexicon))
    solid = [k for k in range(len(lines)) if clean[k]]
    place = {k: i for i, k in enumerate(solid)}

    def label(k: int) -> bool:
        """A short line of words such as a table's row has before its number."""
        text = clean[k]
        return bool(text) and not drop[k] and len(text) < 50 and text[0].isupper() and text[-1].isalpha() and len(text.split()) <= 4 and not any(c in ".,;" for c in text)

    for i, k in enumerate(solid):
        if not k or drop[k]:
            continue
        m = _NUMBER_LINE.match(clean[k])
        if m is None and not _ROMAN_LINE.match(clean[k]):
            continue
        if m is not None and clean[k] != m.group(1):
            drop[k] = True  # with a word, brackets, dashes or a total: a page number
            continue
        if lines[k].startswith("\x0c"):
            drop[k] = True
            continue
        before = solid[i - 1]
        if m is not None and label(before) and place[before] + 1 == i and before == k - 1:
            continue  # a table's number
        # The row's label may stand before the page's furniture, and its number after it.
        j = i - 1
        seen_number = False
        while j > 0 and drop[solid[j]]:
            seen_number = seen_number or bool(_NUMBER_LINE.match(clean[solid[j]]))
            j -= 1
        if m is not None and j < i - 1 and seen_number and label(solid[j]):
            continue
        drop[k] = True
    return drop


class Repair:
    """One document's lines, what is wrong with them, and its paragraphs."""

    def __init__(self, body: str, known: set[int], lexicon: Lexicon):
        self.lines = body.split("\n")
        self.lexicon = lexicon
        self.drop = running_lines(self.lines, known, lexicon)
        self.found: list[tuple[int, str, str]] = [(k + 1, "drop", "") for k, d in enumerate(self.drop) if d]
        self.fixed: list[list[str]] = [x.strip("\x0c").split() if not d else [] for x, d in zip(self.lines, self.drop, strict=True)]
        self._join()
        self._correct()

    def _words(self, k: int) -> list[str]:
        return [core(t) for t in self.fixed[k]]

    def _join(self) -> None:
        self.tails: set[int] = set()  # lines whose first word belongs to the line before
        self.heads: set[int] = set()  # lines whose last word goes on
        live = [k for k in range(len(self.lines)) if self.fixed[k]]
        for k, after in zip(live, live[1:], strict=False):
            m = cut_word(self.lines[k])
            if m is None or k == 0:
                continue
            head, token = m.group(1), self.fixed[after][0]
            tail = re.match(r"[\w|!]+(?:-[\w|!]+)*", token)
            if tail is None:
                continue
            whole = self._whole(head, tail.group(0), m.group(2), self._words(k)[:-1] + self._words(after)[1:4])
            if whole is None:
                continue
            word, exact = whole
            self.found.append((k + 1, "join", word))
            if not exact:
                # The misread glyphs are in the part that the word doesn't begin, or end, with.
                plain = word.replace("-", "")
                if not plain.startswith(head.lower().replace("-", "")):
                    self.found.append((k + 1, "char", word))
                if not plain.endswith(tail.group(0).lower().replace("-", "")):
                    self.found.append((after + 1, "char", word))
            lead = self.fixed[k][-1][: self.fixed[k][-1].rfind(head)] if head in self.fixed[k][-1] else ""
            cased = word[0].upper() + word[1:] if head[:1].isupper() else word
            self.fixed[k][-1] = lead + cased + token[tail.end() :]
            self.fixed[after] = self.fixed[after][1:]
            self.heads.add(k)
            self.tails.add(after)

    def _whole(self, head: str, tail: str, mark: str, around: list[str]) -> tuple[str, bool] | None:
        low, end = head.lower(), tail.lower()
        words = self.lexicon.words
        for word in (low + end, f"{low}-{end}"):
            if word in words:
                return word, True
        for word in (low + end, f"{low}-{end}"):
            right = self.lexicon.correct(word, around)
            if right is not None:
                return right, False
        return None

    def _correct(self) -> None:
        for k, tokens in enumerate(self.fixed):
            low = self._words(k)
            for i, (token, word) in enumerate(zip(tokens, low, strict=True)):
                if not word or word in self.lexicon.words or not has_letter(word) or (k in self.heads and i == len(tokens) - 1):
                    continue
                right = self.lexicon.correct(word, low[max(0, i - 4) : i] + low[i + 1 : i + 5])
                if right is None or bare(word) == bare(right) and word == right:
                    continue
                self.found.append((k + 1, "char", right))
                bulk = _EDGE.sub("", token)
                cased = right.upper() if bulk.isupper() and len(bulk) > 1 else right[0].upper() + right[1:] if bulk[:1].isupper() else right
                tokens[i] = token.replace(bulk, cased, 1)

    def text(self) -> str:
        """The title and paragraphs; a paragraph ends at a blank line, or at a short line that ends a sentence."""
        width = max((len(x) for x, d in zip(self.lines[1:], self.drop[1:], strict=True) if not d), default=0)
        parts: list[list[str]] = []
        fresh = True
        for k, tokens in enumerate(self.fixed):
            if self.drop[k]:
                continue
            if not self.lines[k].strip("\x0c \t"):
                # A blank line next to furniture is the page's end, not the paragraph's.
                page = (k and self.drop[k - 1]) or (k + 1 < len(self.lines) and self.drop[k + 1])
                fresh = fresh or not page or bool(parts and parts[-1] and parts[-1][-1][-1:] in ".:")
                continue
            if fresh or not parts:
                parts.append([])
                fresh = False
            parts[-1].extend(tokens)
            line = self.lines[k].rstrip()
            fresh = k == 0 or (line[-1:] in ".:" and len(line) < 0.8 * width)
        return "\n\n".join(" ".join(p) for p in parts if p)


def _read_lexicon(lexicon: DataFrame) -> dict[str, int]:
    rows = lexicon.where("word <> ''").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"the lexicon has more than {MOST_WORDS} words")
    return {r.word.lower(): r.freq or 0 for r in rows}


def skip_gram(pdfs: DataFrame, words: dict[str, int], size: int = 32, seed: int = 7) -> tuple[dict[str, np.ndarray], np.ndarray | None]:
    """Unit vectors of the lexicon's words, and the map from contexts to words, from the sentences of all documents; none where no word is
    frequent enough."""
    from pyspark.ml.feature import Word2Vec

    bodies = pdfs.where(F.length("body") > 0)
    text = F.regexp_replace(F.lower("body"), r"[-­¬]\s*\n|\n", " ")
    tokens = bodies.select(F.explode(F.split(text, r"(?<=[.;:])\s+")).alias("s"))
    tokens = tokens.select(F.filter(F.split("s", r"(?U)[^\w-]+"), lambda w: w != "").alias("w")).where(F.size("w") > 2)
    scratch = Scratch(pdfs.sparkSession, "sentences")
    tokens = scratch.write(spread(tokens), "tokens")
    try:
        return _trained(tokens, words, size, seed, Word2Vec)
    finally:
        scratch.drop()


def _trained(tokens: DataFrame, words: dict[str, int], size: int, seed: int, Word2Vec) -> tuple[dict[str, np.ndarray], np.ndarray | None]:
    total = tokens.agg(F.sum(F.size("w"))).first()[0] or 0
    if not total:
        return {}, None
    parts = max(1, min(tokens.sparkSession.sparkContext.defaultParallelism, total // 100_000))
    model = Word2Vec(vectorSize=size, minCount=5, numPartitions=int(parts), maxIter=1, windowSize=4, seed=seed, inputCol="w", outputCol="v")
    try:
        vectors = model.fit(tokens).getVectors()
    except Exception as e:  # no word is frequent enough
        if "vocabulary size" not in str(e):
            raise
        return {}, None
    out = {}
    # As many rows as there are frequent words.
    for r in vectors.collect():
        if r.word in words:
            v = np.array(r.vector.toArray(), dtype=np.float32)
            out[r.word] = v / (np.linalg.norm(v) or 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(words, out)
        xx, xy = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            for k in range(0, len(batch), 1000):
                x, y = _contexts(batch["w"].tolist()[k : k + 1000], lex)
                xx += x.T @ x
                xy += x.T @ y
        yield pd.DataFrame({"sums": [np.concatenate([xx.ravel(), xy.ravel()])]})

    if not out:
        return out, None
    # One row of sums from each task.
    added = np.sum([r.sums for r in tokens.mapInPandas(sums, "sums ARRAY<DOUBLE>").collect()] or [np.zeros(2 * size * size)], axis=0).reshape(2, size, size)
    if not added[0].any():
        return out, None
    return out, np.linalg.solve(added[0] + 1e-3 * np.trace(added[0]) / size * np.eye(size), added[1]).astype(np.float32)


def _contexts(sentences: list, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """For each word with a vector that has three such words or more around it: the mean of their vectors, and its own."""
    # Four places without a word part the sentences.
    flat = [-1] * 4
    for sentence in sentences:
        flat += [lexicon.place.get(w, -1) for w in sentence]
        flat += [-1] * 4
    at = np.array(flat)
    mid, near = at[4:-4], [at[4 + d : len(at) - 4 + d] for d in (-4, -3, -2, -1, 1, 2, 3, 4)]
    count = sum((x >= 0).astype(np.int64) for x in near)
    use = (mid >= 0) & (count > 2)
    vectors = np.vstack([lexicon.all, np.zeros((1, lexicon.all.shape[1]), dtype=np.float32)]).astype(np.float64)
    x = np.zeros((int(use.sum()), vectors.shape[1]))
    for n in near:
        x += vectors[n[use]]
    return x / count[use][:, None], vectors[mid[use]]


def _with_known(pdfs: DataFrame, words: dict[str, int], scratch: Scratch, key: str) -> tuple[DataFrame, set[int]]:
    """The documents with the signatures of their source's running lines, and those of all documents."""
    own = pdfs.where(F.length("body") > 0).select(F.col(key).alias("key"), F.coalesce("source", F.lit("")).alias("source"), "body")
    plain = Lexicon(words)

    def signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, body in zip(batch["source"], batch["body"], strict=True):
                title, *lines = body.split("\n")
                rows += [(source, s, _hash(skeleton(title))) for s in {s for line in lines for s in line_signs(line, plain)}]
            yield pd.DataFrame(rows, columns=["source", "sign", "title"])

    # Copies of a document have the same title and count once.
    seen = own.select("source", "body").mapInPandas(signs, "source STRING, sign BIGINT, title BIGINT").distinct()
    counts = seen.groupBy("source", "sign").agg(F.count("*").alias("docs"))
    counts = scratch.write(counts, "signs")
    sources = scratch.write(own.groupBy("source").agg(F.count("*").alias("n")), "sources")
    number = sources.agg(F.sum("n")).first()[0] or 0
    # At most a hundred times the lines of an average document.
    common = counts.groupBy("sign").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= max(3, SHARE_ALL * number))
    shared = {r.sign for r in common.collect()}
    local = counts.join(sources, "source").where((F.col("docs") >= 3) & (F.col("docs") >= SHARE_SOURCE * F.col("n")))
    known = scratch.write(sources.join(local.groupBy("source").agg(F.collect_list("sign").alias("known")), "source", "left"), "known")
    return join_counted(own, known, ["source"], "n", ["key"]), shared


def _apply(pdfs: DataFrame, lexicon: DataFrame, key: str, make, schema: str) -> DataFrame:
    scratch = Scratch(pdfs.sparkSession, "scan")
    words = _read_lexicon(lexicon)
    read, shared = _with_known(pdfs, words, scratch, key)
    vectors, context = skip_gram(pdfs.select("body"), words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon(words, vectors, context)
        for batch in batches:
            rows = []
            for k, body, known in zip(batch["key"], batch["body"], batch["known"], strict=True):
                rows += make(k, Repair(body, shared.union(known.tolist() if known is not None else ()), lex))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return read.select("key", "body", "known").mapInPandas(run, schema).withColumnRenamed("key", key)


def scan_faults(pdfs: DataFrame, lexicon: DataFrame, key: str = "pdf_id") -> DataFrame:
    """(key, line_no, kind, word), distinct: 'drop' lines, 'join' words cut at a line's end, 'char' misread words.

    NULL and empty bodies have no rows. Keys must be unique BIGINTs; columns besides source and body are ignored.
    """
    kind = "key BIGINT, line_no INT, kind STRING, word STRING"
    return _apply(pdfs, lexicon, key, lambda k, r: [(k, *x) for x in sorted(set(r.found))], kind)


def repaired(pdfs: DataFrame, lexicon: DataFrame, key: str = "pdf_id") -> DataFrame:
    """(key, body): continuous paragraphs, without furniture, words whole and corrected. NULL and empty bodies have no row."""
    return _apply(pdfs, lexicon, key, lambda k, r: [(k, r.text())], "key BIGINT, body STRING")
