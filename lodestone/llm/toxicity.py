"""Abusive, hateful and sexual language by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.leakage import LOOK_ALIKES
from lodestone.llm.sentences import sentence_spans
from lodestone.schema import require_columns

KINDS = ("abusive", "hateful", "sexual")
BLOCK = 64

# --- fixed values: signs that stand for letters in masked words ---
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"}
# --- end of fixed values ---

_LOOK = str.maketrans(LOOK_ALIKES)
_SIGN = str.maketrans(SIGNS)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_TAG = re.compile(r"<[^<>]{0,500}>")
_MASKED = re.compile(r"(?<![\w@$])(?=[\w@$!|€]*[a-z])(?=[\w@$!|€]*[0-9@$!|€])[a-z0-9@$!|€]{3,}")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]{1,2}){2,}[^\W\d_](?![^\W_])")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[぀-ヿ㐀-䶿一-鿿]|[^\W_]+(?:\*+[^\W_]*)*")
_NUMBER = re.compile(r"\d+")


def unmask(text: str) -> str:
    """Lower case without accents; look-alikes, signs for letters, stretched and spaced-out words written plainly."""
    t = _TAG.sub(" ", text).lower() if "<" in text else text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", _HIDDEN.sub("", t))
        t = "".join(c for c in t if not unicodedata.combining(c)).translate(_LOOK)
    t = _MASKED.sub(lambda m: m[0].rstrip("!").translate(_SIGN) if not m[0].rstrip("!").isalnum() or any(c.isdigit() for c in m[0].rstrip("!")[:-1]) else m[0], t)
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), t)
    return _REPEAT.sub(r"\1", t)


def features(sentence: str) -> list[str]:
    """Words and pairs of neighbouring words of a sentence, numbers alike."""
    w = [_NUMBER.sub("9", x) for x in _TOKEN.findall(unmask(sentence))]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _key(f: list[str]) -> str:
    return " ".join(f[: (len(f) + 1) // 2])


class BlockMaxIndex:
    """Inverted lists of unit TF-IDF vectors over blocks of neighbouring examples, each list with its largest weight per block.

    ``nearest`` is exact. Terms are split by their largest weight: the small ones together cannot lift an example over the
    threshold, so only the others' lists are read; an example goes on if what it has so far plus the block maxima of the
    small terms can reach the threshold, and is then scored in full.
    """

    def __init__(self, examples: Sequence[list[str]], like: BlockMaxIndex | None = None):
        """``like``: an index over more examples whose term weights are taken."""
        self.n = len(examples)
        df = Counter(t for x in examples for t in set(x))
        self.terms = {t: i for i, t in enumerate(df)}
        self.idf = like.idf if like else {t: math.log((1 + self.n) / (1 + c)) + 1 for t, c in df.items()}
        self.unknown = like.unknown if like else math.log(1 + self.n) + 1
        self.blocks = (self.n + BLOCK - 1) // BLOCK
        vectors = [self._vector(x) for x in examples]
        self.starts = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(v) for v in vectors], out=self.starts[1:])
        self.columns = np.fromiter((self.terms[t] for v in vectors for t in v), np.int32, int(self.starts[-1]))
        self.weights = np.fromiter((w for v in vectors for w in v.values()), np.float32, int(self.starts[-1]))
        order = np.argsort(self.columns, kind="stable")
        self.ids = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.starts))[order]
        self.list_weights = self.weights[order]
        self.list_starts = np.zeros(len(self.terms) + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=len(self.terms)), out=self.list_starts[1:])
        # block maxima of all lists, end to end
        key = np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.list_starts)) * max(1, self.blocks) + self.ids // BLOCK
        at = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
        self.tops = np.maximum.reduceat(self.list_weights, at) if len(at) else np.zeros(0, np.float32)
        self.top_blocks = (key[at] % max(1, self.blocks)).astype(np.int32)
        self.top_starts = np.searchsorted(key[at] // max(1, self.blocks), np.arange(len(self.terms) + 1))
        self.largest = np.maximum.reduceat(self.list_weights, self.list_starts[:-1]).tolist() if len(self.terms) else []
        self._query = np.zeros(len(self.terms) + 1, np.float32)

    def _vector(self, terms: Iterable[str]) -> dict[str, float]:
        tf = Counter(terms)
        v = {t: (1 + math.log(c)) * self.idf.get(t, self.unknown) for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def nearest(self, terms: Sequence[str], k: int, least: float) -> list[tuple[float, int]]:
        """The ``k`` examples of the largest cosine, at least ``least`` (above 0); ties go to the earlier example."""
        q = sorted((w * self.largest[j], j, w) for t, w in self._vector(terms).items() if (j := self.terms.get(t)) is not None)
        if not q or not self.n:
            return []
        small, rest = 0, 0.0
        while small < len(q) and rest + q[small][0] < 0.6 * least:
            rest += q[small][0]
            small += 1
        acc = np.zeros(self.n, np.float32)
        for _, j, w in q[small:]:
            s, e = self.list_starts[j], self.list_starts[j + 1]
            acc[self.ids[s:e]] += np.float32(w) * self.list_weights[s:e]
        eps = 1e-5
        found = np.flatnonzero(acc >= least - rest - eps)
        if small and len(found):
            bound = np.zeros(self.blocks, np.float32)
            for _, j, w in q[:small]:
                s, e = self.top_starts[j], self.top_starts[j + 1]
                bound[self.top_blocks[s:e]] += np.float32(w) * self.tops[s:e]
            found = found[acc[found] + bound[found // BLOCK] >= least - eps]
        if not len(found):
            return []
        # the k-th best of what is known so far is a floor: whoever cannot reach it with its block's maxima is out
        if len(found) > 4 * k:
            floor = np.partition(acc[found], len(found) - k)[len(found) - k]
            reach = acc[found] + (bound[found // BLOCK] if small else 0)
            found = found[reach >= floor - eps]
        for _, j, w in q:
            self._query[j] = w
        lengths = self.starts[found + 1] - self.starts[found]
        first = np.cumsum(lengths) - lengths
        places = np.repeat(self.starts[found] - first, lengths) + np.arange(int(lengths.sum()))
        scores = np.add.reduceat(self._query[self.columns[places]] * self.weights[places], first)
        for _, j, _ in q:
            self._query[j] = 0
        scores = np.round(scores.astype(np.float64), 5)
        keep = np.flatnonzero(scores >= least)
        keep = keep[np.lexsort((found[keep], -scores[keep]))][:k]
        return [(float(scores[i]), int(found[i])) for i in keep]


class Voter:
    """Labelled sentences with their index; scores a text by the votes of each sentence's nearest examples.

    A labelled document says that some sentence of it is of a kind, not which. Each sentence of such a document takes
    part in the document's label as far as its neighbours in other documents vote for the kind, relative to the
    document's strongest sentence; a sentence without neighbours may be the one (0.5). This is repeated ``rounds`` times.
    """

    def __init__(self, documents: Sequence[tuple[str, dict[str, float]]], k: int = 15, least: float = 0.35, shrink: float = 1.0, rounds: int = 4):
        """``documents``: (text, share of raters for each kind)."""
        rows: dict[str, list] = {}
        for n, (text, label) in enumerate(documents):
            for s, e in sentence_spans(text):
                f = features(text[s:e])
                if len(f) >= 3:
                    # the same sentence in several documents is one example
                    rows.setdefault(_key(f), [f, text[s:e], {}])[2][n] = None
        ordered = [rows[x] for x in sorted(rows)]
        self.index = BlockMaxIndex([r[0] for r in ordered])
        self.text = [r[1] for r in ordered]
        docs = [list(r[2]) for r in ordered]
        self.count = [len(x) for x in docs]
        self.k, self.least, self.shrink = k, least, shrink
        total = max(1, len(documents))
        self.base = [sum(label.get(kind, 0.0) for _, label in documents) / total for kind in KINDS]
        self.share = [[0.0] * len(KINDS) for _ in docs]
        self.cache: dict[str, tuple[list[float], int]] = {}
        positive = {n for n, (_, label) in enumerate(documents) if any(label.get(kind, 0.0) > 0 for kind in KINDS)}
        near = {i: self.index.nearest(ordered[i][0], k, least) for i, d in enumerate(docs) if not positive.isdisjoint(d)}
        inside: dict[int, list[int]] = {}
        for i, d in enumerate(docs):
            for n in d:
                if n in positive:
                    inside.setdefault(n, []).append(i)
        holds = [frozenset(d) for d in docs]
        for c, kind in enumerate(KINDS):
            label = {n: documents[n][1].get(kind, 0.0) for n in positive if documents[n][1].get(kind, 0.0) > 0}
            part = {(n, i): x for n, x in label.items() for i in inside.get(n, ())}
            for _ in range(rounds):
                sums = [0.0] * len(docs)
                for (n, i), x in part.items():
                    sums[i] += x
                fresh = {}
                for n, x in label.items():
                    score = {}
                    for i in inside.get(n, ()):
                        mass, votes = 0.5, 0.25
                        for cos, j in near[i]:
                            m = self.count[j] - (n in holds[j])
                            if m:
                                w = cos * cos * min(m, 3)
                                mass += w
                                votes += w * (sums[j] - part.get((n, j), 0.0)) / m
                        score[i] = votes / mass
                    top = max(score.values(), default=1.0) or 1.0
                    # a document whose strongest sentence has little for it was probably labelled wrongly
                    trust = min(1.0, top / 0.45) ** 2
                    for i, v in score.items():
                        fresh[n, i] = x * trust * (v / top) ** 3
                part = fresh
            for (n, i), x in part.items():
                self.share[i][c] += x / self.count[i]
        self.share = [[0.0 if x < 0.15 else x for x in r] for r in self.share]
        # most sentences are near no example of a kind; the few such examples have an index of their own, with the same weights
        self.of_kinds = BlockMaxIndex([r[0] for r, share in zip(ordered, self.share) if max(share) > 0], self.index)
        #: For each term the largest weight among examples of a kind: what they can at most have in common with a sentence.
        self.tops: dict[str, float] = {}
        for r, share in zip(ordered, self.share):
            if max(share) > 0:
                for t, w in self.index._vector(r[0]).items():
                    if w > self.tops.get(t, 0.0):
                        self.tops[t] = w

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def sentence(self, text: str) -> tuple[list[float], int]:
        """Score of each kind, and the nearest example that voted for one (-1: none; then the scores are 0)."""
        f = features(text)
        if len(f) < 3:
            return [0.0] * len(KINDS), -1
        get = self.tops.get
        if not any(map(get, f)):
            return [0.0] * len(KINDS), -1
        key = _key(f)
        hit = self.cache.get(key)
        if hit is None:
            hit = self._votes(f)
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[key] = hit
        return hit

    def _votes(self, f: list[str]) -> tuple[list[float], int]:
        get = self.tops.get
        if sum(w * get(t, 0.0) for t, w in self.index._vector(f).items()) < self.least:
            return [0.0] * len(KINDS), -1  # no example of a kind is near enough to vote
        if not self.of_kinds.nearest(f, 1, self.least):
            return [0.0] * len(KINDS), -1
        mass, votes, first = self.shrink, [self.shrink * b for b in self.base], -1
        for cos, i in self.index.nearest(f, self.k, self.least):
            w = cos * cos * min(self.count[i], 3)
            mass += w
            votes = [v + w * s for v, s in zip(votes, self.share[i])]
            if first < 0 and max(self.share[i]) > 0:
                first = i
        return ([v / mass for v in votes] if first >= 0 else [0.0] * len(KINDS)), first

    def document(self, text: str | None) -> tuple[list[float], list[str | None], list[float | None]]:
        """Per kind: the score of the worst sentence and that sentence."""
        best, said = [0.0] * len(KINDS), [None] * len(KINDS)
        if text:
            for s, e in sentence_spans(text):
                scores, _ = self.sentence(text[s:e])
                for i, x in enumerate(scores):
                    if x > best[i]:
                        best[i], said[i] = x, text[s:e]
        return best, said, []


def fit_voter(documents: DataFrame, key: str, text_col: str, labels: DataFrame, label_col: str, max_positive: int = 12_000, max_none: int = 12_000, **options) -> Voter:
    """Fit on at most ``max_positive`` documents with a kind and ``max_none`` without, those with the smallest key hashes.

    A document's label is the share of its raters for each kind; null and unknown labels do not count.
    """
    require_columns(documents, [key, text_col], "fit_voter")
    require_columns(labels, [key, label_col], "fit_voter")
    low = F.lower(F.trim(label_col))
    known = labels.filter(low.isin("none", *KINDS) & F.col(key).isNotNull())
    rated = known.groupBy(key).agg(*[F.avg(F.when(low == k, 1.0).otherwise(0.0)).alias(f"_{k}") for k in KINDS]).withColumn("_any", F.greatest(*[f"_{k}" for k in KINDS]) > 0).withColumn("_h", F.xxhash64(key))
    picked = rated.filter("_any").orderBy("_h", key).limit(max_positive).unionAll(rated.filter("not _any").orderBy("_h", key).limit(max_none))
    rows = documents.select(key, text_col).join(F.broadcast(picked), key).filter(F.col(text_col).isNotNull()).orderBy("_h", key).collect()
    return Voter([(r[text_col], {k: r[f"_{k}"] for k in KINDS}) for r in rows], **options)


def score_documents(documents: DataFrame, key: str, text_col: str, voter: Voter, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, kind, score, evidence``: for each document and kind the score of its worst sentence, and the sentence.

    The voter is fitted on a bounded number of labelled documents and broadcast. Null, empty and wordless texts score 0
    without evidence. No shuffle.
    """
    require_columns(documents, [key, text_col, *keep], "score_documents")
    cols = [key, *keep]
    shared = documents.sparkSession.sparkContext.broadcast(voter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            at, kinds, scores, said = [], [], [], []
            for i, text in enumerate(b.column(len(cols)).to_pylist()):
                best, evidence, _ = v.document(text)
                at += [i] * len(KINDS)
                kinds += KINDS
                scores += best
                said += evidence
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(at, pa.int64())) for j in range(len(cols))), pa.array(kinds, pa.string()), pa.array(scores, pa.float64()), pa.array(said, pa.string())], [*cols, "kind", "score", "evidence"])

    out = T.StructType([T.StructField(c, documents.schema[c].dataType) for c in cols] + [T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.StringType())])
    return documents.select(*cols, F.col(text_col).alias("_text")).mapInArrow(run, out)
