"""Evaluation texts inside training text: greedy string tiling over normalised words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import require_columns

#: Letters of other scripts, in lower case and without accents, and the Latin letters they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
_LOOK = str.maketrans(LOOK_ALIKES)
_TAG = re.compile(r"<[^<>]{0,500}>")
_FORMAT = re.compile("[­​-‏⁠﻿‪-‮]")
_WORDS = re.compile(r"[぀-ヿ㐀-䶿一-鿿]|[^\W_぀-ヿ㐀-䶿一-鿿]+")


def plain_words(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, markup, invisible characters and look-alike letters."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _FORMAT.sub("", text).lower())
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(_LOOK)
    return _WORDS.findall(text.lower())


class PassageIndex:
    """The seeds of a block of items: every run of ``seed`` words, with the items and places it stands at."""

    def __init__(self, items: Sequence[tuple[object, str]], seed: int):
        self.seed = seed
        self.items = [(k, plain_words(t)) for k, t in items]
        self.at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, w) in enumerate(self.items):
            for j in range(len(w) - seed + 1):
                self.at[" ".join(w[j : j + seed])].append((n, j))
        self.at = dict(self.at)

    def candidates(self, words: list[str], least: int) -> dict[int, list[tuple[int, int]]]:
        """Seed places (in the text, in the item) of each item that may share ``least`` consecutive words.

        A shared run of ``least`` words covers a whole seed that starts at a multiple of ``least - seed + 1``.
        """
        step = max(1, least - self.seed + 1)
        found: dict[int, list[tuple[int, int]]] = {}
        get = self.at.get
        for i in range(0, len(words) - self.seed + 1, step):
            for n, j in get(" ".join(words[i : i + self.seed]), ()):
                found.setdefault(n, []).append((i, j))
        return found


def tiles(a: list[str], b: list[str], seeds: Sequence[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in a, place in b, length), the longest unmarked match first, each word in one tile.

    Matches are grown from shared seeds to their full length; a match that meets marked words is cut and tried again.
    """
    found = set()
    for i, j in seeds:
        s = 0
        while i - s > 0 and j - s > 0 and a[i - s - 1] == b[j - s - 1]:
            s += 1
        i, j = i - s, j - s
        if (i, j) in {(x, y) for x, y, _ in found}:
            continue
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        found.add((i, j, n))
    out, used_a, used_b = [], bytearray(len(a)), bytearray(len(b))
    heap = sorted(found, key=lambda t: (-t[2], t[0], t[1]))
    while heap:
        i, j, n = heap.pop(0)
        # cut at the first marked word on either side
        while n and (used_a[i] or used_b[j]):
            i, j, n = i + 1, j + 1, n - 1
        free = 0
        while free < n and not used_a[i + free] and not used_b[j + free]:
            free += 1
        if free < least:
            continue
        if heap and free < heap[0][2]:
            heap.append((i, j, free))
            heap.sort(key=lambda t: (-t[2], t[0], t[1]))
            continue
        used_a[i : i + free] = b"\1" * free
        used_b[j : j + free] = b"\1" * free
        out.append((i, j, free))
        if n > free:
            heap.append((i + free, j + free, n - free))
            heap.sort(key=lambda t: (-t[2], t[0], t[1]))
    return out


def _respaced(a: list[str], b: list[str], j: int, n: int, run: int) -> bool:
    """Do ``run`` words of ``b`` around its words j..j+n stand in ``a`` when spaces are ignored, at word ends of ``a``?"""
    joined = "".join(a)
    ends, at = {0}, 0
    for w in a:
        at += len(w)
        ends.add(at)
    for s in range(max(0, j + n - run), min(j, len(b) - run) + 1):
        piece = "".join(b[s : s + run])
        p = joined.find(piece)
        while p >= 0:
            if p in ends and p + len(piece) in ends:
                return True
            p = joined.find(piece, p + 1)
    return False


def find_leaks(documents: DataFrame, doc_key: str, text_col: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, seed: int = 6, block_words: int = 2_000_000) -> DataFrame:
    """``doc_key, item_key, longest, covered, coverage``: documents that hold at least ``run`` consecutive words of an item.

    Seeds shared with an item lead to greedy string tiling of the two texts; ``longest`` is the longest tile, ``covered``
    the item's words in tiles of at least ``seed`` words, in whatever order they stand, ``coverage`` their share.
    Case, accents, punctuation, spacing, markup and look-alike letters do not count. The items are taken in blocks of at
    most ``block_words`` words, each broadcast in turn and held against all documents, so what is broadcast is bounded
    however many items there are. No shuffle. Null and empty texts on either side leak nothing; items and documents with
    equal texts are reported each. If both keys have one name, the item's comes out as ``<name>_item``.
    """
    require_columns(documents, [doc_key, text_col], "find_leaks")
    require_columns(items, [item_key, item_text], "find_leaks")
    if not 1 <= seed <= run:
        raise ValueError("find_leaks: seed must lie between 1 and run")
    spark = documents.sparkSession
    item_out = item_key if item_key != doc_key else f"{item_key}_item"
    blocks: list[list[tuple[object, str]]] = [[]]
    held = 0
    for r in items.select(item_key, item_text).filter(F.col(item_text).isNotNull()).toLocalIterator():
        n = len(r[1]) // 2 + 1
        if held + n > block_words and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((r[0], r[1]))
        held += n
    out_schema = T.StructType([T.StructField(doc_key, documents.schema[doc_key].dataType), T.StructField(item_out, items.schema[item_key].dataType), T.StructField("longest", T.IntegerType()), T.StructField("covered", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    item_type = pa.int64() if isinstance(items.schema[item_key].dataType, T.LongType) else pa.int32() if isinstance(items.schema[item_key].dataType, T.IntegerType) else pa.string()

    def scan(block: list[tuple[object, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PassageIndex(shared.value, seed)
            for b in batches:
                docs, rows = [], []
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    words = plain_words(text)
                    for n, places in index.candidates(words, run).items():
                        k, w = index.items[n]
                        # all seeds of the pair, for the other tiles
                        of = index.at
                        every = [(i, j) for i in range(len(words) - seed + 1) for m, j in of.get(" ".join(words[i : i + seed]), ()) if m == n]
                        t = tiles(words, w, every, seed)
                        longest = max((x[2] for x in t), default=0)
                        if longest < run and any(_respaced(words, w, j, n_, run) for _, j, n_ in t if len(w) >= run):
                            longest = run
                        if longest >= run:
                            covered = sum(x[2] for x in t)
                            docs.append(key)
                            rows.append((k, longest, covered, round(covered / max(1, len(w)), 6)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, b.schema.field(0).type), pa.array([r[0] for r in rows], item_type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.float64())], [doc_key, item_out, "longest", "covered", "coverage"])

        return documents.select(doc_key, text_col).mapInArrow(go, out_schema)

    out = scan(blocks[0])
    for block in blocks[1:]:
        out = out.unionAll(scan(block))
    return out
