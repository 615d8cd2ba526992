"""Corpus term statistics from record bitmaps, and how distinctive a term is for a record."""

from __future__ import annotations

import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.schema import require_columns
from lodestone.session import durable

_FORMAT = regex.compile(r"\p{Cf}+")
_ENDS = regex.compile(r"\A[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+\Z")
#: A container holds the records of one block of 2**16 ids: a sorted array of 16-bit ids below ARRAY_MAX, else a bitset of 8 KB.
BLOCK, ARRAY_MAX = 1 << 16, 4096
#: Postings held by one Python worker before its containers are sent on.
MAX_POSTINGS = 4_000_000
_CACHE = 500_000


def normalise_term(piece: str) -> str:
    """The term of a whitespace-separated piece; '' if the piece holds none."""
    t = _FORMAT.sub("", piece) if not piece.isascii() else piece
    if not t.isascii():
        t = unicodedata.normalize("NFC", t)
    t = t.lower()
    return t if t.isalnum() else _ENDS.sub("", t)


class _Terms(dict):
    """piece -> term, kept small."""

    def __missing__(self, piece: str) -> str:
        if len(self) > _CACHE:
            self.clear()
        t = self[piece] = normalise_term(piece)
        return t


def _counts(text: str, terms: _Terms) -> Counter[str]:
    c = Counter(map(terms.__getitem__, text.split()))
    c.pop("", None)
    return c


def container(ids: array) -> bytes:
    """One block's record ids, ascending, as a compressed container."""
    a = np.frombuffer(ids, np.uint16)
    if len(a) < ARRAY_MAX:
        return a.tobytes()
    bits = np.zeros(BLOCK, np.uint8)
    bits[a] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def container_ids(data: bytes) -> np.ndarray:
    """Inverse of ``container``."""
    if len(data) < BLOCK // 8:
        return np.frombuffer(data, np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype(np.uint16)


def cardinality(ids: Column) -> Column:
    """How many records a container holds."""
    return F.when(F.length(ids) < BLOCK // 8, F.shiftright(F.length(ids), 1).cast("long")).otherwise(F.bitmap_count(ids))


_BITMAPS = "term string, block long, records int, occurrences long, ids binary"


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, blocks, part = _Terms(), 0, TaskContext.get().partitionId()
    ids: dict[str, array] = {}
    more: dict[str, int] = {}
    n = held = total = 0

    def flush() -> Iterator[pa.RecordBatch]:
        block = (part << 32) + blocks
        words = list(ids)
        for i in range(0, len(words), 50_000):
            w = words[i : i + 50_000]
            records = [len(ids[t]) for t in w]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(w, pa.string()),
                    pa.array([block] * len(w), pa.int64()),
                    pa.array(records, pa.int32()),
                    pa.array([r + more.get(t, 0) for r, t in zip(records, w)], pa.int64()),
                    pa.array([container(ids[t]) for t in w], pa.binary()),
                ],
                ["term", "block", "records", "occurrences", "ids"],
            )
        # the block's own row, with a null term: the records that have a term, and all occurrences
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([block], pa.int64()), pa.array([n], pa.int32()), pa.array([total], pa.int64()), pa.array([container(array("H", range(n)))], pa.binary())], ["term", "block", "records", "occurrences", "ids"])

    for b in batches:
        for text in b.column(0).to_pylist():
            if not text:
                continue
            c = _counts(text, terms)
            if not c:
                continue
            for t, k in c.items():
                a = ids.get(t)
                if a is None:
                    a = ids[t] = array("H")
                a.append(n)
                if k > 1:
                    more[t] = more.get(t, 0) + k - 1
            total += c.total()
            held += len(c)
            n += 1
            if n == BLOCK or held > MAX_POSTINGS:
                yield from flush()
                ids, more = {}, {}
                n = held = total = 0
                blocks += 1
    if n:
        yield from flush()


def term_bitmaps(records: DataFrame, text_col: str) -> DataFrame:
    """The vertical layout: ``term, block, records, occurrences, ids``, one container per term and block of records.

    A record's id is its block and its place in it; blocks are made inside a partition, so containers of one term never
    overlap and their union is their concatenation. The row with a null term holds a block's records that have a term. Null, empty and wordless texts have none. A container takes at most 8 KB.
    """
    require_columns(records, [text_col], "term_bitmaps")
    return records.select(F.col(text_col)).mapInArrow(_bitmaps, _BITMAPS)


def bitmap_statistics(bitmaps: DataFrame) -> DataFrame:
    """``term, occurrences, records``: ``records`` is the cardinality of the union of a term's containers.

    No record is in two blocks, so the union keeps the containers side by side and its cardinality is the sum of theirs;
    it is summed per partition, and no container goes through the shuffle.
    """
    require_columns(bitmaps, ["term", "occurrences", "ids"], "bitmap_statistics")
    return bitmaps.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(cardinality(F.col("ids"))).alias("records"))


def term_statistics(records: DataFrame, text_col: str) -> DataFrame:
    """``term, occurrences, records`` over all records, with the totals in the row whose term is null.

    ``records`` is read from the term's record bitmaps (see ``term_bitmaps`` and ``bitmap_statistics``): even a term found
    in every record gives one row per block, pre-aggregated before the shuffle.
    """
    return bitmap_statistics(term_bitmaps(records, text_col))


def mark_terms(stats: DataFrame, rare_max: int = 2, common_share: float = 0.1) -> DataFrame:
    """``term, occurrences, records, mark``: 'rare' up to ``rare_max`` records, 'common' above ``common_share`` of the records that have a term, else null.

    A term that is both (a tiny collection) is 'rare' and 'common' in two rows. An empty collection gives no row.
    """
    kept = durable(stats)
    total = kept.filter("term is null").agg(F.sum("records")).first()[0] or 0
    both = F.array_compact(F.array(F.when(F.col("records") <= rare_max, F.lit("rare")), F.when(F.col("records") > common_share * total, F.lit("common"))))
    return kept.filter("term is not null").select("term", "occurrences", "records", F.explode_outer(both).alias("mark"))


_PAIRS = "term string, tf long, length long"


def _pairs(min_tf: int, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for b in batches:
            keys, words, tfs, lengths = [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                c = _counts(text, terms)
                length = c.total()
                for t, k in c.items():
                    if k >= min_tf:
                        keys.append(key)
                        words.append(t)
                        tfs.append(k)
                        lengths.append(length)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(words, pa.string()), pa.array(tfs, pa.int64()), pa.array(lengths, pa.int64())], [b.schema.field(0).name, "term", "tf", "length"])

    return run


def distinctive_terms(records: DataFrame, key: str, text_col: str, prior_mass: float = 1000.0, min_tf: int = 1, hot_share: float = 0.0005) -> DataFrame:
    """How characteristic each term is of its record: ``key, term, tf, records, occurrences, z``.

    z is the log-odds ratio of the record against all other records with an informative Dirichlet prior (the collection's
    counts, scaled to ``prior_mass``), divided by its standard error. ``min_tf`` drops rarer terms of a record before the
    join; counts always cover everything. ``records`` must hold one row per key. Terms above ``hot_share`` of all
    occurrences, of which there are at most 1 / ``hot_share``, are joined by broadcast, so that no hot term's rows meet
    in one task; the rest go through a shuffle. Null and wordless texts give no row; a collection of one single term has
    no rest to compare with and gives z = 0.
    """
    require_columns(records, [key, text_col], "distinctive_terms")
    stats = durable(term_statistics(records, text_col))
    total = stats.filter("term is null").agg(F.sum("occurrences")).first()[0] or 0
    known = stats.filter("term is not null").withColumnRenamed("term", "_term")
    pairs = records.select(key, text_col).mapInArrow(_pairs(min_tf, None), f"`{key}` {records.schema[key].dataType.simpleString()}, {_PAIRS}")
    limit = hot_share * total
    hot = known.filter(F.col("occurrences") > limit)
    rest = known.filter(F.col("occurrences") <= limit)
    with_hot = pairs.join(F.broadcast(hot), pairs["term"] == hot["_term"], "left")
    rows = with_hot.filter("_term is not null").drop("_term")
    cold = with_hot.filter("_term is null").select(key, "term", "tf", "length").join(rest, F.col("term") == F.col("_term")).drop("_term")
    y, n, a0 = F.col("tf").cast("double"), F.col("length").cast("double"), F.lit(float(prior_mass))
    big = F.lit(float(max(total, 1)))
    a = a0 * F.col("occurrences") / big
    yr = F.col("occurrences") - y
    tiny = F.lit(1e-12)
    odds = F.log((y + a) / F.greatest(n + a0 - y - a, tiny)) - F.log((yr + a) / F.greatest(big - n + a0 - yr - a, tiny))
    z = F.when(F.col("occurrences") >= total, F.lit(0.0)).otherwise(odds / F.sqrt(1 / (y + a) + 1 / (yr + a)))
    return rows.unionByName(cold).select(key, "term", "tf", "records", "occurrences", z.alias("z"))
