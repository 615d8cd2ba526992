"""Fields that hold whole lists in one string: infer the delimiter per source, split, and explode with position."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.rows import distinct_rows
from lodestone.schema import require_columns

#: What may separate items, and what says that there is nothing.
DELIMITERS = (",", ";", "|", "\n", "\t", "/", "、", "，", "；", "·", " ")
NOTHING = frozenset(("", "-", "--", "n/a", "na", "nan", "nil", "none", "null", "nothing", "[]", "{}", "()"))
BRACKETS = {"[": "]", "{": "}", "(": ")"}
#: Kinds of piece. A field whose pieces are all of one of these kinds is a regular list.
PIECE_KINDS = {
    "year": re.compile(r"(?:19|20)\d\d"),
    "number": re.compile(r"[+-]?\d+(?:\.\d+)?"),
    "moment": re.compile(r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d(?::\d\d)?"),
    "token": re.compile(r"[A-Za-z0-9_-]{16,64}"),
}
_QUOTED = r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'"
_STATS = "source string, delimiter string, fields long, pieces long, pieces_squared double, regular double"


def _bare(value: str) -> str:
    """The list without outer spaces and enclosing brackets."""
    v = value.strip()
    while len(v) > 1 and BRACKETS.get(v[0]) == v[-1]:
        v = v[1:-1].strip()
    return v


@lru_cache(maxsize=None)
def _splitter(delimiter: str) -> re.Pattern[str]:
    d = "[" + re.escape(delimiter) + "]"
    # an item is quoted as a whole, or runs to the next delimiter; quotes count only where an item begins
    pad = " *" if delimiter == " " else r"\s*"
    return re.compile(rf"{pad}(?:({_QUOTED}){pad}(?={d}|$)|([^{d[1:]}*))(?:{d}|$)")


def split_packed(value: str | None, delimiter: str) -> list[str]:
    """Items of one packed field, split at each character of ``delimiter``. Null, "nothing" words and empty lists give no item; empty items are skipped."""
    if value is None or value.strip().lower() in NOTHING:
        return []
    v = _bare(value)
    if v.lower() in NOTHING:
        return []
    if not delimiter:
        q = re.fullmatch(_QUOTED, v)
        return [x] if (x := _unquoted(v) if q else v) else []
    out = []
    for m in _splitter(delimiter).finditer(v):
        quoted, plain = m.groups()
        item = _unquoted(quoted) if quoted else (plain or "").strip()
        if item:
            out.append(item)
        if m.end() >= len(v):
            break
    return out


def _unquoted(q: str) -> str:
    return q[1:-1].replace(q[0] * 2, q[0])


_QUOTED_ANY = re.compile(rf"(?:(?<=^)|(?<=[\s,;|/、，；·]))(?:{_QUOTED})(?=\s*(?:$|[\s,;|/、，；·]))")


def _outside(value: str) -> tuple[str, str]:
    """The candidate delimiters that stand outside quotes, in natural order, and 'q' if there are quotes."""
    v = _bare(value)
    outside = _QUOTED_ANY.sub("Q", v)
    return "".join(d for d in DELIMITERS if d in outside.strip()), "q" if outside != v else ""


def source_of(value: str, field: str) -> str:
    """The exporter's fingerprint: field, bracket, quoting, and which candidate delimiters stand outside quotes."""
    found, quoted = _outside(value)
    bracket = value.strip()[:1] if value.strip()[:1] in BRACKETS else ""
    return "\x1f".join((field, bracket, quoted, found))


def _candidates(value: str) -> list[str]:
    """No delimiter, each one that occurs, and all but the space together, for an exporter that mixes them."""
    found = _outside(value)[0]
    return [*dict.fromkeys(("", *found, found.replace(" ", "")))]


def _regular(pieces: list[str]) -> float:
    """Share of the pieces that are of the field's most frequent kind."""
    if not pieces:
        return 0.0
    best = 0
    for kind in PIECE_KINDS.values():
        best = max(best, sum(1 for p in pieces if kind.fullmatch(p)))
    return best / len(pieces)


def _score_mapper(named: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], list[float]] = {}
        for b in batches:
            cols = b.to_pydict()
            for i, (field, value) in enumerate(zip(cols["field_name"], cols["value"])):
                if value is None or value.strip().lower() in NOTHING:
                    continue
                source = f"{field}\x1f{cols['source'][i]}" if named else source_of(value, field)
                for d in _candidates(value):
                    pieces = split_packed(value, d)
                    t = total.setdefault((source, d), [0, 0, 0.0, 0.0])
                    t[0] += 1
                    t[1] += len(pieces)
                    t[2] += len(pieces) ** 2
                    # a piece that still holds another candidate's pieces is not of one kind
                    t[3] += _regular(pieces)
        rows = [(s, d, int(t[0]), int(t[1]), float(t[2]), float(t[3])) for (s, d), t in total.items()]
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("source", "delimiter", "fields", "pieces", "pieces_squared", "regular"))}, schema=pa.schema([("source", pa.string()), ("delimiter", pa.string()), ("fields", pa.int64()), ("pieces", pa.int64()), ("pieces_squared", pa.float64()), ("regular", pa.float64())]))

    return run


def delimiter_scores(fields: DataFrame, source_col: str | None = None) -> DataFrame:
    """Per source and candidate delimiter: ``fields, mean_pieces, consistency, regularity, score``.

    ``fields`` has ``field_name, value`` (and ``source_col``). Regularity is the mean share of a field's pieces that are
    of its most frequent kind; consistency is 1 / (1 + variation of the piece count). Counted in one pass with partial
    sums per partition: a row per source and candidate leaves each partition, however many fields a source holds.
    """
    named = source_col is not None
    cols = [F.col("field_name"), F.col("value")] + ([F.col(source_col).cast("string").alias("source")] if named else [])
    sums = fields.select(*cols).mapInArrow(_score_mapper(named), _STATS).groupBy("source", "delimiter").agg(*[F.sum(c).alias(c) for c in ("fields", "pieces", "pieces_squared", "regular")])
    mean = F.col("pieces") / F.col("fields")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("pieces_squared") / F.col("fields") - mean * mean))
    return (
        sums.withColumn("mean_pieces", mean)
        .withColumn("consistency", 1 / (1 + spread / F.greatest(F.lit(1.0), mean)))
        .withColumn("regularity", F.col("regular") / F.col("fields"))
        .withColumn("score", F.round(F.col("regularity") * 0.9 + F.col("consistency") * 0.1, 9))
        .select("source", "delimiter", "fields", "mean_pieces", "consistency", "regularity", "score")
    )


def infer_delimiters(fields: DataFrame, source_col: str | None = None) -> DataFrame:
    """The best-scoring delimiter of each source: ``source, delimiter, score``; ties go to the earlier candidate."""
    rank = F.array_position(F.array(*[F.lit(d) for d in ("", *DELIMITERS)]), F.substring("delimiter", 1, 1)) + 100 * F.length("delimiter")
    s = delimiter_scores(fields, source_col)
    return s.groupBy("source").agg(F.max_by(F.struct("delimiter", "score"), F.struct("score", -rank)).alias("b")).select("source", "b.delimiter", "b.score")


def explode_packed(df: DataFrame, key: str, columns: Sequence[str], source_col: str | None = None, max_sources: int = 20000) -> DataFrame:
    """``key, field_name, pos, item``: one row per item of each packed column, ``pos`` from 0 within the field.

    Method: fields are grouped by source (``source_col``, else the fingerprint of the exporter that the value shows:
    bracket, quoting and the delimiters outside quotes); each source's delimiter is the candidate with the most regular
    and consistent pieces; each field is then split by its source's delimiter, quoting observed. One row is taken for
    each key. Null keys, null fields and fields that only say "nothing" give no row. The table of sources goes to the
    workers when it has at most ``max_sources`` rows; a larger one is joined.
    """
    require_columns(df, [key, *columns, *([source_col] if source_col else [])], "explode_packed")
    one = distinct_rows(df, key, [*dict.fromkeys([*columns, *([source_col] if source_col else [])])])
    fields = one.select(F.col(key).alias("_key"), *([F.col(source_col).cast("string").alias("_source")] if source_col else []), F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("field_name", "value")).filter("value is not null")
    best = infer_delimiters(fields, "_source" if source_col else None)
    found = best.select("source", "delimiter").limit(max_sources + 1).collect()
    named = source_col is not None
    if len(found) > max_sources:
        if named:
            src = F.concat_ws("\x1f", "field_name", F.coalesce("_source", F.lit("None")))
        else:
            src = F.pandas_udf(lambda f, v: pd.Series([source_of(y, x) for x, y in zip(f, v)]), "string")("field_name", "value")
        fields = fields.withColumn("source", src).join(best, "source", "left").select("_key", "field_name", "value", "delimiter")
        table: dict[str, str] | None = None
    else:
        table = {r.source: r.delimiter for r in found}
        fields = fields.select("_key", "field_name", "value", *(["_source"] if named else []))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            keys, names, places, items = [], [], [], []
            for i, (k, f, v) in enumerate(zip(c["_key"], c["field_name"], c["value"])):
                if v is None or v.strip().lower() in NOTHING:
                    continue
                d = c["delimiter"][i] or "" if table is None else table.get(f"{f}\x1f{c['_source'][i]}" if named else source_of(v, f), "")
                parts = split_packed(v, d)
                keys += [k] * len(parts)
                names += [f] * len(parts)
                places += range(len(parts))
                items += parts
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("_key").type), pa.array(names, pa.string()), pa.array(places, pa.int32()), pa.array(items, pa.string())], ["_key", "field_name", "pos", "item"])

    out = T.StructType([T.StructField("_key", one.schema[key].dataType), T.StructField("field_name", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])
    return fields.mapInArrow(split, out).withColumnRenamed("_key", key)
