"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.schema import require_columns
from lodestone.session import durable

TOKENIZER_DIR = "/opt/tokenizers"
#: Texts are tokenised in pieces of at most this many characters, cut at white space where there is any.
PIECE = 20_000
#: Steps on which a weight schedule is integrated.
GRID = 4096

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # fixed value: the public split pattern of this vocabulary
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encoders[path] = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _pieces(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + PIECE // 2, at + PIECE)
        cut = cut if cut > 0 else at + PIECE
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def count_tokens(documents: DataFrame, text_col: str, out_col: str = "tokens", tokenizer: str = "byte_bpe_50k.tiktoken", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``documents`` without the text, with its length in tokens of a public tokenizer; null texts have 0. No shuffle."""
    require_columns(documents, [text_col], "count_tokens")
    keep = [c for c in documents.columns if c != text_col]
    path = os.path.join(tokenizer_dir, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            n = [0 if not t else len(enc.encode_ordinary(t)) if len(t) <= PIECE else sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64())], [*keep, out_col])

    out = T.StructType([documents.schema[c] for c in keep] + [T.StructField(out_col, T.LongType())])
    return documents.select(*keep, text_col).mapInArrow(run, out)


def source_key(source: Column) -> Column:
    """One name for sources that differ only in case, outer spaces, and the use of space, hyphen or underscore."""
    return F.regexp_replace(F.lower(source), r"(?U)[\s_\-]+", "")


def demand(weights: Mapping[str, float], total: float, schedules: Mapping[str, Sequence[tuple[float, float]]] | None = None) -> dict[str, np.ndarray]:
    """Tokens asked of each source up to each of GRID + 1 points of training.

    A schedule is a list of (progress, factor) points, joined by straight lines, by which the source's weight is
    multiplied; sources without one keep their weight. At each moment the weights are made to add up to 1, and each
    source's whole demand is then scaled to its target, weight / sum of weights of ``total``, so that a schedule moves
    when a source is used and not how much.
    """
    t = np.linspace(0, 1, GRID + 1)
    mid = (t[:-1] + t[1:]) / 2
    raw = {}
    for s, w in weights.items():
        points = sorted((schedules or {}).get(s, [(0.0, 1.0)]))
        raw[s] = w * np.maximum(np.interp(mid, [p for p, _ in points], [f for _, f in points]), 0)
    whole = sum(raw.values()) if raw else np.ones(GRID)
    whole = np.where(whole > 0, whole, 1)
    sum_w = sum(weights.values()) or 1.0
    out = {}
    for s, w in weights.items():
        c = np.concatenate([[0], np.cumsum(raw[s] / whole)])
        out[s] = c * (w / sum_w * total / c[-1]) if c[-1] > 0 else np.zeros(GRID + 1)
    return out


def source_targets(tokens: DataFrame, weights: DataFrame, source_col: str = "source", tokens_col: str = "tokens") -> DataFrame:
    """``source, weight, max_repeats, target, own, documents, available, short``: what each listed source should and can give.

    ``tokens`` has a row per document. The mix holds as many tokens as all documents together, those of unlisted and
    null sources included. Listed names that are one source count as one, with their weights added and the largest
    ``max_repeats``; null and negative weights count as 0, null repeats as 1.
    """
    require_columns(tokens, [source_col, tokens_col], "source_targets")
    require_columns(weights, ["source", "weight", "max_repeats"], "source_targets")
    listed = weights.filter("source is not null").groupBy(source_key(F.col("source")).alias("_k")).agg(F.min("source").alias("source"), F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    own = tokens.groupBy(source_key(F.col(source_col)).alias("_s")).agg(F.sum(tokens_col).alias("own"), F.count(F.lit(1)).alias("documents"))
    total = tokens.agg(F.sum(tokens_col)).first()[0] or 0
    sum_w = listed.agg(F.sum("weight")).first()[0] or 0.0
    target = F.col("weight") / F.lit(float(sum_w) or 1.0) * F.lit(float(total))
    j = listed.join(own, F.col("_k") == F.col("_s"), "left").withColumn("own", F.coalesce("own", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    available = F.col("own") * F.col("max_repeats")
    return j.select("_k", "source", "weight", "max_repeats", target.alias("target"), "own", "documents", available.alias("available"), (available < target).alias("short"))


def plan_mix(tokens: DataFrame, key: str, targets: DataFrame, schedules: Mapping[str, Sequence[tuple[float, float]]] | None = None, source_col: str = "source", tokens_col: str = "tokens", buckets: int = 1024, seed: int = 7) -> DataFrame:
    """``source, key, epoch, tokens, position``: every use of a document in the mix, with its place in training (0..1).

    Each source's documents are put in an order of their own for every epoch; a document's cumulative token offset is
    turned into a position by inverting the source's cumulative demand (see ``demand``). Uses that begin beyond the
    source's target are left out. Offsets come from a prefix sum over ``buckets`` hash ranges of each source and epoch,
    so that a source of a third of all documents is spread over all tasks. Documents without tokens are left out.
    """
    require_columns(tokens, [key, source_col, tokens_col], "plan_mix")
    rows = targets.collect()  # one row per listed source
    if not rows:
        return tokens.limit(0).select(F.col(source_col).alias("source"), key, F.lit(0).alias("epoch"), F.col(tokens_col).alias("tokens"), F.lit(0.0).alias("position"))
    sum_w = sum(r["weight"] for r in rows) or 1.0
    total = sum(r["target"] for r in rows)
    curves = demand({r["_k"]: r["weight"] for r in rows}, total, {r["_k"]: s for r in rows for n, s in (schedules or {}).items() if n == r["source"]})
    need = [(r["_k"], r["source"], min(r["max_repeats"], -(-int(np.ceil(r["target"])) // r["own"])) if r["own"] else 0, float(r["target"])) for r in rows]
    spark = tokens.sparkSession
    wanted = spark.createDataFrame(need, "_k string, _source string, _epochs int, _target double")
    uses = (
        tokens.filter(F.col(tokens_col) > 0)
        .select(source_key(F.col(source_col)).alias("_s"), F.col(key), F.col(tokens_col).cast("long").alias("tokens"))
        .join(F.broadcast(wanted), F.col("_s") == F.col("_k"))
        .filter("_epochs > 0")
        .select("_k", "_source", "_target", key, "tokens", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)).alias("epoch"))
        .withColumn("_h", F.xxhash64(F.col(key), F.col("epoch"), F.lit(seed)))
        .withColumn("_b", F.shiftrightunsigned("_h", 64 - (buckets.bit_length() - 1)))
    )
    sums = uses.groupBy("_k", "epoch", "_b").agg(F.sum("tokens").alias("_t"))
    before = sums.withColumn("_before", F.sum("_t").over(W.partitionBy("_k").orderBy("epoch", "_b")) - F.col("_t")).select(F.col("_k").alias("_k2"), F.col("epoch").alias("_e2"), F.col("_b").alias("_b2"), "_before")
    own = F.sum("tokens").over(W.partitionBy("_k", "epoch", "_b").orderBy("_h", key).rowsBetween(W.unboundedPreceding, 0))
    placed = uses.withColumn("_own", own).join(before, (F.col("_k") == F.col("_k2")) & (F.col("epoch") == F.col("_e2")) & (F.col("_b") == F.col("_b2"))).withColumn("_start", F.col("_before") + F.col("_own") - F.col("tokens"))
    used = placed.filter(F.col("_start") < F.col("_target")).select("_k", F.col("_source").alias("source"), key, "epoch", "tokens", "_start")
    shared = spark.sparkContext.broadcast(curves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.linspace(0, 1, GRID + 1)
        for b in batches:
            ks, start, n = b.column(0).to_pylist(), b.column(5).to_numpy(), b.column(4).to_numpy()
            at = np.empty(len(ks))
            ks_a = np.array(ks, object)
            for k in set(ks):
                m = ks_a == k
                at[m] = np.interp(start[m] + n[m] / 2, shared.value[k], grid)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), b.column(4), pa.array(at)], ["source", key, "epoch", "tokens", "position"])

    out = T.StructType([T.StructField("source", T.StringType()), tokens.schema[key], T.StructField("epoch", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("position", T.DoubleType())])
    return used.mapInArrow(place, out)


def mix_report(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, target, used_tokens, uses, documents, repeats, short`` of each listed source."""
    used = plan.groupBy(F.col("source").alias("_u")).agg(F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("uses"), F.max(F.col("epoch") + 1).alias("repeats"))
    whole = durable(targets.join(used, targets["source"] == used["_u"], "left").drop("_u").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0))).withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("repeats", F.coalesce("repeats", F.lit(0))))
    r = whole.agg(F.sum("target"), F.sum("used_tokens")).first()
    return whole.select("source", (F.col("target") / F.lit(float(r[0] or 1))).alias("target_share"), (F.col("used_tokens") / F.lit(float(r[1] or 1))).alias("actual_share"), "target", "used_tokens", "uses", "documents", "repeats", "short")


def counted_documents(documents: DataFrame, key: str, text_col: str, source_col: str = "source", **options) -> DataFrame:
    """``key, source, tokens`` of every document, counted once and written to the checkpoint folder."""
    return durable(count_tokens(documents.select(key, source_col, text_col), text_col, **options))
