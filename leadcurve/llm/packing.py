"""Packing of sequences into batches of one padded length, with least padding.

Lengths are at most ``max_length``: a longer document is cut into sequences of that
length and a rest. The histogram of all lengths (so at most ``max_length`` rows) goes to
the driver, where dynamic programming finds the ``buckets`` upper bounds under which the
padding of all sequences is least. A sequence joins the smallest bucket that holds it; a
bucket's batches hold as many sequences as ``token_budget`` allows at its length.

Places inside a bucket follow a hash of doc_id and the piece number. They are counted by
hash prefix first, so no bucket is numbered in one task.

A document without words, or with a null text, has one sequence of length 1 (its end
token). Rows that share a doc_id are packed one by one; their order among equal rows
is not defined, which changes no column of the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.llm.frames import own_columns, staged

MAX_LENGTH = 2048
BUCKETS = 16
TOKEN_BUDGET = 16_384
PREFIX_BITS = 12  # buckets * 2**PREFIX_BITS counts: a table of fixed size

# words, of which the pattern's complement keeps one character each
_WORDS = r"[^\x20\x09-\x0D]+"


def word_lengths(documents: DataFrame) -> DataFrame:
    """doc_id and length: the words of the whole text, and one for its end."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORDS))
    return own_columns(documents, doc_id="doc_id", length=(words + 1).cast("long"))


def sequences(lengths: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """doc_id, piece (from 0), start and length of each sequence; ``lengths`` has doc_id and length."""
    last = F.greatest(F.expr(f"(length - 1) DIV {max_length}"), F.lit(0))
    out = lengths.filter("length > 0").select("doc_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_length
    return out.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"),
        F.least(F.col("length") - start, F.lit(max_length)).cast("int").alias("length"),
    )


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding; the last one is the largest length.

    ``cost[j]`` is the least padded size of the j shortest distinct lengths in k
    buckets. The last bucket's first length moves up as j does, so its place is searched
    between the places found for the neighbours.
    """
    order = np.argsort(lengths)
    value, below = lengths[order].astype(np.int64), np.append(0, np.cumsum(counts[order], dtype=np.int64))
    n = len(value)
    cost = np.append(0, value * below[1:])
    cuts = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = cost.copy(), np.zeros(n + 1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            total = cost[i] + value[j - 1] * (below[j] - below[i])
            at = int(np.argmin(total))
            new[j], cut[j] = total[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        cost = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        bounds.append(int(value[j - 1]))
        j = int(cut[j])
    return sorted(bounds)


def packed(
    lengths: DataFrame, buckets: int = BUCKETS, max_length: int = MAX_LENGTH, token_budget: int = TOKEN_BUDGET
) -> DataFrame:
    """Per sequence: doc_id, piece, start, length, bucket, padded_length, batch, slot.

    ``batch`` counts from 0 inside its bucket and ``slot`` from 0 inside its batch.
    """
    if token_budget < max_length:
        raise ValueError("token_budget must hold a sequence of max_length")
    parts = staged(sequences(lengths, max_length), "sequences")
    histogram = parts.groupBy("length").count().toPandas()  # at most max_length rows
    bounds = best_bounds(histogram["length"].to_numpy(), histogram["count"].to_numpy(), buckets) if len(histogram) else []
    bucket = F.lit(None).cast("int")
    padded = F.lit(None).cast("int")
    for i in reversed(range(len(bounds))):
        here = F.col("length") <= bounds[i]
        bucket, padded = F.when(here, F.lit(i)).otherwise(bucket), F.when(here, F.lit(bounds[i])).otherwise(padded)
    order = F.xxhash64("doc_id", "piece")
    placed = parts.select(
        "*", bucket.alias("bucket"), padded.alias("padded_length"), order.alias("_order"),
        F.shiftrightunsigned(order, 64 - PREFIX_BITS).alias("_prefix"),
    )
    before = Window.partitionBy("bucket").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("bucket", "_prefix").count()  # at most buckets * 2**PREFIX_BITS rows
    offsets = counts.select("bucket", "_prefix", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("bucket", "_prefix").orderBy("_order", "doc_id", "piece", "length")
    numbered = placed.join(F.broadcast(offsets), ["bucket", "_prefix"])
    place = F.row_number().over(inside) - 1 + F.col("_before")
    room = F.expr(f"{token_budget} DIV padded_length")
    return numbered.withColumn("_place", place).withColumn("_room", room).select(
        "doc_id", "piece", "start", "length", "bucket", "padded_length",
        F.expr("_place DIV _room").alias("batch"), F.expr("CAST(_place % _room AS INT)").alias("slot"),
    )


def batches_of(documents: DataFrame, **options) -> DataFrame:
    """The sequences of whole ``documents`` texts, measured in words."""
    return packed(word_lengths(documents), **options)
