"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

``rotations`` orthogonal maps, each learned on a bounded sample so that the signs of the
rotated vectors lose little (iterative quantisation), give one bit per dimension each.
Vectors of unlike norms are lifted to one norm first, so that near means large product.
The radius is learned on the same sample.
A code is cut into substrings of eight bits and each substring is indexed. If two codes
differ in at most r bits, then in some substring they differ in at most its share of r
(pigeonhole), so probing every value within that share retrieves every code within r.
What is retrieved is checked on whole codes and ranked by inner products of the
original vectors in double precision.

Equal vectors are one entry with their smallest ids, no more than an answer can use.
Entries are spread over shards of bounded size and every shard answers every block of
queries, so no group or shard grows with the table. A query with fewer than ``k``
answers inside the radius is asked again without a radius; nothing is cut off.

Rows without vec_id, and vectors that are null, zero or hold null or non-finite values,
take no part; nor do vectors of another length than the table's most frequent one (the
longer one of equally frequent ones). Rows equal in vec_id and vector count once. Rows
with the query's vec_id are not its answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.llm.frames import own_columns, partitions, staged

SAMPLE_ROWS = 4096  # the rotations are learned on so many vectors at most
ROTATIONS = 2
SAMPLE_QUERIES, TARGET_RECALL = 512, 0.97  # the radius finds so many of the sample's own neighbours
SHARD_ROWS, LEAST_SHARDS = 8192, 16
QUERY_BLOCK = 2048
PASSES = 30

_ROWS = "shard int, block int, query boolean, ids array<long>, vector array<double>"
_FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Codes:
    """Codes in bytes: signs of (point - mean) @ matrix.

    An entry's point has one more dimension, which fills its norm up to ``norm``, and a
    query's point has zero there: then a larger inner product is a smaller angle.
    """

    mean: np.ndarray
    matrix: np.ndarray
    norm: float

    @property
    def bits(self) -> int:
        return self.matrix.shape[1]

    def entries(self, vectors: np.ndarray) -> np.ndarray:
        return self._signs(lifted(vectors, self.norm))

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        size = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        return self._signs(np.append(vectors / size, np.zeros((len(vectors), 1)), axis=1))

    def _signs(self, points: np.ndarray) -> np.ndarray:
        return np.packbits((points - self.mean) @ self.matrix > 0, axis=1)


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1, keepdims=True), 0))
    return np.append(vectors, rest, axis=1) / norm


def learned(sample: np.ndarray, norm: float, rotations: int = ROTATIONS, passes: int = PASSES, seed: int = 7) -> Codes:
    """``norm``: the largest norm of any entry."""
    rng = np.random.default_rng(seed)
    points = lifted(sample, norm)
    mean, dims = points.mean(axis=0), points.shape[1]
    _, axes = np.linalg.eigh((points - mean).T @ (points - mean))
    main = (points - mean) @ axes
    out = []
    for _ in range(rotations):
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(passes):
            left, _, right = np.linalg.svd(np.where(main @ turn > 0, 1.0, -1.0).T @ main)
            turn = (left @ right).T
        out.append(axes @ turn)
    return Codes(mean, np.concatenate(out, axis=1), norm)


def learned_radius(sample: np.ndarray, codes: Codes, k: int, target: float = TARGET_RECALL) -> int:
    """The radius in which ``target`` of the k nearest sample vectors of sample vectors lie.

    A larger table has nearer neighbours than its sample, so there the radius finds more.
    """
    queries = sample[:SAMPLE_QUERIES]
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return codes.bits
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    far = np.bitwise_count(codes.entries(sample)[near] ^ codes.queries(queries)[:, None, :]).sum(axis=2)
    return int(np.quantile(far, target, method="higher"))


def substring_radii(radius: int, substrings: int) -> list[int]:
    """For each substring, how far to probe; -1: not at all.

    With radius = share * substrings + rest, the first rest + 1 substrings are probed
    up to share and the others up to share - 1: if all were further away, the codes
    would differ in more than ``radius`` bits.
    """
    share, rest = divmod(radius, substrings)
    return [share] * (rest + 1) + [share - 1] * (substrings - rest - 1)


class Shard:
    """The substring indexes of one shard: for each substring, entries by value."""

    def __init__(self, codes: Codes, ids: list[list[int]], vectors: np.ndarray, radius: int):
        self.codes, self.ids, self.vectors = codes, ids, vectors
        self.own = codes.entries(vectors)
        self.radius = radius
        self.radii = substring_radii(min(radius, codes.bits), self.own.shape[1])
        values = np.arange(256, dtype=np.uint8)
        self.far = np.bitwise_count(values[:, None] ^ values[None, :])
        self.order = np.argsort(self.own, axis=0, kind="stable")
        self.sizes = [np.bincount(c, minlength=256) for c in self.own.T]

    def near(self, code: np.ndarray) -> np.ndarray:
        """Entries whose code is within the radius."""
        if self.radius >= self.codes.bits:
            return np.arange(len(self.ids))
        hit = np.zeros(len(self.ids), dtype=bool)
        for s, share in enumerate(self.radii):
            probed = np.repeat(self.far[code[s]] <= share, self.sizes[s])
            hit[self.order[probed, s]] = True
        some = np.flatnonzero(hit)
        return some[np.bitwise_count(self.own[some] ^ code).sum(axis=1) <= self.radius]

    def best(self, query: int, vector: np.ndarray, code: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k nearest ids among the retrieved entries, by (-score, id)."""
        some = self.near(code)
        score = (self.vectors[some] * vector).sum(axis=1)
        if len(some) > k + 1:  # an entry may hold the query alone
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            some, score = some[score >= least], score[score >= least]
        pairs = [(-s, i) for e, s in zip(some, score.tolist(), strict=True) for i in self.ids[e] if i != query]
        return sorted(pairs)[:k]


def _usable(vectors: Column) -> Column:
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.isNotNull() & ~bad & F.exists(vectors, lambda x: x != 0)


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with up to k + 1 of their smallest ids."""
    once = vectors.distinct()
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return once.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _answer_cells(batches: Iterator[pa.RecordBatch], codes: Codes, radius: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, entries before queries."""
    cell, ids, vectors, shard = None, [], [], None
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
        flat = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else []
        found: list[tuple[int, int, float]] = []
        for (part, block, query, own), vector in zip(rows, flat, strict=True):
            if (part, block) != cell:
                cell, ids, vectors, shard = (part, block), [], [], None
            if not query:
                ids.append(own)
                vectors.append(vector)
                continue
            if not ids:
                continue
            if shard is None:
                shard = Shard(codes, ids, np.array(vectors), radius)
                vectors = []
            code = codes.queries(vector[None, :])[0]
            found += [(own[0], i, -s) for s, i in shard.best(own[0], vector, code, k)]
        if found:
            q, i, s = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])


def _searched(index: DataFrame, queries: DataFrame, codes: Codes, radius: int, k: int) -> DataFrame:
    spark = index.sparkSession
    shards = max(LEAST_SHARDS, -(-index.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    built = index.select(
        F.pmod(F.hash("vector"), F.lit(shards)).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("query"), "ids", "vector"
    )
    asked = queries.select(
        every(shards).alias("shard"), F.pmod(F.hash("vec_id"), F.lit(blocks)).alias("block"), F.lit(True).alias("query"), F.array("vec_id").alias("ids"), "vector"
    )
    shared = spark.sparkContext.broadcast(codes)  # dimensions * bits numbers
    cells = built.unionByName(asked).repartition(max(partitions(spark), shards), "shard", "block").sortWithinPartitions("shard", "block", "query")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _answer_cells(batches, shared.value, radius, k)

    found = cells.mapInArrow(answer, _FOUND)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, rotations: int = ROTATIONS, target: float = TARGET_RECALL
) -> DataFrame:
    """Per query the k nearest rows found: query_id, rank (from 1), vec_id, score (inner product).

    ``vectors`` and ``queries`` have vec_id and vector.
    """
    usable = vectors.filter(_usable(F.col("vector")) & F.col("vec_id").isNotNull())
    usable = usable.select("vec_id", F.col("vector").cast("array<double>").alias("vector"))
    sizes = usable.groupBy(F.size("vector").alias("n")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    dims = common["n"] if common else 0
    index = staged(entries(usable.filter(F.size("vector") == dims), k), "entries")
    asked = queries.filter(_usable(F.col("vector")) & F.col("vec_id").isNotNull() & (F.size("vector") == dims))
    asked = staged(asked.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).distinct(), "queries")
    if not common:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    sample = index.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE_ROWS).select("vector").collect()
    sample = np.array([r["vector"] for r in sample])
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    codes = learned(sample, index.agg(F.max(size)).first()[0], rotations)
    found = staged(_searched(index, asked, codes, learned_radius(sample, codes, k, target), k), "answers")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    rest = staged(asked.join(full, "vec_id", "left_anti"), "open-queries")
    if rest.isEmpty():
        return found
    again = _searched(index, rest, codes, codes.bits, k)
    return found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again)


def self_neighbours(embeddings: DataFrame, every: int = 20, k: int = 20, **options) -> DataFrame:
    """The neighbours of the rows whose vec_id is divisible by ``every`` among all other rows."""
    vectors = own_columns(embeddings, vec_id="vec_id", vector="embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % every == 0), k, **options)
