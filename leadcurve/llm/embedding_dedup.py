"""Near duplicates among embeddings of one label, by a robust-pruned flat graph.

Equal vectors of a label are one class. Classes are dealt to cells that are split by
k-means, each fitted on a drawn sample of the cell, until none holds more than
``SHARD_ROWS``; at every split a class also enters its second nearest cell as a guest, so
shards overlap. Each shard's graph is built alone, its edges are made to lead both ways, and
the adjacency lists of a class are united over its shards, so that edges lead from shard to
shard.

Every class is searched for from the medoid of its home shard, and of the shards where it
is a guest. A search expands all that it finds within the range, and where the united
lists lead on to another shard it is continued there: such messages go from round to
round until none is new. A shard answers for the classes that are at home in it, so each
is counted once, and what is found is verified by its cosine in double precision. Links
are counted where they are found; only spanning links leave a task. Work on a group of
different vectors that are all linked grows with its pairs, in bounded shards, but no
row per pair is written.

Recall is audited: for up to ``AUDITED`` drawn classes all links are counted by brute
force, and the search is repeated with twice the beam while less than ``TARGET`` of them
are found.

Rows without label, and vectors that are null, zero or hold null or non-finite values or
have another length than most, link with nothing. Rows without vec_id count as vectors
but are no component's name. Repeated rows are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.llm import flatgraph
from leadcurve.llm.blas import single_thread
from leadcurve.llm.frames import own_columns, partitions, staged
from leadcurve.llm.graph import components

THRESHOLD = 0.93
SHARD_ROWS = 512  # a member costs more to link in a larger shard: 1.9 ms in 512, 2.5 in 2,048
SAMPLE_ROWS = 2048  # a cell's centroids are fitted on so many of its rows, on average
MOST_CELLS = 64  # of one split
SALT_ROWS = 1 << 15
AUDITED, TARGET = 256, 0.97
_ODDS = 1 << 30

_EDGES = "array<struct<node: long, home: string, sim: double>>"


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def _cells(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """The slices of each cell; cells stand together, and each is read before the next."""
    slices = _slices(batches, column)
    ahead = next(slices, None)
    while ahead is not None:
        cell = ahead[0]

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal ahead
            while ahead is not None and ahead[0] == cell:
                yield ahead[1]
                ahead = next(slices, None)

        yield cell, own()


def _slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    for batch in batches:
        cells = np.array(batch.column(column).to_pylist(), dtype=object)
        cut = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        for lo, hi in zip([0, *cut], [*cut, len(cells)], strict=True):
            if hi > lo:
                yield cells[lo], batch.slice(lo, hi - lo)


def classes(rows: DataFrame) -> DataFrame:
    """One node per label and vector of ``rows`` (vec_id, label, vector): its rows and smallest vec_id."""
    usable = rows.filter(_usable(F.col("vector")) & F.col("label").isNotNull())
    common = usable.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    same = usable.filter(F.size("vector") == (common["n"] if common else 0))
    once = same.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    return staged(once.withColumn("node", F.monotonically_increasing_id()), "classes")


def _centroids(sample: np.ndarray, k: int, passes: int = 8) -> np.ndarray:
    rng = np.random.default_rng(len(sample))
    own = sample[rng.permutation(len(sample))[:k]]
    for _ in range(passes):
        near = np.argmax(sample @ own.T, axis=1)
        total = np.zeros_like(own)
        np.add.at(total, near, sample)
        size = np.sqrt((total**2).sum(axis=1, keepdims=True))
        own = np.where(size > 0, total / np.maximum(size, 1e-300), own)
    return own


def _fitted(rows: DataFrame, big: DataFrame, turn: int, limit: int) -> DataFrame:
    """cell, salts and the centroids of each cell that is too big, in one row."""
    some = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(_ODDS)) < F.col("size_here") / F.col("size") * _ODDS
    sample = rows.join(big.withColumn("size_here", F.lit(SAMPLE_ROWS)), "cell").filter(some)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        size = int(frame["size"].iloc[0])
        k = max(2, min(MOST_CELLS, -(-4 * size // limit)))
        own = _centroids(_unit(np.stack(frame["vector"].to_numpy())), k)
        return pd.DataFrame({"cell": [frame["cell"].iloc[0]], "vector": [own.ravel()]})

    return sample.select("cell", "size", "vector").groupBy("cell").applyInPandas(fit, "cell string, vector array<double>")


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell and salt, the cell's centroids before them."""
    single_thread()
    for _, own in _cells(batches, "place"):
        centroids = None
        for part in own:
            vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            if centroids is None:
                head = len(part.column("vector")[0])
                centroids, part, vectors = vectors[:head], part.slice(1), vectors[head:]
            if not part.num_rows:
                continue
            vectors = vectors.reshape(part.num_rows, -1)
            node = part.column("node").to_numpy()
            near = _unit(vectors) @ centroids.reshape(-1, vectors.shape[1]).T
            # rows that all centroids are equally near to spread over them
            near += 1e-9 * np.random.default_rng(int(node[0]) & 0x7FFFFFFF).random(near.shape)
            first = np.argmax(near, axis=1)
            near[np.arange(len(near)), first] = -np.inf
            second = np.argmax(near, axis=1)
            cell, guest = part.column("cell").to_pylist(), part.column("guest").to_numpy(zero_copy_only=False)
            home = np.flatnonzero(~guest)
            at = np.append(np.arange(len(node)), home)
            child = np.append(first, second[home]).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[at]), pa.array([f"{cell[i]}/{c}" for i, c in zip(at.tolist(), child, strict=True)]),
                    pa.array(np.append(guest, np.ones(len(home), dtype=bool))), part.column("vector").take(pa.array(at)),
                ],
                ["node", "cell", "guest", "vector"],
            )


def shards(nodes: DataFrame, limit: int = SHARD_ROWS) -> DataFrame:
    """``nodes`` (node, label, vector) as members of overlapping cells: node, cell, guest, vector."""
    rows = nodes.select("node", F.col("label").cast("string").alias("cell"), F.lit(False).alias("guest"), "vector")
    turn = 0
    while True:
        big = staged(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > limit), "big-cells")
        if big.isEmpty():
            return rows
        salts = F.ceil(F.col("size") / SALT_ROWS)
        fitted = _fitted(rows, big, turn, limit).join(big, "cell").select(
            F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("salt"), "cell", F.lit(None).cast("long").alias("node"),
            F.lit(False).alias("guest"), "vector",
        )
        own = rows.join(big, "cell").select(F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), "cell", "node", "guest", "vector")
        both = own.unionByName(fitted).withColumn("place", F.concat_ws(" ", "cell", "salt"))
        both = both.repartition(partitions(rows.sparkSession), "place").sortWithinPartitions("place", F.col("node").asc_nulls_first())
        split = both.mapInArrow(_dealt, "node long, cell string, guest boolean, vector array<double>")
        rows = staged(rows.join(big, "cell", "left_anti").select("node", "cell", "guest", "vector").unionByName(split), "cells")
        turn += 1


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The adjacency list of each member of each shard."""
    single_thread()
    for _, own in _cells(batches, "cell"):
        table = pa.Table.from_batches(list(own))
        node = table.column("node").to_numpy()
        home = np.array(table.column("home").to_pylist(), dtype=object)
        graph = flatgraph.built(_unit(_matrix(table.column("vector"))))
        of, slot = np.nonzero(graph.edges >= 0)
        to = graph.edges[of, slot]
        both = np.unique(np.append(of, to) * len(node) + np.append(to, of))  # every edge leads both ways
        of, to = both // len(node), both % len(node)
        sim = np.einsum("ij,ij->i", graph.vectors[of], graph.vectors[to])
        edges = pa.StructArray.from_arrays([pa.array(node[to]), pa.array(home[to], pa.string()), pa.array(sim)], ["node", "home", "sim"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(node) + 1)), pa.int32()), edges)
        yield pa.RecordBatch.from_arrays([pa.array(node), lists], ["node", "edges"])


def graph_of(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The united graph: node, home, weight, vector and edges to nodes of this and of other shards."""
    home = members.filter("NOT guest").select("node", F.col("cell").alias("home"))
    rows = members.join(home, "node").select("cell", "node", "home", "vector")
    rows = rows.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell", "node")
    lists = staged(rows.mapInArrow(_linked, f"node long, edges {_EDGES}"), "shard-lists")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    return staged(nodes.select("node", "weight", "vector").join(home, "node").join(united, "node"), "graph")


class Shard:
    """The classes at home in one shard, with their edges inside it and out of it."""

    def __init__(self, table: pa.Table):
        self.node = table.column("node").to_numpy()
        self.weight = table.column("weight").to_numpy()
        home = table.column("cell")[0].as_py()
        lists = table.column("edges").combine_chunks()
        flat = lists.flatten()
        of = np.repeat(np.arange(len(self.node)), lists.value_lengths().to_numpy())
        to, sim = flat.field("node").to_numpy(), flat.field("sim").to_numpy()
        where = np.array(flat.field("home").to_pylist(), dtype=object)
        out = where != home
        place = np.searchsorted(self.node, to[~out])
        self.graph = flatgraph.United(_unit(_matrix(table.column("vector"))), of[~out], place)
        self.start = self.graph.medoid()
        self.met = np.zeros((len(self.node), len(self.node)), dtype=bool)  # which class met which, both at home here
        self.asked = np.zeros(len(self.node), dtype=bool)
        self.out_first = np.searchsorted(of[out], np.arange(len(self.node) + 1))
        self.out_node, self.out_home, self.out_angle = to[out], where[out], np.arccos(np.clip(sim[out], -1, 1))

    def found(self, points: np.ndarray, entries: list[list[int]], beam: int, reach: float) -> flatgraph.Pool:
        count = [len(e) for e in entries]
        point = np.append(np.arange(len(points)), np.repeat(np.arange(len(points)), count))
        known = np.array([x for e in entries for x in e], dtype=np.int64)
        vector = np.append(np.full(len(points), self.start), np.searchsorted(self.node, known))
        pool = flatgraph.search(self.graph, points, point, vector, beam, reach)
        return pool[pool.sim >= reach]

    def own_links(self) -> np.ndarray:
        """Rows met at home; what only one of two classes met counts for both."""
        return (self.met | self.met.T) @ self.weight

    def onward(self, pool: flatgraph.Pool, reach: float) -> np.ndarray:
        """(point, edge out) of what was found, where the edge's end may be in reach of the point.

        One edge per point and end. Found rows are followed in parts of bounded size.
        """
        found = [np.zeros((2, 0), dtype=np.int64)]
        first, count = self.out_first[pool.vector], np.diff(self.out_first)[pool.vector]
        limit = np.arccos(np.clip(pool.sim, -1, 1)) + np.arccos(reach) + 1e-7
        part = np.cumsum(count) // flatgraph.STEP_EDGES
        for lo, hi in zip(*(np.searchsorted(part, np.unique(part), side) for side in ("left", "right")), strict=True):
            n = count[lo:hi]
            edge = np.repeat(first[lo:hi] - np.cumsum(n) + n, n) + np.arange(n.sum())
            some = self.out_angle[edge] <= np.repeat(limit[lo:hi], n)
            found.append(self._once(np.stack([np.repeat(pool.point[lo:hi], n)[some], edge[some]])))
        return self._once(np.concatenate(found, axis=1))

    def _once(self, pairs: np.ndarray) -> np.ndarray:
        node = self.out_node[pairs[1]]
        order = np.lexsort((pairs[1], node, pairs[0]))
        pairs, node = pairs[:, order], node[order]
        new = np.ones(len(node), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (pairs[0, 1:] != pairs[0, :-1])
        return pairs[:, new]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end, least end of its component) of the pairs' components, for all ends but the least."""
    ends, at = np.unique(np.append(a, b), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(ends))
    while True:
        both = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, both)
        np.minimum.at(new, b, both)
        new = new[new]
        if (new == least).all():
            break
        least = new
    some = least != np.arange(len(ends))
    return ends[some], ends[least[some]]


_FOUND = "query long, cell string, links long, other long, entry long"


def _answers(batches: Iterator[pa.RecordBatch], beam: int, reach: float) -> Iterator[pa.RecordBatch]:
    """Rows come by shard: its nodes, then the queries. Gives, told apart by nulls,

    (query, cell, links), (query, other): a spanning link, and (query, cell, entry): a message.
    """

    single_thread()

    def rows(query, cell=None, links=None, other=None, entry=None):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.nulls(len(query), k) if v is None else pa.array(v, k) for v, k in zip((query, cell, links, other, entry), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["query", "cell", "links", "other", "entry"])

    def answered(shard: Shard, cell: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        points = _unit(_matrix(table.column("vector")))
        query = table.column("node").to_numpy()
        pool = shard.found(points, table.column("entries").to_pylist(), beam, reach)
        place = np.minimum(np.searchsorted(shard.node, query), len(shard.node) - 1)
        own = shard.node[place] == query
        here = own[pool.point]
        shard.met[place[pool.point[here]], pool.vector[here]] = True
        shard.asked[place[own]] = True
        links = np.zeros(len(query), dtype=np.int64)
        np.add.at(links, pool.point, shard.weight[pool.vector])
        yield rows(query[~own], [cell] * int((~own).sum()), links[~own])
        ends, least = spanning(query[pool.point], shard.node[pool.vector])
        yield rows(ends, other=least)
        point, edge = shard.onward(pool, reach)
        if len(point):
            yield rows(query[point], shard.out_home[edge].tolist(), entry=shard.out_node[edge])

    for cell, own in _cells(batches, "cell"):
        nodes, asked, shard = [], [], None
        for part in own:
            queries = part.column("asked").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(queries, True))
            if cut:
                nodes.append(part.slice(0, cut))
            part = part.slice(cut)
            while part.num_rows and (nodes or shard):  # a cell may have guests only
                if shard is None:
                    shard, nodes = Shard(pa.Table.from_batches(nodes)), []
                asked.append(part.slice(0, flatgraph.BATCH))
                part = part.slice(flatgraph.BATCH)
                if sum(a.num_rows for a in asked) >= flatgraph.BATCH:
                    yield from answered(shard, cell, pa.Table.from_batches(asked))
                    asked = []
        if asked:
            yield from answered(shard, cell, pa.Table.from_batches(asked))
        if shard is not None and shard.asked.any():
            own = np.flatnonzero(shard.asked)
            yield rows(shard.node[own], [cell] * len(own), shard.own_links()[own])


def _asked(graph: DataFrame, messages: DataFrame, beam: int, reach: float) -> DataFrame:
    """The answers to ``messages`` (query, cell, entry; entries may be null), staged."""
    entries = messages.groupBy("query", "cell").agg(F.collect_set("entry").alias("entries"))  # without nulls
    vectors = graph.select(F.col("node").alias("query"), "vector")
    asked = entries.join(vectors, "query").select(
        "cell", F.lit(True).alias("asked"), F.col("query").alias("node"), F.lit(None).cast("long").alias("weight"),
        "vector", F.lit(None).cast(_EDGES).alias("edges"), "entries",
    )
    nodes = graph.select(
        F.col("home").alias("cell"), F.lit(False).alias("asked"), "node", "weight", "vector", "edges",
        F.lit(None).cast("array<long>").alias("entries"),
    )
    nodes = nodes.join(messages.select("cell").distinct(), "cell", "left_semi")
    both = nodes.unionByName(asked).repartition(partitions(graph.sparkSession), "cell").sortWithinPartitions("cell", "asked", "node")
    return staged(both.mapInArrow(lambda batches: _answers(batches, beam, reach), _FOUND), "answers")


def _messages(answers: DataFrame) -> DataFrame:
    return answers.filter("entry IS NOT NULL").select("query", "cell", "entry").distinct()


def range_links(graph: DataFrame, members: DataFrame, beam: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """(query, links: rows found within the range, itself included) and spanning links (a, b)."""
    # a class starts at home from the medoid and from itself, and as a guest from the medoid
    home = F.when(~F.col("guest"), F.col("node"))
    fresh = staged(members.select(F.col("node").alias("query"), "cell", home.alias("entry")), "messages")
    known, results, spans = fresh, None, None
    while True:
        answers = _asked(graph, known.join(fresh.select("query", "cell").distinct(), ["query", "cell"], "left_semi"), beam, reach)
        links = answers.filter("links IS NOT NULL").select("query", "cell", "links")
        pairs = answers.filter("other IS NOT NULL").select(F.col("query").alias("a"), F.col("other").alias("b"))
        results, spans = (links, pairs) if results is None else (results.unionByName(links), spans.unionByName(pairs))
        fresh = staged(_messages(answers).join(known, ["query", "cell", "entry"], "left_anti"), "messages")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    most = results.groupBy("query", "cell").agg(F.max("links").alias("links"))  # a later turn starts from more entries
    return most.groupBy("query").agg(F.sum("links").alias("links")), spans


def brute_links(nodes: DataFrame, reach: float, audited: int = AUDITED) -> DataFrame:
    """For up to ``audited`` classes drawn by hash: node, and all rows within the range, itself included."""
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(audited).select("node", "label", "vector").collect()
    spark = nodes.sparkSession
    if not drawn:
        return nodes.select("node", F.col("weight").alias("exact"))
    ids, labels = np.array([r["node"] for r in drawn]), np.array([r["label"] for r in drawn])
    shared = spark.sparkContext.broadcast((ids, labels, _unit(np.array([r["vector"] for r in drawn]))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, points = shared.value
        total = np.zeros(len(ids), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(batch.column("vector"))) @ points.T >= reach
                near &= batch.column("label").to_numpy()[:, None] == labels
                total += (near * batch.column("weight").to_numpy()[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "exact"])

    counted = nodes.select("label", "weight", "vector").mapInArrow(count, "node long, exact long")
    return counted.groupBy("node").agg(F.sum("exact").alias("exact"))


def audited_recall(links: DataFrame, exact: DataFrame) -> float:
    """The share of drawn classes' links that were found; 1 where they have none."""
    both = exact.join(links.withColumnRenamed("query", "node"), "node")
    one = both.agg(F.sum("links").alias("found"), F.sum("exact").alias("exact")).first()
    return one["found"] / one["exact"] if one["exact"] else 1.0


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, limit: int = SHARD_ROWS, beam: int = flatgraph.BEAM, target: float = TARGET
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (whether it names its component)."""
    own = own_columns(embeddings, vec_id="vec_id", label="label", vector=F.col("embedding").cast("array<double>"))
    nodes = classes(own)
    members = shards(nodes, limit)
    graph = graph_of(nodes, members)
    exact = staged(brute_links(nodes, threshold), "audit")
    while True:
        links, spans = range_links(graph, members, beam, threshold)
        links = staged(links, "links")
        if beam >= limit or audited_recall(links, exact) >= target:
            break
        beam *= 2
    groups = components(spans)
    named = nodes.join(links.withColumnRenamed("query", "node"), "node").join(groups, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = staged(named.groupBy("component").agg(F.min("least").alias("first")), "components")
    named = staged(named.join(least, "component").select("label", "vector", "links", "first"), "named").toDF("_label", "_vector", "links", "first")
    out = own.join(named, own["label"].eqNullSafe(named["_label"]) & own["vector"].eqNullSafe(named["_vector"]), "left")
    first = F.coalesce("first", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("long").alias("n_links"), first.alias("component_id"),
        F.coalesce(F.col("vec_id") == first, F.lit(True)).alias("kept"),
    )
