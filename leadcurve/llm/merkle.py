"""A Merkle manifest of a table of documents, with proofs and versions by path copying.

Every row is a leaf. Per source the leaves ascend by doc_id; runs of three consecutive
nodes become their parent until one is left, the subroot; the subroots, by source, become
the root likewise. Range partitions and their counts give each leaf its place, so that no
source is sorted in one task. A tree is built in aligned blocks of 3**8 leaves: one task
builds a block's nodes and passes on its root, and the roots of blocks are the leaves of
the next level of blocks, up to the root.

Trees are persistent. A changed leaf makes a version of its block that copies the nodes
from the leaf to the block's root and shares all others with the tree as it was. The
version goes on above the block with what the levels above passed down: the siblings of
the block's root there. Every version starts from the original tree.

Null sources form a source of their own, before all others. A null doc_id stands before
all others of its source and is never changed; rows of one doc_id stand in the order of
their leaves, and equal rows are leaves of their own. Null and empty texts differ. An
empty table has no root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.llm.frames import own_columns, partitions, staged

FANOUT = 3
BLOCK_LEVELS = 8  # a block holds FANOUT ** BLOCK_LEVELS nodes at most

Node = tuple[str, tuple]  # digest in hex, children
Path = list[tuple[str, str]]  # from below: siblings' digests to the left and to the right

_NODES = "source string, block long, place long, count long, digest string"
_PATH = "array<struct<left: string, right: string>>"


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _parent(children: tuple[Node, ...]) -> Node:
    return sha256("".join(c[0] for c in children)), children


def height(nodes: int, limit: int) -> int:
    """Levels above so many nodes until one is left, ``limit`` at most."""
    levels = 0
    while nodes > 1 and levels < limit:
        nodes, levels = -(-nodes // FANOUT), levels + 1
    return levels


def built(leaves: list[str], levels: int) -> Node:
    """The tree over the leaves, with exactly so many levels above them."""
    nodes: list[Node] = [(leaf, ()) for leaf in leaves]
    for _ in range(levels):
        nodes = [_parent(tuple(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
    (root,) = nodes
    return root


def changed(node: Node, levels: int, at: int, digest: str) -> Node:
    """The version with another leaf: nodes on the way to it are new, all others are shared."""
    if not levels:
        return digest, ()
    slot, rest = divmod(at, FANOUT ** (levels - 1))
    children = node[1]
    return _parent((*children[:slot], changed(children[slot], levels - 1, rest, digest), *children[slot + 1 :]))


def path(node: Node, levels: int, at: int) -> Path:
    """The siblings of a leaf and of its ancestors, from below."""
    out = []
    for level in range(levels - 1, -1, -1):
        slot, at = divmod(at, FANOUT**level)
        children = node[1]
        out.append(("".join(c[0] for c in children[:slot]), "".join(c[0] for c in children[slot + 1 :])))
        node = children[slot]
    return out[::-1]


def folded(digest: str, way: Path) -> str:
    for left, right in way:
        digest = sha256(left + digest + right)
    return digest


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]).cast("binary"), 256)


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` with their place in their source by ``order`` and the count of the source, staged.

    Rows are dealt to ranges of (source, order) and numbered inside them; what a source has
    in the ranges before is added.
    """
    by = ["source", *order]
    ranged = leaves.repartitionByRange(partitions(leaves.sparkSession), *by).sortWithinPartitions(*by)
    numbered = staged(ranged.withColumn("_id", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_id", 33)
    sizes = numbered.groupBy("source", part.alias("_part")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("source").orderBy("_part")
    sizes = sizes.withColumn("_before", F.sum("_rows").over(earlier) - F.col("_rows"))
    sizes = sizes.withColumn("count", F.sum("_rows").over(Window.partitionBy("source")))
    sizes = staged(sizes.withColumnRenamed("source", "_source"), "leaf-ranges")  # one row per source and range
    here = numbered["source"].eqNullSafe(sizes["_source"]) & (part == sizes["_part"])
    place = F.col("_id") - F.col("_first") + F.col("_before")
    return numbered.join(sizes, here).select(*leaves.columns, place.alias("place"), "count")


def _blocked(nodes: DataFrame, limit: int) -> Column:
    return F.floor(nodes["place"] / FANOUT**limit).cast("long")


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    spread = rows.repartition(partitions(rows.sparkSession), "source", "block")
    return spread.sortWithinPartitions("source", "block", *order)


def _block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, own in groupby(rows, key=lambda r: (r["source"], r["block"])):
        yield list(own)


def _trees(nodes: DataFrame, limit: int) -> DataFrame:
    """The root of each block: (source, place, count) among the blocks of its source, digest."""

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _block_rows(batches):
            top, _ = built([r["digest"] for r in rows], height(rows[0]["count"], limit))
            count = -(-rows[0]["count"] // FANOUT**limit)
            yield pa.RecordBatch.from_pylist([{"source": rows[0]["source"], "place": rows[0]["block"], "count": count, "digest": top}], _roots)

    _roots = pa.schema([("source", pa.string()), ("place", pa.int64()), ("count", pa.int64()), ("digest", pa.string())])
    own = nodes.select("source", _blocked(nodes, limit).alias("block"), "place", "count", "digest")
    return _by_block(own, "place").mapInArrow(root, "source string, place long, count long, digest string")


def _paths(nodes: DataFrame, above: DataFrame | None, limit: int) -> DataFrame:
    """The way of each node up to its source's root, with that root: (source, place, way, top).

    ``above``: the same of the blocks, which are nodes of the level above; None where every
    block is a whole tree.
    """

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _block_rows(batches):
            rest, top = (rows[0]["way"], rows[0]["top"]) if rows[0]["place"] is None else ([], None)
            own = rows[1:] if rows[0]["place"] is None else rows
            levels = height(own[0]["count"], limit)
            tree = built([r["digest"] for r in own], levels)
            out = []
            for i, r in enumerate(own):
                way = [{"left": a, "right": b} for a, b in path(tree, levels, i)] + rest
                out.append({"source": r["source"], "place": r["place"], "way": way, "top": top or tree[0]})
            for lo in range(0, len(out), 512):
                yield pa.RecordBatch.from_pylist(out[lo : lo + 512], _ways)

    _side = pa.struct([("left", pa.string()), ("right", pa.string())])
    _ways = pa.schema([("source", pa.string()), ("place", pa.int64()), ("way", pa.list_(_side)), ("top", pa.string())])
    own = nodes.select("source", _blocked(nodes, limit).alias("block"), "place", "count", "digest")
    rows = own.withColumns({"way": F.lit(None).cast(_PATH), "top": F.lit(None).cast("string")})
    if above is not None:
        none = F.lit(None)
        rows = rows.unionByName(
            above.select(
                "source", F.col("place").alias("block"), none.cast("long").alias("place"), none.cast("long").alias("count"),
                none.cast("string").alias("digest"), "way", "top",
            )
        )
    return _by_block(rows, F.col("place").asc_nulls_first()).mapInArrow(ways, f"source string, place long, way {_PATH}, top string")


def _climbed(nodes: DataFrame, limit: int) -> list[DataFrame]:
    """Levels of blocks above ``nodes``, each staged, until every source has one node."""
    levels = []
    while True:
        nodes = staged(_trees(nodes, limit), "block-roots")
        levels.append(nodes)
        if nodes.filter("count > 1").isEmpty():
            return levels


def _descended(levels: list[DataFrame], limit: int) -> DataFrame:
    """The way of each node of the lowest level to its source's root."""
    way = None
    for nodes in levels[::-1]:
        way = _paths(nodes, way, limit)
    return staged(way, "ways")


def manifest(leaves: DataFrame, limit: int = BLOCK_LEVELS) -> DataFrame:
    """For each block of leaves (source, block): subroot, root, and the way of the block's root up to the root.

    ``leaves``: source, place, count, digest. A block has ``limit`` levels.
    """
    levels = _climbed(leaves, limit)
    below = _descended(levels, limit)  # (source, place of the block, way, subroot)
    tops = levels[-1].select(F.lit("").alias("source"), F.col("source").alias("own"), "digest")
    tops = staged(placed(tops, "own"), "subroots")
    all_ways = _descended([tops.select("source", "place", "count", "digest"), *_climbed(tops, limit)], limit)
    upper = tops.join(all_ways, ["source", "place"]).select("own", F.col("way").alias("rest"), F.col("top").alias("root"))
    upper = staged(upper, "subroot-ways")
    same = below["source"].eqNullSafe(upper["own"])
    return below.join(upper, same).select(
        "source", F.col("place").alias("block"), F.concat("way", "rest").alias("way"), F.col("top").alias("subroot"), "root"
    )


def _verified(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows come by block: the block's way first, then its leaves."""
    for rows in _block_rows(batches):
        upper, own = rows[0], rows[1:]
        rest = [(s["left"], s["right"]) for s in upper["way"]]
        levels = height(own[0]["count"], limit)
        tree = built([r["digest"] for r in own], levels)
        out = []
        for i, r in enumerate(own):
            version = tree if r["tampered"] is None else changed(tree, levels, i, r["tampered"])
            way = path(tree, levels, i) + rest
            end = folded(version[0], rest)
            out.append(
                {
                    "doc_id": r["doc_id"], "leaf": r["digest"], "subroot": upper["subroot"], "root": upper["root"],
                    "proof_sha256": sha256("".join(a + b for a, b in way)), "folded_root": end, "verified": end == upper["root"],
                }
            )
        yield pa.RecordBatch.from_pylist(out, _PROOFS)


_TEXTS = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
_PROOFS = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in _TEXTS], ("verified", pa.bool_())])


def proofs(leaves: DataFrame, limit: int = BLOCK_LEVELS) -> DataFrame:
    """Each leaf with its proof, and the root that its changed version (``tampered``, where not null) leads to.

    ``leaves``: doc_id, source, digest, tampered; digests in lower-case hex.
    """
    own = placed(leaves, "doc_id", "digest")
    ways = manifest(own.select("source", "place", "count", "digest"), limit)
    own = own.withColumn("block", _blocked(own, limit)).withColumns(
        {"way": F.lit(None).cast(_PATH), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")}
    )
    rows = own.unionByName(ways, allowMissingColumns=True)
    return _by_block(rows, F.col("place").asc_nulls_first()).mapInArrow(
        lambda batches: _verified(batches, limit),
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


def tamper_checks(documents: DataFrame, limit: int = BLOCK_LEVELS) -> DataFrame:
    """The proof of every document, and whether it still holds for what a tampering left of the text.

    Tampered are the documents whose crc32 of the decimal doc_id is even: their text loses
    its line feeds. Texts without one stay as they are, and still verify.
    """
    own = own_columns(documents, **{c: c for c in ("doc_id", "source", "lang", "n_chars", "text")})
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return proofs(
        own.select(
            "doc_id", "source", leaf(*fields, F.col("text")).alias("digest"),
            F.when(even, leaf(*fields, F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"),
        ),
        limit,
    )
