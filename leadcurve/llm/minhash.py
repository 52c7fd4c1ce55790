"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document's set holds its distinct runs of ``shingle`` words, A-Z in lower case; with
fewer words the whole sequence is the one member. Documents with equal sets form a
class, and one set stands for it. A class's hashes fall into ``bands * rows`` bins;
each bin keeps its smallest hash and an empty bin takes the value of another bin, drawn
by a fixed sequence, until that one is full. Classes that agree on a band share a bucket.

All classes of a bucket are compared, except those already known to be of one component.
A bucket first gives two stars: from its smallest member, and from a member drawn anew in
every bucket. The first star binds large groups at once; the second one's pairs are
confirmed only where the first has not put both ends in one component. A bucket whose
members still lie in several components gives a third star, from the member that meets
most others over all its bands, which is about a group's centre. What is open after that
is compared pair by pair: small buckets give their pairs, large ones are dealt to blocks
of bounded size, and every two blocks are compared inside a task. Every link is confirmed
on the full sets.

Documents without words, or without doc_id, are linked with nothing and are kept. Rows
that share a doc_id are one document: their links are joined, and all of them stay if
it does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadcurve.llm import words as W
from leadcurve.llm.frames import own_columns, staged, text_key
from leadcurve.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 32, 5
PERCENT = 85

PAIRED = 8  # open buckets of at most so many members give their pairs
BLOCK, BLOCK_SHINGLES = 256, 1 << 18  # about what a block of a larger one holds

_EMPTY = np.iinfo(np.int64).max


class Shingles:
    """Distinct shingle hashes of each text: ``hash`` sorted inside ``row``; ``first`` bounds the rows."""

    def __init__(self, column: pa.Array, shingle: int):
        words = W.split_words(column, lower=True)
        run = W.running(words.hashes())
        count = np.diff(words.first)
        short = np.flatnonzero((count > 0) & (count < shingle))
        at = words.inside(shingle)
        hashes = np.concatenate(
            [
                W.sequence_hash(run, at, at + shingle),
                W.sequence_hash(run, words.first[short], words.first[short + 1]),
            ]
        )
        row = np.concatenate([words.row[at], short]).astype(np.uint32)
        order = np.argsort(hashes)
        order = order[np.argsort(row[order], kind="stable")]
        hashes, row = hashes[order], row[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        self.hash, self.row = hashes[new], row[new].astype(np.int64)
        self.first = np.searchsorted(self.row, np.arange(len(count) + 1))
        self.size = np.diff(self.first)

    def digest(self, salt: int) -> np.ndarray:
        """A 64-bit hash of each set."""
        with np.errstate(over="ignore"):
            run = np.zeros(len(self.hash) + 1, dtype=np.uint64)
            np.cumsum(W.mix(self.hash ^ np.uint64(salt)), out=run[1:])
            return W.mix(run[self.first[1:]] - run[self.first[:-1]] + self.size.astype(np.uint64)).view(np.int64)

    def signature(self, bins: int) -> np.ndarray:
        """Smallest hash of each bin, one pass over the set; texts without a set give empty bins."""
        out = np.full((len(self.size), bins), _EMPTY, dtype=np.int64)
        value = (self.hash & np.uint64(0xFFFFFFFF)).astype(np.int64)
        bin_of = ((self.hash >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out.reshape(-1), self.row * bins + bin_of, value)
        full = out != _EMPTY
        row, at = np.nonzero(~full & (self.size > 0)[:, None])
        attempt = 0
        while len(row):
            attempt += 1
            drawn = W.mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 40)) % np.uint64(bins)
            other = drawn.astype(np.int64)[at]
            hit = full[row, other]
            out[row[hit], at[hit]] = out[row[hit], other[hit]]
            row, at = row[~hit], at[~hit]
        return out


def _band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(W.mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(rows):
        key = W.mix(key ^ parts[:, :, i])
    return key.view(np.int64)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def signatures(documents: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_key, n_shingles, the set's digest (set_a, set_b) and its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            sets = Shingles(batch.column("text"), shingle)
            keys = _band_keys(sets.signature(bands * rows), bands)
            offsets = np.append(0, np.cumsum(np.where(sets.size > 0, bands, 0)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(sets.size, pa.int64()),
                    pa.array(sets.digest(0)), pa.array(sets.digest(0x5851F42D4C957F2D)),
                    _lists(keys[sets.size > 0].reshape(-1), offsets),
                ],
                ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"],
            )

    return documents.select("doc_id", "text_key", "text").mapInArrow(
        sign, "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>"
    )


def shingle_sets(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node and its sorted set, for the texts given."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            sets = Shingles(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), _lists(sets.hash.view(np.int64), sets.first)], ["node", "members"]
            )

    return documents.select("node", "text").mapInArrow(build, "node long, members array<long>")


def _met(classes: DataFrame) -> DataFrame:
    """(band, node)."""
    return classes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))


def _stars(classes: DataFrame) -> DataFrame:
    """(member, hub, first): each bucket's members with its smallest and with its drawn member."""
    keyed = _met(classes)
    mask = F.xxhash64("band")  # a drawn order of the nodes of a bucket, and its own inverse
    hubs = (
        keyed.groupBy("band")
        .agg(F.min("node").alias("least"), F.min(F.col("node").bitwiseXOR(mask)).alias("drawn"), F.max("node").alias("most"))
        .filter("least < most")
        .select("band", "least", F.col("drawn").bitwiseXOR(mask).alias("drawn"))
    )
    met = keyed.join(staged(hubs, "hubs"), "band")
    pairs = met.select("node", F.inline(F.array(
        F.struct(F.col("least").alias("hub"), F.lit(True).alias("first")),
        F.struct(F.col("drawn").alias("hub"), F.lit(False).alias("first")),
    ))).filter("node <> hub")
    return pairs.groupBy(F.col("node").alias("member"), "hub").agg(F.max("first").alias("first"))


def _open_buckets(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """band, node, n_shingles and component of the buckets that hold several components.

    Of buckets with the same members one is left.
    """
    known = known.withColumnRenamed("component", "found")
    placed = keyed.join(known, "node", "left").withColumn("component", F.coalesce("found", "node")).drop("found")
    placed = staged(placed, "placed")
    folded = [F.sum(F.xxhash64(F.col("node"), F.lit(salt)).cast("decimal(38,0)")).alias(f"s{salt}") for salt in (1, 2)]
    buckets = placed.groupBy("band").agg(
        F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n"), *folded
    )
    bands = buckets.filter("least < most").groupBy("n", "s1", "s2").agg(F.min("band").alias("band")).select("band")
    return staged(placed.join(staged(bands, "open-bands"), "band"), "open")


def _central_stars(members: DataFrame) -> DataFrame:
    """(member, hub) of open buckets; the hub is the member with most others in all its buckets."""
    sizes = staged(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "sizes")
    weight = staged(members.join(sizes, "band").groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    ranked = members.join(weight, "node")
    hubs = ranked.groupBy("band").agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("component").alias("of")), F.struct("meets", "node")).alias("h"))
    hubs = staged(hubs.select("band", "h.hub", "h.of"), "centres")
    return members.join(hubs, "band").filter("component <> of").select(F.col("node").alias("member"), "hub").distinct()


class _Block:
    """The sets of some nodes, with shingles numbered; hubs are compared with all others at once."""

    def __init__(self, component: np.ndarray, lists: pa.ListArray):
        values, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        self.at, self.size = at, np.diff(lists.offsets.to_numpy())
        self.first = np.append(0, np.cumsum(self.size))
        _, self.part = np.unique(component, return_inverse=True)
        self.mark = np.zeros(len(values), dtype=bool)
        # a group's centre has its group's most common shingles
        share = np.add.reduceat(np.bincount(at, minlength=len(values))[at], self.first[:-1]) / self.size
        self.order = np.argsort(-share, kind="stable")

    def links(self, side: np.ndarray, cross: bool, percent: int) -> Iterator[tuple[int, int]]:
        """Similar pairs until all that can be linked are: inside the block, or between its two sides."""
        left = np.ones(len(self.size), dtype=bool)
        for hub in self.order:
            if cross and side[hub]:
                continue
            left[hub] = False
            own, size = self.size[hub], self.size
            meets = (side if cross else left) & (self.part != self.part[hub])
            meets &= 100 * np.minimum(size, own) >= percent * np.maximum(size, own)
            some = np.flatnonzero(meets)
            if not len(some):
                continue
            self.mark[self.at[self.first[hub] : self.first[hub + 1]]] = True
            length = size[some]
            begin = np.append(0, np.cumsum(length))
            index = np.repeat(self.first[some] - begin[:-1], length) + np.arange(begin[-1])
            both = np.add.reduceat(self.mark[self.at[index]].astype(np.int64), begin[:-1])
            self.mark[:] = False
            for other in some[100 * both >= percent * (own + length - both)]:
                if self.part[other] != self.part[hub]:
                    self.part[self.part == self.part[other]] = self.part[hub]
                    yield int(hub), int(other)


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different components of large open buckets, from comparing every two blocks."""
    parts = members.groupBy("band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    dealt = members.join(staged(parts, "blocks"), "band").withColumn("own", F.pmod(F.xxhash64("node", "band"), "blocks").cast("int"))
    dealt = dealt.select("node", "component", "band", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "node", "component", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("side")
    )
    rows = dealt.join(sets, "node").select("band", "lo", "hi", "side", "node", "component", "members")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table.column("node").to_numpy()
        side = table.column("side").to_numpy(zero_copy_only=False)
        cross = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        lists = table.column("members").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        found = list(_Block(table.column("component").to_numpy(), lists).links(side, cross, percent))
        a, b = (np.array([x[k] for x in found], dtype=np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return rows.groupBy("band", "lo", "hi").applyInArrow(compare, "a long, b long")


def _small_pairs(members: DataFrame) -> DataFrame:
    """(member, hub): every two members of different components, of buckets of at most ``PAIRED``."""
    own = F.collect_list(F.struct("node", "component")).alias("all")
    sides = members.groupBy("band").agg(own).select(F.explode("all").alias("x"), "all")
    pairs = sides.select("x", F.explode("all").alias("y")).filter("x.node < y.node AND x.component <> y.component")
    return pairs.select(F.col("x.node").alias("member"), F.col("y.node").alias("hub")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough."""
    left = pairs.join(sets.toDF("member", "own"), "member")
    both = left.join(sets.toDF("hub", "other"), "hub")
    common = F.size(F.array_intersect("own", "other"))
    close = 100 * common >= percent * (F.size("own") + F.size("other") - common)
    bound = 100 * F.least(F.size("own"), F.size("other")) >= percent * F.greatest(F.size("own"), F.size("other"))
    return both.filter(bound).filter(close).select(F.col("member").alias("a"), F.col("hub").alias("b"))


def _settled(classes: DataFrame, sets: DataFrame, links: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Components after all classes that share a bucket were compared or found to be of one component."""
    keyed = _met(classes).join(classes.groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n_shingles")), "node").distinct()
    members = _open_buckets(keyed, known)
    if members.isEmpty():
        return known
    more = staged(_confirmed(_central_stars(members), sets, percent), "confirmed")
    if not more.isEmpty():
        links = links.unionByName(more)
        known = components(links)
        members = _open_buckets(members.drop("component"), known)
    sizes = staged(members.groupBy("band").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sized = members.join(sizes, "band")
    small = _confirmed(_small_pairs(sized.filter(f"n <= {PAIRED}")), sets, percent)
    large = _block_links(sized.filter(f"n > {PAIRED}").drop("n"), sets, percent)
    more = staged(small.unionByName(large), "confirmed")
    if not more.isEmpty():
        known = components(links.unionByName(more))
    return known


def groups(
    documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row of ``documents`` (doc_id, text, text_key): doc_id, text_key, n_shingles, component_id, kept."""
    signed = staged(signatures(documents, shingle, bands, rows), "signatures")
    sets_of = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["set_a", "set_b", "n_shingles"]
    classes = sets_of.groupBy(*digest).agg(F.min("doc_id").alias("node"))
    classes = staged(classes, "classes")  # written, so that the join is free to split a hot class
    member_of = staged(
        sets_of.join(classes, digest).select("doc_id", "node", "text_key", "n_shingles", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands")), "members"
    )
    first_rows = member_of.filter("bands IS NOT NULL").dropDuplicates(["doc_id", "text_key"])
    pairs = staged(_stars(first_rows), "stars")
    wanted = pairs.select(F.col("member").alias("node")).unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    texts = first_rows.join(wanted, "node", "left_semi").select("doc_id", "text_key")
    texts = documents.join(texts, ["doc_id", "text_key"], "left_semi").withColumnRenamed("doc_id", "node")
    sets = staged(shingle_sets(texts, shingle).dropDuplicates(["node", "members"]), "sets")

    rows_of_one = member_of.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).filter("b < most")
    joined = member_of.join(rows_of_one.select("doc_id", "b"), "doc_id").select(F.col("node").alias("a"), "b")
    links = staged(_confirmed(pairs.filter("first"), sets, percent).unionByName(joined), "confirmed")
    known = components(links)
    open_pairs = (
        pairs.filter("NOT first")
        .join(known.toDF("member", "ca"), "member", "left")
        .join(known.toDF("hub", "cb"), "hub", "left")
        .filter("ca IS NULL OR cb IS NULL OR ca <> cb")
        .select("member", "hub")
    )
    more = staged(_confirmed(open_pairs, sets, percent), "confirmed")
    if not more.isEmpty():
        links = links.unionByName(more)
        known = components(links)
    known = _settled(first_rows, sets, links, known, percent)
    found = member_of.select("doc_id", "node").distinct().join(known, "node", "left")
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    out = signed.select("doc_id", "text_key", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id of its group), kept."""
    own = own_columns(documents, doc_id="doc_id", text="text", text_key=text_key())
    return groups(own, **options).drop("text_key")


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """``documents`` without those that are not the smallest of their group."""
    own = own_columns(documents, doc_id="doc_id", text="text", text_key=text_key())
    gone = groups(own, **options).filter("NOT kept").select("doc_id").distinct()
    return documents.join(staged(gone, "copies"), "doc_id", "left_anti").select(*documents.columns)
