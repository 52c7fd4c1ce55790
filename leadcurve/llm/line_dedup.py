"""Removal of repeated runs of lines, by a suffix array over line ids.

Only lines that hold a word count; their id is a hash of their words. Every line begins
a suffix of its document. Prefix doubling sorts the suffixes: two neighbouring names for
``n`` lines make one for ``2 n`` lines, and sorting the pairs over range partitions
gives names in suffix order. A suffix whose first lines stand nowhere else is done and
leaves the next round, so a round works only on what is still repeated.

Suffixes that share the name of their first ``min_lines`` lines form an interval of the
suffix array with a longest common prefix of at least as many lines. In each interval
the first copy (smallest doc_id, then text_key, then place) stays; the others' lines are
deleted. A run of more than ``min_lines`` lines is the union of its parts, so maximal
runs go as a whole. ``repeated`` tells how many lines two copies share at least.

Null and empty texts have no lines; documents without doc_id take no part. Rows that
are equal in doc_id and text are one document: the same lines go from all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadcurve.llm import words as W
from leadcurve.llm.frames import own_columns, partitions, staged, text_key

MIN_LINES = 3

_PLACE = ["doc_id", "text_key", "at"]


def line_ids(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, lines: the hash of each line that holds a word."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            words = W.split_words(batch.column("text"))
            lines = W.split_lines(words, W.text_buffer(batch.column("text"))[1])
            ids = W.sequence_hash(W.running(words.hashes()), lines.word, lines.word_end)
            bounds = np.searchsorted(lines.row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), lists], ["doc_id", "text_key", "lines"]
            )

    return documents.select("doc_id", "text_key", "text").mapInArrow(
        hashed, "doc_id long, text_key long, lines array<long>"
    )


def _named(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """Suffixes whose ``by`` occurs at several places, with its name: names follow the order of ``by``."""
    shared = suffixes.groupBy(*by).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(*by)
    sorted_ = shared.repartitionByRange(partitions(shared.sparkSession), *by).sortWithinPartitions(*by)
    names = staged(sorted_.withColumn("_name", F.monotonically_increasing_id()), "names")
    return suffixes.join(names, by).select(*_PLACE, F.col("_name").alias("name"))


def _doubled(suffixes: DataFrame, step: int) -> DataFrame:
    """Suffixes with the name that stands ``step`` lines further; those without one are done."""
    ahead = Window.partitionBy("doc_id", "text_key").orderBy("at").rangeBetween(step, step)
    return suffixes.withColumn("next", F.first("name").over(ahead)).filter("next IS NOT NULL")


def suffix_rounds(ids: DataFrame) -> Iterator[tuple[int, DataFrame]]:
    """(n, suffixes with ``name``): the repeated suffixes sorted by their first n lines, n = 1, 2, 4, ..."""
    places = ids.select("doc_id", "text_key", F.posexplode("lines").alias("at", "line"))
    n, found = 1, staged(_named(places, ["line"]), "suffixes")
    while not found.isEmpty():
        yield n, found
        found = staged(_named(_doubled(found, n), ["name", "next"]), "suffixes")
        n *= 2


def _later_copies(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """Of suffixes with equal ``by``, all but the first."""
    place = F.struct(*_PLACE)
    first = suffixes.groupBy(*by).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    first = staged(first, "firsts")  # written, so that the join is free to split a hot name
    return suffixes.join(first, by).filter(place > F.col("first")).select(*_PLACE)


def repeated_runs(documents: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, text_key and ``runs``, an array of (lo, hi, repeated): lines that an earlier place has.

    Lines are counted among those that hold a word. ``repeated``: a power of two of
    lines, from the run's first line on, that another place shares.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be positive")
    usable = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    ids = staged(line_ids(usable).dropDuplicates(["doc_id", "text_key"]), "line-ids")
    later, depths = None, None
    for n, found in suffix_rounds(ids):
        if n <= min_lines < 2 * n:
            if n == min_lines:
                later = _later_copies(found, ["name"])
            else:  # two overlapping names cover min_lines lines
                later = _later_copies(_doubled(found, min_lines - n), ["name", "next"])
        if n >= min_lines:
            depth = found.select(*_PLACE, F.lit(n).alias("repeated"))
            depths = depth if depths is None else depths.unionByName(depth)
    if later is None:
        return ids.limit(0).select("doc_id", "text_key", F.expr("CAST(array() AS array<struct<lo: int, hi: int, repeated: int>>)").alias("runs"))
    if depths is not None:
        deepest = depths.groupBy(*_PLACE).agg(F.max("repeated").alias("repeated"))
        later = later.join(deepest, _PLACE, "left")
    else:
        later = later.withColumn("repeated", F.lit(None).cast("int"))
    in_order = Window.partitionBy("doc_id", "text_key").orderBy("at")
    new = F.coalesce(F.col("at") > F.lag("at").over(in_order) + min_lines, F.lit(True))
    runs = later.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(in_order))
    runs = runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("at").alias("lo"), (F.max("at") + min_lines).alias("hi"),
        F.max(F.coalesce("repeated", F.lit(min_lines))).alias("repeated"),
    )
    return runs.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi", "repeated")).alias("runs"))


def _kept_text(text: str, runs: list) -> tuple[str, int, int]:
    """The text left, its lines with a word before, and how many of them went."""
    data = text.encode()
    words = W.split_words(pa.array([data], pa.binary()))
    lines = W.split_lines(words, np.array([0, len(words.buf)]))
    if not runs:
        return text, len(lines.number), 0
    gone = np.unique(np.concatenate([np.arange(r["lo"], r["hi"]) for r in runs]))
    out = data.split(b"\n")
    for i in lines.number[gone][::-1]:
        del out[i]
    return b"\n".join(out).decode(), len(lines.number), len(gone)


def _with_runs(documents: DataFrame, columns: list[str], min_lines: int) -> DataFrame:
    own = own_columns(documents, doc_id="doc_id", text="text", text_key=text_key())
    runs = staged(repeated_runs(own, min_lines), "runs").toDF("_doc_id", "_text_key", "_runs")
    same = (documents["doc_id"] == runs["_doc_id"]) & (text_key() == runs["_text_key"])
    return documents.join(runs.hint("merge"), same, "left").select(*[documents[c] for c in columns], "_runs")


def verdicts(documents: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Per row: doc_id, n_lines (with a word), n_removed, longest_run, kept_sha256 (of the text left)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            rows = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("_runs").to_pylist(), strict=True):
                left, n, gone = _kept_text(text or "", runs)
                longest = max((r["hi"] - r["lo"] for r in runs or ()), default=0)
                rows.append((n, gone, longest, hashlib.sha256(left.encode()).hexdigest()))
            n, gone, longest, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(longest, pa.int64()), pa.array(sha),
                ],
                ["doc_id", "n_lines", "n_removed", "longest_run", "kept_sha256"],
            )

    return _with_runs(documents, ["doc_id", "text"], min_lines).mapInArrow(
        digest, "doc_id long, n_lines long, n_removed long, longest_run long, kept_sha256 string"
    )


def without_repeats(documents: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """``documents`` with repeated runs of lines taken out of ``text`` and n_chars set anew. All rows stay."""
    columns = documents.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            texts = [
                _kept_text(text, runs)[0] if runs else text
                for text, runs in zip(batch.column("text").to_pylist(), batch.column("_runs").to_pylist(), strict=True)
            ]
            own = batch.select(columns)
            yield own.set_column(columns.index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    out = _with_runs(documents, columns, min_lines).mapInArrow(cut, documents.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out
