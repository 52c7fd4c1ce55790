"""Quality rules: per-document counts, and lines that many documents of a host share.

Lines are compared in lower case (A-Z) with white space runs as one space, by hash. A
line is common in a host when more than ``min_docs`` documents and more than
``share`` percent of the host's documents hold it. Common lines are removed from every
document of the host but the one with the smallest doc_id, so that no text is lost
altogether. A document is depleted, and rejected, when fewer than ``min_words`` words or
fewer than ``left`` percent of its words are left.

A null source is the host ''. Null texts have no lines and fail the base rule. A null
doc_id does not count as a document, and its common lines are removed. Rows that share
a doc_id count once per line, and each is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve.llm import words as W
from leadcurve.llm.frames import own_columns, staged, text_key

MIN_WORDS = 20
REPEAT_WINDOW, REPEAT_PERCENT = 8, 30
MIN_DOCS, SHARE_PERCENT = 10, 5
LEFT_PERCENT = 30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = (
    "doc_id long, text_key long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line: long, words: int>>"
)


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.append(0, np.cumsum(flags, dtype=np.int64))
    return run[bounds[1:]] - run[bounds[:-1]]


def _line_hashes(words: W.Words, lines: W.Lines) -> np.ndarray:
    """Of words in lower case, whatever stands between them."""
    lower = W.Words(W.lowered(words.buf), words.start, words.end, words.row, words.first)
    return W.sequence_hash(W.running(lower.hashes()), lines.word, lines.word_end)


def _repeated_words(words: W.Words, rows: int, window: int) -> np.ndarray:
    """Words inside windows that their text holds twice or more."""
    one = W.spaced(words)
    at = one.inside(window)
    hashes = W.sequence_hash(W.running(one.hashes()), at, at + window)
    order, group = W.equal_groups(one.buf, one.start[at], one.end[at + window - 1], hashes, one.row[at])
    often = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, at[order[often]], 1)
    np.add.at(change, at[order[often]] + window, -1)
    return _per_row(np.cumsum(change[:-1]) > 0, words.first)


def _line_lists(row: np.ndarray, line: np.ndarray, size: np.ndarray, rows: int) -> pa.Array:
    """Distinct lines of each text, with the words of all their copies."""
    order = np.lexsort((line, row))
    row, line, size = row[order], line[order], size[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    head = np.flatnonzero(new)
    total = np.add.reduceat(size, head) if len(head) else size
    structs = pa.StructArray.from_arrays(
        [pa.array(line[head].view(np.int64)), pa.array(total, pa.int32())], ["line", "words"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[head], np.arange(rows + 1)), pa.int32()), structs)


def measured(documents: DataFrame, window: int = REPEAT_WINDOW) -> DataFrame:
    """Counts and lines of each row of ``documents`` (doc_id, text_key, host, text)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            _, offsets = W.text_buffer(batch.column("text"))
            words = W.split_words(batch.column("text"))
            lines = W.split_lines(words, offsets)
            raw = W.Words(words.buf, lines.start, lines.end, lines.row, lines.row)
            order, group = W.equal_groups(words.buf, lines.start, lines.end, raw.hashes(), lines.row)
            head = np.flatnonzero(np.append(True, np.diff(group) > 0)) if len(group) else group
            distinct = np.bincount(lines.row[order[head]], minlength=batch.num_rows)
            shown = np.bincount(lines.row, minlength=batch.num_rows)
            letters = ((words.buf & 0xC0) != 0x80) & ~W.spaces(words.buf)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), batch.column("host"),
                    pa.array(np.diff(words.first), pa.int64()), pa.array(_per_row(letters, offsets)),
                    pa.array(_per_row(_SYMBOL[words.buf], offsets)), pa.array(shown - distinct, pa.int64()),
                    pa.array(_repeated_words(words, batch.num_rows, window)),
                    _line_lists(
                        lines.row, _line_hashes(words, lines), lines.word_end - lines.word, batch.num_rows
                    ),
                ],
                ["doc_id", "text_key", "host", *_COUNTS, "lines"],
            )

    return documents.select("doc_id", "text_key", "host", "text").mapInArrow(measure, _SCHEMA)


def common_lines(found: DataFrame, min_docs: int = MIN_DOCS, share: int = SHARE_PERCENT) -> DataFrame:
    """(host, line, first): lines above the limits and the smallest document that holds each."""
    lines = found.select("host", "doc_id", F.explode("lines.line").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("first"))
    hosts = found.groupBy("host").agg(F.countDistinct("doc_id").alias("docs"))
    return counts.filter(F.col("n") > min_docs).join(hosts, "host").filter(F.col("n") * 100 > F.col("docs") * share).select("host", "line", "first")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judged(
    documents: DataFrame, min_docs: int = MIN_DOCS, share: int = SHARE_PERCENT, min_words: int = MIN_WORDS,
    left: int = LEFT_PERCENT,
) -> DataFrame:
    """Per row of ``documents`` (doc_id, text_key, host, text): its counts, its verdict, and ``gone``, its common lines."""
    found = staged(measured(documents), "measured")
    common = staged(common_lines(found, min_docs, share), "common")
    lines = found.select("host", "doc_id", "text_key", F.inline("lines"))
    gone = (
        lines.join(common, ["host", "line"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "text_key", "host")
        .agg(F.sum("words").alias("taken"), F.collect_set("line").alias("gone"))
    )
    right = gone.toDF("_doc_id", "_text_key", "_host", "taken", "gone")
    same = (
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & (F.col("text_key") == F.col("_text_key"))
        & (F.col("host") == F.col("_host"))
    )
    out = found.drop("lines").join(right, same, "left").drop("_doc_id", "_text_key", "_host")
    out = out.withColumn("n_common_words", F.coalesce("taken", F.lit(0)).cast("long"))
    remain = F.col("n_words") - F.col("n_common_words")
    depleted = (remain < min_words) | (100 * remain < left * F.col("n_words"))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | depleted))


def _keyed(documents: DataFrame) -> DataFrame:
    return own_columns(
        documents, doc_id="doc_id", text_key=text_key(), host=F.coalesce("source", F.lit("")), text="text"
    )


def verdicts(documents: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept and n_common_words."""
    return judged(_keyed(documents), **options).select("doc_id", *_COUNTS, "base_failed", "kept", "n_common_words")


def cleaned(documents: DataFrame, **options) -> DataFrame:
    """``documents`` without rejected rows and without common lines; n_chars is set anew where lines went."""
    verdict = judged(_keyed(documents), **options).filter("kept").select("doc_id", "text_key", "host", "gone")
    verdict = staged(verdict.distinct(), "verdicts").toDF("_doc_id", "_text_key", "_host", "_gone")
    columns = documents.columns
    same = (
        documents["doc_id"].eqNullSafe(verdict["_doc_id"])
        & (text_key() == F.col("_text_key"))
        & (F.coalesce(documents["source"], F.lit("")) == F.col("_host"))
    )
    joined = documents.join(verdict.hint("merge"), same).select(*[documents[c] for c in columns], "_gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            texts = batch.column("text").to_pylist()
            gone = batch.column("_gone").to_pylist()
            out = [_without_lines(t, g) if g else t for t, g in zip(texts, gone, strict=True)]
            own = batch.select(columns)
            yield own.set_column(columns.index("text"), "text", pa.array(out, batch.schema.field("text").type))

    out = joined.mapInArrow(cut, documents.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def _without_lines(text: str, gone: list[int]) -> str:
    column = pa.array([text.encode()], pa.binary())
    words = W.split_words(column)
    lines = W.split_lines(words, np.array([0, len(words.buf)]))
    out = text.encode().split(b"\n")
    taken = np.isin(_line_hashes(words, lines).view(np.int64), np.array(gone, dtype=np.int64))
    for i in lines.number[taken][::-1]:
        del out[i]
    return b"\n".join(out).decode()
