"""Removal of word windows that stand in an earlier document, by super-k-mers.

A window is ``window`` consecutive words. Its minimiser is the least of its runs of
``gram`` words, rare runs first. Consecutive windows of a document that share their
minimiser travel as one string (a super-k-mer) to the minimiser's bucket; there the
windows are sorted, compared byte by byte, and each learns the smallest document that
holds it.

* Rarity comes from a fixed-size table of counts over the whole corpus, so a common
  passage does not draw the texts around it into its own bucket.
* The super-k-mers that a piece of a task's text has for one bucket travel as one
  compressed row; rows are sorted by bucket, and a bucket is worked on alone.
* Equal super-k-mers of one task travel once, from the task's smallest document; in
  the others all their windows are known to be repeated. A passage that stands in a
  third of all documents so reaches its bucket about once per task.
* A window whose rarest run is still too common travels alone, keyed by itself.

Documents without a ``doc_id`` neither remove nor lose words. Null and empty texts
have no words. Rows that share a ``doc_id`` do not remove each other's words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve.llm import words as W
from leadcurve.llm.frames import own_columns, partitions, staged, text_key

WINDOW = 13
GRAM = 4
SKETCH_BITS = 16  # cells of the count table: its size, on the driver and in each task, is fixed by this
COMMON_ROWS = 1 << 17  # a minimiser that may have more windows than this does not get a bucket
RUN_WINDOWS = 64  # longer super-k-mers are cut
BUCKET_BYTES = 1 << 20  # whole buckets that are sorted together, if several are so small
REMEMBERED = 50_000  # repeated super-k-mers a task remembers

BUCKETS_PER_PARTITION = 16

_SENT = "bucket int, known boolean, size int, packed binary"
_SPANS = "doc_id long, text_key long, lo int, hi int"
_TEXT_KEY_BITS = 31  # rows are told apart by doc_id and so many bits of their text's hash


def _gram_hashes(words: W.Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    run = W.running(words.hashes())
    at = np.arange(max(len(words) - gram + 1, 0))
    return run, W.sequence_hash(run, at, at + gram)


def gram_counts(documents: DataFrame, gram: int = GRAM, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many runs of ``gram`` words fall in each of ``2**bits`` cells, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, dtype=np.int64)
        for batch in W.pieces(batches):
            words = W.split_words(batch.column("text"))
            _, hashes = _gram_hashes(words, gram)
            some = hashes[words.inside(gram)] >> np.uint64(64 - bits)
            cells += np.bincount(some.astype(np.int64), minlength=len(cells))
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(cells[used])], ["cell", "n"])

    counted = documents.select("text").mapInArrow(count, "cell int, n long")
    out = np.zeros(1 << bits, dtype=np.int64)
    rows = counted.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most 2**bits rows
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def gram_levels(counts: np.ndarray, common_rows: int = COMMON_ROWS) -> np.ndarray:
    """The order of cells, rare first; 255 where a cell may hold too many windows."""
    level = np.minimum(np.log2(counts + 1.0) * 4, 254).astype(np.uint8)
    level[counts > max(common_rows, 8 * counts.mean())] = 255
    return level


class _Sender:
    """Cuts one task's documents into super-k-mers."""

    def __init__(self, levels: np.ndarray, window: int, gram: int, buckets: int):
        self.levels, self.window, self.gram, self.buckets = levels, window, gram, buckets
        self.shift = np.uint64(64 - int(len(levels)).bit_length() + 1)
        self.known: dict[int, tuple[bytes, int]] = {}

    def runs(self, words: W.Words) -> tuple[np.ndarray, ...]:
        """First word, number of windows, key and hash of each super-k-mer."""
        k, w = self.window, self.window - self.gram + 1
        if len(words) < k:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        run, hashes = _gram_hashes(words, self.gram)
        level = self.levels[(hashes >> self.shift).astype(np.int64)]
        order = (level.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
        n = len(words) - k + 1
        least, have = order, 1
        while have * 2 <= w:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        if have < w:
            least = np.minimum(least[:n], least[w - have : w - have + n])
        least = least[:n]
        at = words.inside(k)
        if not len(at):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        key = least[at]
        alone = key >> np.uint64(56) == 255
        key = np.where(alone, W.sequence_hash(run, at, at + k), W.mix(key))
        new = np.ones(len(at), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:] | alone[:-1]
        head = np.flatnonzero(new)
        length = np.diff(np.append(head, len(at)))
        if length.max() > RUN_WINDOWS:
            parts = -(-length // RUN_WINDOWS)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            head, left = np.repeat(head, parts) + nth * RUN_WINDOWS, np.repeat(length, parts) - nth * RUN_WINDOWS
            length = np.minimum(left, RUN_WINDOWS)
        first = at[head]
        return first, length, key[head], W.sequence_hash(run, first, first + length + k - 1)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            words = W.spaced(W.split_words(batch.column("text")))
            first, length, key, hashes = self.runs(words)
            if not len(first):
                continue
            doc = batch.column("doc_id").to_numpy()[words.row[first]]
            own = batch.column("text_key").to_numpy()[words.row[first]]
            start, end = words.start[first], words.end[first + length + self.window - 2]
            order, group = W.equal_groups(words.buf, start, end, hashes)
            head = np.flatnonzero(np.append(True, np.diff(group) > 0))
            least = np.minimum.reduceat(doc[order], head)
            least = self._remember(words.buf, start, end, hashes, order, head, least)
            later = np.empty(len(first), dtype=bool)
            later[order] = doc[order] > least[group]
            pos = first - words.first[words.row[first]]
            sent = ~later
            if sent.any():
                yield self._packed(key[sent], doc[sent], own[sent], pos[sent], words.buf, start[sent], end[sent])
            if later.any():
                yield self._spans(doc[later], own[later], pos[later], length[later])

    def _remember(self, buf, start, end, hashes, order, head, least):
        """Lowers ``least`` where an earlier piece of this task has sent the same string."""
        size = np.diff(np.append(head, len(order)))
        known = np.fromiter(self.known, dtype=np.uint64, count=len(self.known))
        for g in np.flatnonzero((size > 2) | np.isin(hashes[order[head]], known)):
            i = order[head[g]]
            value, h = buf[start[i] : end[i]].tobytes(), int(hashes[i])
            held = self.known.get(h)
            if held is None:
                if len(self.known) < REMEMBERED:
                    self.known[h] = value, int(least[g])
            elif held[0] == value:
                least[g] = min(least[g], held[1])
                self.known[h] = value, int(least[g])
        return least

    def _packed(self, key, doc, own, pos, buf, start, end) -> pa.RecordBatch:
        """One compressed string for each bucket that the piece has super-k-mers for."""
        bucket = (key % np.uint64(self.buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        size, packed = [], []
        for lo, hi in zip(head, np.append(head[1:], len(order)), strict=True):
            some = order[lo:hi]
            kmers = W.slices(buf, start[some], end[some])
            raw = _pack(doc[some], own[some], pos[some], end[some] - start[some], kmers)
            size.append(len(raw))
            packed.append(squeeze(raw))
        return _sent(bucket[order[head]], False, size, packed)

    def _spans(self, doc, own, pos, length) -> pa.RecordBatch:
        """What this task knows to be repeated: it passes the buckets as it is, spread by piece."""
        doc, own, lo, hi = _merged(doc, own, pos, pos + length + self.window - 1)
        raw = np.array([doc, own, lo, hi], dtype=np.int64).tobytes()
        at = int(W.mix(doc[:1].astype(np.uint64) ^ own[:1].astype(np.uint64))[0]) % self.buckets
        return _sent(np.array([at], np.int32), True, [len(raw)], [zstandard.compress(raw, 3)])


def _sent(bucket, known: bool, size, packed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket, pa.int32()), pa.array([known] * len(packed), pa.bool_()),
            pa.array(size, pa.int32()), pa.array(packed, pa.binary()),
        ],
        ["bucket", "known", "size", "packed"],
    )


def _pack(doc, own, pos, length, kmers: pa.Array) -> bytes:
    """Counts first, then each column as a whole, then the bytes of the super-k-mers."""
    data = kmers.buffers()[2]
    return b"".join(
        [
            np.int64(len(doc)).tobytes(), doc.astype(np.int64).tobytes(), own.astype(np.uint32).tobytes(),
            pos.astype(np.int32).tobytes(), length.astype(np.int32).tobytes(), data.to_pybytes() if data else b"",
        ]
    )


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc = np.frombuffer(raw, np.int64, n, 8)
    own = np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
    pos = np.frombuffer(raw, np.int32, n, 8 + 12 * n)
    length = np.frombuffer(raw, np.int32, n, 8 + 16 * n)
    return doc, own, pos, length, raw[8 + 20 * n :]


def _merged(doc, own, lo, hi):
    """Overlapping spans of one text as one; spans come in the order of their text."""
    order = np.lexsort((lo, own, doc))
    doc, own, lo, hi = doc[order], own[order], lo[order], hi[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]) | (lo[1:] > hi[:-1])
    head = np.flatnonzero(new)
    return doc[head], own[head], lo[head], np.maximum.reduceat(hi, head) if len(head) else hi


def _span_batch(doc, own, lo, hi) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(own, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
        ["doc_id", "text_key", "lo", "hi"],
    )


def _bucket_spans(held: list[bytes], window: int) -> pa.RecordBatch | None:
    """Windows of whole buckets that stand in a smaller document of the same bucket."""
    squeezed = zstandard.ZstdDecompressor()
    doc, own, pos, length, data = zip(*(_unpack(squeezed.decompress(x)) for x in held), strict=True)
    doc, own, pos, length = (np.concatenate(x) for x in (doc, own, pos, length))
    offsets = np.append(0, np.cumsum(length, dtype=np.int64))
    kmers = pa.Array.from_buffers(
        pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))]
    )
    words = W.split_words(kmers)
    run = W.running(words.hashes())
    at = words.inside(window)
    start, end = words.start[at], words.end[at + window - 1]
    order, group = W.equal_groups(words.buf, start, end, W.sequence_hash(run, at, at + window))
    row = words.row[at[order]]
    head = np.flatnonzero(np.append(True, np.diff(group) > 0))
    least = np.minimum.reduceat(doc[row], head)
    later = doc[row] > least[group]
    if not later.any():
        return None
    at, row = at[order[later]], row[later]
    lo = pos[row] + at - words.first[row]
    return _span_batch(*_merged(doc[row], own[row].astype(np.int64), lo, lo + window))


def _sorted_buckets(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket is worked on when all of it is there."""
    held: list[bytes] = []
    size, last = 0, None
    for batch in batches:
        for bucket, known, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if known:
                doc, own, lo, hi = np.frombuffer(zstandard.decompress(packed), np.int64).reshape(4, -1)
                yield _span_batch(doc, own, lo, hi)
                continue
            if bucket != last and size >= BUCKET_BYTES:
                if (found := _bucket_spans(held, window)) is not None:
                    yield found
                held, size = [], 0
            held.append(packed)
            size, last = size + n, bucket
    if held and (found := _bucket_spans(held, window)) is not None:
        yield found


def repeated_spans(
    documents: DataFrame, window: int = WINDOW, gram: int = GRAM, sketch_bits: int = SKETCH_BITS
) -> DataFrame:
    """Runs of words (``lo`` to before ``hi``) that stand in a document with a smaller doc_id.

    ``documents`` has doc_id, text and text_key. Spans of a document may overlap.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    documents = documents.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    levels = gram_levels(gram_counts(documents, gram, sketch_bits))
    shared = documents.sparkSession.sparkContext.broadcast(levels)  # 2**sketch_bits bytes

    n = partitions(documents.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _Sender(shared.value, window, gram, n * BUCKETS_PER_PARTITION)(batches)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sorted_buckets(batches, window)

    sent = documents.select("doc_id", "text_key", "text").mapInArrow(send, _SENT)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, _SPANS)


def _row_key() -> Column:
    return text_key().bitwiseAND(F.lit((1 << _TEXT_KEY_BITS) - 1))


def with_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """Each document row with ``spans``, an array of its (lo, hi), or null."""
    per_text = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return documents.join(per_text.hint("merge"), ["doc_id", "text_key"], "left")


def kept_words(text: str | None, spans: list | None) -> tuple[list[bytes], int]:
    """The words left of a text and how many were taken."""
    words = text.encode().split() if text else []
    if not spans:
        return words, 0
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, [s["lo"] for s in spans], 1)
    np.add.at(change, [s["hi"] for s in spans], -1)
    kept = np.cumsum(change[:-1]) == 0
    left = [w for w, k in zip(words, kept, strict=True) if k]
    return left, len(words) - len(left)


def digests(documents: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, n_removed, kept_sha256."""
    own = own_columns(documents, doc_id="doc_id", text="text", text_key=_row_key())
    spans = staged(repeated_spans(own, window, **options), "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                left, gone = kept_words(text, found)
                rows.append((len(left) + gone, gone, hashlib.sha256(b" ".join(left)).hexdigest()))
            n, gone, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = with_spans(own, spans).select("doc_id", "text", "spans")
    return joined.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(documents: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """``documents`` with repeated words taken out of ``text`` and n_chars set anew; other columns stay.

    A text that loses nothing stays as it is; in others the kept words are joined by
    one space, or by a line feed where the text had one between them. A text that
    loses every word becomes empty. All rows stay.
    """
    columns = documents.columns
    keyed = documents.withColumn("_text_key", _row_key())
    own = own_columns(keyed, doc_id="doc_id", text="text", text_key="_text_key")
    spans = staged(repeated_spans(own, window, **options), "spans")
    per_text = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    per_text = per_text.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_key"})
    joined = keyed.join(
        per_text.hint("merge"), (keyed["doc_id"] == per_text["_doc_id"]) & (keyed["_text_key"] == per_text["_key"]), "left"
    ).select(*[keyed[c] for c in columns], "_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            texts = [
                without_spans(text, found) if found else text
                for text, found in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)
            ]
            out = batch.select(columns)
            yield out.set_column(columns.index("text"), "text", pa.array(texts, batch.schema.field("text").type))

    out = joined.mapInArrow(cut, documents.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def without_spans(text: str, spans: list) -> str:
    """A text without the words of its spans; line feeds between kept words stay."""
    data = text.encode()
    words = W.split_words(pa.array([data], pa.binary()))
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, [s["lo"] for s in spans], 1)
    np.add.at(change, [s["hi"] for s in spans], -1)
    out, before = [], None
    for i in np.flatnonzero(np.cumsum(change[:-1]) == 0):
        if before is not None:
            out.append(b"\n" if b"\n" in data[before : words.start[i]] else b" ")
        out.append(data[words.start[i] : words.end[i]])
        before = words.end[i]
    return b"".join(out).decode()
