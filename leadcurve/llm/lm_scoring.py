"""Scores of whole texts: a smoothed unigram base and a causal self-attention model.

A text is taken in lower case (A-Z) as its words and one end. Documents whose
crc32(doc_id as text) leaves remainder 1 by 5 are held out; all others are learned from,
a null doc_id (as the empty text) among them. Null and empty texts hold the end alone.

* Word counts cover all training documents. For the base score up to ``FREQUENT_WORDS``
  of the most frequent words (a table of fixed size) are broadcast; all other words meet their
  counts in a join by word, so neither vocabulary nor documents pass through one place.
* The model (``attention``) reads the subwords of " word" for each word in turn, by a
  public tokenizer's ranks. Its classes come from the counts of all training words.
  Weights are learned in ``ROUNDS`` rounds: in each, every task steps through its own
  part of the round's blocks, and the tasks' weights are averaged. Blocks of
  ``BLOCK_CHARS`` characters are dealt to rounds by document and place. With ``SHARE`` 1
  every block of every training document is learned from, in one of the rounds.
* Texts are split and turned into subwords once; both rounds and the scores read these.
* Scores take every subword of the whole text once, in overlapping windows.

Rows are scored one by one, equal rows included.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadcurve.llm import attention as A
from leadcurve.llm import words as W
from leadcurve.llm.blas import single_thread
from leadcurve.llm.bpe import read_ranks
from leadcurve.llm.frames import own_columns, read_in_parts, staged

FOLDS, HELD = 5, 1
FREQUENT_WORDS = 1 << 17
SHARE, ROUNDS, BLOCK_CHARS = 1, 2, 600
RATES = (0.02, 0.007)
PIECE_BYTES = 4 << 20
REMEMBERED = 1 << 18  # words, besides the frequent ones, whose subwords a task remembers
_FIXED = 1 << 20  # weights are summed as whole numbers, so that the order of tasks does not matter

_SPACES = regex.compile(r"[^\S\n ]")
_encodings: dict[tuple[int, str], tiktoken.Encoding] = {}


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def _words(text: str | None) -> list[bytes]:
    """bytes.lower changes A-Z alone, and bytes.split knows exactly the six spaces."""
    return text.encode().lower().split() if text else []


def _indexed(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all texts, each word's place among them, and where each text's begin."""
    words = W.split_words(texts, lower=True)
    offsets = np.append(0, np.cumsum(words.end - words.start))
    data = words.buf.tobytes().translate(None, b" \t\n\v\f\r")  # the words' bytes, one after another
    listed = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = listed.cast(pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), words.first


def _listed(words: pa.Array) -> list[bytes]:
    """As ``to_pylist``, which makes an object of Arrow for each word."""
    buf, offsets = W.text_buffer(words)
    data, ends = buf.tobytes(), offsets.tolist()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Tokenizer:
    """Subwords of words, each with a space before it."""

    def __init__(self, data: bytes, pattern: str):
        key = zlib.crc32(data), pattern
        if key not in _encodings:
            _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(data), special_tokens={})
        self.encoding = _encodings[key]
        self.size = self.encoding.max_token_value + 1
        self.feed = self.encoding.encode_single_token(b"\n")

    def opens(self) -> np.ndarray:
        """Does the id begin with a space? The end, one past the ids, does not."""
        out = np.zeros(self.size + 1, dtype=bool)
        for token in self.encoding.token_byte_values():
            out[self.encoding.encode_single_token(token)] = token.startswith(b" ")
        return out

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All subwords one after another, and where each word's begin (and the total)."""
        text = b"\n ".join([b"", *words]).decode()
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        if _SPACES.search(text):  # such a character may join the spaces before it
            lists = [self.encoding.encode_ordinary(" " + w.decode()) for w in words]
            return np.array([x for own in lists for x in own], np.int64), np.append(0, np.cumsum([len(x) for x in lists]))
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)  # encode_to_numpy also looks for special tokens
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != len(words):
            raise ValueError("a word was not separated")
        return np.delete(ids, feeds), np.append(feeds - np.arange(len(feeds)), len(ids) - len(feeds))


@dataclass(frozen=True)
class Frequent:
    """The most frequent words, their counts and subwords; the subwords of word i begin at ``first[i]``."""

    words: list[bytes]
    counts: np.ndarray
    ids: np.ndarray
    first: np.ndarray


def frequent_subwords(counted: dict[bytes, int], tokenizer: Tokenizer) -> Frequent:
    words = list(counted)
    return Frequent(words, np.array(list(counted.values()), np.int64), *tokenizer(words))


class _Remembered:
    """Subwords of words of which many have been asked before: the frequent ones and up to ``REMEMBERED`` others."""

    def __init__(self, tokenizer: Tokenizer, frequent: Frequent):
        self.tokenizer, self.frequent = tokenizer, frequent
        self._forget()

    def _forget(self) -> None:
        self.known = dict(zip(self.frequent.words, range(len(self.frequent.words)), strict=True))
        self.ids, self.first = self.frequent.ids, self.frequent.first

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each of the distinct words' place in ``first``; frequent words come before all others."""
        if len(self.known) - len(self.frequent.words) > REMEMBERED:
            self._forget()
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            ids, first = self.tokenizer(new)
            place[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, place[missing].tolist(), strict=True))
            self.first = np.append(self.first, first[1:] + self.first[-1])
            self.ids = np.append(self.ids, ids)
        return place


def training_words(documents: DataFrame) -> DataFrame:
    """word and n over all training documents (doc_id, text, held_out), without ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, size=2 * PIECE_BYTES):
            words, place, _ = _indexed(batch.column("text"))
            times = np.bincount(place, minlength=len(words))
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])

    counted = documents.filter("NOT held_out").select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words from such a count on that they are ``most`` at most.

    Counts are put into eight classes for each doubling, a few hundred in all; the
    classes' sizes, from the largest count down, tell where to stop.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().toPandas().sort_values("step", ascending=False)
    fit = sizes[sizes["count"].cumsum() <= most]["step"]
    return counts.filter(step >= int(fit.min())) if len(fit) else counts.limit(0)


def subword_counts(words: DataFrame, tokenizer, ends: int) -> np.ndarray:
    """How often each subword occurs in the counted words; the end last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer()
        out = np.zeros(own.size, dtype=np.int64)
        for batch in W.pieces(batches, "word"):
            ids, first = own(_listed(batch.column("word")))
            n = np.repeat(batch.column("n").to_numpy(), np.diff(first))
            np.add.at(out, ids, n)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used])], ["id", "n"])

    rows = words.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # the vocabulary at most
    counts = np.zeros(tokenizer().size + 1, dtype=np.float64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    counts[-1] = ends
    return counts


def _gather(values: np.ndarray, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs values[first[p]:first[p + 1]] for each p, and where each begins."""
    length = np.diff(first)[place]
    starts = np.append(0, np.cumsum(length))
    return values[np.repeat(first[place] - starts[:-1], length) + np.arange(starts[-1])], starts


def _with_ends(ids: np.ndarray, first: np.ndarray, end: int, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences with an end where ``closed``, and where each begins."""
    return np.insert(ids, first[1:][closed], end), first + np.append(0, np.cumsum(closed))


def _blocks(text: str | None, doc_id: int | None, turn: int) -> Iterator[tuple[list[bytes], bool]]:
    """The words of the text's blocks of this round, and whether each is the last."""
    return ((_words(part), last) for part, last in _block_texts(text, doc_id, turn))


def _block_texts(text: str | None, doc_id: int | None, turn: int) -> Iterator[tuple[str, bool]]:
    """The text's blocks of this round, and whether each is the last of its text."""
    blocks = _cut(text)
    return (x for x, own in zip(blocks, _turns(doc_id, len(blocks)), strict=True) if own == turn)


def _cut(text: str | None) -> list[tuple[str, bool]]:
    """All blocks, and whether each is the last: one begins with the first space behind a multiple of ``BLOCK_CHARS``."""
    text, out, start = text or "", [], 0
    while start >= 0:
        end = text.find(" ", (len(out) + 1) * BLOCK_CHARS)
        out.append((text[start : end if end >= 0 else None], end < 0))
        start = end
    return out


def _turns(doc_id: int | None, blocks: int) -> np.ndarray:
    """The round that learns from each block, or -1."""
    place = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) // FOLDS + np.arange(blocks)
    return np.where(place % SHARE == 0, place // SHARE % ROUNDS, -1)


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The runs values[first[i]:first[i + 1]] as a binary column."""
    offsets = (first * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]).cast(pa.binary())


def _unpacked(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values one after another, and where each row's begin (and the total)."""
    buf, offsets = W.text_buffer(column)
    return np.frombuffer(buf.tobytes(), dtype).astype(np.int64), offsets // dtype.itemsize


def learned_weights(texts: DataFrame, subwords: A.Subwords, rounds: int = ROUNDS) -> A.Weights:
    """Weights after all rounds over the training documents (doc_id, held_out, ids, cuts)."""
    weights = A.first_weights(subwords)
    spark = texts.sparkSession
    training = texts.filter("NOT held_out").select("doc_id", "ids", "cuts")
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((weights, subwords))  # of fixed size

        def step(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            single_thread()
            given, classes = shared.value
            learner = A.Learner(given, classes, RATES[turn])
            for batch in W.pieces(batches, "ids", PIECE_BYTES // 2):
                ids, first = _unpacked(batch.column("ids"), _id_type(classes))
                cuts, own = _unpacked(batch.column("cuts"), _CUT)
                blocks = np.append(cuts + np.repeat(first[:-1], np.diff(own)), first[-1])
                turns = [_turns(doc, n) for doc, n in zip(batch.column("doc_id").to_pylist(), np.diff(own), strict=True)]
                ids, first = _gather(ids, blocks, np.flatnonzero(np.concatenate(turns) == turn))
                some = np.append(True, np.diff(first) > 0)
                if first[-1]:
                    learner.learn(A.windows(classes, ids, first[some], overlap=0))
            if learner.places:
                part = max(1, learner.places >> 10)
                whole = np.round(A.flattened(learner.w).astype(np.float64) * _FIXED).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(whole)), pa.int32()), pa.array(whole * part), pa.array(np.full(len(whole), part))],
                    ["place", "value", "part"],
                )

        summed = training.mapInArrow(step, "place int, value long, part long").groupBy("place")
        rows = summed.agg((F.sum("value") / F.sum("part")).alias("value")).toPandas()  # the number of weights
        if len(rows):
            values = np.zeros(len(rows))
            values[rows["place"].to_numpy()] = rows["value"].to_numpy() / _FIXED
            weights = A.shaped(values, weights)
        shared.unpersist()
    return weights


_PARTS = (
    "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, ids binary, cuts binary, "
    "word string, n long"
)
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]
_SCORED = "row_id long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_CUT = np.dtype(np.int32)


def _id_type(subwords: A.Subwords) -> np.dtype:
    return np.min_scalar_type(subwords.end)


class _Reader:
    """Base scores and subwords of one task's texts; rare words are sent on with their row.

    ``ids``: a text's subwords and its end; ``cuts``: where its blocks begin among them.
    """

    def __init__(self, tokenizer: Tokenizer, frequent: dict[bytes, int] | Frequent, log_size: float, ends: int, subwords: A.Subwords):
        self.frequent = frequent if isinstance(frequent, Frequent) else frequent_subwords(frequent, tokenizer)
        self.remembered = _Remembered(tokenizer, self.frequent)
        self.log_size, self.ends, self.subwords = log_size, ends, subwords
        self.rows = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, size=PIECE_BYTES):
            n = batch.num_rows
            row_id = self.rows + np.arange(n)
            self.rows += n
            blocks = [_cut(text) for text in batch.column("text").to_pylist()]
            own = np.append(0, np.cumsum([len(x) for x in blocks]))
            words, place, bounds = _indexed(pa.array([part for x in blocks for part, _ in x], pa.string()))
            length = np.diff(bounds[own])
            row = np.repeat(np.arange(n), length)
            at = self.remembered.places(_listed(words))
            known = (at < len(self.frequent.words))[place]
            value = np.log10(self.frequent.counts + 0.5) - self.log_size
            base = np.bincount(row[known], value[at[place[known]]], n)
            base = base + np.log10(self.ends + 0.5) - self.log_size
            sure = np.bincount(row[known], minlength=n) + (self.ends > 0)
            ids, starts = _gather(self.remembered.ids, self.remembered.first, at[place])
            ids, first = _with_ends(ids, starts[bounds], self.subwords.end, np.array([last for x in blocks for _, last in x]))
            cuts = first[:-1] - np.repeat(first[own[:-1]], np.diff(own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row_id), batch.column("doc_id"), batch.column("held_out"), pa.array(length + 1, pa.int64()),
                    pa.array(sure, pa.int64()), pa.array(base), _packed(ids.astype(_id_type(self.subwords)), first[own]),
                    _packed(cuts.astype(_CUT), own), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
                ],
                _NAMES,
            )
            rare, n_rare = np.unique(row[~known] * max(len(words), 1) + place[~known], return_counts=True)
            m = len(rare)
            text = words.take(pa.array(rare % max(len(words), 1))).cast(pa.string())
            empty = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_id[rare // max(len(words), 1)]), *empty, text, pa.array(n_rare, pa.int64())], _NAMES
            )


def scored(documents: DataFrame, rank_file: str, pattern: str, frequent_words: int = FREQUENT_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    own = own_columns(documents, doc_id="doc_id", text="text", held_out=held_out(F.col("doc_id")))
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # one vocabulary

    def tokenizer() -> Tokenizer:
        return Tokenizer(ranks.value, pattern)

    counts = staged(training_words(own), "word-counts")
    ends = own.filter("NOT held_out").count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, types = totals[0] + ends, totals[1] + (ends > 0)
    log_size = float(np.log10(tokens + 0.5 * (types + 1)))
    top = _frequent(counts, frequent_words).toPandas()  # at most frequent_words rows
    frequent = frequent_subwords({w.encode(): int(n) for w, n in zip(top["word"], top["n"], strict=True)}, tokenizer())
    subwords = A.subword_classes(subword_counts(counts, tokenizer, ends), tokenizer().opens())
    known = spark.sparkContext.broadcast((frequent, subwords))  # frequent_words, and classes of fixed size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = known.value
        return _Reader(tokenizer(), words, log_size, ends, classes)(batches)

    parts = staged(own.mapInArrow(read, _PARTS), "subwords")
    texts = parts.filter("word IS NULL")
    with read_in_parts(spark):
        weights = learned_weights(texts, subwords, rounds)
        shared = spark.sparkContext.broadcast((weights, subwords))  # of fixed size

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            single_thread()
            learned, classes = shared.value
            for batch in W.pieces(batches, "ids", PIECE_BYTES // 2):
                ids, first = _unpacked(batch.column("ids"), _id_type(classes))
                scores = np.add.reduceat(A.scores(learned, classes, A.windows(classes, ids, first)), first[:-1])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"])

        rows = texts.select("row_id", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "ids")
        rows = staged(rows.mapInArrow(score, _SCORED), "scored")
    # one row per row and rare word; unknown words have no count
    rare = parts.filter("word IS NOT NULL").select("row_id", "word", F.col("n").alias("times"))
    met = rare.join(counts.hint("merge"), "word", "left")
    sums = met.groupBy("row_id").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - log_size)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
    )
    return rows.join(sums.hint("merge"), "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
