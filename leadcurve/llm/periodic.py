"""Periodic runs of words, by a dictionary of basic factors inside each text.

A factor of one word is named by the word, and a factor of 2 L words by the pair of its
halves' names. At each power of two L, an occurrence's successor is the next occurrence
of the same factor in the text; occurrences whose successors stand at one distance of at
most 2 L form arithmetic progressions, and that distance is a proposed period. A run of
smallest period q is proposed whole at the least L of at least q words, for there no
occurrence stands between two that are q apart. Proposals are extended to both sides as
far as words q apart are identical, and of proposals for the same stretch the smallest
period stays. A position goes on to 2 L only if its factor of L words occurs again no further
away than a period can be: of running prose next to nothing is left after a few rounds.

A run has at least ``least`` words and ``repeats`` times its smallest period, and no
neighbouring word continues it. The words of a run after its first period are dropped
from the collapsed text. Each text is worked on whole, by itself: nothing is shuffled, and
a task holds a piece of about 1 MB of text, or one longer text.

Words are runs of bytes other than space, ``\\t \\n \\v \\f \\r``. Null and empty texts have no
words, no runs and an empty collapsed text. Rows that share a doc_id, or have none, are
worked on by themselves; a null doc_id is never unrolled by ``unrolled``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadcurve.llm import words as W
from leadcurve.llm.frames import own_columns

LEAST_WORDS, REPEATS = 6, 4
_STEP = 64  # words compared at once when a proposal is extended

_RUN = "struct<start: long, length: long, period: long>"


@dataclass
class Runs:
    """Runs by text, start and period; words are counted from 0 over all texts."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def successors(name: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each position (ascending), how far the next one of its name in its text is; 0: there is none."""
    order = np.argsort(name, kind="stable")
    far = np.zeros(len(at), dtype=np.int64)
    before, after = order[:-1], order[1:]
    same = (name[before] == name[after]) & (row[before] == row[after])
    far[before[same]] = at[after[same]] - at[before[same]]
    return far


def _near(far: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The positions with a next or a previous occurrence within their ``limit``."""
    near = (far > 0) & (far <= limit)
    near[np.searchsorted(at, (at + far)[near])] = True
    return near


def _progressions(far: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, period) of neighbouring positions whose successors are equally far, within 2 L."""
    some = np.flatnonzero((far > 0) & (far <= 2 * length))
    place, period = at[some], far[some]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (period[1:] != period[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(some)) - 1 if len(head) else head
    return place[head], place[last] + length + period[head], period[head]


def _reach(word: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, sign: int) -> np.ndarray:
    """How many words from ``a`` and from ``b`` on are equal, in the direction of ``sign``, at most ``room``."""
    out = np.zeros(len(a), dtype=np.int64)
    open_ = np.flatnonzero(room > 0)
    step = np.arange(_STEP)
    while len(open_):
        ahead = out[open_, None] + step
        inside = ahead < room[open_, None]
        ahead = np.where(inside, ahead, 0) * sign
        equal = inside & (word[a[open_, None] + ahead] == word[b[open_, None] + ahead])
        whole = equal.all(axis=1)
        out[open_] += np.where(whole, _STEP, np.argmin(equal, axis=1))
        open_ = open_[whole]
    return out


def word_names(words: W.Words) -> np.ndarray:
    """Equal words of one text have equal names; words are compared by their bytes."""
    order, group = W.equal_groups(words.buf, words.start, words.end, words.hashes())
    names = np.empty(len(words), dtype=np.int64)
    names[order] = group
    return names


def runs_of(word: np.ndarray, row: np.ndarray, least: int = LEAST_WORDS, repeats: int = REPEATS) -> Runs:
    """All runs of the texts that ``row`` (ascending) tells apart; ``repeats`` is at least 3."""
    if repeats < 3:
        raise ValueError("the dictionary finds runs of three periods or more")
    proposals = []
    name, at, of, length = word, np.arange(len(word)), row, 1
    longest = np.bincount(row)[row] // repeats if len(row) else row  # no period is longer
    while len(at):
        far = successors(name, at, of)
        proposals.append(_progressions(far, at, length))
        keep = _near(far, at, longest[at])
        name, at, of = name[keep], at[keep], of[keep]
        half = np.searchsorted(at, at + length)
        both = np.flatnonzero((half < len(at)) & (at[np.minimum(half, len(at) - 1)] == at + length)) if len(at) else half
        both = both[of[both] == of[half[both]]]
        pairs = name[both] * (int(name.max(initial=0)) + 1) + name[half[both]]
        name = np.unique(pairs, return_inverse=True)[1]
        at, of, length = at[both], of[both], 2 * length
    if not proposals:
        return Runs(*[np.zeros(0, dtype=np.int64)] * 4)
    start, end, period = (np.concatenate(x) for x in zip(*proposals, strict=True))
    text = row[start] if len(start) else start
    first, last = np.searchsorted(row, text), np.searchsorted(row, text, side="right")
    start = start - _reach(word, start - 1, start - 1 + period, start - first, -1)
    end = end + _reach(word, end - period, end, last - end, 1)
    long = end - start >= np.maximum(least, repeats * period)
    text, start, end, period = text[long], start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    text, start, end, period = text[order], start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text, start, end, period = text[new], start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return Runs(text[order], start[order], (end - start)[order], period[order])


def dropped(runs: Runs, words: int) -> np.ndarray:
    """Whether a word stands in a run after that run's first period."""
    change = np.zeros(words + 1, dtype=np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:-1]) > 0


def unrolled(words: W.Words, ids: list[int | None]) -> np.ndarray:
    """For each word the word of the same text that stands in its place.

    In texts whose crc32 of the decimal id is a multiple of 10, all words from a drawn
    place on repeat the first few of them.
    """
    out = np.arange(len(words))
    for r, doc in enumerate(ids):
        lo, hi = int(words.first[r]), int(words.first[r + 1])
        if doc is None or hi == lo:
            continue
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            n, g = hi - lo, h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[lo + a : hi] = lo + a + np.arange(n - a) % p
    return out


def _joined(words: W.Words, chosen: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per text the chosen words, joined by one space."""
    buf = words.buf.tobytes()
    start, end = words.start[chosen].tolist(), words.end[chosen].tolist()
    parts = [buf[a:b] for a, b in zip(start, end, strict=True)]
    return [b" ".join(parts[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _found(
    batches: Iterator[pa.RecordBatch], least: int, repeats: int, tamper: bool
) -> Iterator[tuple[pa.RecordBatch, W.Words, Runs, list[bytes]]]:
    for batch in W.pieces(batches):
        words = W.split_words(batch.column("text"))
        chosen = unrolled(words, batch.column("doc_id").to_pylist()) if tamper else np.arange(len(words))
        runs = runs_of(word_names(words)[chosen], words.row, least, repeats)
        kept = np.flatnonzero(~dropped(runs, len(words)))
        yield batch, words, runs, _joined(words, chosen[kept], np.searchsorted(kept, words.first))


def detected(documents: DataFrame, least: int = LEAST_WORDS, repeats: int = REPEATS, unroll: bool = False) -> DataFrame:
    """Per row: doc_id, ``runs`` (start, length, period; by start, then period) and the collapsed text.

    ``unroll`` first makes some texts periodic (see ``unrolled``), to test detection with.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, runs, texts in _found(batches, least, repeats, unroll):
            fields = [runs.start - words.first[runs.row], runs.length, runs.period]
            structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])
            bounds = pa.array(np.searchsorted(runs.row, np.arange(batch.num_rows + 1)), pa.int32())
            collapsed = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(bounds, structs), collapsed], ["doc_id", "runs", "collapsed"]
            )

    return own_columns(documents, doc_id="doc_id", text="text").mapInArrow(found, f"doc_id long, runs array<{_RUN}>, collapsed string")


def digests(documents: DataFrame, least: int = LEAST_WORDS, repeats: int = REPEATS) -> DataFrame:
    """Per row the number of runs, the longest of them, and digests of all runs and of the collapsed text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, runs, texts in _found(batches, least, repeats, True):
            bounds = np.searchsorted(runs.row, np.arange(batch.num_rows + 1)).tolist()
            own = list(zip((runs.start - words.first[runs.row]).tolist(), runs.length.tolist(), runs.period.tolist(), strict=True))
            rows = []
            for lo, hi, text in zip(bounds[:-1], bounds[1:], texts, strict=True):
                all_runs = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own[lo:hi]).encode()).hexdigest()
                s, n, q = min(own[lo:hi], key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                share = 1000 * n // q if q else None
                rows.append((hi - lo, s, n, q, share, all_runs, hashlib.sha256(text).hexdigest()))
            count, *longest, all_runs, collapsed = zip(*rows, strict=True)
            numbers = [pa.array(x, pa.int64()) for x in (count, *longest)]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(all_runs), pa.array(collapsed)], names)

    return own_columns(documents, doc_id="doc_id", text="text").mapInArrow(
        digest,
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string",
    )
