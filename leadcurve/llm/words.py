"""Words and word windows of whole Arrow text columns, as numpy arrays inside a task.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``. Hashes are only
candidates: ``same_as_previous`` compares the bytes of what hashes call equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20  # text that is worked on at once; a longer text is worked on alone
_SEGMENT = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._grown(b, size) for b in self.bases)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grown(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.multiply.accumulate(out)


_byte_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spaces(buf: np.ndarray) -> np.ndarray:
    return _SPACE[buf]


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches whose texts have ``size`` bytes together, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    """Words in order. ``row[i]``: the text of word i; ``first[r]``: the first word of text r."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self), dtype=np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(self):
                lo = self.start[at]
                to = max(int(np.searchsorted(self.end, lo + _SEGMENT, side="right")), at + 1)
                hi = self.end[to - 1]
                up, down = _byte_powers(int(hi - lo))
                run = np.zeros(int(hi - lo) + 1, dtype=np.uint64)
                np.cumsum((self.buf[lo:hi].astype(np.uint64) + np.uint64(1)) * up, out=run[1:])
                s, e = self.start[at:to] - lo, self.end[at:to] - lo
                out[at:to] = (run[e] - run[s]) * down[s]
                at = to
        return mix(out)

    def inside(self, n: int) -> np.ndarray:
        """The words at which ``n`` words of one text begin."""
        if len(self) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.row[: len(self) - n + 1] == self.row[n - 1 :])


def running(hashes: np.ndarray) -> np.ndarray:
    """Running sums from which ``sequence_hash`` reads the hash of any run of words."""
    with np.errstate(over="ignore"):
        up, _ = _word_powers(max(len(hashes), 1))
        run = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=run[1:])
    return run


def sequence_hash(run: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A hash of the words from ``at`` to before ``to``, wherever they stand."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    _, down = _word_powers(max(len(run) - 1, 1))
    with np.errstate(over="ignore"):
        return mix((run[to] - run[at]) * down[at] + (to - at).astype(np.uint64))


def split_words(column: pa.Array, lower: bool = False, apart: np.ndarray = _SPACE) -> Words:
    """``apart``: for each byte value, does it stand between words?"""
    buf, offsets = text_buffer(column)
    if lower:
        buf = _LOWER[buf]
    word = ~apart[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    begin, fin = word.copy(), word.copy()
    if len(buf) > 1:
        begin[1:] &= ~word[:-1] | edge[1:-1]
        fin[:-1] &= ~word[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(fin) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(buf, start, end, row, first)


def spaced(words: Words) -> Words:
    """The same words in a buffer that holds one space between two of them and nothing else."""
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    keep = ~_SPACE[words.buf]
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    hole = np.ones(len(out), dtype=bool)
    hole[end[:-1]] = False
    out[hole] = words.buf[keep]
    return Words(out, start, end, words.row, words.first)


def slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The given slices of the buffer as a binary column."""
    length = end - start
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(length, out=offsets[1:])
    index = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    data = buf[index]
    return pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).cast(pa.binary())


def same_as_previous(buf: np.ndarray, start: np.ndarray, end: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Of slices in a given order: where ``maybe``, does slice i have the bytes of slice i-1?"""
    out = np.zeros(len(start), dtype=bool)
    at = np.flatnonzero(maybe)
    at = at[at > 0]
    at = at[(end - start)[at] == (end - start)[at - 1]]
    step = 1 << 14
    for lo in range(0, len(at), step):
        some = at[lo : lo + step]
        length = (end - start)[some]
        offsets = np.zeros(len(some) + 1, dtype=np.int64)
        np.cumsum(length, out=offsets[1:])
        inner = np.arange(offsets[-1])
        a = buf[np.repeat(start[some] - offsets[:-1], length) + inner]
        b = buf[np.repeat(start[some - 1] - offsets[:-1], length) + inner]
        differ = np.zeros(offsets[-1] + 1, dtype=np.int64)
        np.cumsum(a != b, out=differ[1:])
        out[some] = differ[offsets[1:]] == differ[offsets[:-1]]
    return out


def equal_groups(
    buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, owner: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """An order of the slices and the group of each in that order; equal bytes, equal group.

    With ``owner``, slices of different owners are never equal. Inside a group, slices
    keep their order.

    Slices are sorted by hash and compared with their neighbour. Where a hash
    stands for several byte strings, its slices are grouped by the bytes themselves.
    """
    if owner is None:
        owner = np.zeros(len(hashes), dtype=np.int64)
    else:
        hashes = mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    maybe = np.zeros(len(h), dtype=bool)
    maybe[1:] = h[1:] == h[:-1]
    same = same_as_previous(buf, start[order], end[order], maybe)
    same[1:] &= owner[order[1:]] == owner[order[:-1]]
    for wrong in np.unique(h[maybe & ~same]):
        lo, hi = np.searchsorted(h, wrong, "left"), np.searchsorted(h, wrong, "right")
        value = lambda i: (owner[i], bytes(buf[start[i] : end[i]]))
        order[lo:hi] = sorted(order[lo:hi], key=value)
        values = [value(i) for i in order[lo:hi]]
        same[lo:hi] = [i > 0 and values[i] == values[i - 1] for i in range(len(values))]
    return order, np.cumsum(~same) - 1


@dataclass
class Lines:
    """Lines that hold a word: their bytes, their text, and their words from ``word`` to before ``word_end``.

    ``number`` counts all lines of the text from 0, with those that hold no word.
    """

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    number: np.ndarray
    word: np.ndarray
    word_end: np.ndarray


def split_lines(words: Words, offsets: np.ndarray) -> Lines:
    feeds = np.flatnonzero(words.buf == 0x0A)
    # a line begins with each text and after each line feed
    texts = np.arange(len(offsets) - 1)
    start = np.concatenate([offsets[:-1], feeds + 1])
    row = np.concatenate([texts, np.searchsorted(offsets, feeds, side="right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.append(start[1:], len(words.buf))
    own_feed = np.zeros(len(start), dtype=bool)
    own_feed[:-1] = row[1:] == row[:-1]
    end = end - own_feed
    number = np.arange(len(start)) - np.searchsorted(row, row)
    word, word_end = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    some = word_end > word
    return Lines(*(x[some] for x in (start, end, row, number, word, word_end)))
