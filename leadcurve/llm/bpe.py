"""Byte-level BPE: encoding in linear time by backtracking, and decoding.

A sequence of tokens is what the merges give exactly if every two neighbours are: the
merges, run on the bytes of both, stop at these two. So encoding takes the longest token
that fits (all matches come from an Aho-Corasick automaton over bytes as Latin-1), asks
whether it may follow its left neighbour, tries shorter tokens, and steps back when
none is left. A place from which no way leads on is never tried again, so the work is
linear in the text. Answers about neighbours and whole pieces are memoised, up to a
bound.

A text is split by a pattern first; each match is encoded by itself. Null and empty
texts have no tokens. Long texts are split in parts at places where a word ends and a
single space begins, where every match ends as well.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leadcurve.llm import words as W
from leadcurve.llm.frames import own_columns

PART_CHARS = 1 << 16
MEMO_PIECES = 300_000
MEMO_PAIRS = 500_000

_loaded: dict[tuple[bytes, str], BytePairs] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    pairs = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def merged(data: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """The plain merges, lowest rank first, until ``stop`` parts are left or none can be merged."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > stop:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BytePairs:
    """Encodes and decodes by one rank table. All single bytes have a rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.prefix: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens of a token's last merge; a token that no merge makes gives itself twice."""
        got = self.halves.get(token)
        if got is None:
            data = self.bytes_of[token]
            parts = merged(data, self.ranks, 2) if len(data) > 1 else []
            whole = len(parts) == 2 and self.ranks.get(parts[0] + parts[1]) == token
            got = (self.ranks[parts[0]], self.ranks[parts[1]]) if whole else (token, token)
            self.halves[token] = got
        return got

    def _shorter(self, token: int) -> int:
        """The longest other token that the token's bytes begin with, or -1."""
        got = self.prefix.get(token)
        if got is None:
            data = self.bytes_of[token]
            found = (self.ranks.get(data[:n]) for n in range(len(data) - 1, 0, -1))
            got = self.prefix[token] = next((x for x in found if x is not None), -1)
        return got

    def fits(self, left: int, right: int) -> bool:
        """Do the merges, run on the bytes of both tokens, stop at these two?

        The merges of each token are undone from the last one on, and at each step
        the pair at the border is looked up: if it would have merged before the merge
        undone last, the border does not hold.
        """
        key = left, right
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            got = self.pairs[key] = self._holds(left, right)
        return got

    def _holds(self, left: int, right: int) -> bool:
        bound = 1 << 60  # a border merge counts only if its rank is below
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < bound:
                return False
            # the later merge of the two is undone; of equal ones the right one came later
            inner, outer = self._halves(left)[1], self._halves(right)[0]
            if inner == left and outer == right:
                return True
            if outer == right or (inner != left and left > right):
                bound, left = left, inner
            else:
                bound, right = right + 1, outer

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        longest: list[int] = [-1] * len(data)
        reach = [0] * len(data)
        for end, (n, token) in self.automaton.iter(data.decode("latin-1")):
            start = end - n + 1
            if n > reach[start]:
                reach[start], longest[start] = n, token
        open_ = bytearray(b"\x01") * (len(data) + 1)
        size, at, out = self.size, 0, []
        token = longest[0]
        while at < len(data):
            left = out[-1] if out else None
            while token >= 0:
                end = at + size[token]
                if open_[end] and (left is None or self.fits(left, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < len(data) else -1
                    break
                token = self._shorter(token)
            else:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        memo, miss = self.pieces, []
        pieces = self.split(text)
        for piece in set(pieces):
            if piece not in memo:
                miss.append(piece)
        if len(memo) + len(miss) > MEMO_PIECES:
            memo.clear()
            miss = set(pieces)
        for piece in miss:
            memo[piece] = self.encode_piece(piece.encode())
        return list(chain.from_iterable(map(memo.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def tokenizer(data: bytes, pattern: str) -> BytePairs:
    """The tokenizer of a rank file's content, made once in each process."""
    key = hashlib.sha256(data).digest(), pattern
    if key not in _loaded:
        _loaded[key] = BytePairs(read_ranks(data), pattern)
    return _loaded[key]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``size``; a part begins with a single space after a word, or with the text."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def digests(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded bytes)."""
    with open(rank_file, "rb") as f:
        content = documents.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(content.value, pattern)
        shown = {token: str(token) for token in pairs.bytes_of}
        for batch in W.pieces(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
                for part in parts(text or ""):
                    ids = pairs.encode(part)
                    if n and ids:
                        ids_sha.update(b",")
                    n += len(ids)
                    ids_sha.update(",".join(map(shown.__getitem__, ids)).encode())
                    text_sha.update(pairs.decode(ids))
                rows.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
            n, ids_sha, text_sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    own = own_columns(documents, doc_id="doc_id", text="text")
    return own.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(documents: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``documents`` with an array of token ids for each text."""
    with open(rank_file, "rb") as f:
        content = documents.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(content.value, pattern)
        for batch in W.pieces(batches):
            lists = [
                list(chain.from_iterable(pairs.encode(p) for p in parts(t or "")))
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, ids]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    return documents.mapInArrow(encode, f"{fields}, `{ids}` array<int>")


def decoded(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``tokens`` with the text of each id list; null lists give empty texts."""
    with open(rank_file, "rb") as f:
        content = tokens.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = tokenizer(content.value, pattern)
        for batch in batches:
            texts = [pairs.decode(x or []).decode(errors="replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(decode, f"{fields}, `{text}` string")
