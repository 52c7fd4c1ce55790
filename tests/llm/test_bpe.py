import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from leadcurve.llm import bpe
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, written

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    with open(FILE, "rb") as f:
        return bpe.tokenizer(f.read(), PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def texts(seed=0, n=400):
    rng = random.Random(seed)
    alphabets = ["abcdefgh", "theingeraion ", "éèçñßü ", "  \n\t\x1c\x85 　", "日本語テキスト。", "0123456789.,", "🙂👩‍🚀é", "'s't're'LL \"#$%", "aA ", "\x00\x7f​"]
    for _ in range(n):
        yield "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 5, 40, 300])))
    yield from ["", "a" * 5000, "ab" * 3000, " " * 777, "\n" * 50 + "x", "<|endoftext|>", "é" * 999, "thethethe" * 400]


def test_ids_equal_the_library(own, library):
    for text in texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), repr(text[:80])
        assert own.decode(ids) == text.encode()


def test_random_pieces_equal_plain_merges(own):
    rng = random.Random(3)
    for _ in range(2000):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 12)))
        assert list(own.encode_piece(data)) == [own.ranks[x] for x in bpe.merged(data, own.ranks)]


def test_a_vocabulary_in_which_backtracking_is_needed():
    ranks = {bytes([b]): i for i, b in enumerate(b"abcdefgh")}
    for token in [b"ab", b"cd", b"bc", b"abcd", b"de", b"bcde", b"fg", b"efgh", b"gh", b"efg", b"cdefgh", b"ha", b"hab"]:
        ranks[token] = len(ranks)
    own = bpe.BytePairs(ranks, ".+")
    rng = random.Random(5)
    reachable = all(bpe.merged(t, ranks) == [t] for t in ranks)
    for t in [t for t in ranks if bpe.merged(t, ranks) != [t]]:
        del ranks[t]
    own = bpe.BytePairs(ranks, ".+")
    for _ in range(3000):
        data = bytes(rng.choice(b"abcdefgh") for _ in range(rng.randrange(1, 30)))
        if data not in ranks:
            assert list(own.encode_piece(data)) == [ranks[x] for x in bpe.merged(data, ranks)], (data, reachable)


def test_parts_change_nothing(own):
    for text in texts(7, 100):
        got = [x for part in bpe.parts(text, 20) for x in own.encode(part)]
        assert got == own.encode(text) and "".join(bpe.parts(text, 20)) == text


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def check(spark, library, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_byte_bpe"](spark, folder).collect())
    assert got == sorted((str(r.doc_id), *expected(library, r.text)) for r in rows)


def test_driver_table_equals_the_library(spark, library):
    check(spark, library, SF)


@pytest.mark.parametrize("rows", [[(1, None), (2, ""), (None, "x"), (3, "a b"), (3, "a b"), (4, "word " * 100_000)], []])
def test_edges_equal_the_library(spark, library, tmp_path, rows):
    check(spark, library, written(docs(spark, rows), tmp_path))


def test_round_trip_of_columns(spark):
    df = docs(spark, [(1, "é 日本 x"), (2, None), (3, "")])
    ids = bpe.encoded(df, FILE, PATTERN, "tokens").drop("text")
    out = {r.doc_id: r.back for r in bpe.decoded(ids, FILE, PATTERN, "tokens", "back").collect()}
    assert out == {1: "é 日本 x", 2: "", 3: ""}
