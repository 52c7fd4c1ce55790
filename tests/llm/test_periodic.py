import hashlib
import random
import zlib

import numpy as np
import pytest

from leadcurve.llm import periodic
from leadcurve.llm.oracle import ORACLE
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, rows_of, sql_rows, written


def plain_runs(w, least=6, repeats=4):
    """Every period, word by word: (start, length, period)."""
    found = {}
    for q in range(1, len(w) // repeats + 1):
        at = 0
        while at + q < len(w):
            to = at
            while to + q < len(w) and w[to] == w[to + q]:
                to += 1
            if to - at + q >= max(least, repeats * q) and to > at:
                found.setdefault((at, to - at + q), q)
            at = max(to, at + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain(doc, text):
    w = (text or "").encode().split()
    if doc is not None and w and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def texts(seed, n=60):
    rng = random.Random(seed)
    for i in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            part = [f"w{rng.randrange(rng.choice([2, 5, 50]))}" for _ in range(rng.randrange(1, rng.choice([4, 12, 40])))]
            w += part * rng.choice([1, 3, 4, 5, 9]) + part[: rng.randrange(len(part) + 1)]
        yield i, rng.choice([" ", "\n", " \t"]).join(w)


EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a a a a a"), (6, "a a a a a a"), (7, "a b " * 3), (8, "a b " * 4), (8, "a b " * 4), (None, "x " * 9),
    (9, "x\xa0y " * 6), (10, "a b a b a b a b a a a a a a b a a b a a b a a b"), (11, "long " * 20000), (12, " ".join(f"u{i}" for i in range(9000))),
    (13, " ".join(f"u{i % 2500}" for i in range(10500))), (14, "A a " * 5),
]


def compare(spark, rows):
    out = periodic.digests(docs(spark, rows))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted((plain(d, t) for d, t in rows), key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_plain_version(spark, seed):
    compare(spark, list(texts(seed)))


def test_edges(spark):
    compare(spark, [(d, t) for d, t in EDGES if d not in (11, 12, 13)])
    # the plain version is quadratic: the long ones are known
    runs = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.detected(docs(spark, [e for e in EDGES if e[0] in (11, 12, 13)])).collect()}
    assert runs == {11: [(0, 20000, 1)], 12: [], 13: [(0, 10500, 2500)]}


@pytest.mark.parametrize("seed", range(40))
def test_runs_over_small_alphabets(seed):
    rng = np.random.default_rng(seed)
    w = rng.integers(0, 2 if seed % 2 else 3, 500)
    if seed % 3 == 0:
        w = np.repeat(w[:120], rng.integers(1, 9, 120))
    if seed % 5 == 0:
        w = np.concatenate([np.tile(w[:n], 5)[: 4 * n + n // 2] for n in (3, 17, 31, 64)])
    row = np.sort(rng.integers(0, 3, len(w)))
    for least, repeats in ((6, 4), (2, 3)):
        got = periodic.runs_of(w.astype(np.int64), row, least, repeats)
        found = sorted(zip(got.row.tolist(), got.start.tolist(), got.length.tolist(), got.period.tolist(), strict=True))
        want = []
        for r in range(3):
            at = np.flatnonzero(row == r)
            want += [(r, s + int(at[0]), n, q) for s, n, q in plain_runs(w[at].tolist(), least, repeats)]
        assert found == sorted(want)


def test_equals_sql(spark, tmp_path):
    rows = list(texts(7)) + [e for e in EDGES if e[0] != 11]
    folder = written(docs(spark, rows), tmp_path)
    assert rows_of(QUERIES["op13_periodic_runs"](spark, folder)) == sql_rows(ORACLE["op13_periodic_runs"], folder)


def test_driver_table_equals_sql(spark):
    assert rows_of(QUERIES["op13_periodic_runs"](spark, SF)) == sql_rows(ORACLE["op13_periodic_runs"], SF)


def test_collapsed_text_and_other_columns(spark):
    df = docs(spark, [(21, "one two " * 5 + "end")]).withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    (row,) = periodic.detected(df).collect()
    assert row.collapsed == "one two end" and [tuple(r) for r in row.runs] == [(0, 10, 2)]


def test_empty_table(spark):
    assert periodic.digests(docs(spark, [])).collect() == []
