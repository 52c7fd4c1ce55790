import itertools
import random

import numpy as np
import pytest

from leadcurve.llm import packing
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, written


def least_padding(lengths, counts, buckets):
    order = np.argsort(lengths)
    value, count = np.array(lengths)[order], np.array(counts)[order]
    best = None
    for k in range(min(buckets, len(value))):
        for cut in itertools.combinations(range(len(value) - 1), k):
            ends = [*cut, len(value) - 1]
            total, at = 0, 0
            for e in ends:
                total += value[e] * count[at : e + 1].sum()
                at = e + 1
            best = total if best is None else min(best, total)
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bounds_have_least_padding(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 60), rng.randrange(1, 10))
    counts = [rng.randrange(1, 50) for _ in lengths]
    buckets = rng.randrange(1, 6)
    bounds = packing.best_bounds(np.array(lengths), np.array(counts), buckets)
    assert len(bounds) <= buckets and bounds[-1] == max(lengths)
    total = sum(c * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts, strict=True))
    assert total == least_padding(lengths, counts, buckets)


def verify(rows, lengths, buckets, max_length, budget):
    """Whole documents, full batches, smallest buckets and the least padding."""
    want = []
    for doc, n in lengths:
        pieces = [max_length] * ((n - 1) // max_length) + [(n - 1) % max_length + 1]
        want += [(doc, i, i * max_length, x) for i, x in enumerate(pieces)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length)) for r in rows)
    if not rows:
        return
    bounds = sorted({r.padded_length for r in rows})
    values, counts = np.unique([w[3] for w in want], return_counts=True)
    assert sum(r.padded_length for r in rows) == sum(
        c * min(b for b in packing.best_bounds(values, counts, buckets) if b >= v) for v, c in zip(values, counts, strict=True)
    )
    for r in rows:
        assert r.padded_length == min(b for b in bounds if b >= r.length) and r.padded_length == bounds[r.bucket]
    for bucket in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == bucket]
        room = budget // own[0].padded_length
        assert sorted(r.batch * room + r.slot for r in own) == list(range(len(own)))
        assert all(r.slot < room for r in own)


def words_of(rows):
    return [(r[0], len((r[1] or "").encode().split()) + 1) for r in rows]


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (None, "a b"), (5, "w " * 1000), (6, "\x0b\x1c\x85 z"), (7, "v " * 99)]


@pytest.mark.parametrize("rows", [EDGES, [(i, "w " * (i % 37)) for i in range(300)], [(9, "x")], []])
def test_small_tables(spark, rows):
    out = packing.batches_of(docs(spark, rows), buckets=4, max_length=100, token_budget=250).collect()
    verify(out, words_of(rows), 4, 100, 250)


def test_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op6_packing"](spark, SF).collect()
    verify(out, words_of(rows), packing.BUCKETS, packing.MAX_LENGTH, packing.TOKEN_BUDGET)


def test_clashing_columns(spark, tmp_path):
    df = docs(spark, [(1, "a b"), (2, "c")]).withColumnRenamed("lang", "bucket").withColumnRenamed("source", "length")
    assert QUERIES["op6_packing"](spark, written(df, tmp_path)).count() == 2


def test_budget_below_one_sequence_is_refused(spark):
    with pytest.raises(ValueError):
        packing.batches_of(docs(spark, [(1, "a")]), max_length=100, token_budget=99)
