import itertools

import numpy as np
import pytest

from leadcurve.llm import ann
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, written

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=20, k=20):
    """query -> its nearest (-score, id), all of them exact."""
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and fine(v)})
    vectors = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for (i, _), vector in zip(rows, vectors, strict=True):
        if i % every == 0:
            scores = (vectors * vector).sum(axis=1)
            out.setdefault(i, sorted((-s, j) for s, (j, _) in zip(scores, rows, strict=True) if j != i)[:k])
    return out


def compare(found, exact, k=20):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    assert set(got) == {q for q, best in exact.items() if best}
    for q, best in exact.items():
        own = sorted(got.get(q, []))
        assert [x[0] for x in own] == list(range(1, len(best) + 1))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in best})
        total += len(best)
    return hits / max(total, 1)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_recall_on_driver_tables(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = QUERIES["op10_multi_index_hashing"](spark, folder).collect()
    exact = brute(rows)
    assert compare(found, exact) >= 0.9
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    assert all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 for r in found)


def test_edges(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60) if i != 20]
    rows += [(100 + i, [1.0] + [0.0] * 7) for i in range(50)] + [(100, [1.0] + [0.0] * 7), (20, [0.5] * 8), (20, [0.5] * 8)]
    bad = [(300, None), (320, [0.0] * 8), (340, [None] * 8), (360, [float("nan")] * 8), (380, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (400, [1.0, 2.0]), (420, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], SCHEMA).withColumnRenamed("label", "vector")
    found = QUERIES["op10_multi_index_hashing"](spark, written(df, tmp_path, "embeddings")).collect()
    hot = [r for r in found if r.query_id == 100]
    assert [r.vec_id for r in sorted(hot, key=lambda r: r.rank)][:20] == [101 + i for i in range(20)] or len(hot) == 20
    assert compare(found, brute(rows)) >= 0.9


def test_fewer_candidates_than_asked(spark):
    rows = [(20, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.self_neighbours(df).collect())
    assert found == [(20, 1, 2, 0.0), (20, 2, 1, -1.0)]


def test_empty_table(spark):
    assert ann.self_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 5, 9, 16, 24])
def test_probing_retrieves_every_code_in_the_radius(radius):
    rng = np.random.default_rng(radius)
    vectors = rng.normal(size=(300, 12))
    codes = ann.learned(vectors, 9.0, 2)
    shard = ann.Shard(codes, [[i] for i in range(300)], vectors, radius)
    for code in codes.queries(rng.normal(size=(20, 12))):
        far = np.unpackbits(shard.own ^ code, axis=1).sum(axis=1)
        assert sorted(shard.near(code)) == sorted(np.flatnonzero(far <= radius)) or radius >= codes.bits


def test_pigeonhole_shares():
    for radius, parts in itertools.product(range(12), (1, 3, 4)):
        shares = ann.substring_radii(radius, parts)
        assert len(shares) == parts and sum(s + 1 for s in shares) == radius + 1
