import numpy as np
import pytest

from leadcurve.llm import embedding_dedup as E
from leadcurve.llm import flatgraph
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, written

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """(vec_id, links, component, kept) of rows (vec_id, vector, label), in the given order."""
    n = len(rows)
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) and k is not None for _, v, k in rows]
    near = np.zeros((n, n), dtype=bool)
    for label in {k for _, _, k in rows if k is not None}:
        at = [i for i in range(n) if fine[i] and rows[i][2] == label]
        if not at:
            continue
        v = np.array([rows[i][1] for i in at], dtype=np.float32).astype(np.float64)
        v = v / np.sqrt((v**2).sum(axis=1, keepdims=True))
        near[np.ix_(at, at)] = v @ v.T >= threshold
    np.fill_diagonal(near, False)
    part = np.arange(n)
    while True:
        new = np.array([min([part[i], *part[near[i]]]) for i in range(n)], dtype=int)
        if (new == part).all():
            break
        part = new
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[part[i]] = min(least.get(part[i], d), d)
    name = [least.get(part[i]) for i in range(n)]
    return sorted((str(d), int(near[i].sum()), str(name[i]), d is None or d == name[i]) for i, (d, _, _) in enumerate(rows))


def got(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def planted(seed, n=900, dims=24):
    """Flat vectors, chains of near ones, a large group of different near copies, and exact copies."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)).astype(np.float32)
    centre = rng.normal(size=dims)
    for i in range(300):
        v[i] = centre + rng.normal(size=dims) * 0.12
    for i in range(300, 420):
        v[i] = v[rng.integers(300, max(i, 301))] + rng.normal(size=dims) * 0.3
    v[420:480] = v[rng.integers(0, n, 60)] * 2
    v[480:520] = v[519]
    ids = rng.permutation(n)
    return [(int(ids[i]), v[i].tolist(), int(i % 2) if i >= 600 else 0) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k) for i, v, k in rows], SCHEMA)


def test_edges(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), i % 3) for i in range(40)]
    rows += [(50 + i, rows[i][1], rows[i][2]) for i in range(9)] + [(70, rows[0][1], 1), (71, rows[0][1], None)]
    rows += [(72, rows[3][1], 0), (72, rows[3][1], 0), (73, [x * 1e30 for x in rows[3][1]], 0), (None, rows[5][1], 2)]
    bad = [(80, None, 0), (81, [0.0] * 6, 0), (82, [None] * 6, 0), (83, [float("nan")] * 6, 0), (84, [float("inf")] + [1.0] * 5, 0), (85, [1.0], 0), (86, [], 0), (None, None, None)]
    df = frame(spark, rows + bad).withColumnRenamed("vec_id", "x")
    df = df.selectExpr("x AS vec_id", "embedding", "label", "x AS node", "1 AS links", "'c' AS cell", "x AS weight")
    found = QUERIES["op11_flat_graph"](spark, written(df, tmp_path, "embeddings"))
    want = brute(rows + [b for b in bad if b[0] != 85]) + [("85", 0, "85", True)]
    assert got(found) == sorted(want)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 3)], [(5, [1.0, 2.0], 3), (2, [2.0, 4.0], 3)]])
def test_small_tables(spark, rows):
    assert got(E.near_duplicates(frame(spark, rows))) == brute(rows)


def test_many_overlapping_shards(spark):
    rows = planted(0)
    found, want = got(E.near_duplicates(frame(spark, rows), limit=64)), brute(rows)
    assert [r[0] for r in found] == [r[0] for r in want]
    links, exact = sum(r[1] for r in found), sum(r[1] for r in want)
    assert exact > 80000 and 0.98 * exact <= links <= exact
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))  # nothing below the threshold
    assert sum(a[2] == b[2] for a, b in zip(found, want, strict=True)) >= 0.99 * len(rows)


def test_one_shard_equals_brute_force(spark):
    rows = planted(1, 700)
    assert got(E.near_duplicates(frame(spark, rows))) == brute(rows)


def test_parallel_vectors_are_split(spark):
    rows = [(i, [float(i + 1), 2.0 * (i + 1)], 0) for i in range(300)]
    assert got(E.near_duplicates(frame(spark, rows), limit=40)) == brute(rows)


def test_audit_counts_by_brute_force(spark):
    rows = planted(2, 600)
    nodes = E.classes(frame(spark, rows).selectExpr("vec_id", "label", "CAST(embedding AS array<double>) AS vector"))
    exact = {r.node: r.exact for r in E.brute_links(nodes, 0.93, 50).collect()}
    want = {int(d): n + 1 for d, n, _, _ in brute(rows)}
    assert len(exact) == 50 and all(want[r.least] == exact[r.node] for r in nodes.collect() if r.node in exact)


def test_driver_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(QUERIES["op11_flat_graph"](spark, SF)) == brute(rows)


def test_graph_finds_the_nearest_from_the_medoid():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 16))
    v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    graph = flatgraph.built(v)
    assert ((graph.edges >= 0).sum(axis=1) > 0).all()
    asked = np.arange(200)
    pool = flatgraph.search(graph, v[asked], asked, np.full(200, graph.medoid()))
    assert (pool.vector[np.searchsorted(pool.point, asked)] == asked).mean() > 0.99


def test_pruning_drops_what_a_neighbour_covers():
    v = np.array([[1, 0], [0.99, 0.14], [0.98, 0.2], [0, 1.0]])
    v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    kept = flatgraph.pruned(v, np.array([0]), np.array([[1, 2, 3, -1]]), 1.0, 3)[0]
    assert kept.tolist() == [1, -1, -1] or kept.tolist() == [1, 3, -1]
    assert 2 not in kept


def test_spanning_pairs_keep_components():
    a, b = E.spanning(np.array([5, 9, 9, 1, 4]), np.array([7, 7, 5, 4, 4]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(4, 1), (7, 5), (9, 5)]
