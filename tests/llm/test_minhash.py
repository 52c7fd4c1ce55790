import random

import numpy as np
import pyarrow as pa
import pytest

from leadcurve.llm import minhash
from leadcurve.llm.oracle import ORACLE
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, rows_of, sql_rows, written


def edited(rng, words, share):
    return [rng.choice("qrstuv") + str(rng.random())[:4] if rng.random() < share else w for w in words]


def families(seed=0, bases=6, copies=12):
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([6, 40, 200, 600]))]
        for c in range(copies):
            rows.append((len(rows), " ".join(edited(rng, base, 0.004 * (c % 6)))))
    return rows


EDGES = [
    (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one two three"), (906, "a b c d e"),
    (907, "A b c d  e"), (908, "é É b"), (909, "É É b"), (903, "one two"), (910, "x " * 5000), (911, "x " * 9), (912, "x x x x"),
    (913, "a b c d e f"), (913, "one two three"), (914, "one two"),
]


@pytest.mark.parametrize("rows", [families(), EDGES, families(3) + EDGES, []])
def test_equals_sql(spark, tmp_path, rows):
    folder = written(docs(spark, rows), tmp_path)
    assert rows_of(QUERIES["op8_minhash"](spark, folder)) == sql_rows(ORACLE["op8_minhash"], folder)


def test_driver_table_equals_sql(spark):
    assert rows_of(QUERIES["op8_minhash"](spark, SF)) == sql_rows(ORACLE["op8_minhash"], SF)


def test_documents_without_id_and_other_columns_stay(spark):
    df = docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)])
    df = df.withColumnRenamed("lang", "component_id").withColumnRenamed("source", "bands")
    out = minhash.without_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("1", "a b c d e f"), ("3", None), ("None", "a b c d e f")]


def test_chain_of_links_is_one_group(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(10)]  # neighbours share 52 of 60 shingles
    found = minhash.near_duplicates(docs(spark, rows), percent=80).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1


def star_family(copies, seed=1, first=0, base=None):
    """Copies with three edited words each, and their centre last: copies are like the centre, but not like each other."""
    rng = random.Random(seed)
    base = base or [f"w{i}" for i in range(200)]
    rows = []
    for c in range(copies):
        own = list(base)
        for at in rng.sample(range(5, 195, 5), 3):
            own[at] = f"e{first + c}x{at}"
        rows.append((first + c, " ".join(own)))
    return [*rows, (first + copies, " ".join(base))]


def test_large_group_with_its_centre_last_is_one_group(spark):
    found = minhash.near_duplicates(docs(spark, star_family(300))).collect()
    assert {r.component_id for r in found} == {0}


def test_several_groups_in_shared_buckets_equal_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    base = [f"w{i}" for i in range(200)]
    other = [f"o{i}" if i % 40 == 20 else w for i, w in enumerate(base)]  # centres are below 85 %, copies often meet
    rows = [*star_family(40, 2), *star_family(40, 3, 100, other), *star_family(40, 4, 200, other[::-1])]
    folder = written(docs(spark, rows), tmp_path)
    assert rows_of(QUERIES["op8_minhash"](spark, folder)) == sql_rows(ORACLE["op8_minhash"], folder)


@pytest.mark.parametrize("cross", [False, True])
def test_blocks_link_what_all_pairs_link(cross):
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(40), rng.choice([20, 30, 36]))) for _ in range(60)]
    side = np.array([cross and i % 2 == 0 for i in range(60)])
    part = np.array([i // 3 for i in range(60)])

    def joined(pairs):
        root = part.copy()
        for a, b in pairs:
            root[root == root[b]] = root[a]
        return {frozenset(np.flatnonzero(root == x).tolist()) for x in root}

    block = minhash._Block(part, pa.array(sets, pa.list_(pa.int64())))
    near = lambda a, b: 100 * len({*sets[a]} & {*sets[b]}) >= 70 * len({*sets[a]} | {*sets[b]})
    pairs = [(a, b) for a in range(60) for b in range(a) if (not cross or side[a] != side[b]) and near(a, b)]
    assert joined(block.links(side, cross, 70)) == joined(pairs)
