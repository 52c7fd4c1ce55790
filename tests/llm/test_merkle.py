import hashlib
import random
import zlib

import pytest

from leadcurve.llm import merkle
from leadcurve.llm.oracle import ORACLE
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, rows_of, sql_rows, written

COLUMNS = ["doc_id", "folded_root", "leaf", "proof_sha256", "root", "subroot", "verified"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests):
    """Root, and per node its siblings' digests (left, right) from below, level by level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    ways = []
    for at in range(len(digests)):
        way = []
        for level in levels[:-1]:
            lo = at - at % 3
            way.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + 3])))
            at //= 3
        ways.append(way)
    return levels[-1][0], ways


def brute(rows):
    """rows: doc_id, text, lang, source, n_chars; as the columns of the query, sorted by name."""
    digest = lambda d, t, lang, s, n: sha("".join(field(x) for x in (d, s, lang, n, t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, digest(*r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, leaf, (d, t, *rest)), own in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            way, end = own + top, leaf
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                end = digest(d, None if t is None else t.replace("\n", ""), *rest)
            for a, b in way:
                end = sha(a + end + b)
            proof = sha("".join(a + b for a, b in way))
            out.append((str(d), end, leaf, proof, root, trees[s][0], str(end == root)))
    return sorted(out)


def got(df):
    return sorted(tuple(str(r[c]) for c in COLUMNS) for r in df.collect())


def table(rows):
    return [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows]


EDGES = [
    (1, "a\nb", "x"), (2, None, "x"), (3, "", "x"), (4, "\n" * 3000, "x"), (5, "ünïcode\n", "é"), (5, "ünïcode\n", "é"),
    (5, "other", "é"), (None, "no\nid", "x"), (None, "no\nid", None), (7, "null\nsource", None), (-8, "below\nzero", ""), (9, "lone", "z"), (10, "word " * 40000, "x"),
]


@pytest.mark.parametrize("rows", [EDGES, EDGES[:1], [(i, f"t\n{i}", f"s{i}") for i in range(40)], [(i, f"t\n{i}", "one") for i in range(28)]])
def test_equals_plain_version_and_sql(spark, tmp_path, rows):
    folder = written(docs(spark, rows), tmp_path)
    found = QUERIES["op12_merkle"](spark, folder)
    assert got(found) == brute(table(rows))
    assert rows_of(found) == sql_rows(ORACLE["op12_merkle"], folder)


def test_driver_table_equals_sql(spark):
    assert rows_of(QUERIES["op12_merkle"](spark, SF)) == sql_rows(ORACLE["op12_merkle"], SF)


@pytest.mark.parametrize("levels", [1, 2])
def test_several_levels_of_blocks(spark, levels):
    rng = random.Random(levels)
    rows = [(i, "x\n" * rng.randrange(4), rng.choice(["hot", "hot", "hot", "b", None, f"s{i}"])) for i in range(400)]
    assert got(merkle.tamper_checks(docs(spark, rows), levels)) == brute(table(rows))


def test_versions_share_all_untouched_nodes():
    leaves = [sha(str(i)) for i in range(23)]
    old = merkle.built(leaves, 3)
    new = merkle.changed(old, 3, 13, sha("new"))
    assert new == merkle.built([*leaves[:13], sha("new"), *leaves[14:]], 3)
    assert old == merkle.built(leaves, 3)  # the old version still stands

    def nodes(node):
        yield id(node)
        for child in node[1]:
            yield from nodes(child)

    assert len(set(nodes(new)) - set(nodes(old))) == 4  # a leaf and its three ancestors


def test_empty_table_and_other_columns(spark, tmp_path):
    assert merkle.tamper_checks(docs(spark, [])).collect() == []
    df = docs(spark, EDGES)
    for name in ("place", "count", "leaf", "own", "_id", "block", "way"):
        df = df.withColumn(name, df["lang"])
    assert got(merkle.tamper_checks(df)) == brute(table(EDGES))
