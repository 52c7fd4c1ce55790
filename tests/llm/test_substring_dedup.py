import random

import pytest

from leadcurve.llm import substring_dedup
from leadcurve.llm.oracle import ORACLE
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, rows_of, sql_rows, written


def sample(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("a b c d e f g hh ii jj".split())
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.choice([0, 3, 12, 13, 14, 60])))
        if i % 3 == 0:
            text = f"{text}\n\n{passage}\t {word()}"
        rows.append((i, text))
    return rows


EDGES = [
    (None, " ".join("abcdefghijklmnopq")), (500, None), (501, ""), (502, " \n "), (503, "x " * 400), (504, "x " * 20),
    (505, " ".join("abcdefghijklmnopq")), (506, " ".join("abcdefghijklmnopq")), (506, " ".join("abcdefghijklmnopq")),
    (506, "other " + " ".join("abcdefghijklmnopq")), (507, "é  ü " * 15), (508, "é  ü " * 14),
    (-3, " ".join("ABCDEFGHIJKLMNOP")), (9, " ".join("ABCDEFGHIJKLMNOP")), (510, "y" * 3_000_000 + " z" * 30),
]


@pytest.mark.parametrize("rows", [sample(), EDGES, sample(2) + EDGES, []])
def test_equals_sql(spark, tmp_path, rows):
    folder = written(docs(spark, rows), tmp_path)
    got = rows_of(QUERIES["op1_substring_dedup"](spark, folder))
    assert got == sql_rows(ORACLE["op1_substring_dedup"], folder)


def test_driver_table_equals_sql(spark):
    assert rows_of(QUERIES["op1_substring_dedup"](spark, SF)) == sql_rows(ORACLE["op1_substring_dedup"], SF)


def test_common_minimisers_and_small_buckets_change_nothing(spark, monkeypatch):
    df = docs(spark, sample(3) + EDGES)
    expected = rows_of(substring_dedup.digests(df))
    monkeypatch.setattr(substring_dedup.gram_levels, "__defaults__", (5,))
    assert rows_of(substring_dedup.digests(df, sketch_bits=4)) == expected


def test_cut_documents_keep_rows_and_other_columns(spark):
    df = docs(spark, [(1, "a b c\nd e f"), (2, "x a b c\nd e f y"), (None, "a b c"), (3, None)]).withColumnRenamed("lang", "spans")
    out = substring_dedup.without_repeats(df, window=3, gram=2)
    assert out.columns == df.columns
    got = {r.doc_id: (r.text, r.n_chars, r.spans) for r in out.collect()}
    assert got == {1: ("a b c\nd e f", 11, "en"), 2: ("x\ny", 3, "en"), None: ("a b c", 5, "en"), 3: (None, None, "en")}
