import random

import pytest

from leadcurve.llm import line_dedup
from leadcurve.llm.oracle import ORACLE
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, rows_of, sql_rows, written


def sample(seed=0, n=60):
    rng = random.Random(seed)
    line = lambda: rng.choice(["a", "b c", "d", " d", "e\tf", "e f", "", " "])
    block = [line() for _ in range(30)]
    rows = []
    for i in range(n):
        body = [line() for _ in range(rng.randrange(12))]
        if i % 3 == 0:
            body[rng.randrange(len(body) + 1) :] = block[: rng.randrange(30)]
        rows.append((i, "\n".join(body)))
    return rows


EDGES = [
    (900, None), (901, ""), (902, "\n\n"), (903, "x\n" * 40), (904, "x\n" * 40), (905, "a\nb"), (906, "a\nb"),
    (907, "long " * 30000 + "\nq\nr\ns"), (908, "q\nr\r\ns \nt"), (-1, "t\nq\nr\ns"), (None, "x\nx\nx\nx"),
]


@pytest.mark.parametrize("rows", [sample(), EDGES, sample(5) + EDGES, []])
def test_equals_sql(spark, tmp_path, rows):
    folder = written(docs(spark, rows), tmp_path)
    assert rows_of(QUERIES["op5_line_dedup"](spark, folder)) == sql_rows(ORACLE["op5_line_dedup"], folder)


def test_driver_table_equals_sql(spark):
    assert rows_of(QUERIES["op5_line_dedup"](spark, SF)) == sql_rows(ORACLE["op5_line_dedup"], SF)


def brute(rows, n):
    """Lines deleted by comparing every run of n lines with all earlier ones."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = [" ".join(x.split()) for x in text.split("\n") if x.split()]
        gone = set()
        for i in range(len(lines) - n + 1):
            run = tuple(lines[i : i + n])
            if run in seen:
                gone |= set(range(i, i + n))
            seen.add(run)
        out[doc] = len(gone)
    return out


@pytest.mark.parametrize("n", [1, 2, 4, 5, 7])
def test_any_run_length(spark, n):
    rows = sample(n, 30)
    got = {r.doc_id: r.n_removed for r in line_dedup.verdicts(docs(spark, rows), n).collect()}
    assert got == brute(rows, n)


def test_rounds_give_the_suffix_order(spark):
    """Names order the repeated suffixes as their first lines do, by line hash."""
    ids = line_dedup.line_ids(docs(spark, sample(8)).withColumnRenamed("n_chars", "text_key"))
    lines = {r.doc_id: r.lines for r in ids.collect()}
    last = 0
    for n, found in line_dedup.suffix_rounds(ids):
        if n == 1:
            value = {(r.doc_id, r.at): r.name for r in found.collect()}
            assert len(set(value.values())) == len({lines[d][a] for d, a in value})
            order = sorted(value, key=lambda x: lines[x[0]][x[1]])
        else:
            value = {(r.doc_id, r.at): r.name for r in found.collect()}
            order = sorted(value, key=lambda x: lines[x[0]][x[1] : x[1] + n])
        names = [value[x] for x in order]
        assert names == sorted(names)
        last = n
    assert last >= 16


def test_repeated_rows_and_other_columns(spark):
    df = docs(spark, [(1, "a\nb\nc\nown"), (2, "a\nb\n\nc"), (2, "a\nb\n\nc"), (3, None)]).withColumnRenamed("lang", "runs")
    out = line_dedup.without_repeats(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "", r.n_chars or 0) for r in out.collect()) == [(1, "a\nb\nc\nown", 9), (2, "", 0), (2, "", 0), (3, "", 0)]
