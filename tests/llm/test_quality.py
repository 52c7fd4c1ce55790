import random

import pytest

from leadcurve.llm import quality
from leadcurve.llm.oracle import ORACLE
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, rows_of, sql_rows, written

NOTICE = "Read our  cookie notice"


def sites(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(80):
        body = "\n".join(" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([2, 9, 30]))) for _ in range(rng.choice([1, 4])))
        notice = NOTICE if i % 2 else NOTICE.upper().replace("  ", "\t")
        rows.append((i, f"{notice}\n{body}\n\n{notice} " if i % 3 else f"{body}\n \n{body}", f"h{i % 2}"))
    rows += [(100 + i, "\n".join([NOTICE] * 9 + ["few own words here"]), "h1") for i in range(20)]
    return rows


EDGES = [
    (900, None), (901, ""), (902, "\n\n \n"), (903, "x " * 500), (904, "é ü ß " * 7 + "\n#*$%&|<>"), (None, "a b c " * 3),
    (905, "a\r\nb\r\na\r\nb"), (906, "same\n same\nsame\n"), (906, "same\n same\nsame\n"), (907, "1 2 3 4 5 6 7 8 9 " * 2, None), (908, "a\nb\nc", ""),
]


@pytest.mark.parametrize("rows", [sites(), EDGES, sites(4) + EDGES, []])
def test_equals_sql(spark, tmp_path, rows):
    folder = written(docs(spark, rows), tmp_path)
    assert rows_of(QUERIES["op3_quality_rules"](spark, folder)) == sql_rows(ORACLE["op3_quality_rules"], folder)


def test_driver_table_equals_sql(spark):
    assert rows_of(QUERIES["op3_quality_rules"](spark, SF)) == sql_rows(ORACLE["op3_quality_rules"], SF)


def test_cleaned_documents(spark):
    body = " ".join(f"own{i}" for i in range(30))
    rows = [(i, f"{NOTICE}\n{body} {i}\n\nend", "h") for i in range(12)] + [(50, f"{NOTICE}\nshort", "h"), (60, None, "h")]
    df = docs(spark, rows).withColumnRenamed("lang", "gone")
    out = quality.cleaned(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(range(12))
    assert got[0].text == f"{NOTICE}\n{body} 0\n\nend"  # the first holder keeps the line
    # "end" stands in all twelve as well
    assert got[5].text == f"{body} 5\n" and got[5].n_chars == len(got[5].text) and got[5].gone == "en"


def test_rows_that_share_an_id_are_judged_alone(spark):
    text = " ".join(f"w{i}" for i in range(25))
    out = quality.verdicts(docs(spark, [(1, text), (1, "short"), (1, text)])).collect()
    assert sorted(r.kept for r in out) == [False, True, True]
