import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from leadcurve.llm import licenses
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, docs, written


def bigrams(text):
    low = text.translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", low)
    return Counter(zip(words, words[1:], strict=False))


def brute(text, percent, templates):
    """Every part against every template."""
    lines = (text or "").split("\n")
    has = [bool(re.search(r"[A-Za-z0-9\x80-\U0010ffff]", x)) for x in lines]
    parts = [("line", x) for x in lines]
    runs, run = [], []
    for line, some in [*zip(lines, has, strict=True), ("", False)]:
        if some:
            run.append(line)
        elif run:
            runs.append(run)
            run = []
    parts += [("paragraph", "\n".join(r)) for r in runs if len(r) > 1]
    if len(runs) > 1:
        parts.append(("text", text))
    found = []
    for kind, part in parts:
        own, best = bigrams(part), None
        for name, template in templates:
            other = bigrams(template)
            both = (own & other).total()
            total = own.total() + other.total()
            if both and 200 * both >= percent * total:
                best = min(x for x in (best, (-2 * both / total, name)) if x)
        if best:
            found.append((best[0], best[1], kind))
    first = min(found, default=(None, None, None))
    score = None if first[0] is None else -first[0]
    return first[1], score, first[2], len(found), ",".join(sorted({n for _, n, _ in found}))


def sample(seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        name, text = rng.choice(licenses.TEMPLATES)
        words = [w if rng.random() > 0.05 * (i % 4) else rng.choice(["other", "of the", "License"]) for w in text.split()]
        if i % 3 == 0:
            cut = rng.randrange(len(words) + 1)
            words.insert(cut, "\n" if i % 2 else "\n\n")
        own = "plain words of the day\n" * (i % 3)
        rows.append((i, f"{own}{' '.join(words)}\n{own.upper()}"))
    return rows


EDGES = [(1, None), (2, ""), (3, "\n\n"), (4, "one"), (5, "MIT License " * 5000), (5, "All rights reserved."), (None, "ALL RIGHTS-RESERVED"), (6, "é ü\r\nAll rights\treserved"), (7, "...\n---")]


@pytest.mark.parametrize(("rows", "percent"), [(sample(), 80), (sample(2), 60), (sample(3), 100), (EDGES, 80), ([], 80)])
def test_equals_brute_force(spark, rows, percent):
    got = licenses.scanned(docs(spark, rows), percent).collect()
    want = [(str(d), *brute(t, percent, licenses.TEMPLATES)) for d, t in rows]
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.license, r.score, r.part, r.n_matches, ",".join(r.licenses))) for r in got)


def test_driver_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op9_license_scan"](spark, SF).collect()
    want = [(d, *brute(t, licenses.PERCENT, licenses.TEMPLATES)) for d, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.license, r.score, r.part, r.n_matches, r.licenses)) for r in got)
    assert {"MIT", "Apache-2.0"} <= {r.license for r in got}


def test_size_bounds_keep_every_match():
    table = licenses.Templates([(str(n), " ".join(f"w{i}" for i in range(n + 1))) for n in range(1, 60)], 80)
    for size in range(1, 90):
        fits = {n for n, _, _ in table.fitting(size)}
        assert fits == {n for n in range(1, 60) if 200 * min(n, size) >= 80 * (n + size)}


def test_clashing_columns(spark, tmp_path):
    df = docs(spark, [(1, "Released under the MIT License.")]).withColumnRenamed("lang", "license").withColumnRenamed("source", "score")
    assert [r.license for r in QUERIES["op9_license_scan"](spark, written(df, tmp_path)).collect()] == ["MIT"]


def inside(texts, templates=licenses.TEMPLATES, percent=80):
    return licenses.matches_of(pa.array(texts), licenses.Templates(templates, percent))[1]


def test_notices_of_several_paragraphs_inside_other_text(spark):
    apache = [t for n, t in licenses.TEMPLATES if n == "Apache-2.0"][1]
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))
    cut = lambda t: "\n#\n# ".join(re.split(r"(?=You may obtain|Unless required|See the|This program is distributed)", t))
    around = "\n\n".join(f"some code {i} that is about other things" for i in range(60))
    texts = [f"{around}\n\n{cut(apache)}\n\n{around}", f"{around}\n{cut(gpl)}\n{around}", "Our code is free. Released under the MIT License. See docs.", around]
    got = licenses.scanned(docs(spark, list(enumerate(texts)))).collect()
    assert [r.embedded for r in sorted(got, key=lambda r: r.doc_id)] == [["Apache-2.0"], ["GPL-3.0"], ["MIT"], []]


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_embedded_equals_all_windows(percent):
    rng = random.Random(percent)
    templates = [("a", "x y z x y"), ("b", "z z y x x y z y"), ("c", "q r")]
    texts = [" ".join(rng.choice("xyzqr") for _ in range(rng.randrange(14))) for _ in range(80)] + [None]
    for text, got in zip(texts, inside(texts, templates, percent), strict=True):
        words, want = (text or "").split(), {}
        for name, template in templates:
            other = bigrams(template)
            for a in range(len(words)):
                for b in range(a + 2, len(words) + 1):
                    own = bigrams(" ".join(words[a:b]))
                    both, total = (own & other).total(), own.total() + other.total()
                    if 200 * both >= percent * total:
                        want[name] = max(want.get(name, 0), 2 * both / total)
        assert got == want
