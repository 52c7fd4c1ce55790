"""The pipeline against plain Python."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from leadcurve.llm import packing, substring_dedup
from tests.llm.helpers import SF, docs, written
from tests.llm.test_packing import verify


def words(text):
    return (text or "").encode().split()


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def line_words(line):
    return " ".join(w.decode() for w in line.encode().split())


def brute_quality(rows):
    """rows: (doc_id, text, source)."""
    hosts, holders = defaultdict(set), defaultdict(set)
    for doc, text, host in rows:
        hosts[host or ""].add(doc)
        for line in (text or "").split("\n"):
            if line_words(line):
                holders[host or "", low(line_words(line))].add(doc)
    common = {k: min(v) for k, v in holders.items() if len(v) > 10 and len(v) * 100 > 5 * len(hosts[k[0]])}
    out = []
    for doc, text, host in rows:
        w = words(text)
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
        if len(w) < 20 or 100 * len(covered) > 30 * len(w):
            continue
        key = lambda x: (host or "", low(line_words(x)))
        lines = (text or "").split("\n")
        left = [x for x in lines if not (line_words(x) and common.get(key(x), doc) != doc)]
        n = len(words("\n".join(left)))
        if n < 20 or 100 * n < 30 * len(w):
            continue
        out.append((doc, "\n".join(left), host))
    return out


def brute_lines(rows, n=3):
    seen, cut = {}, {}
    for doc, text, _ in sorted(rows):
        shown = [line_words(x) for x in text.split("\n") if line_words(x)]
        gone = set()
        for i in range(len(shown) - n + 1):
            run = tuple(shown[i : i + n])
            if run in seen:
                gone |= set(range(i, i + n))
            seen[run] = 1
        at, left = 0, []
        for line in text.split("\n"):
            if line_words(line):
                at += 1
                if at - 1 in gone:
                    continue
            left.append(line)
        cut[doc] = "\n".join(left)
    return [(d, cut[d], h) for d, _, h in rows if words(cut[d])]


def brute_near(rows):
    sets = {}
    for doc, text, _ in rows:
        w = words(low(text))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    holders = defaultdict(list)
    for doc, members in sets.items():
        for s in members:
            holders[s].append(doc)
    for a, b in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def brute_passages(rows, n=13):
    first = {}
    for doc, text, _ in rows:
        w = words(text)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, host in rows:
        w = words(text)
        spans = [{"lo": i, "hi": i + n} for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < doc]
        left = substring_dedup.without_spans(text, spans) if spans else text
        if words(left):
            out.append((doc, left, host))
    return out


def sample():
    rng = random.Random(9)
    line = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 9, 15])))
    block, passage = [line() for _ in range(4)], line() + " " + line() + " " + line()
    rows = []
    for i in range(90):
        own = [line() for _ in range(rng.choice([1, 3, 8]))]
        if i % 4 == 0:
            own += block
        if i % 5 == 0:
            own.insert(0, f"{line()} {passage}")
        if i % 2 == 0:
            own.append("Read our NOTICE" if i % 3 else "read  our notice")
        if i % 7 == 6:
            own = rows[-3][1].split("\n")
        if i % 9 == 8:
            own = f"{rows[-2][1]} edited".split("\n")
        rows.append((i, "\n".join(own), f"h{i % 2}" if i % 11 else None))
    return rows + [(200, None, "h"), (201, "", None)]


@pytest.mark.parametrize("source", ["sample", SF])
def test_stages_equal_brute_force(spark, tmp_path, source):
    df = docs(spark, sample()) if source == "sample" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    frame, columns = df, df.columns
    for (_, stage), brute in zip(corpus_pipeline.STAGES, [brute_quality, brute_lines, brute_near, brute_passages], strict=False):
        frame = stage(spark, frame, str(tmp_path))
        rows = brute(rows)
        assert frame.columns == columns
        got = frame.collect()
        assert sorted((r.doc_id, r.text, r.source or "") for r in got) == sorted((d, t, h or "") for d, t, h in rows)
        assert all(r.n_chars == len(r.text) for r in got)
        frame = spark.createDataFrame(got, df.schema)
    out = corpus_pipeline.run(spark, written(df, tmp_path)).collect()
    verify(out, [(d, len(words(t)) + 1) for d, t, _ in rows], packing.BUCKETS, packing.MAX_LENGTH, packing.TOKEN_BUDGET)


def test_copies_and_near_copies_are_gone_at_the_end(spark, tmp_path):
    rng = random.Random(4)
    line = lambda n=9: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    text = [line() for _ in range(12)]
    one_line = line(80)
    rows = [(i, "\n".join(line() for _ in range(6)), "h") for i in range(20)]
    rows += [
        (30, "\n".join(text), "h"), (31, "\n".join(text), "h"), (32, "\n".join(text[:11]), "g"),
        (33, one_line, "h"), (34, f"{one_line} edited", "h"), (35, one_line, "g"),
    ]
    frame = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
    kept = {r.doc_id: r.text for r in frame.collect()}
    assert set(kept) == {*range(20), 30, 33}  # one of each group, and no emptied text
    assert all(words(t) for t in kept.values())


def test_empty_table_and_other_columns(spark, tmp_path):
    df = docs(spark, []).withColumnRenamed("lang", "spans").withColumnRenamed("n_chars", "gone")
    assert corpus_pipeline.run(spark, written(df, tmp_path)).collect() == []
    body = " ".join(f"w{i}" for i in range(30))
    df = docs(spark, [(1, body), (1, body), (None, body), (2, None)]).withColumnRenamed("lang", "spans").withColumnRenamed("n_chars", "gone")
    out = corpus_pipeline.run(spark, written(df, tmp_path)).collect()
    assert sorted((str(r.doc_id), r.length) for r in out) == [("1", 31), ("1", 31), ("None", 31)]
