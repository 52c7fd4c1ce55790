import base64
import gzip
import hashlib
import pathlib

import pytest

from leadcurve.llm import warc
from leadcurve.llm.queries import QUERIES
from tests.llm.helpers import SF, written

PAGES = "page_id long, url string, html string"


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row, by brute force."""
    data = [((html or "").encode(), page) for page, _, html in rows]
    out = []
    for payload, page in data:
        same = [p for d, p in data if d == payload and p is not None]
        first = min(same) if same and len(payload) >= least else None
        revisit = first is not None and page != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


EDGES = [
    (1, "http://a", "x\r\n\r\nWARC/1.1\r\n\r\n"), (2, None, None), (3, "http://c\r\nX: y", ""), (4, "é", "é" * 100), (0, "http://d", "é" * 100),
    (5, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (5, "u", "twice"), (5, "u", "twice"), (None, "n", "twice"),
    (None, "n", "alone"), (-7, "v", "\r\n" * 50), (8, "w", "日本" * 1000), (9, "w", "x" * 70_000), (10, "w", "x" * 70_000),
]


@pytest.mark.parametrize("chunk", [7, 100, 1 << 16])
@pytest.mark.parametrize("rows", [EDGES, []])
def test_round_trip_equals_brute_force(spark, rows, chunk):
    if chunk == 7:
        rows = [r for r in rows if len(r[2] or "") < 10_000]
    df = spark.createDataFrame(rows, PAGES)
    assert rows_of(warc.round_trip(df, chunk_bytes=chunk)) == expected(rows)


def test_small_payloads_are_not_revisits(spark):
    df = spark.createDataFrame(EDGES, PAGES)
    assert rows_of(warc.round_trip(df, least_bytes=150)) == expected(EDGES, 150)


def test_driver_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert rows_of(QUERIES["op2_warc"](spark, SF)) == expected(rows)


def test_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a", 9, "z")], PAGES + ", record_id int, payload string")
    assert rows_of(QUERIES["op2_warc"](spark, written(df, tmp_path, "pages"))) == expected([(1, "u", "a")])


def test_files_are_archives_of_segmented_records(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/b", "x" * 25)], "page_id long, url string, payload string")
    warc.write_archives(df, str(tmp_path / "w"), chunk_bytes=10)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(pathlib.Path(tmp_path / "w").glob("*.gz")))
    records = data.split(b"\r\n\r\nWARC/1.1\r\n")
    assert len(records) == 3 and data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    assert b"WARC-Segment-Number: 1\r\n" in records[0] and b"WARC-Target-URI: http://a/b\r\n" in records[0]
    assert b"WARC-Type: continuation" in records[1] and b"WARC-Segment-Total-Length" not in records[1]
    assert b"WARC-Segment-Total-Length: %d\r\n" % (25 + len(warc._HTTP)) in records[2]


def test_a_cut_file_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/b", "x" * 25)], "page_id long, url string, payload string")
    warc.write_archives(df, str(tmp_path / "w"))
    [file] = pathlib.Path(tmp_path / "w").glob("*.gz")
    whole = gzip.decompress(file.read_bytes())
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.gz").write_bytes(gzip.compress(whole[:-20]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, str(tmp_path / "cut")).collect()
