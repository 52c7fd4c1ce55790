"""Small tables, and queries compared with DuckDB."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def written(df, tmp_path, table="documents"):
    folder = str(tmp_path)
    df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return folder


def plain(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in df.collect())


def sql_rows(sql, folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            path = f"{folder}/{name}"
            path = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
