"""Row-by-row comparison of a Spark result with its DuckDB twin."""

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list):
        return [plain(v) for v in value]
    return repr(value)


def rows_of(names, rows, order):
    at = [names.index(c) for c in order]
    return sorted(str([plain(row[i]) for i in at]) for row in rows)


def assert_same(df, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    order = sorted(df.columns)
    assert order == sorted(names)
    got = rows_of(df.columns, df.collect(), order)
    want = rows_of(names, expected, order)
    assert len(got) == len(want)
    assert got == want
