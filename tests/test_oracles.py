"""Every query with SQL against DuckDB over the same tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        files = path + "/*.parquet" if os.path.isdir(path) else path
        if glob.glob(files):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "as_tuple"):
        return round(float(v), 3) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__) if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    out = duck.execute(SQL[name])
    cols = [d[0] for d in out.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=key)
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, (len(bad), names, bad[:3])
