"""A query against its SQL: same columns, same rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def same(spark, query, sql, sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    columns, got = rows_of(query(spark, sf_dir))
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    want = sorted(result.select(",".join(f'"{c}"' for c in columns)).fetchall(), key=str)
    assert list(map(str, got)) == list(map(str, want))
    return len(got)
