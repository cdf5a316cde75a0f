"""Row-by-row comparison of a registered query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 9)
    return v


def same(spark, name, query, sql, folder):
    got = query(spark, folder)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns, name
    a = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    b = sorted(repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall())
    assert len(a) == len(b), name
    assert a == b, (name, [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2])
