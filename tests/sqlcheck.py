"""A query's rows against its SQL in DuckDB."""
import datetime
import decimal
import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if v != v else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def same(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for f in glob.glob(data + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(row[names.index(c)]) for c in cols)) for row in r.fetchall())
    assert got == want
