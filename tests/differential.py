"""Compares a query with its SQL."""

import math
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.6f}"
    if isinstance(x, (list, tuple)):
        return str([text(i) for i in x])
    return str(x)


def both(spark, sf, query, sql):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert columns == sorted(names)
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in result.fetchall())
    return got, want
