"""Spark rows against DuckDB rows, in any order."""

import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def same(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    rel = con.sql(sql)
    names = [c.lower() for c in rel.columns]
    assert sorted(rel.columns) == cols
    order = [names.index(c.lower()) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in con.execute(sql).fetchall()), key=str)
    got = sorted((tuple(plain(v) for v in r) for r in spark_df.select(*cols).collect()), key=str)
    assert got == want
