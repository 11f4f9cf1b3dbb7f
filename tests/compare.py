"""Comparing a query with its SQL, order and the last digits of doubles aside."""

import math


def text(v) -> str:
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "0" if v == 0 else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def assert_same(df, con, sql: str) -> None:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = got.fetchall()
    cols = sorted(df.columns)
    assert cols == sorted(names)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    spark_kinds, sql_kinds = dict(df.dtypes), {c[0]: str(c[1]) for c in got.description}
    assert {c: kinds[spark_kinds[c]] for c in cols} == {c: sql_kinds[c] for c in cols}
    a = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    b = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in want)
    assert a == b


def views(folder):
    import duckdb

    con = duckdb.connect()
    for f in sorted(folder.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con
