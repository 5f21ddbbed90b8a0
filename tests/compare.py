"""A query's rows against those of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(v: object) -> str:
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_text, v)) + "]"
    return repr(v)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    ours = sorted("|".join(_text(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted("|".join(_text(r[i]) for i in order) for r in result.fetchall())
    assert ours == theirs
