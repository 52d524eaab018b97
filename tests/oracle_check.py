"""Comparison of a query's rows with its SQL twin's, order aside."""

from __future__ import annotations

import datetime as dt
import decimal

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def differences(df, con, sql) -> str | None:
    """None when equal, else what differs first."""
    cols_a, a = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    cols_b, b = _rows([d[0] for d in cur.description], cur.fetchall())
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cells = [(c, p, q) for c, p, q in zip(cols_a, x, y) if p != q]
        return f"{len(bad)} rows differ; first: {str(cells)[:600]}"
    return None
