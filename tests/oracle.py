"""Compare a registered query with its SQL oracle as bags of rows."""

from __future__ import annotations

import collections
import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


KINDS = {"INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "VARCHAR": "string", "DOUBLE": "double",
         "FLOAT": "float", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def _cell(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the difference."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} vs {sorted(rel.columns)}"
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    kinds = dict(df.dtypes)
    odd = [f"{n}: {kinds[n]} vs {theirs[n]}" for n in names if KINDS.get(theirs[n], theirs[n]) != kinds[n]]
    table = df.select(*[f"`{n}`" for n in names]).toArrow().to_pydict()
    ours = collections.Counter(zip(*[[_cell(v) for v in table[n]] for n in names]))
    wanted = ", ".join(f'"{n}"' for n in names)
    rows = con.execute(f"SELECT {wanted} FROM ({sql.rstrip().rstrip(';')})").fetchall()
    want = collections.Counter(tuple(_cell(v) for v in r) for r in rows)
    if ours != want:
        return (
            f"rows {sum(ours.values())} vs {sum(want.values())}; only ours {list((ours - want).items())[:3]}; "
            f"only theirs {list((want - ours).items())[:3]}"
        )
    return f"types {odd}" if odd else None
