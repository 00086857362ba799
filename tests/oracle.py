"""Side-by-side comparison of a query with its SQL, as sorted rows."""

import glob
import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, Decimal):
        return str(x)
    return "~" if x is None else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    theirs = rows([c[0] for c in cur.description], cur.fetchall())
    assert mine[0] == theirs[0], (name, mine[0], theirs[0])
    assert len(mine[1]) == len(theirs[1]), (name, len(mine[1]), len(theirs[1]))
    bad = [(a, b) for a, b in zip(mine[1], theirs[1], strict=True) if a != b]
    assert not bad, (name, bad[:3])
