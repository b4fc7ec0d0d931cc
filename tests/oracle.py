"""Run a query and its SQL twin side by side."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def compare(spark, folder, run, sql):
    """Messages about what differs; empty when the two agree in names, types, rows and values."""
    df = run(spark, folder)
    names = sorted(df.columns)
    ours = df.select(*[f"`{n}`" for n in names])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(sql)
    problems = []
    if sorted(rel.columns) != names:
        return [f"columns {names} vs {sorted(rel.columns)}"], 0
    types = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in ours.dtypes:
        if KINDS.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} vs {types[name]}")
    theirs = con.execute("SELECT " + ",".join(f'"{n}"' for n in names) + f" FROM ({sql})").fetchall()
    left = sorted(tuple(map(value, r)) for r in ours.collect())
    right = sorted(tuple(map(value, r)) for r in theirs)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} vs {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        problems.append(f"only spark {len(a - b)}: {[x for x in left if x not in b][:3]}")
        problems.append(f"only sql {len(b - a)}: {[x for x in right if x not in a][:3]}")
    return problems, len(left)
