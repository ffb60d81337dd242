"""Run a registered query and its SQL on the same files and compare rows without regard to order."""

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(df, con, sql):
    """Return a list of differences (empty when equal)."""
    result = con.execute(sql)
    wanted_names, wanted = rows_of([d[0] for d in result.description], result.fetchall())
    names, found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if names != wanted_names:
        problems.append(f"columns {names} != {wanted_names}")
    if len(found) != len(wanted):
        problems.append(f"row count {len(found)} != {len(wanted)}")
    bad = [(a, b) for a, b in zip(found, wanted) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. {bad[0][0]} != {bad[0][1]}")
    types = {n: t for n, t in df.dtypes}
    return problems, types, [(d[0], str(d[1])) for d in result.description], len(found)
