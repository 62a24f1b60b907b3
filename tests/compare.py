"""The same query by Spark and by DuckDB: columns by name, rows in any order."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat().replace("T00:00:00", "")
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return str(v)


def by_duckdb(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, cur.fetchall()


def by_spark(df):
    return df.columns, [tuple(r) for r in df.collect()]


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql, sf_dir):
    """An empty list if both agree."""
    (n1, r1), (n2, r2) = canonical(*by_spark(df)), canonical(*by_duckdb(sql, sf_dir))
    if n1 != n2:
        return [f"columns {n1} and {n2}"]
    if len(r1) != len(r2):
        return [f"{len(r1)} and {len(r2)} rows; {r1[:2]} {r2[:2]}"]
    return [f"{a} and {b}" for a, b in zip(r1, r2) if a != b][:3]
