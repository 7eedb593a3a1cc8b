"""Row comparison between a Spark query and its SQL twin."""

import math
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float) and not isinstance(v, bool):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark_df, con, sql):
    """None when equal, else a short description."""
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    expected = rows(sql_names, result.fetchall())
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(sql_names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(sql_names)}"
    if got == expected:
        return None
    here, there = set(got), set(expected)
    return f"{len(got)} against {len(expected)} rows; only Spark {sorted(here - there, key=repr)[:3]}; only SQL {sorted(there - here, key=repr)[:3]}"
