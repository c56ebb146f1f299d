"""Compare a query with its SQL: columns by name, rows as sorted texts."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def text(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x)


def table_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in rows)


def differences(spark_df, sql, con):
    got = table_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = table_rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    if got[1] == want[1]:
        return ""
    a, b = set(got[1]), set(want[1])
    return f"rows {len(got[1])} / {len(want[1])}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
