"""Spark's rows against those of the other engine, as multisets with columns in order of name."""

from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = round(float(v), 6)
        return None if f != f else f + 0.0
    return str(v)[:19]


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark_df, con, sql):
    a = rows_of(spark_df.columns, spark_df.collect())
    rel = con.sql(sql)
    b = rows_of(rel.columns, rel.fetchall())
    if a == b:
        return ""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    only = list((a[1] - b[1]).items())[:3], list((b[1] - a[1]).items())[:3]
    return f"{sum(a[1].values())} and {sum(b[1].values())} rows; only here {only[0]}; only there {only[1]}; {sum((a[1] - b[1]).values())} differ"
