"""Run registered queries on both engines and compare: ``python tests/oracle_check.py sf_dir [names]``."""

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return repr(float(value))
    return repr(value)


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in records)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(df, con, sql):
    """None when equal, else what differs."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows, first {str(bad[0])[:600]}" if bad else None


def main(sf_dir, names):
    from conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    spark, con, oracles = make_session(), duck(sf_dir), oracle_sql()
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            diff = difference(fn(spark, sf_dir), con, oracles[name]) if name in oracles else f"no oracle, {fn(spark, sf_dir).count()} rows"
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{name:22s} {time.time() - start:6.2f}s {'ok' if diff is None else diff}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
