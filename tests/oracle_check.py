"""Compare registered queries with their SQL on the same tables: ``python -m tests.oracle_check [sf] [query ...]``."""

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def kind(v):
    if isinstance(v, bool):
        return "bool"
    return "float" if isinstance(v, (float, decimal.Decimal)) else type(v).__name__


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows), [
        next((kind(r[i]) for r in rows if r[i] is not None), None) for i in order]


def difference(df, con, sql):
    """None when equal, else what differs."""
    got = df.collect()
    cols, rows, kinds = normal(df.columns, [tuple(r) for r in got])
    cur = con.execute(sql)
    want = cur.fetchall()
    ocols, orows, okinds = normal([d[0] for d in cur.description], want)
    if cols != ocols:
        return f"columns {sorted(set(cols) ^ set(ocols))}"
    if rows == orows:
        return None if kinds == okinds else f"types {[(c, a, b) for c, a, b in zip(cols, kinds, okinds) if a != b]}"
    mine, theirs = set(rows) - set(orows), set(orows) - set(rows)
    detail = ""
    if mine and theirs and len(rows) == len(orows):
        a, b = sorted(mine)[0], sorted(theirs)[0]
        detail = str([(c, x, y) for c, x, y in zip(cols, a, b) if x != y])[:700]
    return (f"{len(rows)} rows against {len(orows)}; only here {len(mine)} {sorted(mine)[:2]}; "
            f"only there {len(theirs)} {sorted(theirs)[:2]}")[:1200] + detail


if __name__ == "__main__":
    from tests.session import session
    from trustdesk.plans.oracle import ORACLES
    from trustdesk.plans.queries import QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    only = sys.argv[2:]
    spark, sf_dir = session(), f"/root/testdata/{sf}"
    con = duck(sf_dir)
    for name, build in QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in ORACLES:
                diff = difference(build(spark, sf_dir), con, ORACLES[name])
                state = "ok" if diff is None else f"DIFFERS {diff}"
            else:
                state = f"no sql, {build(spark, sf_dir).count()} rows"
        except Exception as e:
            state = f"FAILED {type(e).__name__} {str(e)[:600]}"
        print(f"{name:26s} {time.time() - start:6.2f}s {state}", flush=True)
