"""Side-by-side run of a registered query and its SQL check."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], data


def compare(spark, folder, con, query, sql):
    """Return a list of differences; empty if both sides agree."""
    df = query(spark, folder)
    left = table(df.columns, df.collect())
    cur = con.execute(sql)
    right = table([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return [f"columns {left[0]} / {right[0]}"]
    if len(left[1]) != len(right[1]):
        return [f"rows {len(left[1])} / {len(right[1])}", f"{left[1][:2]} / {right[1][:2]}"]
    bad = [(a, b) for a, b in zip(left[1], right[1]) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return [f"{len(bad)} of {len(left[1])} rows differ", *[f"{a}\n      {b}"[:1500] for a, b in bad[:2]]] if bad else []


def main(names):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from crawlframe.plans.local import local_session

    spark = local_session(8)
    folder = "/root/testdata/sf0.01"
    con = duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        t = time.time()
        try:
            if name in oracle:
                diff = compare(spark, folder, con, queries[name], oracle[name])
                note = "ok" if not diff else "DIFF"
            else:
                n = queries[name](spark, folder).count()
                diff, note = [], f"rows only: {n}"
        except Exception as e:  # noqa: BLE001
            diff, note = [str(e)[:1500]], "ERROR"
        print(f"{name:28s} {note} {time.time() - t:.1f}s", flush=True)
        for line in diff:
            print("     ", line)
        if diff:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
