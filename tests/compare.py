"""Run registered queries against DuckDB: ``python tests/compare.py [folder] [name ...]``."""

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, db, folder, query, sql):
    """None when both give the same columns and rows, else what differs."""
    frame = query(spark, folder)
    got = normal(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = normal(names, cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None
    extra = [r for r in got[1][:100000] if r not in set(want[1])][:3]
    missing = [r for r in want[1] if r not in set(got[1])][:3]
    return f"{len(got[1])} rows != {len(want[1])}; only here {extra}; only there {missing}"


def main():
    from __spark_entry__ import oracle_sql, queries
    from pathlode.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db, sql = local_session(8), connect(folder), oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, query in queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, db, folder, query, sql[name])
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        took = f"{time.time() - start:.1f}s"
        if problem:
            print("BAD", name, took, problem, flush=True)
        else:
            rows = db.execute(f"SELECT count(*) FROM ({sql[name]})").fetchone()[0]
            print("ok ", name, took, rows, flush=True)
        bad += bool(problem)
    print("bad:", bad)


if __name__ == "__main__":
    main()
