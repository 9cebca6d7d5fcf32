"""Run registered queries beside their SQL and compare the rows.

    python tests/oracle.py SF_DIR [name ...]
"""

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, queries, oracle, sf_dir):
    """None if equal, else a short text."""
    began = time.time()
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    if name not in oracle:
        return None if got else "no rows", len(got), took
    res = con.execute(oracle[name])
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got), took
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; e.g. {sorted(set(got) ^ set(want), key=repr)[:4]}", len(got), took
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return (f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None), len(got), took


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from laneward.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failed = 0
    for name in names or sorted(queries()):
        try:
            problem, n, took = compare(spark, con, name, queries(), oracle_sql(), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem, n, took = f"{type(e).__name__}: {str(e)[:600]}", 0, 0.0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {took:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
