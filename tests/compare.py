"""Run registered queries beside their SQL and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(partitions: str = "8"):
    from pyspark.sql import SparkSession
    spark = (
        SparkSession.builder.master("local[8]").appName("palisade")
        .config("spark.sql.shuffle.partitions", partitions).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return len(mine[1]), None, took, []
    t = time.time()
    rel = con.execute(sql)
    theirs = rows_of([c[0] for c in rel.description], rel.fetchall())
    diff = []
    if mine[0] != theirs[0]:
        diff.append(f"columns {mine[0]} / {theirs[0]}")
    elif mine[1] != theirs[1]:
        a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
        diff += [f"spark {x[:600]}" for x in sorted(a - b)[:2]]
        diff += [f"duck  {x[:600]}" for x in sorted(b - a)[:2]]
        diff.append(f"{len(mine[1])} / {len(theirs[1])} rows, {len(a - b)} / {len(b - a)} unmatched")
    return len(mine[1]), len(theirs[1]), took, diff


def main(argv):
    import traceback

    from palisade.plans.queries import ORACLES, QUERIES
    sf_dir = argv[0]
    spark, con = session(), duck(sf_dir)
    names = argv[1:] or list(QUERIES)
    bad = 0
    for n in names:
        try:
            a, b, took, diff = compare(spark, con, n, QUERIES[n], ORACLES.get(n), sf_dir)
            print(f"{'ok ' if not diff else 'BAD'} {n} rows={a} oracle={b} {took:.1f}s", flush=True)
            for line in diff:
                print("   ", line, flush=True)
            bad += bool(diff)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print("ERR", n, str(e)[:700], flush=True)
            tb = traceback.extract_tb(e.__traceback__)
            print("    ", [f"{f.filename.split('/')[-1]}:{f.lineno}" for f in tb if "palisade" in f.filename][-3:])
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
