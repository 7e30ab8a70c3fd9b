"""Run registered queries beside their SQL texts: python check.py [folder] [name ...]."""

import math
import sys
import time

import duckdb

from freshet import build_session
from freshet.catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return repr(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return str(value)


def main() -> int:
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                 "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in args or list(QUERIES):
        began = time.time()
        try:
            df = QUERIES[name](spark, folder)
            columns = sorted(df.columns)
            mine = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
            took = time.time() - began
            if name not in ORACLES:
                print(f"rows  {name} {len(mine)} {took:.2f}s")
                bad += not mine
                continue
            cur = con.execute(ORACLES[name])
            names = [c[0] for c in cur.description]
            at = [names.index(c) for c in columns]
            theirs = sorted(tuple(normal(r[i]) for i in at) for r in cur.fetchall())
            ok = mine == theirs and sorted(names) == columns and len(mine) > 0
            print(f"{'ok   ' if ok else 'DIFF '} {name} {len(mine)} {len(theirs)} {took:.2f}s")
            if not ok:
                bad += 1
                a, b = set(mine), set(theirs)
                print("   columns", columns, sorted(names))
                print("   spark only", sorted(a - b)[:3])
                print("   sql only  ", sorted(b - a)[:3])
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name} {type(error).__name__}: {str(error)[:700]}")
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
