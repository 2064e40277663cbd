"""Run the registered queries next to their SQL and report differences.

    python tools/check_oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from heliofleet.session import build_session  # noqa: E402
from heliofleet.catalog import all_oracles, all_queries  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows),
                                   key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                  "spark.driver.memory": "12g",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    queries, oracles = all_queries(), all_oracles()
    bad, count = [], 0
    for name, run in queries.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        count += 1
        start = time.time()
        try:
            df = run(spark, args.sf)
            got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(oracles[name])
            want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: sql {str(e)[:600]}", flush=True)
            bad.append(name)
            continue
        kinds = {d[0]: str(d[1]) for d in cur.description}
        spark_kinds = dict(df.dtypes)
        pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}
        mism = [c for c in got_cols if pairs.get(spark_kinds[c]) != kinds.get(c)]
        if got_cols != want_cols:
            print(f"DIFF {name}: columns {set(got_cols) ^ set(want_cols)}", flush=True)
            bad.append(name)
        elif got == want and got and not mism:
            print(f"ok   {name}: {len(got)} rows {took:.1f}s", flush=True)
        else:
            first = [(a, b) for a, b in zip(got, want) if a != b][:2]
            n = sum(a != b for a, b in zip(got, want))
            cols = sorted({got_cols[i] for a, b in zip(got, want) for i in range(len(a)) if a[i] != b[i]}) \
                if len(got) == len(want) else "?"
            print(f"DIFF {name}: {len(got)} vs {len(want)} rows, {n} differ in {cols} types {mism}\n"
                  + "\n".join(f"   spark {a}\n   sql   {b}" for a, b in first), flush=True)
            bad.append(name)
    print(f"{count - len(bad)} of {count} fine; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
