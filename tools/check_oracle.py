"""Run registered queries in Spark and their oracle SQL in DuckDB; compare
row count, column names and an order-insensitive hash of the values.

    python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from helpdesk_lake.plans.catalog import load_all  # noqa: E402
from helpdesk_lake.plans.compare import TABLES, digest  # noqa: E402
from helpdesk_lake.session import build_session  # noqa: E402

def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    reg = load_all()
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name, spec in reg.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = spec.build(spark, sf_dir)
            s_cols = df.columns
            s_rows = [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(exc).__name__}: {str(exc)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if spec.oracle is None:
            print(f"---- {name}: rows={len(s_rows)} (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(spec.oracle)
            o_cols = [d[0] for d in cur.description]
            o_rows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:400]}")
            bad += 1
            continue
        sh, sl = digest(s_cols, s_rows)
        oh, ol = digest(o_cols, o_rows)
        ok = sorted(s_cols) == sorted(o_cols) and len(s_rows) == len(o_rows) and sh == oh
        status = "ok  " if ok else "FAIL"
        bad += 0 if ok else 1
        print(f"{status} {name}: rows={len(s_rows)}/{len(o_rows)} {ts:.1f}s")
        if not ok:
            if sorted(s_cols) != sorted(o_cols):
                print("   cols spark", sorted(s_cols), "\n   cols duck ", sorted(o_cols))
            diff_s = [x for x in sl if x not in set(ol)][:3]
            diff_o = [x for x in ol if x not in set(sl)][:3]
            print("   spark-only", diff_s, "\n   duck-only ", diff_o)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
