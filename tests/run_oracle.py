"""Check registered queries by name prefix: ``python tests/run_oracle.py SF [prefix ...]``."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
import oracle

from worktrail.session import local_session

if __name__ == "__main__":
    sf = f"/root/testdata/{sys.argv[1]}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    con = oracle.connect(sf)
    bad = 0
    for name in queries:
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        try:
            text, spent, ok = oracle.check(name, spark, sf, con, queries, sqls)
        except Exception as e:  # report and go on
            text, spent, ok = f"{type(e).__name__}: {str(e)[:700]}", 0.0, False
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name} {spent:.2f}s {text[:900]}", flush=True)
    print("failures:", bad)
