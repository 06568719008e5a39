"""CLI: compare every query with its oracle and print one line per query."""

import sys
import time

sys.path.insert(0, ".")

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from basketlens.session import local_session  # noqa: E402
from tests.compare import compare, duck_views  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = sys.argv[2:] 
spark = local_session()
con = duck_views(sf)
bad = 0
for name in sorted(queries()):
    if only and name not in only:
        continue
    t0 = time.time()
    try:
        df = queries()[name](spark, sf)
        if name not in oracle_sql():
            n = df.count()
            print(f"{name:34s} rows-only {n} ({time.time()-t0:.1f}s)")
            continue
        ok, msg, exact = compare(df, con.execute(oracle_sql()[name]).fetchdf())
    except Exception as e:  # noqa: BLE001
        ok, msg, exact = False, f"ERROR {type(e).__name__}: {str(e)[:400]}", False
    bad += not ok
    print(f"{name:34s} {'OK ' if ok else 'BAD'} {'exact' if exact else ''} {msg if not ok else ''} ({time.time()-t0:.1f}s)")
print("failures:", bad)
