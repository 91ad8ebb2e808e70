"""Run registered queries in Spark and their DuckDB twins; print a per-query verdict.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""
import json
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from meterwise.plans.catalog import REGISTRY  # noqa: E402
from meterwise.plans.compare import compare, duckdb_connection  # noqa: E402
from meterwise.session import build_session  # noqa: E402
from meterwise.sources.fixtures import Fixtures  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:] or list(REGISTRY)
spark = build_session("local[8]")
con = duckdb_connection(sf)
fx = Fixtures(spark, sf)
bad = []
for n in names:
    q = REGISTRY[n]
    t = time.time()
    try:
        df = q.build(fx)
        if q.oracle is None:
            r = {"match": None, "rows_spark": df.count()}
        else:
            r = compare(df, con, q.oracle_sql())
    except Exception as e:  # report and go on
        r = {"match": False, "error": f"{type(e).__name__}: {str(e)[:600]}"}
    r["sec"] = round(time.time() - t, 2)
    if r["match"] is False:
        bad.append(n)
        print(n, q.op_id, json.dumps(r, default=str)[:3000])
    else:
        print(n, q.op_id, "OK" if r["match"] else "rows-only", r.get("rows_spark"), r["sec"])
print("FAILED:", bad if bad else "none", f"({len(names)} checked)")
