"""Compare every registered query with its SQL oracle: python tests/run_oracles.py [sf_dir] [name...]"""
import json
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from caseflow import get_spark  # noqa: E402
from oracle_harness import compare, duck  # noqa: E402
import __spark_entry__ as E  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
only = set(sys.argv[2:])
spark = get_spark("local[8]", shuffle_partitions=8)
con = duck(sf)
qs, sqls = E.queries(), E.oracle_sql()
results = {}
for name, fn in qs.items():
    if only and name not in only:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in sqls:
            res = compare(df, sqls[name], con)
        else:
            res = {"spark_rows": df.count(), "match": None}
    except Exception as e:  # report and continue
        res = {"error": repr(e)[:400], "trace": traceback.format_exc()[-800:]}
    res["sec"] = round(time.time() - t, 2)
    results[name] = res
    print(name, json.dumps(res, default=str)[:600], flush=True)
ok = sum(1 for r in results.values() if r.get("match"))
print(f"MATCH {ok}/{len(results)}")
