"""Compare every registered query with its SQL: python tests/run_oracles.py <folder> [name part ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
import __spark_entry__ as entry
from quire.session import local_session
from tests.oracle import compare

if __name__ == "__main__":
    folder, parts = sys.argv[1], sys.argv[2:]
    spark = local_session("oracles")
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        began = time.time()
        try:
            if name in sqls:
                problems, rows = compare(spark, folder, run, sqls[name])
            else:
                rows, problems = len(run(spark, folder).collect()), []
        except Exception as error:  # noqa: BLE001 - reported below
            problems, rows = [f"{type(error).__name__}: {str(error)[:700]}"], 0
        status = "ok " if not problems else "BAD"
        bad += bool(problems)
        print(f"{status} {name} rows={rows} {time.time() - began:.1f}s {'(no sql)' if name not in sqls else ''}", flush=True)
        for p in problems:
            print("    ", p[:1200], flush=True)
    print("bad:", bad)
