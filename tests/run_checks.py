"""Run registered queries against their SQL twins: ``python tests/run_checks.py [sf] [NAME ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tests.checks import compare, connect  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    folder = f"/root/testdata/{sf}"
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad, total = 0, time.time()
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                n = ""
            else:
                n = len(df.collect())
                problems = [] if n else ["no rows"]
        except Exception as e:
            text = str(e).splitlines()
            problems = [f"{type(e).__name__}: {' '.join(text[:4])[:600]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problems:
            bad += 1
        state = "FAIL" if problems else ("ok" if name in oracles else f"rows={n}")
        print(f"{name:18} {state:10} {time.time() - start:6.2f}s {problems or ''}", flush=True)
    print(f"{bad} bad, {time.time() - total:.0f}s")


if __name__ == "__main__":
    main()
