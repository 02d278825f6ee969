"""Compare all operations (or the named ones) with their SQL on one scale: python check.py <dir> [name ...]"""

from __future__ import annotations

import sys
import time
import traceback

from sievework import registry
from sievework.session import build_session
from tests import oracle


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                 "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle.connect(sf_dir), 0
    for name, op in registry.operations().items():
        if names and name not in names:
            continue
        start, took = time.time(), 0.0
        try:
            df = op.runner(spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            took = time.time() - start
            problems = oracle.differences(df, con, op.sql) if op.sql else []
            state = ("ok" if not problems else "DIFF") if op.sql else f"rows={df.count()}"
        except Exception as e:
            problems, state = [f"{type(e).__name__}: {str(e)[:700]}"], "ERROR"
            if names:
                traceback.print_exc()
        bad += bool(problems)
        print(f"{took:6.2f}s {time.time() - start:6.2f}s {state:8} {name} {op.covers}", flush=True)
        for p in problems:
            print("        ", p, flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
