"""Run registered queries next to their SQL: python tests/check.py FOLDER [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as registry  # noqa: E402
from segmentry.session import build_session  # noqa: E402


def main() -> None:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    sql = registry.oracle_sql()
    bad = 0
    for name, run in registry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                message = oracle.compare(df, con, sql[name])
            else:
                message, n = "", len(df.collect())
                name = f"{name} (no SQL, {n} rows)"
        except Exception as error:  # report and go on
            message = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {time.time() - start:6.1f}s {name} {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
