"""Run registered queries against their SQL: `python -m tests.check_oracle <sf_dir> [names]`."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

import __spark_entry__ as entry
from tests.compare import database, difference


def main(sf: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = database(sf), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, sf)
            found = difference(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as e:  # report and go on to the next query
            found = f"{type(e).__name__}: {str(e)[:600]}"
        ok = found is None or found.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
