"""Headline timings: prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced end to end with the ``noop`` sink (every row and
column computed, nothing collected).  Every query first runs once on sf0.001
so the timings are steady-state (code generation and JIT warm-up excluded).
``rows_per_s`` reports input rows of the main table per second, the unit the
reference's progress log uses.

The given tables are one row group each, which Spark reads in one task.  A
large table has many files, so the bench first writes each table as two files
per core into a scratch folder (not timed) and runs on those.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sombra.plans import registry as R  # noqa: E402
from sombra.session import local_session  # noqa: E402

HEADLINE = [
    # (name, main input table)
    ("classify_columns", None),
    ("mask_customer", "customer"),
    ("masked_join", "orders"),
    ("mask_orders_cpf", "orders"),
    ("mask_documents", "documents"),
    ("mask_long_documents", "documents"),
    ("find_all_pii", "documents"),
    ("mask_pages_email", "pages"),
    ("candidate_terms", "documents"),
    ("fk_orphans", "lineitem"),
    ("audit_by_type", "documents"),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="sombra-bench")
    laid_out = os.path.join(tempfile.mkdtemp(prefix="sombra-bench-"), os.path.basename(sf_dir.rstrip("/")))
    for t in R.TABLES:
        (spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(2 * int(cpus))
         .write.parquet(f"{laid_out}/{t}.parquet"))
    # steady state: compile each plan once on the smallest input (codegen,
    # regex and JIT warm-up), then time it on the bench scale factor
    for name, _ in HEADLINE:
        R.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    times, rates = {}, {}
    for name, main_table in HEADLINE:
        t0 = time.time()
        R.QUERIES[name](spark, laid_out).write.format("noop").mode("overwrite").save()
        dt = time.time() - t0
        times[name] = round(dt, 3)
        if main_table:
            n = spark.read.parquet(f"{sf_dir}/{main_table}.parquet").count()
            rates[name] = round(n / dt, 1)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows_per_s": rates, "sf": sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
