"""Benchmark: headline jobs of the library at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Every job runs to completion: DataFrame results go to the ``noop`` sink (all
partitions computed, nothing collected); detector jobs return their small record
frame.  Reported times are wall-clock seconds, measured after every job has run
once on the sf0.001 tables (JVM warm-up; see below).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from pyspark.sql import functions as F  # noqa: E402

from cellwright.operators import transforms as TR  # noqa: E402
from cellwright.operators.apply import apply_decisions, decisions_by_rule  # noqa: E402
from cellwright.operators.cells import CellFinder, find_cells  # noqa: E402
from cellwright.operators.detect import detect_anomalies  # noqa: E402
from cellwright.plans import review as RV  # noqa: E402
from cellwright.plans.fixtures import (dirty, dirty_lineitem, review_anomalies, review_datasets,  # noqa: E402
                                       review_decisions, table)
from cellwright.plans.instructions import parse_instructions  # noqa: E402
from cellwright.plans.registry import INSTRUCTION_SQL, flagship  # noqa: E402
from cellwright.session import get_spark  # noqa: E402


def sink(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark(f"local[{cpus}]", app="cellwright-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})

    def lineitem():
        return table(spark, sf_dir, "lineitem")

    jobs = {
        "flagship_clean_chain": lambda: sink(flagship(spark, sf_dir)),
        "transforms_lineitem": lambda: sink(TR.run_chain(lineitem(), [
            {"type": "TRIM_WHITESPACE"}, {"type": "UPPERCASE", "columns": ["l_returnflag"]},
            {"type": "FILTER_ROWS", "params": {"column": "l_quantity", "operator": "gte", "value": 5}},
            {"type": "REMOVE_DUPLICATES", "columns": ["l_orderkey", "l_linenumber"], "params": {"keep": "first"}},
        ], order_by="l_partkey")[0]),
        "fill_forward_lineitem": lambda: sink(TR.fill_nulls(
            lineitem().withColumn("l_tax", F.when(F.col("l_partkey") % 3 == 0, F.lit(None)).otherwise(F.col("l_tax")))
            .withColumn("__k", F.monotonically_increasing_id()),
            ["l_tax"], strategy="forward", order_by="__k")[0]),
        "outliers_iqr_lineitem": lambda: sink(TR.detect_outliers(
            lineitem(), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], method="iqr", action="flag")[0]),
        "detect_orders": lambda: detect_anomalies(table(spark, sf_dir, "orders"), "orders",
                                                  order_by="o_orderkey").collect(),
        "detect_lineitem": lambda: detect_anomalies(
            lineitem().withColumn("__k", F.monotonically_increasing_id()), "lineitem", order_by="__k").collect(),
        "detect_find_apply_dirty": lambda: _dirty_cycle(spark, sf_dir),
        "detect_find_apply_lineitem": lambda: _dirty_cycle(spark, sf_dir, dirty_lineitem),
        "review_report": lambda: [sink(x) for x in RV.review_report(review_anomalies(spark, sf_dir),
                                                                    review_decisions(spark, sf_dir))],
        "user_stats": lambda: sink(RV.user_stats(review_datasets(spark, sf_dir), review_anomalies(spark, sf_dir),
                                                 "1998-06-15 00:00:00")),
        "parse_instructions": lambda: sink(parse_instructions(
            table(spark, sf_dir, "events").selectExpr("event_id", f"{INSTRUCTION_SQL} AS instruction"),
            "instruction", ["value"])),
    }
    # Warm-up: every job runs once on the smallest tables first, so the timings below
    # measure steady-state work, not one-time JVM JIT and code-generation compiles
    # (fixed costs that do not grow with the data).  Set BENCH_WARMUP=0 to skip.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(warm_dir):
        target = sf_dir
        sf_dir = warm_dir
        for fn in jobs.values():
            fn()
        sf_dir = target
    times = {}
    for name, fn in jobs.items():
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": int(cpus)}))
    spark.stop()


def _dirty_cycle(spark, sf_dir, make=dirty):
    d = make(spark, sf_dir)
    an = detect_anomalies(d, "dirty", order_by="row_key")
    an = an.cache()
    finder = CellFinder(d, an, "row_key")  # one set of finder statistics for both steps
    sink(find_cells(d, an, "row_key", finder=finder))
    sink(apply_decisions(d, an, decisions_by_rule(an), "row_key", finder=finder))


if __name__ == "__main__":
    main()
