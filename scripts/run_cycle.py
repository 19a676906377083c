"""End-to-end job: read a table, clean it, detect anomalies, apply reviewed decisions, write.

The reference runs this as one blocking worker job around a human review; here it
is two Spark jobs with the decision table between them.  This script plays both
halves, with the fixture's review rule standing in for the reviewer.

Usage: python scripts/run_cycle.py <input (csv/json/parquet)> <output dir> [order column] [format]
Without arguments it runs on the dirty customer view of /root/testdata/sf0.01 and
writes Parquet under the session's checkpoint folder.
"""

from __future__ import annotations

import json
import os
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def main():
    from cellwright.operators.apply import apply_decisions, decisions_by_rule
    from cellwright.operators.detect import detect_anomalies
    from cellwright.operators.transforms import run_chain
    from cellwright.plans.fixtures import dirty
    from cellwright.session import get_spark, scratch_path
    from cellwright.sources.io import read_table, write_table

    spark = get_spark()
    if len(sys.argv) > 2:
        src, out_dir = sys.argv[1], sys.argv[2]
        order = sys.argv[3] if len(sys.argv) > 3 else None
        fmt = sys.argv[4] if len(sys.argv) > 4 else "parquet"
        df = read_table(spark, src)
    else:
        df, out_dir, order, fmt = dirty(spark, "/root/testdata/sf0.01"), scratch_path(spark, "cycle"), "row_key", "parquet"

    # 1. transforms (job configuration as the reference's payload: type, columns, params)
    clean, results = run_chain(df, [{"type": "TRIM_WHITESPACE", "columns": [c for c, t in df.dtypes
                                                                             if t == "string" and c != "nombre"]}],
                               order_by=order)
    # 2. detection: a small table of anomaly records
    anomalies = detect_anomalies(clean, "cycle", order_by=order).cache()
    write_table(anomalies, os.path.join(out_dir, "anomalies"), "parquet")
    # 3. review (here: a fixed rule) and apply; rows are never dropped
    decisions = decisions_by_rule(anomalies)
    write_table(decisions, os.path.join(out_dir, "decisions"), "parquet")
    fixed = apply_decisions(clean, anomalies, decisions, order_by=order)
    written = write_table(fixed, os.path.join(out_dir, "output"), fmt)
    print(json.dumps({"steps": [r.type for r in results if r.success], "anomalies": anomalies.count(),
                      "rows_in": df.count(), "rows_out": spark.read.format(written).load(
                          os.path.join(out_dir, "output")).count() if written != "csv" else None,
                      "output": out_dir}))


if __name__ == "__main__":
    main()
