"""Driver contract: entry point, query registry and oracle coverage."""

import __spark_entry__ as E

ROWS_ONLY = {"a8_sample_rows"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and set(df.columns) == {"c_mktsegment", "n_customers", "total_acctbal"}


def test_every_query_has_an_oracle_unless_declared(spark):
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    missing = {q for q in set(qs) - set(ors) if not q.startswith("op") and q != "pipeline"}
    assert missing <= ROWS_ONLY


def test_queries_run_on_smallest_tables(spark):
    qs = E.queries()
    for name in ("b05_fill_forward", "d00_all_anomalies", "m06_review_by_type", "n01_parse_instructions"):
        df = qs[name](spark, "/root/testdata/sf0.001")
        assert len(df.columns) > 1 and df.count() > 0
