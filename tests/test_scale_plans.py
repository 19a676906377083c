"""Scale properties: hot keys give right answers, plans combine before shuffling,
nothing big runs in one task, filters reach the scan."""

import io
import contextlib

from pyspark.sql import functions as F

from cellwright.operators import transforms as TR
from cellwright.operators.cells import find_cells
from cellwright.operators.detect import detect_records
from cellwright.operators.ordered import fill_ordered
from cellwright.plans import review as RV

from conftest import SF01


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def hot_table(spark, n=30_000):
    """One key holds a third of all rows."""
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"),
        (F.col("id") * 7 % 1000).cast("double").alias("v"),
        F.when(F.col("id") % 3 == 0, F.lit("hot@x.co")).otherwise(F.concat(F.col("id").cast("string"), F.lit("@x.co")))
        .alias("email"))


def test_dedup_on_hot_key_is_right_and_pre_aggregated(spark):
    df = hot_table(spark)
    out, _, _ = TR.remove_duplicates(df, ["key"], keep="first", order_by="k")
    assert out.count() == 20_001
    assert out.where("key = 0").collect()[0]["k"] == 0
    p = plan(out)
    # a partial aggregate runs before the shuffle, so the hot key leaves each task as one row
    head = p.split("\n\n")[0]
    assert head.count("Aggregate") >= 2 and "Exchange" in head and "Window" not in head


def test_duplicate_finder_on_hot_value(spark):
    df = hot_table(spark)
    recs = detect_records(df, "hot", order_by="k", types=["DUPLICATE"])
    email = [r for r in recs if r["column"] == "email"]
    # 10,000 copies of one address: unique ratio 0.67 < 0.8, so no record (reference rule)
    assert not email
    recs = [{"anomaly_id": "x", "column": "email", "anomaly_type": "DUPLICATE", "original_value": None}]
    cells = find_cells(df, recs, "k")
    assert cells.count() == 9_999
    assert "Window" not in plan(cells).split("\n\n")[0]


def test_forward_fill_has_no_single_partition_window_on_data(spark):
    df = hot_table(spark).withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v")))
    out = fill_ordered(df, ["v"], "k", "forward", slices=16)
    # the only windows left run over one row per slice, by block
    assert "Window" not in plan(out).split("Scan parquet")[0] and "__block" in plan(out)
    assert out.where(F.col("v").isNull()).count() == 0


def test_pending_by_user_pre_aggregates_before_join(spark):
    ds = spark.range(100).select(F.col("id").alias("dataset_id"), (F.col("id") % 3).alias("user_id"))
    an = spark.range(60_000).select((F.col("id") % 100).alias("dataset_id"), F.lit("PENDING").alias("status"))
    out = RV.pending_anomalies_by_user(ds, an)
    assert sum(r["pending_reviews"] for r in out.collect()) == 60_000
    head = plan(out).split("\n\n")[0]
    join_at = head.find("Join")
    assert join_at > 0 and "Aggregate" in head[join_at:]


def test_filters_and_columns_reach_the_scan(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    out, _, _ = TR.filter_rows(li.select("l_orderkey", "l_quantity"), column="l_quantity", operator="gte", value=25)
    p = plan(out)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,25.0)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_order_dependent_ops_same_at_1_and_8_shuffle_partitions(spark):
    from cellwright.operators.apply import apply_decisions, decisions_by_rule
    from cellwright.operators.detect import detect_anomalies
    from cellwright.plans.fixtures import dirty
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            d = dirty(spark, SF01)
            fwd = TR.fill_nulls(d.select("row_key", "email", "saldo"), ["email", "saldo"], strategy="forward",
                                order_by="row_key")[0]
            first = TR.remove_duplicates(d.select("row_key", "pais", "segmento"), ["pais", "segmento"],
                                         keep="first", order_by="row_key")[0]
            an = detect_anomalies(d, "dirty", order_by="row_key")
            cells = find_cells(d, an, "row_key")
            applied = apply_decisions(d, an, decisions_by_rule(an), "row_key")
            results.append([sorted(map(tuple, x.collect()), key=str) for x in (fwd, first, cells, applied)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


def test_spread_deals_rows_of_one_task(spark):
    """Rows that a compact file keeps in one task are dealt over the cores; small tables stay as they are."""
    from cellwright.session import spread
    one = spark.range(0, 200_000, 1, 1).selectExpr("id AS k", "'v' || id % 7 AS v")
    out = spread(one)
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 100_000 and out.exceptAll(one).isEmpty() and out.count() == 200_000
    small = one.limit(1000)
    assert spread(small) is small


def test_order_statistics_compute_their_value_once(spark):
    """The expression of a request is in a projection of its own, not in every count and sketch."""
    from cellwright.functions import quantiles as Q
    seen = []
    real = Q._leaf_sketches
    Q._leaf_sketches = lambda df, *a: seen.append(df.columns) or real(df, *a)
    try:
        df = spark.range(5000).selectExpr("id * 3 AS a")
        reqs = [Q.Request(n, "CAST(regexp_extract('n' || a, 'n([0-9]+)', 1) AS BIGINT)", k, 5000) for n, k in (("x", 10), ("y", 4000))]
        assert Q.kth_smallest(df, reqs, exact_limit=100) == {"x": 30, "y": 12000}
    finally:
        Q._leaf_sketches = real
    assert seen and all(c == ["x0"] for c in seen)
