"""Registered queries: one per operator of the inventory, each over the given tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
match the oracle SQL of the same key (see ``oracles.py`` at the repository root).
Doubles that come out of an aggregate are rounded so both engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transforms as TR
from ..session import scratch_path, spread
from ..sources import io as IO
from .fixtures import DIRTY_ORDER, dirty, table

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: trim + lower the segment, keep non-negative balances, count per segment."""
    cust = _t(spark, sf_dir, "customer")
    out, _ = TR.run_chain(cust, [
        {"type": "TRIM_WHITESPACE", "columns": ["c_mktsegment"]},
        {"type": "LOWERCASE", "columns": ["c_mktsegment"]},
        {"type": "FILTER_ROWS", "params": {"column": "c_acctbal", "operator": "gte", "value": 0}},
    ])
    return out.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.round(F.sum("c_acctbal"), 2).alias("total_acctbal"))


# ---------------------------------------------------------------- sources (A)
CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
                  "c_acctbal": "double", "c_mktsegment": "string"}


@query("a1_csv_roundtrip")
def a1_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    IO.write_table(_t(spark, sf_dir, "customer"), path, "csv")
    back = IO.read_csv(spark, path)
    return back.select(*[F.col(c).cast(t).alias(c) for c, t in CUSTOMER_TYPES.items()])


@query("a2_json_roundtrip")
def a2_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "json")
    IO.write_table(_t(spark, sf_dir, "customer"), path, "json")
    back = IO.read_table(spark, path, "json")
    return back.select(*[F.col(c).cast(t).alias(c) for c, t in CUSTOMER_TYPES.items()])


@query("a1_csv_late_types")
def a1_csv_late_types(spark, sf_dir):
    """A number column whose only texts are in the last rows keeps them all."""
    o = _t(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderkey")).first()[0] or 0
    late = (o.orderBy("o_orderkey").select("o_orderkey", F.when(
        F.col("o_orderkey") > last - 40, F.concat(F.lit("late "), F.col("o_orderkey")))
        .otherwise(F.col("o_custkey").cast("string")).alias("code")))
    path = scratch_path(spark, "csv-late")
    IO.write_table(late, path, "csv")
    return IO.read_csv(spark, path).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
                                           F.col("code").cast("string").alias("code"))


@query("a1_csv_multiline")
def a1_csv_multiline(spark, sf_dir):
    """Cells with line breaks, quotes and separators come back as they were, read by splits."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('a "q", b\n'), "text").alias("cell"))
    path = scratch_path(spark, "csv-lines")
    IO.write_table(d, path, "csv")
    return IO.read_table(spark, path, "csv", schema="doc_id BIGINT, cell STRING")


@query("a1_csv_whole_texts")
def a1_csv_whole_texts(spark, sf_dir):
    """Every document comes back whole, with line breaks, quotes and separators deep in it, and null as null."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('a "q", b\n'), "text", F.lit('\n"z",')).alias("cell"))
    path = scratch_path(spark, "csv-texts")
    IO.write_table(d, path, "csv")
    return IO.read_table(spark, path, "csv", schema="doc_id BIGINT, cell STRING")


#: Rows of an array file, about: the files follow from the row count.
ARRAY_ROWS = 4_000


@query("a2_json_array")
def a2_json_array(spark, sf_dir):
    """One array of objects per file, read with the defaults."""
    path = scratch_path(spark, "json-array")
    c = _t(spark, sf_dir, "customer")
    files = c.count() // ARRAY_ROWS + 1
    (c.groupBy(F.expr(f"pmod(xxhash64({', '.join(CUSTOMER_TYPES)}), {files})").alias("part"))
     .agg(F.to_json(F.collect_list(F.struct(*[F.col(x) for x in CUSTOMER_TYPES]))).alias("value"))
     .write.partitionBy("part").text(path))
    back = IO.read_table(spark, path, "json")
    return back.select(*[F.col(x).cast(t).alias(x) for x, t in CUSTOMER_TYPES.items()])


@query("a5_detect_format")
def a5_detect_format(spark, sf_dir):
    """The customer table staged in three formats, each read by what its name tells."""
    base, out = scratch_path(spark, "formats"), None
    for name, fmt in (("t.csv", "csv"), ("t.JSON", "json"), ("t.pq", "parquet")):
        IO.write_table(_t(spark, sf_dir, "customer"), f"{base}/{name}", fmt)
        got = IO.read_table(spark, f"{base}/{name}").agg(
            F.lit(name).alias("name"), F.lit(IO.detect_format(name)).alias("format"), F.count("*").alias("n"),
            F.sum(F.col("c_custkey").cast("bigint")).alias("keys"))
        out = got if out is None else out.unionByName(got)
    return out


@query("a8_sample_size")
def a8_sample_size(spark, sf_dir):
    """A sample holds as many rows as asked for, all of the table, none twice, and is repeatable."""
    o = _t(spark, sf_dir, "orders")
    one, two = (IO.sample_rows(o, n=100, seed=7, key=["o_orderkey"]).select("o_orderkey") for _ in range(2))
    return (one.join(two, "o_orderkey").join(o.select("o_orderkey"), "o_orderkey")
            .agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_keys")))


@query("a3_read_parquet")
def a3_read_parquet(spark, sf_dir):
    return IO.read_table(spark, f"{sf_dir.rstrip('/')}/orders.parquet")


@query("a6_schema_report")
def a6_schema_report(spark, sf_dir):
    return IO.schema_report(_t(spark, sf_dir, "lineitem"))


@query("a7_table_stats")
def a7_table_stats(spark, sf_dir):
    return IO.table_stats(dirty(spark, sf_dir))


@query("a8_sample_rows")
def a8_sample_rows(spark, sf_dir):
    return IO.sample_rows(_t(spark, sf_dir, "orders"), n=100, seed=7, key=["o_orderkey"])


@query("a9_preview")
def a9_preview(spark, sf_dir):
    return IO.preview(_t(spark, sf_dir, "orders"), n=10, order_by=["o_orderkey"])


# ---------------------------------------------------------------- transforms (B)
def _step(df, cfg, order_by=None):
    out, _ = TR.apply_transform(df, cfg, order_by)
    return out


@query("b01_clean_nulls")
def b01(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "email", "telefono", "saldo")
    return _step(d, {"type": "CLEAN_NULLS", "columns": ["email", "telefono", "saldo"]})


@query("b02_fill_literal")
def b02(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "email", "saldo")
    d = _step(d, {"type": "FILL_NULLS", "columns": ["email"], "params": {"value": "sin-email"}})
    return _step(d, {"type": "FILL_NULLS", "columns": ["saldo"], "params": {"value": 0}})


@query("b03_fill_mean")
def b03(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "saldo", "puntaje")
    out = _step(d, {"type": "FILL_NULLS", "columns": ["saldo", "puntaje"], "params": {"strategy": "mean"}})
    return out.select("row_key", F.round("saldo", 4).alias("saldo"), "puntaje")


@query("b04_fill_median")
def b04(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "saldo")
    out = _step(d, {"type": "FILL_NULLS", "columns": ["saldo"], "params": {"strategy": "median"}})
    return out.select("row_key", F.round("saldo", 4).alias("saldo"))


@query("b05_fill_forward")
def b05(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "email", "saldo", "pedido")
    return _step(d, {"type": "FILL_NULLS", "columns": ["email", "saldo", "pedido"],
                     "params": {"strategy": "forward"}}, order_by=DIRTY_ORDER)


@query("b06_fill_backward")
def b06(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "email", "saldo", "pedido")
    return _step(d, {"type": "FILL_NULLS", "columns": ["email", "saldo", "pedido"],
                     "params": {"strategy": "backward"}}, order_by=DIRTY_ORDER)


@query("b05_date_key")
def b05_date_key(spark, sf_dir):
    """Daily totals, two days of three unknown, filled along the date."""
    d = _t(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("o_orderdate")).agg(F.count("*").alias("orders"), F.max("o_custkey").alias("top"))
    d = d.select("o_orderdate", F.when(F.col("top") % 3 == 0, F.col("orders")).alias("orders.known"))
    out = _step(d, {"type": "FILL_NULLS", "columns": ["orders.known"], "params": {"strategy": "forward"}}, order_by="o_orderdate")
    return out.select(F.col("o_orderdate").cast("string").alias("day"), F.col("`orders.known`").alias("orders"))


@query("b05_text_key")
def b05_text_key(spark, sf_dir):
    """Balances filled along a text key."""
    d = _t(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("/"), "c_custkey").alias("ref"),
                                             F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).alias("c_acctbal"))
    return _step(d, {"type": "FILL_NULLS", "columns": ["c_acctbal"], "params": {"strategy": "forward"}}, order_by="ref")


@query("b06_composite_key")
def b06_composite_key(spark, sf_dir):
    """Roles filled backward along conversation and turn."""
    d = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 5 == 1, F.col("role")).alias("role"))
    return _step(d, {"type": "FILL_NULLS", "columns": ["role"], "params": {"strategy": "backward"}}, order_by=["conv_id", "turn"])


@query("b07_trim_whitespace")
def b07(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "nombre", "direccion", "saldo")
    return _step(d, {"type": "TRIM_WHITESPACE"})


@query("b08_uppercase")
def b08(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "email", "nombre")
    return _step(d, {"type": "UPPERCASE", "columns": ["email", "nombre"]})


@query("b09_lowercase")
def b09(spark, sf_dir):
    return _step(_t(spark, sf_dir, "customer"), {"type": "LOWERCASE"})


@query("b10_dedup_keep_first")
def b10(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return _step(o, {"type": "REMOVE_DUPLICATES", "columns": ["o_custkey"], "params": {"keep": "first"}},
                 order_by="o_orderkey")


@query("b11_dedup_keep_last")
def b11(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return _step(o, {"type": "REMOVE_DUPLICATES", "columns": ["o_custkey", "o_orderstatus"],
                     "params": {"keep": "last"}}, order_by="o_orderkey")


@query("b12_dedup_keep_none")
def b12(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return _step(o, {"type": "REMOVE_DUPLICATES", "columns": ["o_custkey", "o_orderstatus"],
                     "params": {"keep": "none"}}, order_by="o_orderkey")


@query("b13_convert_type")
def b13(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    c = _step(c, {"type": "CONVERT_TYPE", "columns": ["c_acctbal"], "params": {"target_type": "int"}})
    return _step(c, {"type": "CONVERT_TYPE", "columns": ["c_nationkey"], "params": {"target_type": "str"}})


@query("b14_rename_column")
def b14(spark, sf_dir):
    return _step(_t(spark, sf_dir, "customer"), {"type": "RENAME_COLUMN",
                                                 "params": {"mapping": {"c_name": "name", "c_acctbal": "balance"}}})


@query("b15_drop_column")
def b15(spark, sf_dir):
    return _step(_t(spark, sf_dir, "customer"), {"type": "DROP_COLUMN", "columns": ["c_name", "c_mktsegment"]})


@query("b16_filter_compare")
def b16(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    li = _step(li, {"type": "FILTER_ROWS", "params": {"column": "l_quantity", "operator": "gte", "value": 25}})
    return _step(li, {"type": "FILTER_ROWS", "params": {"column": "l_returnflag", "operator": "ne", "value": "N"}})


@query("b17_filter_contains")
def b17(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return _step(c, {"type": "FILTER_ROWS", "params": {"column": "c_name", "operator": "contains",
                                                        "value": "#0+1[0-9]{2}$"}})


@query("b18_filter_null")
def b18(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "email", "telefono")
    return _step(d, {"type": "FILTER_ROWS", "params": {"column": "email", "operator": "is_null"}})


@query("b19_map_values")
def b19(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return _step(c, {"type": "MAP_VALUES", "columns": ["c_mktsegment"],
                     "params": {"mapping": {"BUILDING": "B", "AUTOMOBILE": "A"}, "default": "OTHER"}})


@query("b20_normalize_dates_format")
def b20(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "fecha_texto", "nota")
    return _step(d, {"type": "NORMALIZE_DATES", "columns": ["fecha_texto", "nota"], "params": {"format": "%d/%m/%Y"}})


@query("b21_normalize_dates_auto")
def b21(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "fecha_texto", "nombre",
                                    F.date_format("fecha_alta", "yyyyMMdd").alias("alta_compacta"))
    return _step(d, {"type": "NORMALIZE_DATES"})


@query("b22_validate_types")
def b22(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    _, res = TR.apply_transform(c, {"type": "VALIDATE_TYPES", "params": {"expected_types": {
        "c_custkey": "int", "c_name": "str", "c_acctbal": "float", "c_nationkey": "int64",
        "c_mktsegment": "int", "c_phone": "str"}}})
    return res.details["report"]


def _outliers(spark, sf_dir, method, action):
    d = dirty(spark, sf_dir).select("row_key", "saldo", "monto", "puntaje")
    return _step(d, {"type": "DETECT_OUTLIERS", "columns": ["saldo", "monto", "puntaje"],
                     "params": {"method": method, "action": action}})


@query("b23_outliers_iqr_flag")
def b23(spark, sf_dir):
    return _outliers(spark, sf_dir, "iqr", "flag")


@query("b24_outliers_zscore_flag")
def b24(spark, sf_dir):
    return _outliers(spark, sf_dir, "zscore", "flag")


@query("b25_outliers_iqr_remove")
def b25(spark, sf_dir):
    return _outliers(spark, sf_dir, "iqr", "remove").select("row_key")


@query("b26_outliers_zscore_remove")
def b26(spark, sf_dir):
    return _outliers(spark, sf_dir, "zscore", "remove").select("row_key")


@query("b27_label_encode")
def b27(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "segmento", "pais")
    return _step(d, {"type": "ENCODE_CATEGORICALS", "columns": ["segmento", "pais"], "params": {"encoding": "label"}})


@query("b28_onehot_encode")
def b28(spark, sf_dir):
    d = dirty(spark, sf_dir).select("row_key", "segmento")
    return _step(d, {"type": "ENCODE_CATEGORICALS", "columns": ["segmento"],
                     "params": {"encoding": "onehot", "drop_first": True}})


@query("b29_transform_chain")
def b29(spark, sf_dir):
    """A chain that stops at its failing step and keeps what came before."""
    d = dirty(spark, sf_dir).select("row_key", "telefono", "saldo", "email")
    out, results = TR.run_chain(d, [
        {"type": "TRIM_WHITESPACE", "columns": ["telefono"]},
        {"type": "FILL_NULLS", "columns": ["saldo"], "params": {"value": 0}},
        {"type": "FILTER_ROWS", "params": {"column": "saldo", "operator": "gte", "value": 100}},
        {"type": "CONVERT_TYPE", "columns": ["saldo"], "params": {"target_type": "no such type"}},
        {"type": "UPPERCASE", "columns": ["email"]},
    ])
    steps = ",".join(f"{r.type}:{'ok' if r.success else 'failed'}" for r in results)
    return out.select("*", F.lit(steps).alias("steps"))


# ---------------------------------------------------------------- detectors (D)
from ..operators.detect import detect_anomalies  # noqa: E402

NUMERIC_SUGGESTION = ("MISSING_VALUE", "OUTLIER", "OUTLIER_IQR")


def detector_view(anomalies: DataFrame) -> DataFrame:
    """Comparable projection of anomaly records: numeric suggestions as rounded doubles."""
    sv = F.col("suggested_value")
    num = F.round(sv.try_cast("double"), 4)
    numeric = F.col("anomaly_type").isin(list(NUMERIC_SUGGESTION)) & num.isNotNull()
    return anomalies.select(
        F.col("column").alias("column_name"), "anomaly_type", "affected", "original_value",
        F.when(~numeric | num.isNull(), sv).alias("suggested_value"),
        F.when(numeric, num).alias("suggested_num"), "related_column")


def _detect(atype):
    def run(spark, sf_dir):
        d = dirty(spark, sf_dir)
        return detector_view(detect_anomalies(d, "dirty", order_by=DIRTY_ORDER, types=[atype]))
    run.__name__ = f"detect_{atype.lower()}"
    return run


DETECTOR_QUERIES = {
    "d01_missing_value": "MISSING_VALUE", "d02_outlier_zscore_and_dates": "OUTLIER",
    "d03_duplicate": "DUPLICATE", "d04_format_invalid": "FORMAT_INVALID", "d06_inconsistent": "INCONSISTENT",
    "d08_whitespace_only": "WHITESPACE_ONLY", "d09_cross_field_swap": "CROSS_FIELD_SWAP",
    "d10_placeholder": "SUSPICIOUS_PLACEHOLDER", "d11_leading_trailing": "LEADING_TRAILING_WHITESPACE",
    "d12_date_logical": "DATE_LOGICAL", "d13_round_number": "NUMERIC_ROUND_NUMBER",
    "d14_low_variance": "LOW_VARIANCE", "d16_outlier_iqr": "OUTLIER_IQR", "d17_sequence_gap": "SEQUENCE_GAP",
}
for _name, _type in DETECTOR_QUERIES.items():
    QUERIES[_name] = _detect(_type)


@query("d00_all_anomalies")
def d00_all(spark, sf_dir):
    return detector_view(detect_anomalies(dirty(spark, sf_dir), "dirty", order_by=DIRTY_ORDER))


@query("d19_detect_orders")
def d19_orders(spark, sf_dir):
    """All detectors over a driver table as it is (orders, keyed by o_orderkey)."""
    return detector_view(detect_anomalies(_t(spark, sf_dir, "orders"), "orders", order_by="o_orderkey"))


# ---------------------------------------------------------------- correction language (I, F, C, O)
from .corrections import QUERIES as CORRECTION_QUERIES  # noqa: E402

QUERIES.update(CORRECTION_QUERIES)

# ---------------------------------------------------------------- cell finders (R) and apply (P)
from ..operators.apply import apply_decisions, decisions_by_rule  # noqa: E402
from ..operators.cells import find_cells  # noqa: E402


def _dirty_anomalies(spark, sf_dir):
    d = spread(dirty(spark, sf_dir))
    return d, detect_anomalies(d, "dirty", order_by=DIRTY_ORDER)


@query("r01_find_cells")
def r01_find_cells(spark, sf_dir):
    d, an = _dirty_anomalies(spark, sf_dir)
    return find_cells(d, an, DIRTY_ORDER).select(
        "row_key", F.col("column").alias("column_name"), "anomaly_type")


@query("p01_apply_decisions")
def p01_apply_decisions(spark, sf_dir):
    d, an = _dirty_anomalies(spark, sf_dir)
    out = apply_decisions(d, an, decisions_by_rule(an), DIRTY_ORDER)
    return out.select(*[F.col(c).cast("string").alias(c) for c in out.columns])


# ---------------------------------------------------------------- review analytics (M)
from . import review as RV  # noqa: E402
from .fixtures import review_anomalies, review_datasets, review_decisions, review_suggestions  # noqa: E402

AS_OF = "1998-06-15 00:00:00"


@query("m01_user_stats")
def m01(spark, sf_dir):
    return RV.user_stats(review_datasets(spark, sf_dir), review_anomalies(spark, sf_dir), AS_OF)


@query("m02_anomalies_with_decision")
def m02(spark, sf_dir):
    out = RV.anomalies_with_decision(review_anomalies(spark, sf_dir), review_decisions(spark, sf_dir))
    return out.select("anomaly_id", "dataset_id", "anomaly_type", "status", "created_at", "decision_action")


@query("m03_pending_by_user")
def m03(spark, sf_dir):
    return RV.pending_anomalies_by_user(review_datasets(spark, sf_dir), review_anomalies(spark, sf_dir))


@query("m04_pending_by_dataset")
def m04(spark, sf_dir):
    return RV.pending_by_dataset(review_anomalies(spark, sf_dir))


@query("m05_decisions_of_datasets")
def m05(spark, sf_dir):
    return RV.decisions_of_datasets(review_anomalies(spark, sf_dir), review_decisions(spark, sf_dir)) \
        .select("anomaly_id", "dataset_id", "action")


@query("m06_review_totals")
def m06(spark, sf_dir):
    return RV.review_report(review_anomalies(spark, sf_dir), review_decisions(spark, sf_dir))[0]


@query("m06_review_by_type")
def m06b(spark, sf_dir):
    return RV.review_report(review_anomalies(spark, sf_dir), review_decisions(spark, sf_dir))[1]


@query("m07_dataset_page")
def m07(spark, sf_dir):
    return RV.dataset_page(review_datasets(spark, sf_dir), limit=20, offset=20) \
        .select("dataset_id", "user_id", "status", "created_at")


def _status_updates(spark, sf_dir):
    dec = review_decisions(spark, sf_dir)
    first = dec.where("action = 'APPROVED'").select("anomaly_id", F.lit("IN_REVIEW").alias("status"),
                                                    F.col("created_at").alias("updated_at"))
    final = dec.select("anomaly_id", F.lit("RESOLVED").alias("status"),
                       (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    return first.unionByName(final)


@query("m08_upsert_latest")
def m08(spark, sf_dir):
    base = review_anomalies(spark, sf_dir).select("anomaly_id", "dataset_id", "anomaly_type", "status")
    return RV.upsert(base, _status_updates(spark, sf_dir), ["anomaly_id"], "updated_at", update_cols=["status"])


@query("m08_merge_bucketed")
def m08_merge(spark, sf_dir):
    """The status updates merged into a written table, the ones of a review first, then the final ones."""
    base = review_anomalies(spark, sf_dir).select("anomaly_id", "dataset_id", "anomaly_type", "status")
    path, keys = scratch_path(spark, "anomalies"), ["anomaly_id"]
    RV.write_bucketed(base, path, keys, 32)
    updates = _status_updates(spark, sf_dir)
    for status in ("IN_REVIEW", "RESOLVED"):
        RV.merge_bucketed(spark, path, base.schema, updates.where(F.col("status") == status), keys, "updated_at", 32, ["status"])
    return RV.read_bucketed(spark, path, base.schema)


def _decisions_with_foreign(spark, sf_dir):
    foreign = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(
        (-F.col("o_orderkey") - 1).alias("anomaly_id"),  # ids no line item has
        F.lit("APPROVED").alias("action"), F.col("o_orderdate").alias("created_at"))
    return review_decisions(spark, sf_dir).unionByName(foreign)


@query("m09_resolve_anomalies")
def m09(spark, sf_dir):
    out, _ = RV.resolve_anomalies(review_anomalies(spark, sf_dir), _decisions_with_foreign(spark, sf_dir))
    return out.select("anomaly_id", "status")


@query("m09_rejected_decisions")
def m09b(spark, sf_dir):
    _, rej = RV.resolve_anomalies(review_anomalies(spark, sf_dir), _decisions_with_foreign(spark, sf_dir))
    return rej


@query("m10_normalize_suggestions")
def m10(spark, sf_dir):
    return RV.normalize_suggestions(review_suggestions(spark, sf_dir))


@query("m11_read_suggestions")
def m11(spark, sf_dir):
    return RV.read_suggestions(RV.normalize_suggestions(review_suggestions(spark, sf_dir)))


@query("m12_column_evidence")
def m12(spark, sf_dir):
    d, an = _dirty_anomalies(spark, sf_dir)
    ev = RV.column_evidence(d, an, DIRTY_ORDER)
    return ev.select(F.col("column").alias("column_name"), "anomaly_type", "dtype", "affected",
                     F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "q05", "q95",
                     F.array_join(F.transform("outlier_values", lambda x: x.cast("string")), "|").alias("outliers"),
                     F.array_join("samples", "|").alias("samples"))


# ---------------------------------------------------------------- instructions (N)
from .instructions import parse_instructions  # noqa: E402

INSTRUCTION_SQL = """CASE event_id % 12
  WHEN 0 THEN 'null' WHEN 1 THEN '  ' || CAST(event_id % 100 AS STRING) || '.5 '
  WHEN 2 THEN '''sin dato ' || event_type || '''' WHEN 3 THEN 'usa la mediana'
  WHEN 4 THEN 'pon el promedio de ' || event_type WHEN 5 THEN 'Usa la MODA'
  WHEN 6 THEN 'con el mínimo' WHEN 7 THEN 'pon el MÁXIMO del grupo'
  WHEN 8 THEN 'elimina esta fila' WHEN 9 THEN 'mejor mantener el valor'
  WHEN 10 THEN CASE WHEN event_id % 24 = 10 THEN 'copia el dato de value' ELSE 'toma el dato del ' || event_type END
  ELSE 'si es mayor que 10 usa la media' END"""


@query("n01_parse_instructions")
def n01(spark, sf_dir):
    ev = table(spark, sf_dir, "events").selectExpr("event_id", f"{INSTRUCTION_SQL} AS instruction")
    out = parse_instructions(ev, "instruction", column_names=["event_id", "ts", "user_id", "event_type", "value",
                                                             "props"])
    return out.select("event_id", "op", "value_text", "value_num", "agg", "source_column", "source")


# ---------------------------------------------------------------- streaming (S)
from ..streaming import streams as ST  # noqa: E402


def _stream(spark, sf_dir, job, mode):
    """Result of a streaming job over the events, which arrive in time slices, one trigger each."""
    path, schema, arrivals = ST.event_slices(spark, sf_dir)
    return ST.run_available_now(job(ST.read_stream(spark, path, schema)), mode, arrivals)


@query("s01_latest_status")
def s01(spark, sf_dir):
    return _stream(spark, sf_dir, lambda ev: ST.latest_status(ST.job_events(ev)), "complete")


@query("s02_job_feed")
def s02(spark, sf_dir):
    out = _stream(spark, sf_dir, lambda ev: ST.job_feed(ST.job_events(ev)), "append")
    return out.select("job_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event")


@query("s03_review_gate")
def s03(spark, sf_dir):
    def gate(ev):
        raised, decided = (ev.where(F.col("event_type") == t).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
                           for t in ("error", "purchase"))
        return ST.review_gate(raised, decided)
    out = _stream(spark, sf_dir, gate, "append")
    return out.select("a_id", "a_key", F.col("a_ts").cast("timestamp_ntz").alias("a_ts"), "d_id",
                      F.col("d_ts").cast("timestamp_ntz").alias("d_ts"), "timed_out")


@query("s04_row_checks")
def s04(spark, sf_dir):
    prof = ST.frozen_profile(table(spark, sf_dir, "events"))
    return _stream(spark, sf_dir, lambda ev: ST.row_check_counts(ST.row_checks(ev, prof)), "complete")


@query("s04_profile_join")
def s04_profile_join(spark, sf_dir):
    """Checks against a profile table that has its first version before the stream starts, and gets
    its second, of all events, when half of the time slices have been checked."""
    ev, where = table(spark, sf_dir, "events"), scratch_path(spark, "profile")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = ev.agg(F.min(us), F.max(us)).first()
    ST.write_profile(ev.where(us <= F.lit(lo + (hi - lo) * 2 // 4)), where, 1)
    path, schema, arrivals = ST.event_slices(spark, sf_dir, 4)

    def third():
        ST.write_profile(ev, where, 2)
        arrivals[2]()
    out = ST.run_available_now(ST.profiled_row_checks(ST.read_stream(spark, path, schema), where), "append",
                               [*arrivals[:2], third, arrivals[3]])
    return out.select("event_id", "zscore_outlier", "iqr_outlier", F.col("version").cast("bigint").alias("version"))


@query("s05_stream_dedup")
def s05(spark, sf_dir):
    """The first event of each run of a user's events of one type, for the runs that have ended."""
    out = _stream(spark, sf_dir, lambda ev: ST.stream_dedup_by_gap(ev, ["user_id", "event_type"], "6 hours"), "append")
    return out.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "n_rows")


@query("s05_late_rows")
def s05_late(spark, sf_dir):
    """Rows and late rows by micro-batch and type, where every tenth event arrives one time slice after its own."""
    path, schema, arrivals = ST.event_slices(spark, sf_dir, 4, held="event_id % 10 = 0")
    out = ST.run_available_now(ST.mark_late(ST.read_stream(spark, path, schema), "1 hour"), "append", arrivals)
    return out.groupBy(F.col("arrived").cast("bigint").alias("arrived"), "event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("n_late"))


@query("s05_stream_dedup_hourly")
def s05b(spark, sf_dir):
    out = _stream(spark, sf_dir, lambda ev: ST.stream_dedup_by_bucket(ev, ["user_id", "event_type"]), "append")
    return out.select("user_id", "event_type", F.col("bucket").cast("timestamp_ntz").alias("bucket"))


def _detect_table(name, order):
    def run(spark, sf_dir):
        return detector_view(detect_anomalies(_t(spark, sf_dir, name), name, order_by=order))
    run.__name__ = f"detect_{name}"
    return run


# every detector over driver tables as they are
QUERIES["d20_detect_customer"] = _detect_table("customer", "c_custkey")
QUERIES["d21_detect_events"] = _detect_table("events", "event_id")
QUERIES["d22_detect_part"] = _detect_table("part", "p_partkey")


@query("d23_detect_dirty_lineitem")
def d23(spark, sf_dir):
    from .fixtures import dirty_lineitem
    return detector_view(detect_anomalies(dirty_lineitem(spark, sf_dir), "lineitem", order_by="row_key"))


def _dirty_lineitem_anomalies(spark, sf_dir):
    from .fixtures import dirty_lineitem
    d = spread(dirty_lineitem(spark, sf_dir))
    return d, detect_anomalies(d, "lineitem", order_by="row_key")


@query("r02_find_cells_dirty_lineitem")
def r02(spark, sf_dir):
    d, an = _dirty_lineitem_anomalies(spark, sf_dir)
    return find_cells(d, an, "row_key").select("row_key", F.col("column").alias("column_name"), "anomaly_type")


@query("p02_apply_decisions_dirty_lineitem")
def p02(spark, sf_dir):
    d, an = _dirty_lineitem_anomalies(spark, sf_dir)
    out = apply_decisions(d, an, decisions_by_rule(an), "row_key")
    return out.select(*[F.col(c).cast("string").alias(c) for c in out.columns])
QUERIES["d24_detect_documents"] = _detect_table("documents", "doc_id")
QUERIES["d25_detect_labels"] = _detect_table("labels", "doc_id")
QUERIES["d26_detect_conversations"] = _detect_table("conversations", ["conv_id", "turn"])
QUERIES["d27_detect_pages"] = _detect_table("pages", "page_id")
QUERIES["d28_detect_benchmark"] = _detect_table("benchmark", "item_id")


@query("d03_decimal_keys")
def d03_decimal_keys(spark, sf_dir):
    """Duplicates of keys that a double cannot tell apart."""
    from .fixtures import decimal_keys
    return detector_view(detect_anomalies(decimal_keys(spark, sf_dir), "orders", order_by="row_key", types=["DUPLICATE"]))


def _detect_faulty(name):
    def run(spark, sf_dir):
        from .fixtures import faulty
        return detector_view(detect_anomalies(faulty(spark, sf_dir, name), name, order_by="row_key"))
    run.__name__ = f"detect_faulty_{name}"
    return run


QUERIES["d29_faulty_part"] = _detect_faulty("part")
QUERIES["d30_faulty_conversations"] = _detect_faulty("conversations")
QUERIES["d31_faulty_pages"] = _detect_faulty("pages")
QUERIES["d32_faulty_benchmark"] = _detect_faulty("benchmark")


@query("b29_metrics")
def b29_metrics(spark, sf_dir):
    """What each step of a chain reports of its rows and nulls, measured in one job."""
    d = dirty(spark, sf_dir).select("row_key", "email", "saldo", "puntaje")
    _, res = TR.run_chain(d, [
        {"type": "CLEAN_NULLS", "columns": ["email"]}, {"type": "FILL_NULLS", "columns": ["saldo"], "params": {"value": 0.0}},
        {"type": "DETECT_OUTLIERS", "columns": ["puntaje"], "params": {"action": "remove"}}], order_by=DIRTY_ORDER, metrics=True)
    rows = [(i, r.type, r.rows_before, r.rows_after, *[next(iter(r.details.get(m, {}).values()), None) for m in (
        "null_counts_before", "null_counts_after", "outlier_counts")]) for i, r in enumerate(res)]
    return spark.createDataFrame(rows, "step bigint, type string, rows_before bigint, rows_after bigint, "
                                       "nulls_before bigint, nulls_after bigint, outliers bigint")
