"""Review and metadata analytics (M1-M12) as DataFrame plans.

The reference runs these as separate ORM queries and counts rows in loops; here each
is one aggregate or join plan.  Skew: a user or dataset holding a third of all
anomalies is a hot key only for hash aggregates, which combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import quantiles as Q
from ..functions.text import count_if, py_str
from ..functions.types import dtypes, is_numeric
from ..session import written
from .profile import order_column

PAGE_DEFAULT, PAGE_MAX = 20, 100
VALID_SUGGESTION_ACTIONS = ("FILL", "DELETE", "KEEP")


# ------------------------------------------------------------------ M1 + M3
def user_stats(datasets: DataFrame, anomalies: DataFrame, as_of) -> DataFrame:
    """Seven metrics per user: total, this month, not PENDING, READY, ERROR,
    mean processing time in ms over READY datasets with ``processed_at`` (0 if none,
    rounded half up), and PENDING anomalies on the user's datasets."""
    month_start = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    st = F.col("status")
    ready_done = (st == "READY") & F.col("processed_at").isNotNull()
    # wall-clock difference, independent of the session time zone for both timestamp kinds
    ms = F.expr("timestampdiff(MICROSECOND, created_at, processed_at)") / 1000.0
    per_user = datasets.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_datasets"),
        count_if(F.col("created_at") >= month_start).alias("datasets_this_month"),
        count_if(st != "PENDING").alias("total_jobs"),
        count_if(st == "READY").alias("jobs_completed"),
        count_if(st == "ERROR").alias("jobs_failed"),
        F.avg(F.when(ready_done, ms)).alias("__avg_ms"),
    )
    pending = pending_anomalies_by_user(datasets, anomalies)
    return (per_user.join(pending, "user_id", "left").select(
        "user_id", "total_datasets", "datasets_this_month", "total_jobs", "jobs_completed", "jobs_failed",
        F.coalesce(F.floor(F.col("__avg_ms") + 0.5), F.lit(0)).cast("bigint").alias("avg_processing_time_ms"),
        F.coalesce(F.col("pending_reviews"), F.lit(0)).cast("bigint").alias("pending_reviews")))


def pending_anomalies_by_user(datasets: DataFrame, anomalies: DataFrame) -> DataFrame:
    """M3: PENDING anomalies whose dataset belongs to the user.

    Pre-aggregated per dataset before the join, so the join side is one row per
    dataset whatever the anomaly volume."""
    per_ds = anomalies.where(F.col("status") == "PENDING").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return (per_ds.join(datasets.select("dataset_id", "user_id"), "dataset_id")
            .groupBy("user_id").agg(F.sum("n").alias("pending_reviews")))


# ------------------------------------------------------------------ M2, M4, M5
def anomalies_with_decision(anomalies: DataFrame, decisions: DataFrame) -> DataFrame:
    """M2: every anomaly with its decision if any (left outer join, one decision per anomaly), in
    ascending order of creation (a range sort; ties by id)."""
    d = latest(decisions, ["anomaly_id"], "created_at")
    return anomalies.join(d.select("anomaly_id", F.col("action").alias("decision_action"),
                                   F.col("created_at").alias("decided_at")), "anomaly_id", "left") \
        .orderBy("created_at", "anomaly_id")


def pending_by_dataset(anomalies: DataFrame) -> DataFrame:
    """M4: PENDING anomaly count per dataset."""
    return anomalies.where(F.col("status") == "PENDING").groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("pending"))


def decisions_of_datasets(anomalies: DataFrame, decisions: DataFrame) -> DataFrame:
    """M5: decisions joined to their anomaly's dataset (inner join)."""
    return decisions.join(anomalies.select("anomaly_id", "dataset_id"), "anomaly_id")


# ------------------------------------------------------------------ M6
def review_report(anomalies: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: (totals per dataset, summary per dataset and type).

    The dominant action of a type is its most frequent decided action; a tie goes
    to the action seen first in anomaly creation order; no decisions -> PENDING.
    """
    joined = anomalies_with_decision(anomalies, decisions)
    act = F.col("decision_action")
    totals = joined.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        count_if(act == "APPROVED").alias("approved"),
        count_if(act == "CORRECTED").alias("corrected"),
        count_if(act == "DISCARDED").alias("discarded"),
        count_if(act.isNull() | ~act.isin(*K.ACTIONS)).alias("pending"))
    per_action = (joined.where(act.isin(*K.ACTIONS))
                  .groupBy("dataset_id", "anomaly_type", "decision_action")
                  .agg(F.count(F.lit(1)).alias("n"),
                       F.min(F.struct("created_at", "anomaly_id")).alias("first_seen")))
    # most frequent first; a tie goes to the action seen first (creation time, then id)
    dominant = per_action.groupBy("dataset_id", "anomaly_type").agg(
        F.min_by("decision_action", F.struct((-F.col("n")).alias("nn"), F.col("first_seen").alias("fs")))
        .alias("dominant"))
    counts = joined.groupBy("dataset_id", "anomaly_type").agg(F.count(F.lit(1)).alias("count"))
    by_type = counts.join(dominant, ["dataset_id", "anomaly_type"], "left").select(
        "dataset_id", "anomaly_type", "count", F.coalesce("dominant", F.lit("PENDING")).alias("action"))
    return totals, by_type


# ------------------------------------------------------------------ M7
def dataset_page(datasets: DataFrame, user_id=None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """M7: newest first, id as tie-break; limit defaults to 20 and is capped at 100."""
    limit = PAGE_DEFAULT if not limit else min(int(limit), PAGE_MAX)
    df = datasets if user_id is None else datasets.where(F.col("user_id") == F.lit(user_id))
    return df.orderBy(F.col("created_at").desc(), F.col("dataset_id").desc()).offset(int(offset)).limit(limit)


# ------------------------------------------------------------------ M8
def latest(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """One row per key, the row with the greatest ``ts`` (ties: largest row content).

    A ``max_by`` hash aggregate rather than a ``row_number`` window, so a hot key is
    collapsed on the map side."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.dropDuplicates(keys)
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.max_by(row, F.struct(F.col(f"`{ts}`"), row)).alias("__r")).select(
        *[F.col(f"`{k}`") for k in keys], *[F.col("__r")[c].alias(c) for c in others])


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], ts: str,
           update_cols: list[str] | None = None) -> DataFrame:
    """Later write wins per key.  With ``update_cols`` an existing row keeps its other
    columns and takes only those from its latest update (the anomaly update rule)."""
    upd = latest(updates, keys, ts)
    if update_cols is None:
        return latest(base.unionByName(upd, allowMissingColumns=True), keys, ts)
    u = upd.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`").alias(f"__u_{c}") for c in update_cols],
                   F.lit(True).alias("__hit"))
    merged = base.join(u, keys, "full")
    out = []
    for c in base.columns:
        q = F.col(f"`{c}`")
        if c in keys:
            out.append(q)
        elif c in update_cols:
            out.append(F.when(F.col("__hit"), F.col(f"`__u_{c}`")).otherwise(q).alias(c))
        else:
            out.append(q)
    return merged.select(*out)


#: Name of the partition column of a bucketed table.
BUCKET = "__bucket"


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write ``df`` as Parquet with one folder per bucket, a hash of the keys; ``merge_bucketed``
    must be given the same keys and number of buckets."""
    df.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_bucketed(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(f"{_ddl(schema)}, {BUCKET} int").parquet(path).drop(BUCKET)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def merge_bucketed(spark, path: str, schema, updates: DataFrame, keys: list[str], ts: str, buckets: int,
                   update_cols: list[str] | None = None) -> list[int]:
    """M8 on a written table: ``upsert`` of the updates into the buckets that they touch, which are
    the only ones read and written again; the files of the others stay as they are.  Returns the
    touched buckets.

    The merged buckets are first written to the shared folder and then put in place of the old ones
    with dynamic partition overwrite, so that no task reads what another replaces.  Nothing else may
    write the table meanwhile.  Null keys never match (as in ``upsert``); without updates nothing
    is written."""
    upd = written(updates.withColumn(BUCKET, _bucket(keys, buckets)), "merge-updates")
    touched = sorted(r[0] for r in upd.select(BUCKET).distinct().collect())   # at most ``buckets`` numbers
    if not touched:
        return []
    base = spark.read.schema(f"{_ddl(schema)}, {BUCKET} int").parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    merged = upsert(base, upd.drop(BUCKET), keys, ts, update_cols).select(*[F.col(f"`{f.name}`") for f in schema.fields])
    merged = written(merged.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET), "merge")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched


# ------------------------------------------------------------------ M9
def resolve_anomalies(anomalies: DataFrame, decisions: DataFrame, dataset_id=None):
    """M9: anomalies with a decision become RESOLVED.

    Returns (anomalies, rejected) where ``rejected`` lists decision ids that point to
    an unknown anomaly or to another dataset (left anti join)."""
    scope = anomalies if dataset_id is None else anomalies.where(F.col("dataset_id") == F.lit(dataset_id))
    ids = scope.select("anomaly_id")
    rejected = decisions.select("anomaly_id").join(ids, "anomaly_id", "left_anti").distinct()
    decided = decisions.select("anomaly_id").join(ids, "anomaly_id", "left_semi").distinct() \
        .withColumn("__decided", F.lit(True))
    out = anomalies.join(decided, "anomaly_id", "left").withColumn(
        "status", F.when(F.col("__decided"), F.lit("RESOLVED")).otherwise(F.col("status"))).drop("__decided")
    return out.select(*anomalies.columns), rejected


# ------------------------------------------------------------------ M10, M11
SUGGESTION_SCHEMA = T.StructType([
    T.StructField("actionType", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("reason", T.StringType())])


def _is_json_object(text: Column) -> Column:
    return F.get_json_object(text, "$").isNotNull() & F.ltrim(text).startswith("{")


def normalize_suggestions(df: DataFrame, id_col: str = "anomaly_id", text_col: str = "suggestion") -> DataFrame:
    """Valid JSON objects with actionType FILL/DELETE/KEEP are kept as sent; any
    other text is wrapped as ``{"actionType":"KEEP","value":null,"reason":<first 100 chars>}``.
    Rows with an empty id or text are skipped."""
    t = F.col(text_col)
    action = F.get_json_object(t, "$.actionType")
    ok = _is_json_object(t) & action.isin(*VALID_SUGGESTION_ACTIONS)
    wrapped = F.to_json(F.struct(F.lit("KEEP").alias("actionType"), F.lit(None).cast("string").alias("value"),
                                 F.substring(t, 1, 100).alias("reason")), {"ignoreNullFields": "false"})
    keep = (F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "") & t.isNotNull() & (t != ""))
    return df.where(keep).select(F.col(id_col).alias("anomaly_id"),
                                 F.when(ok, t).otherwise(wrapped).alias("suggestion"))


def read_suggestions(df: DataFrame, text_col: str = "suggestion") -> DataFrame:
    """actionType, value and reason from stored JSON; free text falls through as text."""
    t = F.col(text_col)
    is_obj = _is_json_object(t)
    return df.select(
        "*",
        F.when(is_obj, F.get_json_object(t, "$.actionType")).alias("ai_action_type"),
        F.when(is_obj, F.get_json_object(t, "$.value")).alias("ai_action_value"),
        F.when(is_obj, F.coalesce(F.get_json_object(t, "$.reason"), t)).otherwise(t).alias("ai_suggestion_text"))


# ------------------------------------------------------------------ M12
def column_evidence(df: DataFrame, anomalies, order_by, n_outliers: int = 10, n_samples: int = 5) -> DataFrame:
    """Per anomaly record, the column's statistics and a few example values.

    Mean, sample std and nearest-rank q05/q95 for numeric columns with at least two
    values; the first ``n_outliers`` z > 3 values for OUTLIER records; the first
    ``n_samples`` non-null values.  Examples come from per-column TakeOrdered plans,
    so no step holds more than ``n`` rows per column."""
    spark = df.sparkSession
    recs = [a if isinstance(a, dict) else a.asDict() for a in
            (anomalies.collect() if isinstance(anomalies, DataFrame) else anomalies)]
    types = dtypes(df)
    cols = sorted({a["column"] for a in recs if a["column"] in types})
    num = [c for c in cols if is_numeric(types[c])]
    stats = {}
    if num:
        row = df.agg(*[x for i, c in enumerate(num) for x in (
            F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"),
            F.stddev_samp(F.col(f"`{c}`").cast("double")).alias(f"s{i}"))]).collect()[0]
        reqs = []
        for i, c in enumerate(num):
            n = row[f"n{i}"]
            stats[c] = {"n": n, "mean": row[f"m{i}"], "std": row[f"s{i}"]}
            if n >= 2:
                e = f"CAST(`{c}` AS DOUBLE)"
                reqs += [Q.Request(f"{c}|q05", e, Q.nearest_rank(n, 0.05), n),
                         Q.Request(f"{c}|q95", e, Q.nearest_rank(n, 0.95), n)]
        qs = Q.kth_smallest(df, reqs) if reqs else {}
        for c in num:
            stats[c]["q05"], stats[c]["q95"] = qs.get(f"{c}|q05"), qs.get(f"{c}|q95")
    o = order_column(order_by)
    parts = []
    for c in cols:
        x = F.col(f"`{c}`")
        parts.append(df.where(x.isNotNull()).select(F.lit(c).alias("column"), F.lit("sample").alias("kind"),
                                                    o.alias("__o"), py_str(x, types[c]).alias("v"))
                     .orderBy("__o").limit(n_samples))
        s = stats.get(c)
        if s and s["n"] >= 2 and s["std"] and s["std"] > 0:
            d = x.cast("double")
            hit = F.abs(d - F.lit(s["mean"])) / F.lit(s["std"]) > K.ZSCORE_LIMIT
            parts.append(df.where(hit).select(F.lit(c).alias("column"), F.lit("outlier").alias("kind"),
                                              o.alias("__o"), d.cast("string").alias("v"))
                         .orderBy("__o").limit(n_outliers))
    ex: dict = {}
    if parts:
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        for r in u.groupBy("column", "kind").agg(
                F.sort_array(F.collect_list(F.struct("__o", "v"))).alias("l")).collect():
            ex[(r["column"], r["kind"])] = [e["v"] for e in r["l"]]
    rows = []
    for a in recs:
        c = a["column"]
        if c not in types:
            continue
        s = stats.get(c) if stats.get(c) and stats[c]["n"] >= 2 else None
        outl = ex.get((c, "outlier")) if a["anomaly_type"] == "OUTLIER" and s else None
        rows.append((a["anomaly_id"], c, types[c].simpleString(), a["anomaly_type"], int(a["affected"]),
                     s["mean"] if s else None, s["std"] if s else None, s["q05"] if s else None,
                     s["q95"] if s else None, [float(v) for v in outl] if outl else None,
                     ex.get((c, "sample"), [])))
    schema = ("anomaly_id string, column string, dtype string, anomaly_type string, affected bigint, "
              "mean double, std double, q05 double, q95 double, outlier_values array<double>, "
              "samples array<string>")
    return spark.createDataFrame(rows, schema)
