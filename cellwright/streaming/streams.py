"""Streaming operators (S1-S5) on Structured Streaming.

The reference has job events and a poll loop, not a dataflow engine; these are the
equivalent streaming jobs a Spark user runs:

* S1 latest status per dataset – streaming aggregate, update mode;
* S2 job event feed until terminal – micro-batches folded with windows over pieces of
  a job's time, and a state of two small fields per job, of which each batch writes the jobs it saw;
* S3 review gate – stream-stream left outer join with watermarks; anomalies with
  no decision inside the window come out as timed out;
* S4 row checks on a stream – stateless projection; the z-score rule reads a
  profile frozen from a batch read, carried as literals, or joins the newest version of a
  profile table that may change between triggers;
* S5 dedup on a stream – ``dropDuplicatesWithinWatermark``, or the first row of each run of
  rows of a key that follow each other within the delay (session windows);
* late rows are split off and counted instead of being dropped in silence.

``run_available_now`` drives a query over everything present in the source and
returns the sink table, which is how the tests and the registered queries use them.
Checkpoints go to the shared checkpoint folder, so a restarted query resumes.
``event_slices`` lets the table arrive in time slices, one trigger each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import count_if, ustrip
from ..session import scratch_path

# FIXED VALUES: job event names and the dataset status each one means.
EVENT_STATUS = {"active": "PROCESSING", "completed": "READY", "failed": "ERROR"}
TERMINAL_EVENTS = ("completed", "failed")


def _time_slices(ev: DataFrame, n: int) -> list[DataFrame]:
    """``ev`` in ``n`` slices of equal time spans, in order; rows without a time are in the first."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = ev.agg(F.min(us), F.max(us)).first()
    edges = [lo + (hi - lo) * i // n for i in range(1, n)] if lo is not None else []
    out = []
    for a, b in zip([None, *edges], [*edges, None]):
        cond = us.isNull() if a is None else us > F.lit(a)
        if b is not None:
            cond = us.isNull() | (us <= F.lit(b)) if a is None else cond & (us <= F.lit(b))
        elif a is None:
            cond = F.lit(True)
        out.append(ev.where(cond))
    return out


def event_slices(spark: SparkSession, sf_dir: str, n: int = 4,
                 held: str | None = None) -> tuple[str, T.StructType, list[Callable[[], None]]]:
    """Folder and schema of ``events`` as a file stream source, and its arrivals: each call has
    the executors append the next time slice, in as many files as they like.  A trigger after
    each call takes exactly one slice, so the micro-batches are in event-time order; only rows
    for which the condition ``held`` is true arrive one slice after their own."""
    path = scratch_path(spark, "events-stream")
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    ev.where(F.lit(False)).write.parquet(path)
    slices = _time_slices(ev, n)
    if held:
        late = F.coalesce(F.expr(held), F.lit(False))
        before = [None, *(d.where(late) for d in slices[:-1])]
        now = [*(d.where(~late) for d in slices[:-1]), slices[-1]]
        slices = [d if b is None else d.unionByName(b) for d, b in zip(now, before)]
    return path, ev.schema, [lambda d=d: d.write.mode("append").parquet(path) for d in slices]


def stage_events(spark: SparkSession, sf_dir: str, n_files: int = 8) -> tuple[str, T.StructType]:
    """Write ``events`` again as time slices, one append after the other: the file source
    takes files by modification time, so several micro-batches arrive in event-time order
    where a slice is one file."""
    path = scratch_path(spark, "events-stream")
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    for d in _time_slices(ev, n_files):
        d.write.mode("append").parquet(path)
    return path, ev.schema


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


@dataclass(frozen=True)
class PerBatch:
    """A stream of which ``run_available_now`` writes, per micro-batch, what ``step(rows, number,
    folder)`` makes of it.  ``folder`` is the step's own for what it carries to the next batch; a
    batch that is run again must start from the same carried rows, so a step keeps them by ``number``."""
    events: DataFrame
    step: Callable[[DataFrame, int, str], DataFrame]
    schema: T.StructType


def run_available_now(df: DataFrame | PerBatch, mode: str, arrivals: Iterable[Callable[[], None]] = ()) -> DataFrame:
    """Run a streaming query over all available input; returns what it wrote to the shared folder.

    With ``arrivals`` the query is run once after each of them, from the same checkpoint, so
    state and watermark go from one micro-batch to the next.  Executors write the result as
    Parquet.  ``append`` results go to Spark's file sink; ``complete`` and ``update`` results
    and those of a ``PerBatch`` are written per micro-batch, of which ``complete`` returns the
    last and the others all, ``update`` with their ``batch`` number.
    """
    per = df if isinstance(df, PerBatch) else None
    events = per.events if per else df
    spark = events.sparkSession
    out, folder = scratch_path(spark, "stream"), scratch_path(spark, "stream-carried")
    writer = events.writeStream.outputMode(mode).option("checkpointLocation", scratch_path(spark, "stream-state"))
    done: list[int] = []
    if mode == "append" and not per:
        writer = writer.format("parquet").option("path", out)
    else:
        def write(batch: DataFrame, number: int) -> None:
            if per:
                batch = per.step(batch, number, folder)
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            done.append(number)
        writer = writer.foreachBatch(write)
    for arrive in arrivals or [lambda: None]:
        arrive()
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception():
            raise RuntimeError(str(q.exception()))
    if mode == "append" and not per:
        return spark.read.schema(df.schema).parquet(out)
    if not done:
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{out}/batch={done[-1]}")
    found = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    return found.drop("batch") if per else found


# ------------------------------------------------------------------ job events
def job_events(events: DataFrame) -> DataFrame:
    """Job status events derived from the events stream: job = user, the event type
    says whether the job is active, completed or failed."""
    et = F.col("event_type")
    status = (F.when(et == "purchase", F.lit("completed")).when(et == "error", F.lit("failed"))
              .otherwise(F.lit("active")))
    return events.select(F.col("user_id").alias("job_id"), "ts", status.alias("event"), "event_id")


# ------------------------------------------------------------------ S1
def latest_status(job_ev: DataFrame) -> DataFrame:
    """The latest dataset status per job (streaming aggregate, update mode)."""
    mapping = F.create_map(*[x for k, v in EVENT_STATUS.items() for x in (F.lit(k), F.lit(v))])
    last = F.max_by(F.struct("event", "event_id"), F.struct("ts", "event_id"))
    return job_ev.groupBy("job_id").agg(last.alias("l"), F.max("ts").alias("updated_at"),
                                        F.count(F.lit(1)).alias("n_events")) \
        .select("job_id", F.element_at(mapping, F.col("l.event")).alias("status"), "updated_at", "n_events")


# ------------------------------------------------------------------ S2
FEED_STATE = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("last", T.StringType()),
                           T.StructField("done", T.BooleanType())])
#: Events in one piece of a micro-batch's time, about.
FEED_PIECE_ROWS = 200_000
#: The state of all jobs is put together once in so many micro-batches.
FEED_WHOLE_EVERY = 16


def feed_step(rows: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Status changes of one micro-batch, and the state (job, last status, ended) of its jobs after it.

    Time is cut into pieces of about as many events each, more of them for a larger batch.  Rows of a
    job are compared inside a piece; per job and piece one row, its last status and whether it ended,
    goes on, and a window over these rows, with the job's state before them, says what the first row
    of each piece follows.  So rows of a job with a large share of all events never meet in one task.
    """
    us = F.unix_micros("ts")
    n = rows.count()
    pieces = max(1, -(-n // FEED_PIECE_ROWS))
    cuts = rows.agg(F.percentile_approx(us, [i / pieces for i in range(1, pieces)], 10 * pieces)).first()[0] if pieces > 1 else None
    edges = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    # rows without a time come last, in a piece of their own
    piece = F.when(us.isNull(), pieces).otherwise(F.size(F.filter(edges, lambda x: x < us)))
    end = F.coalesce(F.col("event").isin(*TERMINAL_EVENTS), F.lit(False))

    order = [F.asc_nulls_last("ts"), F.col("event_id")]
    w = Window.partitionBy("job_id", "__piece").orderBy(*order)
    inside = (rows.withColumns({"__end": end, "__piece": piece})
              .withColumns({"__n": F.row_number().over(w), "__before": F.lag("event").over(w),
                            "__ended": F.coalesce(F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))}))
    # a later row with the status before it, or behind an end, is no change whatever came before the piece
    few = inside.where(~F.col("__ended") & ((F.col("__n") == 1) | ~F.col("event").eqNullSafe(F.col("__before"))))

    at = F.struct(F.col("ts").isNull(), "ts", "event_id")
    sums = rows.withColumns({"__end": end, "__piece": piece}).groupBy("job_id", "__piece").agg(
        F.max_by("event", at).alias("last"), F.max("__end").alias("done"))
    if state is not None:
        touched = rows.select(F.col("job_id").alias("__job")).distinct()
        mine = state.join(touched, F.col("job_id").eqNullSafe(F.col("__job")), "left_semi")
        sums = sums.unionByName(mine.select("job_id", F.lit(-1).alias("__piece"), "last", "done"))
    by_piece = Window.partitionBy("job_id").orderBy("__piece")
    carried = sums.select(
        F.col("job_id").alias("__job"), F.col("__piece").alias("__at"), F.lag("last").over(by_piece).alias("__last"),
        F.coalesce(F.max("done").over(by_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("__done"))
    found = few.join(carried, F.col("job_id").eqNullSafe(F.col("__job")) & (F.col("__piece") == F.col("__at"))) \
        .where(~F.col("__done") & ((F.col("__n") > 1) | ~F.col("event").eqNullSafe(F.col("__last")))).select(*rows.columns)
    return found, sums.groupBy("job_id").agg(F.max_by("last", "__piece").alias("last"), F.max("done").alias("done"))


def _newest_states(parts: DataFrame) -> DataFrame:
    return parts.groupBy("job_id").agg(F.max_by(F.struct("last", "done"), "batch").alias("s")).select("job_id", "s.last", "s.done")


def _feed_batch(rows: DataFrame, number: int, folder: str) -> DataFrame:
    """One micro-batch of the feed.  It writes the state of the jobs it saw; after every
    ``FEED_WHOLE_EVERY`` batches those states are put together, and later batches read on from there."""
    spark = rows.sparkSession
    schema = T.StructType([*FEED_STATE.fields, T.StructField("batch", T.IntegerType())])
    start = number - number % FEED_WHOLE_EVERY
    if number == start and number:
        old = number - FEED_WHOLE_EVERY
        parts = spark.read.schema(schema).parquet(f"{folder}/since={old}")
        _newest_states(parts).write.mode("overwrite").parquet(f"{folder}/since={start}/batch={start - 1}")
    before = _newest_states(spark.read.schema(schema).parquet(f"{folder}/since={start}").where(F.col("batch") < number)) \
        if number else None
    found, state = feed_step(rows, before)
    state.write.mode("overwrite").parquet(f"{folder}/since={start}/batch={number}")
    return found


def job_feed(job_ev: DataFrame) -> PerBatch:
    """Per job, the status changes in time order, nothing after completed / failed.

    Rows are put in time order inside a micro-batch; the micro-batches follow each other as they
    arrive.  No job is forgotten, as a later event of it would be taken for a change: the state
    is one short row per job, written only when the job has events.
    """
    ev = job_ev.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event")
    return PerBatch(ev, _feed_batch, ev.schema)


# ------------------------------------------------------------------ S3
def review_gate(raised: DataFrame, decided: DataFrame, wait_seconds: int = K.REVIEW_MAX_WAIT_SECONDS,
                lateness: str = "10 minutes") -> DataFrame:
    """S3: each raised anomaly paired with every decision on its key inside the wait
    window; an anomaly with none comes out once, with a null decision (timed out),
    when the watermark passes the end of its window."""
    a = raised.select(F.col("key").alias("a_key"), F.col("ts").cast("timestamp").alias("a_ts"),
                      F.col("id").alias("a_id")) \
        .withWatermark("a_ts", lateness)
    d = decided.select(F.col("key").alias("d_key"), F.col("ts").cast("timestamp").alias("d_ts"),
                       F.col("id").alias("d_id")) \
        .withWatermark("d_ts", lateness)
    cond = (F.col("a_key") == F.col("d_key")) & (F.col("d_ts") >= F.col("a_ts")) & \
           (F.col("d_ts") <= F.col("a_ts") + F.expr(f"INTERVAL {int(wait_seconds)} SECONDS"))
    return a.join(d, cond, "leftOuter").select(
        "a_id", "a_key", "a_ts", "d_id", "d_ts", F.col("d_id").isNull().alias("timed_out"))


# ------------------------------------------------------------------ S4
def frozen_profile(events_batch: DataFrame, column: str = "value") -> dict:
    """Mean, sample std and IQR fences (nearest-rank quartiles) of a column from a
    batch read, frozen for the stream: the z-score (D2) and IQR (D16) rules then
    run on each micro-batch as plain comparisons with literals."""
    from ..functions import quantiles as Q
    r = events_batch.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"),
                         F.count(column).alias("n")).collect()[0]
    prof = {"mean": r["m"], "std": r["s"], "lower": None, "upper": None}
    n = r["n"]
    if n and n >= 4:
        e = f"CAST(`{column}` AS DOUBLE)"
        qs = Q.kth_smallest(events_batch, [Q.Request("q1", e, Q.nearest_rank(n, 0.25), n),
                                           Q.Request("q3", e, Q.nearest_rank(n, 0.75), n)])
        iqr = qs["q3"] - qs["q1"]
        if iqr != 0:
            prof["lower"], prof["upper"] = qs["q1"] - K.IQR_FACTOR * iqr, qs["q3"] + K.IQR_FACTOR * iqr
    return prof


def row_checks(events: DataFrame, profile: dict) -> DataFrame:
    """Row-local detector rules per event plus the z-score and IQR rules against
    the frozen profile, carried as literals (no join at all)."""
    et = F.col("event_type")
    st = ustrip(et)
    v = F.col("value")
    z = (F.abs(v - F.lit(profile["mean"])) / F.lit(profile["std"]) > K.ZSCORE_LIMIT) if profile["std"] \
        else F.lit(False)
    iqr = ((v < F.lit(profile["lower"])) | (v > F.lit(profile["upper"]))) if profile["lower"] is not None \
        else F.lit(False)
    return events.select(
        "event_id", "ts",
        v.isNull().alias("missing_value"),
        ((F.year("ts") < K.DATE_MIN_YEAR) | (F.year("ts") > K.DATE_MAX_YEAR)).alias("date_outlier"),
        F.lower(st).isin(list(K.PLACEHOLDERS)).alias("placeholder"),
        ((et != st) & (F.length(st) > 0)).alias("padding"),
        (et.isNotNull() & (F.length(st) == 0)).alias("whitespace_only"),
        F.coalesce(z, F.lit(False)).alias("zscore_outlier"),
        F.coalesce(iqr, F.lit(False)).alias("iqr_outlier"),
    )


def write_profile(events_batch: DataFrame, path: str, version: int, column: str = "value") -> None:
    """Append a version of a column's profile (one row: mean, std, fences) to the profile table."""
    prof = frozen_profile(events_batch, column)
    row = [(column, *[prof[k] for k in ("mean", "std", "lower", "upper")], version)]
    events_batch.sparkSession.createDataFrame(row, PROFILE_SCHEMA).coalesce(1).write.mode("append").parquet(path)


PROFILE_SCHEMA = "profiled string, mean double, std double, lower double, upper double, version int"


def profiled_row_checks(events: DataFrame, profile_path: str, column: str = "value") -> PerBatch:
    """S4 with a stream-static join: the z-score and IQR rules per event against the newest version
    of the profile table at the start of its micro-batch; ``version`` says which one it was.

    The table is read anew for each micro-batch and has one row per profiled column and version, so
    its newest version is broadcast.  Without a version for the column no rule applies and ``version``
    is null.  A micro-batch that is run again after a new version came is checked against that one."""
    def step(rows: DataFrame, number: int, folder: str) -> DataFrame:
        table = rows.sparkSession.read.schema(PROFILE_SCHEMA).parquet(profile_path)
        newest = table.groupBy("profiled").agg(
            F.max_by(F.struct("mean", "std", "lower", "upper", "version"), "version").alias("p"))
        v = F.col(column)
        joined = rows.withColumn("profiled", F.lit(column)).join(F.broadcast(newest), "profiled", "left")
        z = (F.col("p.std") != 0) & (F.abs(v - F.col("p.mean")) / F.col("p.std") > K.ZSCORE_LIMIT)
        iqr = (v < F.col("p.lower")) | (v > F.col("p.upper"))
        return joined.select("event_id", "ts", F.coalesce(z, F.lit(False)).alias("zscore_outlier"),
                             F.coalesce(iqr, F.lit(False)).alias("iqr_outlier"), F.col("p.version").alias("version"))
    schema = T.StructType([events.schema["event_id"], events.schema["ts"], T.StructField("zscore_outlier", T.BooleanType()),
                           T.StructField("iqr_outlier", T.BooleanType()), T.StructField("version", T.IntegerType())])
    return PerBatch(events, step, schema)


ROW_CHECKS = ["missing_value", "date_outlier", "placeholder", "padding", "whitespace_only", "zscore_outlier",
              "iqr_outlier"]


def row_check_counts(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count(F.lit(1)).alias("rows"), *[count_if(F.col(c)).alias(c) for c in ROW_CHECKS])


# ------------------------------------------------------------------ S5
def stream_dedup(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Drop repeated keys while they are inside the watermark delay."""
    # event time must be a TIMESTAMP (session time zone) for a watermark
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) \
        .dropDuplicatesWithinWatermark(keys)


def stream_dedup_by_bucket(events: DataFrame, keys: list[str], bucket: str = "hour", delay: str = "1 hour") -> DataFrame:
    """S5, bucketed: one row per key and event-time bucket.  The bucket is part of the
    key and carries the watermark, so state for a bucket is dropped once the stream
    has moved ``delay`` past it; the set of surviving keys does not depend on how the
    rows were split into micro-batches."""
    b = F.date_trunc(bucket, F.col("ts").cast("timestamp")).alias("bucket")
    return events.select("*", b).withWatermark("bucket", delay).dropDuplicates(keys + ["bucket"])


def stream_dedup_by_gap(events: DataFrame, keys: list[str], delay: str = "1 hour", order: str = "event_id") -> DataFrame:
    """S5, chained: the first row (time, then ``order``) of every run of rows of a key in which each
    row follows the one before by at most ``delay``; ``n_rows`` counts the run.

    Runs are session windows, so they do not depend on how the rows were split into micro-batches,
    and a run comes out, and leaves the state, when the watermark has passed its end.  Rows whose
    run the watermark has passed are late and dropped; rows without a time too."""
    ts = F.col("ts")
    return events.where(ts.isNotNull()).withColumn("ts", ts.cast("timestamp")).withWatermark("ts", delay) \
        .groupBy(*keys, F.session_window("ts", delay)) \
        .agg(F.min(F.struct(ts, F.col(order))).alias("f"), F.count(F.lit(1)).alias("n_rows")) \
        .select(*keys, F.col("f.ts").alias("ts"), F.col(f"f.{order}").alias(order), "n_rows")


# ------------------------------------------------------------------ late rows
def mark_late(events: DataFrame, delay: str = "1 hour") -> PerBatch:
    """Every row with ``late``: whether its time is more than ``delay`` before the largest time of the
    micro-batches before its own (``arrived`` is its micro-batch), the rows that an operator with this
    watermark drops.  Carried is one time per micro-batch.  Rows without a time are not late."""
    seen = T.StructType([T.StructField("top", T.TimestampType()), T.StructField("batch", T.IntegerType())])

    def step(rows: DataFrame, number: int, folder: str) -> DataFrame:
        spark = rows.sparkSession
        top = spark.read.schema(seen).parquet(folder).where(F.col("batch") < number).agg(F.max("top")).first()[0] if number else None
        rows.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        late = F.col("ts") < F.lit(top) - F.expr(f"INTERVAL {delay}") if top else F.lit(False)
        return rows.withColumns({"late": F.coalesce(late, F.lit(False)), "arrived": F.lit(number)})
    ev = events.withColumn("ts", F.col("ts").cast("timestamp"))
    schema = T.StructType([*ev.schema.fields, T.StructField("late", T.BooleanType()), T.StructField("arrived", T.IntegerType())])
    return PerBatch(ev, step, schema)
