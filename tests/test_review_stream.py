"""Review analytics, instruction rules and streaming operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellwright.plans import review as RV
from cellwright.plans.instructions import parse_instructions
from cellwright.streaming import streams as ST

from conftest import SF001


def test_user_stats_and_pending(spark):
    ds = spark.createDataFrame([
        (1, 10, "READY", dt.datetime(2024, 5, 1), dt.datetime(2024, 5, 1, 0, 0, 2)),
        (2, 10, "ERROR", dt.datetime(2024, 5, 20), None),
        (3, 10, "PENDING", dt.datetime(2024, 4, 1), None),
        (4, 11, "READY", dt.datetime(2024, 5, 2), None),
    ], "dataset_id long, user_id long, status string, created_at timestamp, processed_at timestamp")
    an = spark.createDataFrame([("a", 1, "PENDING"), ("b", 1, "RESOLVED"), ("c", 4, "PENDING"), ("d", 3, "PENDING")],
                               "anomaly_id string, dataset_id long, status string")
    st = {r["user_id"]: r for r in RV.user_stats(ds, an, "2024-05-15").collect()}
    u = st[10]
    assert (u["total_datasets"], u["datasets_this_month"], u["total_jobs"], u["jobs_completed"], u["jobs_failed"]) == \
        (3, 2, 2, 1, 1)
    assert u["avg_processing_time_ms"] == 2000 and u["pending_reviews"] == 2
    assert st[11]["avg_processing_time_ms"] == 0 and st[11]["pending_reviews"] == 1


def test_review_report_dominant_action(spark):
    an = spark.createDataFrame([
        ("a", 1, "OUTLIER", dt.datetime(2024, 1, 1)), ("b", 1, "OUTLIER", dt.datetime(2024, 1, 2)),
        ("c", 1, "DUPLICATE", dt.datetime(2024, 1, 3)), ("d", 1, "MISSING_VALUE", dt.datetime(2024, 1, 4))],
        "anomaly_id string, dataset_id long, anomaly_type string, created_at timestamp")
    dec = spark.createDataFrame([("a", "DISCARDED", dt.datetime(2024, 2, 1)), ("b", "APPROVED", dt.datetime(2024, 2, 1)),
                                 ("c", "CORRECTED", dt.datetime(2024, 2, 1))],
                                "anomaly_id string, action string, created_at timestamp")
    totals, by_type = RV.review_report(an, dec)
    t = totals.collect()[0]
    assert (t["total_anomalies"], t["approved"], t["corrected"], t["discarded"], t["pending"]) == (4, 1, 1, 1, 1)
    bt = {r["anomaly_type"]: (r["count"], r["action"]) for r in by_type.collect()}
    assert bt == {"OUTLIER": (2, "DISCARDED"), "DUPLICATE": (1, "CORRECTED"), "MISSING_VALUE": (1, "PENDING")}


def test_page_upsert_resolve(spark):
    ds = spark.range(30).select(F.col("id").alias("dataset_id"), (F.col("id") % 2).alias("user_id"),
                                F.timestamp_seconds(F.col("id")).alias("created_at"))
    page = [r["dataset_id"] for r in RV.dataset_page(ds, user_id=1, limit=500, offset=2).collect()]
    assert page == [25, 23, 21, 19, 17, 15, 13, 11, 9, 7, 5, 3, 1]
    assert RV.dataset_page(ds).count() == 20
    base = spark.createDataFrame([("a", "PENDING", "x"), ("b", "PENDING", "y")], "anomaly_id string, status string, s string")
    upd = spark.createDataFrame([("a", "RESOLVED", "z", 2), ("a", "PENDING", "w", 1), ("c", "RESOLVED", "q", 1)],
                                "anomaly_id string, status string, s string, updated_at int")
    out = {r["anomaly_id"]: r for r in RV.upsert(base, upd, ["anomaly_id"], "updated_at", ["status"]).collect()}
    assert out["a"]["status"] == "RESOLVED" and out["a"]["s"] == "x" and out["b"]["status"] == "PENDING"
    dec = spark.createDataFrame([("a",), ("zz",)], "anomaly_id string")
    res, rej = RV.resolve_anomalies(base.withColumn("dataset_id", F.lit(1)), dec)
    assert {r["anomaly_id"]: r["status"] for r in res.collect()} == {"a": "RESOLVED", "b": "PENDING"}
    assert [r[0] for r in rej.collect()] == ["zz"]


def test_suggestions_normalize_and_read(spark):
    df = spark.createDataFrame([
        ("1", '{"actionType": "FILL", "value": "3", "reason": "mean"}'), ("2", "just text"),
        ("3", '{"actionType": "BOOM"}'), ("", "x"), ("4", None), ("5", "y" * 150)], "anomaly_id string, suggestion string")
    norm = {r["anomaly_id"]: r["suggestion"] for r in RV.normalize_suggestions(df).collect()}
    assert set(norm) == {"1", "2", "3", "5"}
    assert norm["1"].startswith('{"actionType": "FILL"')
    assert norm["2"] == '{"actionType":"KEEP","value":null,"reason":"just text"}'
    assert len(norm["5"]) == len('{"actionType":"KEEP","value":null,"reason":""}') + 100
    read = {r["anomaly_id"]: r for r in RV.read_suggestions(RV.normalize_suggestions(df)).collect()}
    assert (read["1"]["ai_action_type"], read["1"]["ai_action_value"], read["1"]["ai_suggestion_text"]) == \
        ("FILL", "3", "mean")
    assert read["2"]["ai_action_type"] == "KEEP"


def test_column_evidence(spark):
    vals = [10.0] * 12 + [500.0]
    df = spark.createDataFrame([(i, v, f"s{i}") for i, v in enumerate(vals)], "k long, x double, s string")
    an = [{"anomaly_id": "o", "column": "x", "anomaly_type": "OUTLIER", "affected": 1},
          {"anomaly_id": "t", "column": "s", "anomaly_type": "DUPLICATE", "affected": 0}]
    ev = {r["anomaly_id"]: r for r in RV.column_evidence(df, an, "k").collect()}
    assert ev["o"]["outlier_values"] == [500.0] and ev["o"]["samples"] == ["10.0"] * 5
    # nearest rank: index round(12 * 0.95) = 11 of 13 values -> still 10.0
    assert ev["o"]["q05"] == 10.0 and ev["o"]["q95"] == 10.0
    assert ev["t"]["mean"] is None and ev["t"]["samples"] == ["s0", "s1", "s2", "s3", "s4"]


@pytest.mark.parametrize("text,op,extra", [
    ("null", "FILL_LITERAL", {}), ("  -12.5 ", "FILL_LITERAL", {"value_num": -12.5}),
    ('"hola"', "FILL_LITERAL", {"value_text": "hola"}), ("'x y'", "FILL_LITERAL", {"value_text": "x y"}),
    ("usa la mediana", "FILL_AGGREGATE", {"agg": "median"}), ("pon el promedio", "FILL_AGGREGATE", {"agg": "mean"}),
    ("Usa la MODA", "FILL_AGGREGATE", {"agg": "mode"}), ("con el mínimo", "FILL_AGGREGATE", {"agg": "min"}),
    ("pon el MÁXIMO", "FILL_AGGREGATE", {"agg": "max"}), ("elimina la fila", "DELETE_ROWS", {}),
    ("mejor mantener", "KEEP", {}), ("copia el valor de other", "FILL_FROM_COLUMN", {"source_column": "other"}),
    ("copia el valor de nada", None, {}), ("si es mayor usa la media", None, {}), ("haz magia", None, {}),
])
def test_instruction_rules(spark, text, op, extra):
    df = spark.createDataFrame([(text,)], "t string")
    r = parse_instructions(df, "t", ["value", "other"]).collect()[0]
    assert r["op"] == op
    assert r["source"] == ("rule" if op else "unresolved")
    for k, v in extra.items():
        assert r[k] == v


def test_streams_equal_batch(spark):
    path, schema = ST.stage_events(spark, SF001, n_files=4)
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    latest = {r["job_id"]: r["status"] for r in
              ST.run_available_now(ST.latest_status(ST.job_events(ST.read_stream(spark, path, schema))), "complete")
              .collect()}
    batch = {r["job_id"]: r["status"] for r in ST.latest_status(ST.job_events(ev)).collect()}
    assert latest == batch
    feed = ST.run_available_now(ST.job_feed(ST.job_events(ST.read_stream(spark, path, schema, 2))), "append")
    rows = feed.orderBy("job_id", "ts", "event_id").collect()
    per_job = {}
    for r in rows:
        per_job.setdefault(r["job_id"], []).append(r["event"])
    for events in per_job.values():
        assert all(a != b for a, b in zip(events, events[1:]))
        assert all(e not in ST.TERMINAL_EVENTS for e in events[:-1])
    prof = ST.frozen_profile(ev)
    counts = ST.run_available_now(ST.row_check_counts(ST.row_checks(ST.read_stream(spark, path, schema), prof)),
                                  "complete").collect()[0]
    assert counts["rows"] == ev.count()
    ded = ST.run_available_now(ST.stream_dedup(ST.read_stream(spark, path, schema), ["user_id", "event_type"]),
                               "append")
    assert 0 < ded.count() <= ev.count()


def test_latest_status_update_mode_changelog(spark):
    path, schema = ST.stage_events(spark, SF001, n_files=4)
    changes = ST.run_available_now(ST.latest_status(ST.job_events(ST.read_stream(spark, path, schema))), "update")
    final = RV.latest(changes, ["job_id"], "n_events")   # the newest row per job in the change log
    complete = ST.latest_status(ST.job_events(spark.read.parquet(f"{SF001}/events.parquet")))
    assert sorted(map(tuple, final.select("job_id", "status", "n_events").collect())) == \
        sorted(map(tuple, complete.select("job_id", "status", "n_events").collect()))


def test_instruction_to_correction_flow(spark):
    """Instruction text -> IR (rules) -> compiled column on the cells of one column."""
    import json
    from cellwright.operators.apply import apply_correction
    df = spark.createDataFrame([(0, 10.0, 1.0), (1, None, 2.0), (2, 30.0, 3.0)], "k long, value double, other double")
    texts = spark.createDataFrame([("usa la mediana",), ("  7.5 ",), ("copia el valor de other",), ("null",)], "t string")
    irs = [json.loads(r["ir"]) for r in parse_instructions(texts, "t", df.columns).collect()]
    expected = [[10.0, 20.0, 30.0], [10.0, 7.5, 30.0], [10.0, 2.0, 30.0], [10.0, None, 30.0]]
    for ir, want in zip(irs, expected):
        kind, out = apply_correction(df, "value", ir, F.col("value").isNull())
        assert kind == "FILL"
        assert [r["value"] for r in out.orderBy("k").collect()] == want


def _sliced(spark, tmp_path, rows, n):
    d = str(tmp_path / "t")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string") \
        .repartition(3).write.parquet(f"{d}/events.parquet")
    return ST.event_slices(spark, d, n)


def test_job_feed_over_slices(spark, tmp_path):
    """An ended job stays ended, and a status that goes on is no change, however long the silence."""
    day = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    rows = [(1, day[0], 1, "click"), (2, day[1], 1, "purchase"), (3, day[390], 1, "click"), (4, day[399], 1, "error"),
            (5, day[2], 2, "click"), (6, day[300], 2, "click"), (7, day[350], 2, "error"), (8, day[200], None, "click")]
    rows += [(100 + i, day[i], 3, "click") for i in range(300)] + [(1000, day[320], 3, "purchase"), (1001, day[321], 3, "click")]
    path, schema, arrivals = _sliced(spark, tmp_path, rows, 4)
    got = ST.run_available_now(ST.job_feed(ST.job_events(ST.read_stream(spark, path, schema))), "append", arrivals)
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 5, 7, 8, 100, 1000]


def test_stream_dedup_within_delay(spark, tmp_path):
    """A key is dropped while the watermark has not passed its first row by the delay, and comes again after it."""
    t = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    # slices end at hours 6, 12, 18; the last row of the first is at 5:30, so its watermark is 4:30
    rows = [(1, t(0), 9, "x"), (2, t(3, 20), 1, "x"), (3, t(5), 2, "x"), (4, t(5, 30), 3, "x"), (5, t(7), 1, "x"),
            (6, t(7), 2, "x"), (7, t(11), 4, "x"), (8, t(14), 2, "x"), (9, t(24), 5, "x")]
    path, schema, arrivals = _sliced(spark, tmp_path, rows, 4)
    got = ST.run_available_now(ST.stream_dedup(ST.read_stream(spark, path, schema), ["user_id", "event_type"]), "append", arrivals)
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_anomalies_with_decision_come_in_order_of_creation(spark):
    an = spark.createDataFrame([(i, 1, "X", "PENDING", (i * 37) % 50) for i in range(200)],
                               "anomaly_id long, dataset_id long, anomaly_type string, status string, created_at int").repartition(5)
    dec = spark.createDataFrame([(3, "APPROVED", 1), (3, "DISCARDED", 2)], "anomaly_id long, action string, created_at int")
    out = RV.anomalies_with_decision(an, dec).collect()
    assert [(r.created_at, r.anomaly_id) for r in out] == sorted((r.created_at, r.anomaly_id) for r in out) and len(out) == 200
    assert {r.anomaly_id: r.decision_action for r in out if r.decision_action} == {3: "DISCARDED"}


def _jobs(rows):
    """What a feed has to give: changes per job in (ts, event_id) order, nothing behind the first end."""
    want, last, done = [], {}, set()
    for eid, ts, job, event in sorted(rows, key=lambda r: (r[1] is None, r[1] or dt.datetime.min, r[0])):
        if job not in done and last.get(job) != event:
            want.append(eid)
        last[job] = event
        if event in ST.TERMINAL_EVENTS:
            done.add(job)
    return sorted(want)


@pytest.mark.parametrize("piece_rows", [7, 50, 10 ** 6])
def test_job_feed_step_over_pieces(spark, monkeypatch, piece_rows):
    """A job with most of the events, whose statuses alternate or repeat across the borders of the
    pieces, ties in time and rows without a time give what one pass over all rows gives."""
    import random
    monkeypatch.setattr(ST, "FEED_PIECE_ROWS", piece_rows)
    rnd = random.Random(piece_rows)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=rnd.randrange(150)) if rnd.random() < 0.97 else None,
             rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice(["active", "waiting", "waiting"])) for i in range(300)]
    rows += [(1000 + j, t0 + dt.timedelta(seconds=60 + j), j, "failed") for j in (2, 3)]
    schema = "event_id long, ts timestamp, job_id long, event string"
    first = [r for r in rows if r[1] is not None and r[1] < t0 + dt.timedelta(seconds=70)]
    rest = [r for r in rows if r not in first]
    a, state = ST.feed_step(spark.createDataFrame(first, schema), None)
    b, after = ST.feed_step(spark.createDataFrame(rest, schema), state)
    assert sorted(r["event_id"] for r in a.union(b).collect()) == _jobs(rows)
    assert {r["job_id"] for r in after.collect()} == {r[2] for r in rest}


def test_job_feed_writes_the_state_of_jobs_it_saw(spark, tmp_path, monkeypatch):
    """A batch's state has its own jobs only, and states put together every few batches lose none."""
    monkeypatch.setattr(ST, "FEED_WHOLE_EVERY", 2)
    folder, schema = str(tmp_path / "f"), "event_id long, ts timestamp, job_id long, event string"
    t = [dt.datetime(2024, 1, d) for d in range(1, 8)]
    batches = [[(1, t[0], 1, "active"), (2, t[0], 2, "active")], [(3, t[1], 1, "active")], [(4, t[2], 3, "active")],
               [(5, t[3], 2, "completed")], [(6, t[4], 2, "active"), (7, t[4], 1, "failed")], [(8, t[5], 3, "active")]]
    got = []
    for n, rows in enumerate(batches):
        run = [sorted(r["event_id"] for r in ST._feed_batch(spark.createDataFrame(rows, schema), n, folder).collect())
               for _ in range(2)]   # a batch that is run again
        assert run[0] == run[1]
        got.append(run[0])
        state = spark.read.parquet(f"{folder}/since={n - n % 2}/batch={n}")
        assert sorted(r["job_id"] for r in state.collect()) == sorted({r[2] for r in rows})
    assert got == [[1, 2], [], [4], [5], [7], []]


def test_dedup_by_gap_and_late_rows(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    rows = [(1, t(0), 1, "x"), (2, t(0, 40), 1, "x"), (3, t(1, 30), 1, "x"), (4, t(2, 30), 1, "x"), (11, t(3, 31), 1, "x"), (6, t(0), 1, "x"),
            (7, t(10), 2, "y"), (8, None, 2, "y"), (5, t(10), None, "y"), (9, t(24), 3, "x")]
    path, schema, arrivals = _sliced(spark, tmp_path, rows, 4)
    got = ST.run_available_now(ST.stream_dedup_by_gap(ST.read_stream(spark, path, schema), ["user_id", "event_type"]), "append", arrivals)
    # the run of key 1 is chained over 150 minutes; its row 61 minutes after the last starts a new one; key 3 has not ended
    assert sorted((r["event_id"], r["n_rows"]) for r in got.collect()) == [(1, 5), (5, 1), (7, 1), (11, 1)]

    d = str(tmp_path / "late")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{d}/events.parquet")
    path, schema, arrivals = ST.event_slices(spark, d, 4, held="event_id IN (2, 4, 9)")
    out = {r["event_id"]: (r["arrived"], r["late"]) for r in
           ST.run_available_now(ST.mark_late(ST.read_stream(spark, path, schema)), "append", arrivals).collect()}
    # rows 2 and 4 come with the second slice; the first had seen 3:31, so what is before 2:31 is late
    assert out[2] == (1, True) and out[4] == (1, True) and out[3] == (0, False) and out[8] == (0, False) and out[9] == (3, False)
    assert {e for e, (_, late) in out.items() if late} == {2, 4} and len(out) == len(rows)


def test_profile_join_takes_the_newest_version(spark, tmp_path):
    d, where = str(tmp_path / "t"), str(tmp_path / "profile")
    day = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    ev = spark.createDataFrame([(i, day[i], 10.0 + i % 3 if i != 25 else 500.0) for i in range(40)] + [(99, day[39], None)],
                               "event_id long, ts timestamp_ntz, value double")
    ev.write.parquet(f"{d}/events.parquet")
    path, schema, arrivals = ST.event_slices(spark, d, 2)
    wide = ev.select(F.lit(1e6).alias("value")).union(ev.select(F.lit(-1e6).alias("value")))

    def second():
        ST.write_profile(wide, where, 2)
        arrivals[1]()

    ST.write_profile(ev.where("event_id < 20"), where, 1)
    out = ST.run_available_now(ST.profiled_row_checks(ST.read_stream(spark, path, schema), where), "append", [arrivals[0], second])
    got = {r["event_id"]: (r["zscore_outlier"], r["iqr_outlier"], r["version"]) for r in out.collect()}
    assert got[0] == (False, False, 1) and got[25] == (False, False, 2) and got[99] == (False, False, 2) and len(got) == 41
    # the same row against the first version is an outlier by both rules
    path, schema, arrivals = ST.event_slices(spark, d, 1)
    where1 = str(tmp_path / "p1")
    ST.write_profile(ev.where("event_id < 20"), where1, 1)
    out = ST.run_available_now(ST.profiled_row_checks(ST.read_stream(spark, path, schema), where1), "append", arrivals)
    assert [r["event_id"] for r in out.where("zscore_outlier AND iqr_outlier").collect()] == [25]


def test_merge_touches_only_the_buckets_of_the_updates(spark, tmp_path):
    import glob
    path, keys = str(tmp_path / "m"), ["k"]
    base = spark.createDataFrame([(i, "PENDING", f"s{i}") for i in range(200)] + [(None, "PENDING", "none")], "k long, status string, s string")
    RV.write_bucketed(base, path, keys, 16)

    def files():
        return {f for f in glob.glob(f"{path}/{RV.BUCKET}=*/*.parquet")}
    before = files()
    upd = spark.createDataFrame([(3, "OLD", "x", 1), (3, "RESOLVED", "y", 2), (1000, "NEW", "z", 1)], "k long, status string, s string, at int")
    touched = RV.merge_bucketed(spark, path, base.schema, upd, keys, "at", 16, ["status"])
    assert 1 <= len(touched) <= 2
    changed = {f.split(f"{RV.BUCKET}=")[1].split("/")[0] for f in before ^ files()}
    assert changed == {str(b) for b in touched}
    got = {r["k"]: (r["status"], r["s"]) for r in RV.read_bucketed(spark, path, base.schema).collect()}
    want = {r["k"]: (r["status"], r["s"]) for r in RV.upsert(base, upd, keys, "at", ["status"]).collect()}
    assert got == want and got[3] == ("RESOLVED", "s3") and got[1000] == ("NEW", None) and len(got) == 202
    now = files()
    assert RV.merge_bucketed(spark, path, base.schema, upd.where("k < 0"), keys, "at", 16, ["status"]) == [] and files() == now
