"""Detectors, cell finders and decision apply: reference cases plus invariants."""

import pytest
from pyspark.sql import functions as F

from cellwright import constants as K
from cellwright.operators.apply import apply_decisions, decisions_by_rule
from cellwright.operators.cells import find_cells
from cellwright.operators.detect import detect_anomalies, detect_records
from cellwright.plans.fixtures import dirty

from conftest import SF01


def recs_by(recs):
    return {(r["column"], r["anomaly_type"]): r for r in recs}


def test_outlier_csv_case(spark):
    """20 ages near 30 and one 9999 -> OUTLIER on age suggesting the mean; no z for name."""
    ages = [28, 29, 30, 31, 32, 30, 29, 31, 30, 28, 32, 30, 29, 31, 30, 28, 32, 30, 29, 31, 9999]
    df = spark.createDataFrame([(i, f"P{i}", a) for i, a in enumerate(ages)], "k long, name string, age bigint")
    r = recs_by(detect_records(df, "ds", order_by="k"))
    out = r[("age", "OUTLIER")]
    assert out["affected"] == 1
    assert float(out["suggested_value"]) == pytest.approx(sum(ages) / len(ages))


def test_missing_and_clean_cases(spark):
    df = spark.createDataFrame([(0, "A", 30), (1, None, 25), (2, "C", None)], "k long, name string, age bigint")
    r = recs_by(detect_records(df, "ds", order_by="k"))
    assert r[("name", "MISSING_VALUE")]["affected"] == 1 and r[("name", "MISSING_VALUE")]["suggested_value"] == "A"
    assert r[("age", "MISSING_VALUE")]["suggested_value"] == "27.5"
    clean = spark.createDataFrame([(0, "A", 30), (1, "B", 25), (2, "C", 35)], "k long, name string, age bigint")
    assert detect_records(clean, "ds", order_by="k") == []


def test_phone_and_address_missing_have_no_suggestion(spark):
    df = spark.createDataFrame([(0, None, None), (1, "300-1234567", "Calle 1")], "k long, telefono string, direccion string")
    r = recs_by(detect_records(df, "ds", order_by="k"))
    assert r[("telefono", "MISSING_VALUE")]["suggested_value"] is None
    assert r[("direccion", "MISSING_VALUE")]["suggested_value"] is None


@pytest.fixture(scope="module")
def dirty_run(spark):
    d = dirty(spark, SF01)
    return d, detect_records(d, "dirty", order_by="row_key")


def test_dirty_fixture_counts(dirty_run):
    """The planted counts of FIXTURES §3 at sf0.01."""
    _, recs = dirty_run
    r = recs_by(recs)
    expect = {("client_code", "SEQUENCE_GAP"): 16, ("pedido", "SEQUENCE_GAP"): 15, ("nombre", "CROSS_FIELD_SWAP"): 29,
              ("nombre", "LEADING_TRAILING_WHITESPACE"): 36, ("nombre", "WHITESPACE_ONLY"): 22,
              ("email", "MISSING_VALUE"): 52, ("email", "FORMAT_INVALID"): 39, ("email", "DUPLICATE"): 82,
              ("telefono", "MISSING_VALUE"): 35, ("telefono", "FORMAT_INVALID"): 57,
              ("direccion", "SUSPICIOUS_PLACEHOLDER"): 25, ("segmento", "INCONSISTENT"): 10,
              ("saldo", "OUTLIER"): 14, ("puntaje", "OUTLIER_IQR"): 150, ("fecha_nacimiento", "OUTLIER"): 19,
              ("fecha_nacimiento", "DATE_LOGICAL"): 18, ("tasa", "LOW_VARIANCE"): 1500, ("pais", "LOW_VARIANCE"): 1500}
    for key, n in expect.items():
        assert r[key]["affected"] == n, key
    assert r[("monto", "NUMERIC_ROUND_NUMBER")]["affected"] / 1500 > 0.4
    assert r[("fecha_nacimiento", "DATE_LOGICAL")]["related_column"] == "fecha_alta"
    assert ("saldo", "OUTLIER_IQR") not in r  # skipped: already an OUTLIER column


def test_ids_are_deterministic(dirty_run):
    _, recs = dirty_run
    ids = [r["anomaly_id"] for r in recs]
    assert len(set(ids)) == len(ids)
    from cellwright.operators.detect import anomaly_id
    r = recs_by(recs)[("email", "DUPLICATE")]
    assert r["anomaly_id"] == anomaly_id("dirty", "email", "DUPLICATE", None)


def test_same_result_at_one_and_many_partitions(spark, dirty_run):
    d, recs = dirty_run
    base = {(r["column"], r["anomaly_type"], r["affected"], r["original_value"]) for r in recs}
    one = d.repartition(1)
    many = d.repartition(7, "pais")
    for df in (one, many):
        got = {(r["column"], r["anomaly_type"], r["affected"], r["original_value"])
               for r in detect_records(df, "dirty", order_by="row_key")}
        assert got == base


def test_finders_agree_with_detectors_where_rules_match(spark, dirty_run):
    d, recs = dirty_run
    cells = find_cells(d, recs, "row_key").groupBy("column", "anomaly_type").count().collect()
    got = {(r["column"], r["anomaly_type"]): r["count"] for r in cells}
    for r in recs:
        key = (r["column"], r["anomaly_type"])
        if r["anomaly_type"] in ("MISSING_VALUE", "FORMAT_INVALID", "DUPLICATE", "OUTLIER", "OUTLIER_IQR",
                                 "LEADING_TRAILING_WHITESPACE", "SEQUENCE_GAP", "DATE_LOGICAL") \
                and not (r["anomaly_type"] == "SEQUENCE_GAP" and r["column"] == "pedido"):
            assert got.get(key, 0) == r["affected"], key


def test_duplicate_finder_marks_later_occurrences(spark):
    vals = ["a@x.co", "A@x.co ", "b@x.co", "c@x.co", "d@x.co", "e@x.co", "f@x.co", "g@x.co", "h@x.co", "a@x.co", None]
    df = spark.createDataFrame(list(enumerate(vals)), "k long, email string")
    recs = detect_records(df, "ds", order_by="k", types=["DUPLICATE"])
    assert recs and recs[0]["affected"] == 2
    cells = [r["row_key"] for r in find_cells(df, recs, "k").collect()]
    assert sorted(cells) == [1, 9]


def test_apply_keeps_every_row_and_is_one_projection(spark, dirty_run):
    d, recs = dirty_run
    an = detect_anomalies(d, "dirty", order_by="row_key")
    out = apply_decisions(d, an, decisions_by_rule(an), "row_key")
    assert out.count() == d.count()
    assert out.select("row_key").distinct().count() == d.count()


def test_apply_decision_effects(spark):
    df = spark.createDataFrame([
        (0, "  ana ", "a@x.co", 10.0), (1, "   ", "bad", 11.0), (2, "luis", "a@x.co", None), (3, "eva", "e@x.co", 12.0),
        (4, "leo", "l@x.co", 10.0), (5, "max", "m@x.co", 11.0), (6, "ida", "i@x.co", 12.0), (7, "bo", "b@x.co", 11.0),
    ], "k long, nombre string, email string, monto double")
    an = detect_anomalies(df, "ds", order_by="k")
    recs = {(r["column"], r["anomaly_type"]): r for r in an.collect()}
    dec = [
        {"anomaly_id": recs[("nombre", "WHITESPACE_ONLY")]["anomaly_id"], "action": "APPROVED"},
        {"anomaly_id": recs[("email", "FORMAT_INVALID")]["anomaly_id"], "action": "APPROVED"},
        {"anomaly_id": recs[("email", "DUPLICATE")]["anomaly_id"], "action": "CORRECTED", "correction": "x"},
        {"anomaly_id": recs[("monto", "MISSING_VALUE")]["anomaly_id"], "action": "CORRECTED",
         "correction_ir": '{"op": "FILL_AGGREGATE", "agg": "median"}'},
        {"anomaly_id": "unknown", "action": "APPROVED"},
    ]
    out = {r["k"]: r for r in apply_decisions(df, an, dec, "k").collect()}
    assert out[1]["nombre"] is None                      # blank -> null
    assert out[0]["nombre"] == "ana"                     # final strip
    assert out[1]["email"] == K.LABEL_EMAIL_INVALID      # approved suggestion
    assert out[2]["email"] == "a@x.co_DUP"               # later duplicate marked
    assert out[2]["monto"] == pytest.approx(11.0)        # median of 10,11,12,10,11,12,11
    assert len(out) == 8


def test_apply_without_decisions_returns_input(spark):
    df = spark.createDataFrame([(0, " a ")], "k long, s string")
    assert apply_decisions(df, [], [], "k").collect()[0]["s"] == " a "


def test_date_repair(spark):
    import datetime as dt
    df = spark.createDataFrame([(0, dt.date(1990, 1, 1), dt.date(1980, 1, 1)), (1, dt.date(1990, 1, 1), dt.date(2010, 1, 1))],
                               "k long, fecha_nacimiento date, fecha_alta date")
    an = detect_anomalies(df, "ds", order_by="k")
    r = [a for a in an.collect() if a["anomaly_type"] == "DATE_LOGICAL"][0]
    out = {x["k"]: x for x in apply_decisions(df, an, [{"anomaly_id": r["anomaly_id"], "action": "DISCARDED"}],
                                             "k").collect()}
    assert out[0]["fecha_alta"] == dt.date(1990, 1, 1) + dt.timedelta(days=6570)
    assert out[1]["fecha_alta"] == dt.date(2010, 1, 1)


def test_wrong_field_rules_see_every_row(spark):
    vals = [f"ok {i}" for i in range(600)] + ["300-123-4567"] * 400
    df = spark.createDataFrame(list(enumerate(vals)), "k long, nota string")
    full = detect_records(df, "ds", order_by="k", types=["CROSS_FIELD_SWAP"])
    assert full[0]["affected"] == 400


def test_detect_without_order_key(spark):
    df = spark.createDataFrame([("a",), (None,), ("  b",)], "nombre string")
    r = recs_by(detect_records(df, "ds"))
    assert r[("nombre", "MISSING_VALUE")]["affected"] == 1
    assert r[("nombre", "LEADING_TRAILING_WHITESPACE")]["original_value"] == "  b"
    assert all(k[0] == "nombre" for k in r)


def test_decision_with_no_cells_changes_nothing(spark):
    df = spark.createDataFrame([(0, 5), (1, 6)], "k long, codigo bigint")
    rec = {"anomaly_id": "a1", "column": "codigo", "anomaly_type": "DUPLICATE", "affected": 0,
           "original_value": None, "suggested_value": "DUPLICADO", "related_column": None}
    out = apply_decisions(df, [rec], [{"anomaly_id": "a1", "action": "APPROVED"}], "k")
    assert dict(out.dtypes)["codigo"] == "bigint"
    assert sorted(r["codigo"] for r in out.collect()) == [5, 6]


def test_descriptions_tell_count_and_example(spark):
    df = spark.createDataFrame([(i, "300-123-4567" if i % 2 else f"ok {i}") for i in range(60)], "k long, nota string")
    r = detect_records(df, "ds", order_by="k", types=["CROSS_FIELD_SWAP"])[0]
    assert r["affected"] == 30 and "30 cells" in r["description"] and "300-123-4567" in r["description"]


def test_odd_column_names(spark):
    from cellwright.operators import transforms as TR
    rows = [(i, f"  n{i % 7}" if i % 5 else None, float(i % 11) if i % 13 else 1000.0, f"a{i}@x.co")
            for i in range(60)]
    df = spark.createDataFrame(rows, "`row id` long, `first name` string, `a.b` double, `e mail` string")
    recs = detect_records(df, "odd", order_by="row id")
    assert {r["column"] for r in recs} >= {"first name", "a.b"}
    cells = find_cells(df, recs, "row id").count()
    assert cells > 0
    out = apply_decisions(df, recs, [{"anomaly_id": r["anomaly_id"], "action": "APPROVED"} for r in recs], "row id")
    assert out.count() == 60 and out.columns == df.columns
    d, _, _ = TR.remove_duplicates(df, ["first name"], keep="first", order_by="row id")
    assert d.columns == df.columns
    enc, _, _ = TR.encode_categoricals(df, ["first name"])
    assert enc.count() == 60


def test_sequence_with_long_digit_runs(spark):
    base = 10**25
    vals = [f"ORD{base + i}" for i in range(200)] + [f"ORD{base + 10**20}"]
    df = spark.createDataFrame(list(enumerate(vals)), "k long, pedido string")
    recs = detect_records(df, "ds", order_by="k", types=["SEQUENCE_GAP"])
    # model of the rule with Python ints and float fences, as the reference computes it
    nums = sorted(int(v[3:]) for v in vals)
    n = len(nums)
    q1, q3 = nums[int(n * 0.25)], nums[min(n - 1, int(n * 0.75))]
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    outside = [x for x in nums if not (lo <= x <= hi)]
    assert recs and recs[0]["affected"] == len(outside)
    assert recs[0]["original_value"].split("|")[3] == f"ORD{outside[0]}"
    cells = find_cells(df, recs, "k").count()
    assert cells == len(outside)


def test_shared_finder_gives_same_results(spark, dirty_run):
    from cellwright.operators.cells import CellFinder
    d, recs = dirty_run
    an = detect_anomalies(d, "dirty", order_by="row_key")
    dec = decisions_by_rule(an)
    f = CellFinder(d, an, "row_key")
    assert sorted(map(tuple, find_cells(d, an, "row_key", finder=f).collect())) == \
        sorted(map(tuple, find_cells(d, an, "row_key").collect()))
    shared = apply_decisions(d, an, dec, "row_key", finder=f)
    alone = apply_decisions(d, an, dec, "row_key")
    assert sorted(map(tuple, shared.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)


@pytest.mark.parametrize("digits,limit", [(40, 50_000), (40, 20), (400, 50_000)])
def test_sequence_numbers_of_any_length(spark, monkeypatch, digits, limit):
    """Sequences far beyond 38 digits, over a change of length, with holes and with a value out of range.
    Fences are the reference's floats where a float can hold them, and exact beyond."""
    from cellwright.functions import quantiles as Q
    monkeypatch.setattr(Q.kth_smallest, "__defaults__", (limit, *Q.kth_smallest.__defaults__[1:]))
    step = 10**26 if digits < 300 else 1
    base = 10**digits - 50 * step
    nums = [base + i * step for i in range(100) if i != 51]
    df = spark.createDataFrame([(i, f"A{h}", f"A{f}") for i, (h, f) in enumerate(zip([*nums, base + 100 * step], [*nums, 7]))],
                               "k long, hole string, far string")
    recs = {r["column"]: r for r in detect_records(df, "ds", order_by="k", types=["SEQUENCE_GAP"])}
    missing = 100 * step + 1 - 100
    assert recs["hole"]["affected"] == min(missing, 2**63 - 1) and recs["hole"]["description"].startswith(f"{missing} ")
    first = base + 51 if step == 1 else base + 1
    assert recs["hole"]["original_value"] == f"A|{base}|{base + 100 * step}|A{first}"
    assert recs["far"]["affected"] == 1 and recs["far"]["original_value"].endswith("7")
    assert [r["value"] for r in find_cells(df, [recs["far"]], "k").collect()] == ["A7"]


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_holes_on_and_off_the_borders_of_slices(spark, slices):
    """With about as many slices as keys nearly every hole falls on a border."""
    from cellwright.operators.detect import holes, seq_int, seq_key
    for gone in ([], [1], [9], [10, 11, 12], [57], [40, 99], [98, 99, 100], [5, 30, 70]):
        have = [n for n in range(0, 121) if n not in gone] + [7, 7, 8]
        df = spark.createDataFrame([(seq_key(n),) for n in have] + [(None,)], "x string").repartition(4)
        n, first = holes(df, F.col("x"), slices)
        assert n == len(set(have)), gone
        assert seq_int(first) == (min(gone) - 1 if gone else None), gone
    assert tuple(holes(spark.createDataFrame([], "x string"), F.col("x"), slices)) == (None, None)


def test_next_number_of_any_length(spark):
    from cellwright.operators.detect import seq_key, seq_next
    ns = [0, 1, 8, 9, 10, 99, 109, 199, 989, 10 ** 40 - 1, 10 ** 40, 123_999]
    df = spark.createDataFrame([(seq_key(n), seq_key(n + 1)) for n in ns], "x string, y string")
    assert df.where(seq_next(F.col("x")) != F.col("y")).count() == 0


def test_heavy_hitter_among_many_values(spark):
    """One value on most rows of a column with many others: found past the sketch, nulls left out."""
    df = spark.range(30_000).selectExpr("id AS k", "CASE WHEN id % 24 = 0 THEN 'v' || id ELSE 'same' END AS kind",
                                        "CASE WHEN id % 2 = 0 THEN NULL WHEN id % 6 = 1 THEN 'w' || id ELSE 'most' END AS other")
    r = recs_by(detect_records(df, "ds", order_by="k", types=["LOW_VARIANCE"]))
    assert r[("kind", "LOW_VARIANCE")]["affected"] == 30_000 and r[("kind", "LOW_VARIANCE")]["original_value"] == "same"
    assert ("other", "LOW_VARIANCE") not in r
