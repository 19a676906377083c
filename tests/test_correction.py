"""Correction expressions: the reference's executor cases, run as Spark columns."""

import pytest
from pyspark.sql import functions as F

from cellwright.functions.correction import IRError
from cellwright.operators.apply import apply_correction


@pytest.fixture
def num(spark):
    return spark.createDataFrame([(i, float(v), float(o)) for i, (v, o) in
                                  enumerate(zip([10, 20, 30, 40, 50], [1, 2, 3, 4, 5]))],
                                 "k long, value double, other double")


@pytest.fixture
def text(spark):
    return spark.createDataFrame([(0, "alice", "NYC"), (1, "bob", "LA"), (2, "charlie", "NYC"), (3, "dave", "SF")],
                                 "k long, name string, city string")


def values(df, col="value"):
    return [r[0] for r in df.orderBy("k").select(col).collect()]


def fill(df, col, ir, mask=None):
    kind, out = apply_correction(df, col, ir, mask)
    return kind, values(out, col)


def test_fill_literal_casts_to_column_type(spark, num):
    ints = spark.createDataFrame([(0, 1), (1, None)], "k long, x bigint")
    assert fill(ints, "x", {"op": "FILL_LITERAL", "value": "42"})[1] == [42, 42]
    assert fill(ints, "x", {"op": "FILL_LITERAL", "value": 7.9})[1] == [7, 7]
    assert fill(num, "value", {"op": "FILL_LITERAL", "value": 3.14})[1][0] == pytest.approx(3.14)
    assert fill(num, "value", {"op": "FILL_LITERAL", "value": None})[1] == [None] * 5


@pytest.mark.parametrize("agg,expected", [("mean", 30.0), ("median", 30.0), ("min", 10.0), ("max", 50.0),
                                          ("sum", 150.0), ("mode", 10.0)])
def test_fill_aggregate(num, agg, expected):
    kind, vals = fill(num, "value", {"op": "FILL_AGGREGATE", "agg": agg})
    assert kind == "FILL" and vals == [pytest.approx(expected)] * 5


def test_fill_aggregate_errors_and_empty(spark, text):
    with pytest.raises(IRError):
        apply_correction(text, "name", {"op": "FILL_AGGREGATE", "agg": "mean"})
    with pytest.raises(IRError):
        apply_correction(text, "name", {"op": "FILL_AGGREGATE", "agg": "p99"})
    modes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "k long, s string")
    assert fill(modes, "s", {"op": "FILL_AGGREGATE", "agg": "mode"})[1] == ["a"] * 3
    empty = spark.createDataFrame([(0, None)], "k long, value double")
    assert fill(empty, "value", {"op": "FILL_AGGREGATE", "agg": "mean"})[1] == [None]


def test_fill_aggregate_int_column_truncates(spark):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "k long, x bigint")
    assert fill(df, "x", {"op": "FILL_AGGREGATE", "agg": "mean"}, F.col("x").isNull())[1] == [1, 2, 1]


def test_fill_from_column_and_missing(num):
    assert fill(num, "value", {"op": "FILL_FROM_COLUMN", "sourceColumn": "other"})[1] == [1.0, 2.0, 3.0, 4.0, 5.0]
    with pytest.raises(IRError):
        apply_correction(num, "value", {"op": "FILL_FROM_COLUMN", "sourceColumn": "nope"})


def test_delete_and_keep_never_change_rows(num):
    kind, out = apply_correction(num, "value", {"op": "DELETE_ROWS"})
    assert kind == "DELETE" and out.count() == 5
    assert apply_correction(num, "value", {"op": "KEEP"})[0] == "KEEP"


def tr(fn, inner, **params):
    return {"op": "TRANSFORM", "fn": fn, "params": params, "input": inner}


LIT = lambda v: {"op": "FILL_LITERAL", "value": v}


@pytest.mark.parametrize("fn,inp,params,expected", [
    ("round", 3.567, {"decimals": 1}, 3.6), ("floor", 3.7, {}, 3.0), ("ceil", 3.2, {}, 4.0),
    ("abs", -5.5, {}, 5.5), ("multiply", 5.0, {"by": 2}, 10.0), ("add", 5.0, {"by": 5}, 10.0),
    ("subtract", 10.0, {"by": 3}, 7.0), ("divide", 10.0, {"by": 2}, 5.0),
])
def test_numeric_functions_on_scalars(num, fn, inp, params, expected):
    assert fill(num, "value", tr(fn, LIT(inp), **params))[1][0] == pytest.approx(expected)


@pytest.mark.parametrize("fn,inp,expected", [("upper", "hello", "HELLO"), ("lower", "HELLO", "hello"),
                                             ("title", "hello world", "Hello World"), ("trim", "  spaces  ", "spaces")])
def test_text_functions_on_scalars(text, fn, inp, expected):
    assert fill(text, "name", tr(fn, LIT(inp)))[1][0] == expected


def test_function_errors(num):
    with pytest.raises(IRError):
        apply_correction(num, "value", tr("divide", LIT(1.0), by=0))
    with pytest.raises(IRError):
        apply_correction(num, "value", tr("multiply", LIT(1.0)))
    with pytest.raises(IRError):
        apply_correction(num, "value", tr("exec", LIT(1.0)))


def test_title_on_column_matches_python(spark):
    words = ["o'neil mc-donald", "hello world", "ÉCOLE élève", "x1y2 z", "", "a_b c-d"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "k long, s string")
    got = fill(df, "s", tr("title", {"op": "FILL_FROM_COLUMN", "sourceColumn": "s"}))[1]
    assert got == [w.title() for w in words]


def test_nested_transform_and_per_row(num, text):
    assert fill(num, "value", tr("round", {"op": "FILL_AGGREGATE", "agg": "mean"}, decimals=1))[1][0] == 30.0
    got = fill(text, "name", tr("upper", {"op": "FILL_FROM_COLUMN", "sourceColumn": "name"}), F.col("k") < 2)[1]
    assert got == ["ALICE", "BOB", "charlie", "dave"]


def cond(op, left, right=None, upper=None):
    c = {"op": op, "left": left}
    if right is not None:
        c["right"] = right
    if upper is not None:
        c["upper"] = upper
    return c


COL = lambda c: {"kind": "column", "column": c}
L = lambda v: {"kind": "literal", "value": v}


def conditional(c, then, other):
    return {"op": "CONDITIONAL", "condition": c, "then": then, "else": other}


def test_conditional_mixed_keep_writes_null(num):
    ir = conditional(cond("gt", COL("value"), L(25)), LIT(100), {"op": "KEEP"})
    kind, vals = fill(num, "value", ir)
    assert kind == "FILL" and vals == [None, None, 100.0, 100.0, 100.0]
    kind, out = apply_correction(num, "value", ir, keep_means_keep=True)
    assert values(out) == [10.0, 20.0, 100.0, 100.0, 100.0]


def test_conditional_all_true_all_false_all_delete(num):
    assert fill(num, "value", conditional(cond("gt", COL("value"), L(0)), LIT(100), LIT(0)))[1] == [100.0] * 5
    assert fill(num, "value", conditional(cond("gt", COL("value"), L(999)), LIT(100), LIT(0)))[1] == [0.0] * 5
    assert apply_correction(num, "value", conditional(cond("gt", COL("value"), L(0)), {"op": "DELETE_ROWS"},
                                                      {"op": "KEEP"}))[0] == "DELETE"


@pytest.mark.parametrize("c,expected_true", [
    (cond("eq", COL("value"), L(30.0)), [2]), (cond("neq", COL("value"), L(30.0)), [0, 1, 3, 4]),
    (cond("gte", COL("value"), L(40)), [3, 4]), (cond("lt", COL("value"), L(20)), [0]),
    (cond("lte", COL("value"), L(20)), [0, 1]), (cond("between", COL("value"), L(20), L(40)), [1, 2, 3]),
    (cond("gt", COL("value"), {"kind": "aggregate", "agg": "mean"}), [3, 4]),
])
def test_conditions(num, c, expected_true):
    vals = fill(num, "value", conditional(c, LIT(1), LIT(0)))[1]
    assert [i for i, v in enumerate(vals) if v == 1.0] == expected_true


def test_text_conditions_and_nulls(spark, text):
    for c, want in [(cond("contains", COL("name"), L("li")), [0, 2]), (cond("starts_with", COL("name"), L("b")), [1]),
                    (cond("ends_with", COL("name"), L("e")), [0, 2, 3])]:
        vals = fill(text, "name", conditional(c, LIT("Y"), LIT("N")))[1]
        assert [i for i, v in enumerate(vals) if v == "Y"] == want
    df = spark.createDataFrame([(0, 1.0), (1, None)], "k long, x double")
    assert fill(df, "x", conditional(cond("is_null", COL("x")), LIT(0), LIT(99)))[1] == [99.0, 0.0]
    with pytest.raises(IRError):  # gt on a null operand is an error in the reference
        apply_correction(df, "x", conditional(cond("gt", COL("x"), L(0)), LIT(0), LIT(1)))


def test_depth_limit_and_unknown_nodes(num):
    ir = LIT(1)
    for _ in range(3):
        ir = tr("abs", ir)
    assert apply_correction(num, "value", ir)[0] == "FILL"
    with pytest.raises(IRError):
        apply_correction(num, "value", tr("abs", ir))
    with pytest.raises(IRError):
        apply_correction(num, "value", {"op": "EVAL"})
    with pytest.raises(IRError):
        apply_correction(num, "value", conditional({"op": "matches", "left": L(1), "right": L(1)}, LIT(1), LIT(2)))
    with pytest.raises(IRError):
        apply_correction(num, "value", conditional(cond("eq", {"kind": "sql"}, L(1)), LIT(1), LIT(2)))
    with pytest.raises(IRError):
        apply_correction(num, "value", conditional(cond("eq", COL("nope"), L(1)), LIT(1), LIT(2)))


def test_salary_mean_fills_nulls(spark):
    df = spark.createDataFrame([(0, 1000.0), (1, None), (2, 3000.0), (3, None), (4, 5000.0)], "k long, salary double")
    kind, out = apply_correction(df, "salary", {"op": "FILL_AGGREGATE", "agg": "mean"}, F.col("salary").isNull())
    assert values(out, "salary") == [1000.0, 3000.0, 3000.0, 3000.0, 5000.0]
