"""Registered queries of the correction language: one per node, function, condition and
operand, each applied to every row of ``orders``.

``SPECS`` holds (query, target column, tree, mask); the oracle of each is its own SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.correction import IRError
from ..operators.apply import apply_correction, apply_decisions
from .fixtures import table

#: The input: a number with gaps (v), another (w), an integer (n), padded text with gaps (s), a code (st).
BASE_SQL = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v,
  o_totalprice / 3 - 20000.013 AS w, o_custkey AS n,
  CASE WHEN o_orderkey % 5 <> 0 THEN concat('  ', lower(o_orderpriority), ' ') END AS s, o_orderstatus AS st"""


def literal(x) -> dict:
    return {"op": "FILL_LITERAL", "value": x}


def column(c: str) -> dict:
    return {"op": "FILL_FROM_COLUMN", "sourceColumn": c}


def transform(fn: str, inner: dict, **params) -> dict:
    return {"op": "TRANSFORM", "fn": fn, "params": params, "input": inner}


def op_col(c: str) -> dict:
    return {"kind": "column", "column": c}


def op_lit(x) -> dict:
    return {"kind": "literal", "value": x}


def choose(op: str, left: dict, right: dict | None = None, upper: dict | None = None,
           then: dict | None = None, other: dict | None = None) -> dict:
    cond = {"op": op, "left": left, "right": right, "upper": upper}
    return {"op": "CONDITIONAL", "condition": cond, "then": then or literal("yes"), "else": other or literal("no")}


ALL, GAP, FULL = "k = k", "v IS NULL", "v IS NOT NULL"
SPECS: list[tuple[str, str, dict, str]] = [
    ("i01_fill_literal", "n", literal("42.9"), "k % 7 = 0"),
    *[(f"i0{i}_fill_{a}", "v", {"op": "FILL_AGGREGATE", "agg": a}, GAP)
      for i, a in enumerate(("mean", "median", "min", "max", "sum"), 2)],
    ("i07_fill_mode", "st", {"op": "FILL_AGGREGATE", "agg": "mode"}, "k % 3 = 0"),
    ("i08_fill_from_column", "v", column("w"), GAP),
    ("i09_delete_rows", "v", {"op": "DELETE_ROWS"}, GAP),
    ("i10_keep", "v", {"op": "KEEP"}, GAP),
    ("i11_transform", "v", transform("round", transform("multiply", column("w"), by=2), decimals=1), ALL),
    ("i12_conditional", "v", choose("gt", op_col("v"), {"kind": "aggregate", "column": "v", "agg": "mean"},
                                    then=literal(1), other=column("w")), FULL),
    ("f01_round", "w", transform("round", column("w"), decimals=1), ALL),
    *[(f"f0{i}_{fn}", "w", transform(fn, column("w")), ALL) for i, fn in enumerate(("floor", "ceil", "abs"), 2)],
    *[(f"f0{i}_{fn}", "s", transform(fn, column("s")), ALL) for i, fn in enumerate(("upper", "lower", "title", "trim"), 5)],
    *[(f"f{i:02d}_{fn}", "w", transform(fn, column("w"), by=4), ALL)
      for i, fn in enumerate(("multiply", "add", "subtract", "divide"), 9)],
    ("c01_eq", "s", choose("eq", op_col("st"), op_lit("F")), ALL),
    ("c02_neq", "s", choose("neq", op_col("st"), op_lit("F")), ALL),
    *[(f"c0{i}_{op}", "s", choose(op, op_col("n"), op_lit(700)), ALL) for i, op in enumerate(("gt", "gte", "lt", "lte"), 3)],
    ("c07_is_null", "s", choose("is_null", op_col("v")), ALL),
    ("c08_is_not_null", "s", choose("is_not_null", op_col("v")), ALL),
    ("c09_contains", "s", choose("contains", op_col("s"), op_lit("-")), "s IS NOT NULL"),
    ("c10_starts_with", "s", choose("starts_with", op_col("s"), op_lit("  1")), "s IS NOT NULL"),
    ("c11_ends_with", "s", choose("ends_with", op_col("s"), op_lit("h ")), "s IS NOT NULL"),
    ("c12_between", "s", choose("between", op_col("v"), op_lit(50000), op_lit(150000)), FULL),
    ("c13_eq_text_number", "s", choose("eq", op_col("st"), op_lit(1)), ALL),
    ("o01_literal", "s", choose("gte", op_col("n"), op_lit(500)), ALL),
    ("o02_column", "s", choose("lt", op_col("v"), op_col("w")), FULL),
    ("o03_aggregate", "s", choose("gt", op_col("v"), {"kind": "aggregate", "column": "v", "agg": "median"}), FULL),
]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr(*[x.strip() for x in _items(BASE_SQL.removeprefix("SELECT "))])


def _items(select: str) -> list[str]:
    """Top-level items of a select list."""
    out, depth, item = [], 0, ""
    for ch in select:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += ch
    return [*out, item]


def _query(target: str, tree: dict, mask: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind, out = apply_correction(base(spark, sf_dir), target, tree, F.expr(mask))
        value = F.round(target, 4) if out.schema[target].dataType.typeName() == "double" else F.col(target)
        return out.select("k", F.lit(kind).alias("kind"), value.alias("value"))
    return run


QUERIES = {name: _query(target, tree, mask) for name, target, tree, mask in SPECS}

#: Trees that must be refused, with the reason why the row keeps its value.
REFUSED: list[tuple[str, str, dict]] = [
    ("numeric function of text", "w", transform("round", column("s"))),
    ("text branch of a number", "v", choose("is_null", op_col("v"), then=column("s"), other=literal(1))),
    ("text literal branch of a number", "v", choose("is_null", op_col("v"), then=literal("x"), other=literal(1))),
    ("order of text and number", "v", choose("gt", op_col("s"), op_lit(5), then=literal(1), other=literal(2))),
    ("division by zero", "v", transform("divide", column("w"), by=0)),
    ("missing column", "v", column("nope")),
]


def c14_refused_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every refused tree leaves the table alone: reason, rows, and the sum of the target."""
    b = base(spark, sf_dir)
    rows = []
    for reason, target, tree in REFUSED:
        try:
            _, out = apply_correction(b, target, tree)
            refused = False
        except IRError:
            out, refused = b, True
        rows.append(out.agg(F.lit(reason).alias("reason"), F.lit(refused).alias("refused"), F.count("*").alias("n"),
                            F.round(F.sum(target), 2).alias("total")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


QUERIES["c14_refused_trees"] = c14_refused_trees


#: Input of ``p03_apply_types``: a date, a second date and a decimal, all with gaps.
TYPED_SQL = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS d,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS e,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DECIMAL(12, 2)) END AS m"""


def p03_apply_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions keep the types of date and decimal columns: a text that is no date is skipped."""
    src = table(spark, sf_dir, "orders").selectExpr(*[x.strip() for x in _items(TYPED_SQL.removeprefix("SELECT "))])
    records = [{"anomaly_id": c, "column": c, "anomaly_type": "MISSING_VALUE", "affected": 1, "original_value": None,
                "suggested_value": "null", "related_column": None} for c in ("d", "e", "m")]
    decisions = [{"anomaly_id": "d", "action": "APPROVED"}, {"anomaly_id": "e", "action": "CORRECTED", "correction": "2020-01-31"},
                 {"anomaly_id": "m", "action": "CORRECTED", "correction": "2.5"}]
    out = apply_decisions(src, records, decisions, "k")
    return out.select("k", "d", "e", F.col("m").cast("string").alias("m"),
                      F.lit(",".join(out.schema[c].dataType.simpleString() for c in "dem")).alias("types"))


QUERIES["p03_apply_types"] = p03_apply_types
