"""Applying reviewed decisions (P1-P11) without ever losing a row.

``apply_decisions(df, anomalies, decisions, order_by)`` folds every decision into
ONE projection over the table: each column's final value is a nested ``CASE``
built from the cell masks (computed on the untouched snapshot, as the reference
does) and the decisions in order.  Aggregates a correction needs are evaluated on
the current (already corrected) column expression.  The only joins are with
aggregated frames holding one row per key, so the output has exactly the input's
rows by construction.
"""

from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import quantiles as Q
from ..functions.correction import DELETE, FILL, KEEP, Compiler, IRError, cast_to_dtype
from ..functions.text import ustrip
from ..functions.types import dtypes, is_date, is_integral, is_numeric, is_string
from .cells import CellFinder

DECISION_SCHEMA = T.StructType([
    T.StructField("anomaly_id", T.StringType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("correction", T.StringType(), True),
    T.StructField("correction_ir", T.StringType(), True),
    T.StructField("ir_source", T.StringType(), True),
    T.StructField("user_id", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])


def _rows(x) -> list[dict]:
    if x is None:
        return []
    if isinstance(x, DataFrame):
        return [r.asDict() for r in x.collect()]
    return [r if isinstance(r, dict) else r.asDict() for r in x]


def match_decisions(anomalies, decisions) -> list[tuple[dict, dict]]:
    """Pair each decision with its anomaly; the last decision per anomaly wins.

    Both inputs are review metadata (a handful of rows per column), so they are
    small by construction.  When given as DataFrames they are joined in Spark first.
    """
    if isinstance(anomalies, DataFrame) and isinstance(decisions, DataFrame):
        decisions = decisions.join(anomalies.select("anomaly_id"), "anomaly_id", "left_semi")
    anoms = {a["anomaly_id"]: a for a in _rows(anomalies)}
    decs = _rows(decisions)
    decs.sort(key=lambda d: (d.get("created_at") is None, d.get("created_at") or 0))
    chosen: dict[str, dict] = {}
    for d in decs:
        chosen[d["anomaly_id"]] = d  # dict keeps the first position, later decisions replace the value
    return [(anoms[k], d) for k, d in chosen.items() if k in anoms]


def _lit(v, dtype) -> Column:
    return F.lit(None).cast(dtype) if v is None else F.lit(v).cast(dtype)


def _fits(v, dtype) -> bool:
    """Would the value go into a column of this type without changing the type?"""
    if v is None:
        return True
    if is_integral(dtype):
        return isinstance(v, int) and not isinstance(v, bool)
    if isinstance(dtype, T.DecimalType):
        return isinstance(v, Decimal) and v.is_finite() and abs(v) < Decimal(10) ** (dtype.precision - dtype.scale)
    if is_numeric(dtype):
        return isinstance(v, (int, float)) and not isinstance(v, bool)
    if is_string(dtype):
        return isinstance(v, str)
    if isinstance(dtype, T.BooleanType):
        return isinstance(v, bool)
    return not isinstance(v, str)


class Applier:
    def __init__(self, df: DataFrame, anomalies, decisions, order_by, keep_means_keep: bool = False,
                 finder: CellFinder | None = None):
        self.src = df
        self.given_finder = finder
        self.order_by = order_by
        self.keep_means_keep = keep_means_keep
        self.all_anoms = _rows(anomalies)
        self.pairs = match_decisions(anomalies, decisions)
        self.cols = list(df.columns)
        self.dtype = dtypes(df)
        self.skipped: list[tuple[str, str]] = []

    # ------------------------------------------------------------- statistics
    HELPERS = ("__dup_cols", "__rare")

    def _base_for(self, *exprs) -> DataFrame:
        """The plain table when the expressions use no helper-join column, so a
        statistic does not re-run the duplicate / rare-value joins."""
        text = " ".join(str(e) for e in exprs)
        return self.finder.df if any(h in text for h in self.HELPERS) else self.src

    def aggregate(self, col: str, agg: str):
        """Whole-column statistic of the CURRENT column value (earlier decisions applied)."""
        x = self.cur[col]
        base = self._base_for(x)
        if agg == "mode":
            vc = base.where(x.isNotNull()).groupBy(x.alias("v")).count()
            top = vc.agg(F.min(F.struct((-F.col("count")).alias("nc"), F.col("v").alias("v")))).collect()[0][0]
            return None if top is None else top["v"]
        d = x.cast("double")
        if agg == "median":
            tmp = base.select(d.alias("__x"))
            n = tmp.agg(F.count("__x")).collect()[0][0]
            if not n:
                return None
            r = Q.kth_smallest(tmp, [Q.Request("a", "`__x`", (n - 1) // 2, n), Q.Request("b", "`__x`", n // 2, n)])
            return (r["a"] + r["b"]) / 2.0
        fn = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[agg]
        row = base.agg(fn(d).alias("v"), F.count(d).alias("n")).collect()[0]
        return None if not row["n"] else row["v"]

    def split_for(self, mask: Column):
        def split(cond: Column, bad: Column | None):
            aggs = [F.max(mask & cond).alias("t"), F.max(mask & ~cond).alias("f")]
            aggs.append(F.max(mask & bad).alias("b") if bad is not None else F.lit(False).alias("b"))
            r = self._base_for(aggs[0], aggs[1], aggs[2]).agg(*aggs).collect()[0]
            return bool(r["t"]), bool(r["f"]), bool(r["b"])
        return split

    # ------------------------------------------------------------- writes
    def promote(self, col: str):
        if not is_string(self.dtype[col]):
            self.cur[col] = self.cur[col].cast("string")
            self.dtype[col] = T.StringType()

    def write_scalar(self, col: str, mask: Column, value: Any, allow_text: bool) -> bool:
        dt = self.dtype[col]
        if is_date(dt) and isinstance(value, str):
            # a date column takes dates only: any other text leaves it as it is
            try:
                value = datetime.fromisoformat(value.strip())
            except ValueError:
                return False
        if not _fits(value, dt):
            if not allow_text:
                return False
            self.promote(col)
            dt = self.dtype[col]
            value = None if value is None else str(value)
        self.cur[col] = F.when(mask, _lit(value, dt)).otherwise(self.cur[col])
        return True

    # ------------------------------------------------------------- decisions
    def one(self, anomaly: dict, decision: dict):
        col, atype = anomaly["column"], anomaly["anomaly_type"]
        action = (decision.get("action") or "").upper()
        if col not in self.cur:
            return
        mask = self.finder.mask(anomaly)
        if atype == "DUPLICATE" and action != "DISCARDED":
            self.promote(col)
            cur = self.cur[col]
            hit = mask & cur.isNotNull() & ~cur.endswith(K.DUP_SUFFIX)
            self.cur[col] = F.when(hit, F.concat(cur, F.lit(K.DUP_SUFFIX))).otherwise(cur)
            return
        if atype == "WHITESPACE_ONLY" and action == "APPROVED":
            self.cur[col] = F.when(mask, F.lit(None).cast(self.dtype[col])).otherwise(self.cur[col])
            return
        if atype == "LEADING_TRAILING_WHITESPACE" and action == "APPROVED":
            if is_string(self.dtype[col]):
                self.cur[col] = F.when(mask, ustrip(self.cur[col])).otherwise(self.cur[col])
            return
        if action == "DISCARDED":
            return
        if action == "CORRECTED" and decision.get("correction_ir") is not None:
            ir = decision["correction_ir"]
            if isinstance(ir, str):
                ir = json.loads(ir)
            try:
                res = Compiler(col, dict(self.dtype), self.aggregate, self.split_for(mask),
                               self.keep_means_keep, dict(self.cur)).compile(ir)
            except IRError as exc:
                self.skipped.append((anomaly["anomaly_id"], str(exc)))
                return
            if res.kind in (KEEP, DELETE):
                return  # rows are never deleted
            if res.is_scalar:
                if not self.write_scalar(col, mask, res.scalar, allow_text=False):
                    self.skipped.append((anomaly["anomaly_id"], "fill type mismatch"))
                return
            dt = self.dtype[col]
            self.cur[col] = F.when(mask, res.column.try_cast(dt)).otherwise(self.cur[col])
            return
        if action == "CORRECTED" and decision.get("correction") is not None:
            value = cast_to_dtype(decision["correction"], self.dtype[col]) \
                if is_numeric(self.dtype[col]) else decision["correction"]
            self.write_scalar(col, mask, value, allow_text=True)
            return
        if action == "APPROVED" and anomaly.get("suggested_value") is not None:
            sv = anomaly["suggested_value"]
            value = cast_to_dtype(sv, self.dtype[col]) if is_numeric(self.dtype[col]) else sv
            self.write_scalar(col, mask, value, allow_text=True)

    def date_repair(self):
        """P10: for every DATE_LOGICAL record, an end date before its start becomes start + 6570 days."""
        for a in self.all_anoms:
            if a["anomaly_type"] != "DATE_LOGICAL":
                continue
            s, e = a["column"], a.get("related_column")
            if not e or s not in self.cur or e not in self.cur:
                continue
            if not (is_date(self.dtype[e]) and (is_date(self.dtype[s]) or is_string(self.dtype[s]))):
                continue
            sd = F.try_to_date(F.substring(self.cur[s].cast("string"), 1, 10), "yyyy-MM-dd") if is_string(self.dtype[s]) \
                else self.cur[s].cast("date")
            ed = self.cur[e].cast("date")
            fixed = F.date_add(sd, K.DATE_REPAIR_DAYS).cast(self.dtype[e])
            cond = self.cur[s].isNotNull() & self.cur[e].isNotNull() & sd.isNotNull() & (ed < sd)
            self.cur[e] = F.when(cond, fixed).otherwise(self.cur[e])

    def run(self) -> DataFrame:
        if not self.pairs:
            return self.src
        self.finder = self.given_finder or CellFinder(self.src, [a for a, _ in self.pairs], self.order_by)
        self.cur = {c: F.col(f"`{c}`") for c in self.cols}
        # A decision whose finder selects no cell is skipped (no type change either):
        # one aggregate tells, for every decided record, whether its mask is empty.
        live = [(a, d) for a, d in self.pairs if a["column"] in self.cur]
        if live:
            masks = [self.finder.mask(a) for a, _ in live]  # may add helper joins to finder.df
            hit = self.finder.df.agg(*[F.max(m).alias(f"h{i}") for i, m in enumerate(masks)]).collect()[0]
            live = [p for i, p in enumerate(live) if hit[f"h{i}"]]
        for a, d in live:
            self.one(a, d)
        # Every text column trimmed, blank -> null
        for c in self.cols:
            if is_string(self.dtype[c]):
                t = ustrip(self.cur[c])
                self.cur[c] = F.when(F.length(t) == 0, F.lit(None).cast("string")).otherwise(t)
        self.date_repair()
        return self.finder.df.select(*[self.cur[c].alias(c) for c in self.cols])


def apply_decisions(df: DataFrame, anomalies, decisions, order_by, keep_means_keep: bool = False,
                    finder: CellFinder | None = None) -> DataFrame:
    """Apply reviewed decisions; ``finder`` (a ``CellFinder`` already built for these
    anomalies on this table, e.g. by the caller of ``find_cells``) saves its passes."""
    return Applier(df, anomalies, decisions, order_by, keep_means_keep, finder).run()


def decisions_by_rule(anomalies: DataFrame, user_id: str = "reviewer") -> DataFrame:
    """The fixture's review rule (FIXTURES §4): approve format, blank, padding and duplicate
    findings; correct missing balances with a literal and z-score outliers with the median;
    discard the rest.  ``created_at`` follows the detector order so decisions apply in it."""
    t = F.col("anomaly_type")
    action = (F.when(t.isin("FORMAT_INVALID", "WHITESPACE_ONLY", "LEADING_TRAILING_WHITESPACE", "DUPLICATE"),
                     F.lit("APPROVED"))
              .when((t == "MISSING_VALUE") & (F.col("column") == "saldo"), F.lit("CORRECTED"))
              .when(t == "OUTLIER", F.lit("CORRECTED"))
              .otherwise(F.lit("DISCARDED")))
    correction = F.when((t == "MISSING_VALUE") & (F.col("column") == "saldo"), F.lit("0"))
    ir = F.when((t == "OUTLIER") & (F.col("column") != "fecha_nacimiento"),
                F.lit(json.dumps({"op": "FILL_AGGREGATE", "agg": "median"})))
    order = F.array_position(F.array(*[F.lit(x) for x in K.ANOMALY_TYPES]), t)
    return anomalies.select(
        "anomaly_id", action.alias("action"), correction.alias("correction"), ir.alias("correction_ir"),
        F.when(ir.isNotNull(), F.lit("rule")).alias("ir_source"), F.lit(user_id).alias("user_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=order.cast("int"))).alias("created_at"))


def apply_correction(df: DataFrame, column: str, ir, mask: Column | None = None,
                     keep_means_keep: bool = False) -> tuple[str, DataFrame]:
    """Run one correction tree on the cells selected by ``mask`` (all rows by default).

    Returns the result kind (FILL / KEEP / DELETE) and the table with the column
    rewritten on those cells; raises ``IRError`` where the reference would skip the
    decision.  Rows are never removed: DELETE leaves the table as it is.
    """
    if isinstance(ir, str):
        ir = json.loads(ir)
    mask = F.lit(True) if mask is None else mask
    app = Applier(df, [], [], order_by=None)
    app.finder = type("NoFinder", (), {"df": df})()
    app.cur = {c: F.col(f"`{c}`") for c in df.columns}
    res = Compiler(column, dict(app.dtype), app.aggregate, app.split_for(mask), keep_means_keep,
                   dict(app.cur)).compile(ir)
    if res.kind in (KEEP, DELETE):
        return res.kind, df
    if res.is_scalar:
        if not app.write_scalar(column, mask, res.scalar, allow_text=False):
            raise IRError("fill value does not fit the column type")
    else:
        app.cur[column] = F.when(mask, res.column.try_cast(app.dtype[column])).otherwise(app.cur[column])
    return FILL, df.select(*[app.cur[c].alias(c) for c in df.columns])
