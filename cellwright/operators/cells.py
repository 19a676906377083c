"""Cell finders R1-R14: which cells an anomaly record covers.

Each finder is a boolean ``Column`` over the untouched table (the snapshot).  Finders
that need table-level facts get them as literals from one aggregate (z-score
moments, round-number divisor, IQR and sequence fences) or as a helper column from
a join with an aggregated frame that has one row per key (duplicates, rare values),
so the row count never changes.  ``find_cells`` turns the masks into the long
``finding`` table: (row key, column, anomaly type, value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import quantiles as Q
from ..functions.text import digit_count, dup_key, phone_key, py_str, ustrip
from ..functions.types import dtypes, is_date, is_numeric, is_string
from ..plans.profile import order_column, run_aggs
from .detect import seq_fences, seq_inside, seq_number


def _q(c):
    return F.col(f"`{c}`")


def _record(a) -> dict:
    return a if isinstance(a, dict) else a.asDict()


class CellFinder:
    """Builds masks for many anomaly records over one snapshot, batching the aggregates."""

    def __init__(self, df: DataFrame, anomalies, order_by):
        self.base = df
        self.cols = list(df.columns)
        self.types = dtypes(df)
        self.order = order_column(order_by)
        # anomaly records are review metadata: a few rows per column
        rows = anomalies.collect() if isinstance(anomalies, DataFrame) else anomalies
        self.anoms = [_record(a) for a in rows]
        self.df = df  # grows helper columns (1:1 joins)
        self.masks: dict[str, Column] = {}
        self._prepare()

    # --------------------------------------------------------------- prepare
    def _prepare(self):
        need_stats, iqr_cols, round_cols, seq = set(), set(), set(), {}
        for a in self.anoms:
            c, t = a["column"], a["anomaly_type"]
            if c not in self.types:
                continue
            if t == "OUTLIER" and is_numeric(self.types[c]):
                need_stats.add(c)
            elif t == "NUMERIC_ROUND_NUMBER" and is_numeric(self.types[c]):
                round_cols.add(c)
            elif t == "OUTLIER_IQR" and is_numeric(self.types[c]):
                iqr_cols.add(c)
            elif t == "SEQUENCE_GAP":
                prefix = (a.get("original_value") or "").split("|")[0]
                seq[(c, prefix)] = True
        aggs = {}
        for c in need_stats | round_cols | iqr_cols:
            d = _q(c).cast("double")
            aggs[f"{c}|n"], aggs[f"{c}|m"], aggs[f"{c}|s"] = F.count(d), F.avg(d), F.stddev_samp(d)
        for a in self.anoms:  # non-null counts for the rare-value threshold
            if a["anomaly_type"] == "INCONSISTENT" and a["column"] in self.types:
                aggs[f"{a['column']}|cnt"] = F.count(_q(a["column"]))
        for (c, prefix) in seq:  # how many values carry each sequence prefix
            aggs[f"{c}|{prefix}|seqn"] = F.count(F.expr(self.num_expr(c, prefix)))
        # one scan for every statistic the finders need
        self.stats = run_aggs(self.base, aggs) if aggs else {}
        reqs = []
        for c in iqr_cols:
            n = self.stats[f"{c}|n"]
            e = f"CAST(`{c}` AS DOUBLE)"
            reqs += [Q.Request(f"{c}|q1", e, Q.nearest_rank(n, 0.25), n),
                     Q.Request(f"{c}|q3", e, Q.nearest_rank(n, 0.75), n)]
        self.seq_fence = {}
        for (c, prefix) in seq:
            e = self.num_expr(c, prefix)
            n = self.stats[f"{c}|{prefix}|seqn"]
            if n == 0:
                self.seq_fence[(c, prefix)] = None
                continue
            for nm, qq in (("q1", 0.25), ("q3", 0.75), ("p10", 0.10), ("p90", 0.90)):
                reqs.append(Q.Request(f"{c}|{prefix}|{nm}", e, Q.floor_index(n, qq), n))
            self.seq_fence[(c, prefix)] = n
        self.qs = Q.kth_smallest(self.base, reqs) if reqs else {}
        dup_cols = sorted({a["column"] for a in self.anoms
                           if a["anomaly_type"] == "DUPLICATE" and a["column"] in self.types
                           and not is_date(self.types[a["column"]])})
        if dup_cols:
            self._dup_flags(dup_cols)

    def _dup_flags(self, cols: list[str]):
        """Later occurrences of repeated keys, for all duplicate columns at once.

        Three passes over the table whatever the number of columns: repeated keys per
        column, the first row of each repeated key, and the rows after it.  Keys are
        counted with map-side combine, so a key holding a third of the table costs
        one row per task before the shuffle.  The flagged row keys (usually few) are
        joined back once; the planner broadcasts them when they are small.
        """
        o = self.order
        def entries(key_fn):
            return F.explode(F.array(*[F.struct(F.lit(c).alias("c"), key_fn(c).alias("k")) for c in cols]))
        raw = self.base.select(entries(lambda c: F.when(_q(c).isNotNull(), dup_key(_q(c), c)))).select("col.*")
        reps = raw.where(F.col("k").isNotNull()).groupBy("c", "k").count().where(F.col("count") > 1).select("c", "k")

        def base_key(c):
            sx = py_str(_q(c), self.types[c])
            return F.when(_q(c).isNotNull(), dup_key(F.regexp_replace(sx, "_DUP\\z", ""), c))
        tagged = self.base.select(o.alias("__o"), entries(base_key).alias("e")).select("__o", "e.c", "e.k") \
            .where(F.col("k").isNotNull())
        firsts = tagged.join(reps, ["c", "k"], "left_semi").groupBy("c", "k").agg(F.min("__o").alias("__first"))
        flagged = (tagged.join(firsts, ["c", "k"]).where(F.col("__o") > F.col("__first"))
                   .groupBy("__o").agg(F.collect_set("c").alias("__dup_cols")))
        # materialised once in the shared checkpoint folder (reliable, survives executor
        # loss): the masks are read by several jobs, the three passes then run once
        from ..session import cut_lineage
        flagged = cut_lineage(flagged)
        self.df = self.df.join(flagged.withColumnRenamed("__o", "__dup_o"), o == F.col("__dup_o"), "left") \
            .drop("__dup_o")

    @staticmethod
    def num_expr(c: str, prefix: str) -> str:
        return seq_number(f"CAST(`{c}` AS STRING)", prefix)

    # --------------------------------------------------------------- masks
    def mask(self, a) -> Column:
        a = _record(a)
        aid = a["anomaly_id"]
        if aid not in self.masks:
            self.masks[aid] = self._build(a)
        return self.masks[aid]

    def _build(self, a) -> Column:
        c, t = a["column"], a["anomaly_type"]
        if c not in self.types:
            return F.lit(False)
        x, dt = _q(c), self.types[c]
        fn = getattr(self, "_" + t.lower(), None)
        if fn is None:
            return F.lit(False)
        m = fn(a, c, x, dt)
        return F.coalesce(m, F.lit(False))

    def _missing_value(self, a, c, x, dt):
        return x.isNull()

    def _outlier(self, a, c, x, dt):
        if is_numeric(dt):
            n, m, s = self.stats[f"{c}|n"], self.stats[f"{c}|m"], self.stats[f"{c}|s"]
            if n < 4 or s is None or s == 0:
                return F.lit(False)
            return F.abs(x.cast("double") - F.lit(m)) / F.lit(s) > K.ZSCORE_LIMIT
        if is_date(dt):
            return (F.year(x) < K.DATE_MIN_YEAR) | (F.year(x) > K.DATE_MAX_YEAR)
        return F.lit(False)

    def _duplicate(self, a, c, x, dt):
        """Second and later rows (in order) of a repeated key; a ``_DUP`` suffix is ignored."""
        if is_date(dt) or "__dup_cols" not in self.df.columns:
            return F.lit(False)
        return x.isNotNull() & F.coalesce(F.array_contains(F.col("__dup_cols"), F.lit(c)), F.lit(False))

    def _format_invalid(self, a, c, x, dt):
        if not is_string(dt):
            return F.lit(False)
        if K.is_email_name(c):
            return x.isNotNull() & ~x.rlike(K.RE_EMAIL)
        if K.is_phone_name(c):
            cl = phone_key(x)
            return x.isNotNull() & (~cl.rlike(K.RE_PHONE_DIGITS) | cl.rlike(K.RE_ALL_ZERO)
                                    | ustrip(x).rlike(K.RE_AREA_00))
        return F.lit(False)

    def _inconsistent(self, a, c, x, dt):
        """Rare values (count below max(2, 1% of n)); no distinct-count guard."""
        if not is_string(dt):
            return F.lit(False)
        i = len(self.masks)
        vc = self.base.where(x.isNotNull()).groupBy(x.alias("__v")).count()
        thr = max(2, int(self.stats[f"{c}|cnt"] * K.INCONSISTENT_SHARE))
        rare = vc.where(F.col("count") < thr).select(F.col("__v").alias(f"__rv{i}"), F.lit(True).alias(f"__rare{i}"))
        self.df = self.df.join(rare, x == F.col(f"__rv{i}"), "left").drop(f"__rv{i}")
        return F.col(f"__rare{i}")

    def _whitespace_only(self, a, c, x, dt):
        if not is_string(dt):
            return F.lit(False)
        return x.isNotNull() & (F.length(ustrip(x)) == 0) & (F.length(x) > 0)

    def _cross_field_swap(self, a, c, x, dt):
        if not is_string(dt):
            return F.lit(False)
        s = ustrip(x)
        low = F.lower(s)
        addr_word = reduce(lambda p, q: p | q, [low.contains(w) for w in K.ADDRESS_WORDS])
        email_like = s.rlike(K.RE_SWAP_EMAIL_PREFIX)
        conds = []
        is_name, is_phone = K.is_name_name(c), K.is_phone_name(c)
        if is_name:
            conds += [email_like, s.rlike(K.RE_SWAP_DATE)]
        if K.is_email_name(c):
            conds += [s.rlike(K.RE_SWAP_PHONE_IN_EMAIL) & ~s.contains("@"), ~email_like & addr_word]
        if K.is_address_name(c):
            conds += [email_like, s.rlike(K.RE_SWAP_ID_IN_ADDRESS)]
        if is_phone:
            conds += [email_like, addr_word]
        if is_name:
            conds += [s.rlike(K.RE_SWAP_LOCALITY)]
        if not is_phone:
            conds += [s.rlike(K.RE_SWAP_PHONE) & (digit_count(s) >= 7)]
        if not conds:
            return F.lit(False)
        return x.isNotNull() & reduce(lambda p, q: p | q, conds)

    def _suspicious_placeholder(self, a, c, x, dt):
        s = ustrip(py_str(x, dt))
        return x.isNotNull() & (F.lower(s).isin(list(K.PLACEHOLDERS)) | s.isin(list(K.ZERO_PLACEHOLDERS)))

    def _leading_trailing_whitespace(self, a, c, x, dt):
        if not is_string(dt):
            return F.lit(False)
        return x.isNotNull() & (x != ustrip(x)) & (F.length(ustrip(x)) > 0)

    def _date_logical(self, a, c, x, dt):
        e = a.get("related_column")
        if not e or e not in self.types:
            return F.lit(False)
        return x.isNotNull() & _q(e).isNotNull() & (x > _q(e))

    def _numeric_round_number(self, a, c, x, dt):
        if not is_numeric(dt):
            return F.lit(False)
        n, m = self.stats[f"{c}|n"], self.stats[f"{c}|m"]
        if n < K.ROUND_MIN_ROWS or m is None or m == 0:
            return F.lit(False)
        div = 1000.0 if abs(m) >= 1000 else 100.0
        return x.isNotNull() & (x.cast("double") % F.lit(div) == 0.0)

    def _low_variance(self, a, c, x, dt):
        if is_numeric(dt):
            return F.lit(False)
        dom = a.get("original_value")
        if dom is None:
            row = (self.base.where(x.isNotNull()).groupBy(py_str(x, dt).alias("v")).count()
                   .agg(F.min(F.struct((-F.col("count")).alias("nc"), F.col("v").alias("v")))).collect()[0][0])
            if row is None:
                return F.lit(False)
            dom = row["v"]
        return x.isNotNull() & (ustrip(py_str(x, dt)) == F.lit(dom.strip()))

    def _outlier_iqr(self, a, c, x, dt):
        if not is_numeric(dt):
            return F.lit(False)
        n = self.stats[f"{c}|n"]
        q1, q3 = self.qs.get(f"{c}|q1"), self.qs.get(f"{c}|q3")
        if n < 4 or q1 is None or q3 is None or q3 - q1 <= 0:
            return F.lit(False)
        iqr = q3 - q1
        d = x.cast("double")
        return (d < F.lit(q1 - K.IQR_FACTOR * iqr)) | (d > F.lit(q3 + K.IQR_FACTOR * iqr))

    def _sequence_gap(self, a, c, x, dt):
        prefix = (a.get("original_value") or "").split("|")[0]
        if not self.seq_fence.get((c, prefix)):
            return F.lit(False)
        _, lo, hi = seq_fences({k: self.qs[f"{c}|{prefix}|{k}"] for k in ("q1", "q3", "p10", "p90")})
        num = F.expr(self.num_expr(c, prefix))
        return num.isNotNull() & ~seq_inside(num, lo, hi)


FINDING_COLUMNS = ["row_key", "column", "anomaly_type", "anomaly_id", "value"]


def find_cells(df: DataFrame, anomalies, order_by, finder: "CellFinder | None" = None) -> DataFrame:
    """Long-form findings: one row per affected cell of every anomaly record.

    One scan: the masks of all records are evaluated in a single projection, then
    ``explode`` keeps the (record, cell) pairs that hold.  The row key is the
    ``order_by`` column.
    """
    # a finder built once can serve find_cells and apply_decisions on the same table
    finder = finder or CellFinder(df, anomalies, order_by)
    anoms = [a for a in finder.anoms if a["column"] in finder.types]
    if not anoms:
        return df.sparkSession.createDataFrame(
            [], "row_key long, column string, anomaly_type string, anomaly_id string, value string")
    masks = [(a, finder.mask(a)) for a in anoms]
    hits = F.array(*[F.when(m, F.struct(F.lit(a["column"]).alias("column"), F.lit(a["anomaly_type"]).alias("anomaly_type"),
                                        F.lit(a["anomaly_id"]).alias("anomaly_id"),
                                        py_str(_q(a["column"]), finder.types[a["column"]]).alias("value")))
                     for a, m in masks])
    out = finder.df.select(order_column(order_by).alias("row_key"), F.explode(F.array_compact(hits)).alias("h"))
    return out.select("row_key", "h.column", "h.anomaly_type", "h.anomaly_id", "h.value")
