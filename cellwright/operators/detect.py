"""Anomaly detectors D1-D18: ``detect_anomalies(df, dataset_id, order_by) -> anomaly DataFrame``.

One record per column and type (per start/end pair for dates), holding the number
of affected cells.  The work is a few shared passes over the table:

1. pass 1 – one aggregate with every row-local counter and the first hit of each
   rule (then a keyed fetch of those few example rows);
2. V – the value-count frame (mode, duplicates, rare values, low variance, prefixes), for the
   columns that sketches of distinct values and heavy hitters leave over;
3. pass 2 – the counters that need pass-1 literals (z-score, round numbers) in the
   same scan as the exact order statistics (IQR quartiles, medians, sequence
   quartiles; see ``functions.quantiles``);
4. pass 3 – IQR and sequence counters with the fence literals;
5. one pass with the counters of the wrong-field rules, over all non-null values
   (a threshold on the order key from the order statistics, then one scan).

Every value that reaches the driver is per column; descriptions and suggested
values are formatted there with Python's ``str`` so numbers print as the
reference prints them.
"""

from __future__ import annotations

import hashlib
import math
import re
from datetime import datetime, timezone
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import quantiles as Q
from ..functions.text import count_if, digit_count, email_valid, first_by, phone_valid, ustrip
from ..functions.types import dtypes, kind_of
from ..plans.profile import (KEY, PREFIX, RAW, fetch_values, least_values, order_column, persist, run_aggs,
                             value_counts, value_text)
from ..session import spread, written

ANOMALY_SCHEMA = T.StructType([
    T.StructField("anomaly_id", T.StringType(), False),
    T.StructField("dataset_id", T.StringType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("anomaly_type", T.StringType(), False),
    T.StructField("affected", T.LongType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("original_value", T.StringType(), True),
    T.StructField("suggested_value", T.StringType(), True),
    T.StructField("related_column", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])


def anomaly_id(dataset_id: str, column: str, atype: str, related: str | None) -> str:
    """Deterministic id: a re-run of the same job yields the same ids."""
    return hashlib.sha256(f"{dataset_id}|{column}|{atype}|{related or ''}".encode()).hexdigest()


# Sequence numbers have any number of digits.  They are handled as keys, texts that sort as the
# numbers do: the count of digits (ten characters), then the digits without leading zeros.
def seq_number(column: str, prefix: str) -> str:
    """SQL: the key of a value's number where it has the given prefix, else null."""
    pe = prefix.replace("\\", "\\\\").replace("'", "\\'")
    pat = K.RE_SEQUENCE.replace("\\", "\\\\")
    digits = f"regexp_replace(regexp_extract({column}, '{pat}', 2), '^0+(?=[0-9])', '')"
    return (f"CASE WHEN {column} RLIKE '{pat}' AND regexp_extract({column}, '{pat}', 1) = '{pe}' "
            f"THEN concat(lpad(CAST(length({digits}) AS STRING), 10, '0'), {digits}) END")


def seq_next(key: Column) -> Column:
    """The key of the number after a key's: the nines at the end become zeros, the digit before them one more."""
    d = F.concat(F.lit("0"), F.substring(key, 11, 2**31 - 1))
    head, digit, nines = (F.regexp_extract(d, "^(.*?)([0-8])(9*)$", i) for i in (1, 2, 3))
    more = F.regexp_replace(F.concat(head, (digit.cast("int") + 1).cast("string"), F.repeat(F.lit("0"), F.length(nines))),
                            "^0+(?=[0-9])", "")
    return F.concat(F.lpad(F.length(more).cast("string"), 10, "0"), more)


def seq_digits(n: int | float) -> str:
    """Text of a number; ``str`` refuses very long ints."""
    return str(n) if isinstance(n, float) else format(Decimal(n), "f")


def seq_key(n: int) -> str:
    return f"{len(seq_digits(n)):010d}{seq_digits(n)}"


def seq_int(key: str | None) -> int | None:
    return None if key is None else int(Decimal(key[10:]))


def holes(df: DataFrame, num: Column, slices: int | None = None) -> tuple[int, str | None]:
    """Number of different keys, and the smallest key that is not the largest and whose successor
    is missing.

    The keys are range-partitioned, without repeats inside a slice (equal keys share one), and
    written once.  Inside a slice each key looks at the next; the last key of a slice looks at the
    first one of the next slice that has any, by a window over one row per slice."""
    keys = df.select(num.alias("x")).where(F.col("x").isNotNull()).distinct()
    keys = keys.repartitionByRange(slices, "x") if slices else keys.repartitionByRange("x")
    keys = written(keys.withColumn("slice", F.spark_partition_id()), "sequence")
    after = F.lead("x").over(Window.partitionBy("slice").orderBy("x"))
    hole = F.col("after").isNotNull() & (F.col("after") != seq_next(F.col("x")))
    ends = keys.withColumn("after", after).groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(F.when(hole, F.col("x"))).alias("first"))
    borders = ends.withColumn("after", F.lead("lo").over(Window.partitionBy(F.lit(0)).orderBy("lo")))
    at_border = F.when(F.col("after").isNotNull() & (F.col("after") != seq_next(F.col("hi"))), F.col("hi"))
    return borders.agg(F.sum("n"), F.min(F.coalesce("first", at_border))).first()


def seq_fences(g: dict) -> tuple:
    """IQR and fences of the keys q1, q3, p10, p90: the reference's floats, or exact fractions
    where a float cannot hold them."""
    q1, q3, p10, p90 = (seq_int(g[k]) for k in ("q1", "q3", "p10", "p90"))
    iqr = q3 - q1
    if iqr <= 0:
        return iqr, p10, p90
    try:
        lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        if math.isfinite(lo) and math.isfinite(hi):
            return iqr, lo, hi
    except OverflowError:
        pass
    return iqr, q1 - Fraction(3 * iqr, 2), q3 + Fraction(3 * iqr, 2)


def seq_inside(num: Column, lo, hi) -> Column:
    """Whether a number's key is within the fences, compared exactly."""
    low, high = math.ceil(lo), math.floor(hi)
    return (num >= seq_key(max(low, 0))) & ((num <= seq_key(high)) if high >= 0 else F.lit(False))


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _s(v) -> str | None:
    return None if v is None else str(v)


def say(count, what: str, **facts) -> str:
    """Description of a record: how many cells, what is odd about them, and the facts behind it."""
    details = "; ".join(f"{k}: {v}" for k, v in facts.items())
    return f"{count} cells {what}" + (f" ({details})" if details else "")


def _tokens(name: str) -> set:
    return set(re.split(r"[\s_\-]+", name.lower()))


class Detector:
    def __init__(self, df: DataFrame, dataset_id: str, order_by, types=None):
        self.df = df
        self.dataset_id = dataset_id
        self.order = order_column(order_by)
        self.order_by = order_by
        self.want = set(types or K.ANOMALY_TYPES)
        self.types = dtypes(df)
        self.cols = list(df.columns)
        self.kind = {c: kind_of(t) for c, t in self.types.items()}
        self.records: list[dict] = []

    # ----------------------------------------------------------------- helpers
    def emit(self, column, atype, affected, description, original=None, suggested=None, related=None):
        self.records.append({
            "anomaly_id": anomaly_id(self.dataset_id, column, atype, related),
            "dataset_id": self.dataset_id, "column": column, "anomaly_type": atype,
            "affected": int(affected), "description": description, "original_value": original,
            "suggested_value": suggested, "related_column": related, "status": "PENDING",
        })

    def of(self, *kinds):
        return [c for c in self.cols if self.kind[c] in kinds]

    def date_pairs(self):
        dates = self.of("date")
        if len(dates) < 2:
            return []
        starts = [c for c in dates if _tokens(c) & set(K.START_DATE_TOKENS)]
        ends = [c for c in dates if _tokens(c) & set(K.END_DATE_TOKENS)]
        if not starts or not ends:
            return []
        return [(s, e) for s in starts for e in ends if s != e]

    # ----------------------------------------------------------------- passes
    def pass1(self):
        a: dict[str, Column] = {}
        ex: dict[str, tuple[Column, Column]] = {}   # example name -> (value, condition)
        for c in self.cols:
            x = _q(c)
            a[f"{c}|nulls"] = count_if(x.isNull())
            a[f"{c}|n"] = F.count(x)
            k = self.kind[c]
            if k == "numeric":
                d = x.cast("double")
                a[f"{c}|mean"] = F.avg(d)
                a[f"{c}|std"] = F.stddev_samp(d)
            elif k == "string":
                stripped = ustrip(x)
                if K.is_email_name(c):
                    bad = x.isNotNull() & ~email_valid(x)
                    a[f"{c}|fmt"], ex[f"{c}|fmt_ex"] = count_if(bad), (x, bad)
                elif K.is_phone_name(c):
                    bad = x.isNotNull() & ~phone_valid(x)
                    a[f"{c}|fmt"], ex[f"{c}|fmt_ex"] = count_if(bad), (x, bad)
                ws = x.isNotNull() & (F.length(stripped) == 0)
                a[f"{c}|ws"], ex[f"{c}|ws_ex"] = count_if(ws), (x, ws)
                ph = F.lower(stripped).isin(list(K.PLACEHOLDERS))
                a[f"{c}|ph"], ex[f"{c}|ph_ex"] = count_if(ph), (x, ph)
                pad = (x != stripped) & (F.length(stripped) > 0)
                a[f"{c}|pad"], ex[f"{c}|pad_ex"] = count_if(pad), (x, pad)
                ex[f"{c}|pad_fix"] = (stripped, pad)
                if K.is_name_name(c):
                    em = x.rlike(K.RE_EMAIL)
                    a[f"{c}|em"], ex[f"{c}|em_ex"] = count_if(em), (x, em)
                a[f"{c}|seq"] = count_if(x.rlike(K.RE_SEQUENCE))
            elif k == "date":
                yr = F.year(x)
                bad = (yr < K.DATE_MIN_YEAR) | (yr > K.DATE_MAX_YEAR)
                a[f"{c}|yr"], ex[f"{c}|yr_ex"] = count_if(bad), (x, bad)
        for s, e in self.date_pairs():
            both = _q(s).isNotNull() & _q(e).isNotNull()
            inv = both & (_q(s).cast("date") > _q(e).cast("date"))
            a[f"{s}>{e}|inv"] = count_if(inv)
            ex[f"{s}>{e}|inv_ex"] = (F.struct(_q(s).alias("s"), _q(e).alias("e")), inv)
        self.p1 = self._with_examples(a, ex)

    def _numeric_order(self) -> bool:
        odt = self.types.get(self.order_by if isinstance(self.order_by, str) else
                             (self.order_by[0] if len(self.order_by) == 1 else None))
        return isinstance(odt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType,
                                T.DecimalType))

    def _fast_examples(self) -> bool:
        odt = self.types.get(self.order_by if isinstance(self.order_by, str) else
                             (self.order_by[0] if len(self.order_by) == 1 else None))
        return isinstance(odt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))

    def _example_aggs(self, ex: dict) -> dict:
        """Aggregates locating the first hit of each example rule.

        With a single integral order column the first hit is ``min(order)`` (a
        fixed-width buffer, so the aggregate stays a code-generated hash aggregate)
        and the example rows are fetched by key afterwards; otherwise ``min_by`` gives
        the value in the same pass."""
        if self._fast_examples():
            return {f"{n}|pos": F.min(F.when(c, self.order)) for n, (v, c) in ex.items()}
        return {n: first_by(v, c, self.order) for n, (v, c) in ex.items()}

    def _resolve_examples(self, out: dict, ex: dict) -> dict:
        """Turn first-hit positions into example values with one keyed fetch."""
        if not ex or not self._fast_examples():
            return out
        o = self.order
        found = {n: p for n in ex if (p := out.pop(f"{n}|pos", None)) is not None}
        # of rows that share the order key, the least value where the rule holds
        hits = self.df.where(o.isin(sorted(set(found.values())))) if found else None
        out |= dict.fromkeys(ex)
        out |= run_aggs(hits, {n: F.min(F.when((o == p) & ex[n][1], ex[n][0])) for n, p in found.items()}) if found else {}
        return out

    def _with_examples(self, a: dict, ex: dict) -> dict:
        """Counters plus first-hit examples (one aggregate, then one keyed fetch)."""
        return self._resolve_examples(run_aggs(self.df, {**a, **self._example_aggs(ex)}), ex)

    #: Sketched distinct counts only rule columns out, with this much to spare (rsd is 0.05).
    SPARE = 1.6
    #: Columns with more distinct values than this are asked for a heavy hitter before V counts them.
    HEAVY_FROM = 1_000

    def v_entries(self) -> list[tuple]:
        """(column, kind) pairs that some rule can still concern, chosen by distinct-count and
        heavy-hitter sketches."""
        w, p1 = self.want, self.p1
        cols = [c for c in self.cols if self.kind[c] != "date" and p1[f"{c}|n"]]
        if not cols:
            return []
        row = self.df.agg(*[F.approx_count_distinct(_q(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
        est = {c: row[f"d{i}"] for i, c in enumerate(cols)}
        out, heavy = [], []
        for c in cols:
            n, text = p1[f"{c}|n"], self.kind[c] == "string"
            raw = bool("MISSING_VALUE" in w and self._needs_mode(c))
            if "DUPLICATE" in w and n >= K.DUP_MIN_ROWS and est[c] * self.SPARE >= self._dup_ratio(c) * n:
                if self._dup_kind(c) == KEY:
                    out.append((c, KEY))
                else:
                    raw = True
            raw |= "INCONSISTENT" in w and text and n >= K.INCONSISTENT_MIN_ROWS and est[c] <= self.SPARE * K.INCONSISTENT_MAX_DISTINCT
            if "SEQUENCE_GAP" in w and text and n >= K.SEQ_MIN_ROWS and est[c] * self.SPARE >= K.SEQ_UNIQUE_RATIO * n \
                    and p1[f"{c}|seq"] / n >= K.SEQ_MATCH_SHARE:
                raw = True
                out.append((c, PREFIX))
            if not raw and "LOW_VARIANCE" in w and text and not K.is_id_name(c) and n > K.LOW_VAR_MIN_ROWS \
                    and est[c] <= self.SPARE * ((1 - K.LOW_VAR_TOP_SHARE) * n + 1):
                if est[c] > self.HEAVY_FROM:
                    heavy.append(c)
                else:
                    raw = True
            if raw:
                out.append((c, RAW))
        if heavy:  # estimates are never below the true count
            top = self.df.agg(*[F.expr(f"approx_top_k(xxhash64(`{c}`), 1, 100) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"t{i}")
                                for i, c in enumerate(heavy)]).first()
            out += [(c, RAW) for i, c in enumerate(heavy)
                    if top[f"t{i}"] and top[f"t{i}"][0]["count"] >= K.LOW_VAR_TOP_SHARE * p1[f"{c}|n"]]
        return out

    def _needs_mode(self, c: str) -> bool:
        return bool(self.p1[f"{c}|nulls"] and self.p1[f"{c}|n"] and self.kind[c] in ("string", "boolean")
                    and not (K.is_phone_name(c) or K.is_address_name(c)))

    def _dup_kind(self, c: str) -> int:
        return KEY if K.is_email_name(c) or K.is_phone_name(c) else RAW

    def _dup_ratio(self, c: str) -> float:
        return K.DUP_RATIO_ID if K.is_id_name(c) or K.is_email_name(c) or K.is_phone_name(c) else K.DUP_RATIO_OTHER

    def _duplicated(self, c: str) -> bool:
        s, n = self.vs.get((c, self._dup_kind(c))), self.p1[f"{c}|n"]
        return bool(s and n >= K.DUP_MIN_ROWS and s["distinct"] / n >= self._dup_ratio(c) and s["dup_values"])

    def _few_categories(self, c: str) -> bool:
        s, n = self.vs.get((c, RAW)), self.p1[f"{c}|n"]
        return bool(s and self.kind[c] == "string" and n >= K.INCONSISTENT_MIN_ROWS and s["distinct"] <= K.INCONSISTENT_MAX_DISTINCT
                    and s["distinct"] / n < K.INCONSISTENT_MAX_RATIO and s["rare_sum"])

    def _one_sided(self, c: str) -> bool:
        s, n = self.vs.get((c, RAW)), self.p1[f"{c}|n"]
        return bool(s and self.kind[c] == "string" and not K.is_id_name(c) and n > K.LOW_VAR_MIN_ROWS
                    and s["max_cnt"] / n >= K.LOW_VAR_TOP_SHARE)

    def build_v(self):
        """Counts of the chosen entries, and the values that records will show."""
        self.entries = self.v_entries()
        self.vs = {}
        if not self.entries:
            return
        v = persist(value_counts(self.df, self.entries))
        self.thr = {c: max(2, int(self.p1[f"{c}|n"] * K.INCONSISTENT_SHARE)) for c in self.cols}
        t = F.element_at(F.array(*[F.lit(self.thr[c]) for c, _ in self.entries]), F.col("entry") + 1)
        for r in v.groupBy("entry").agg(
                F.count(F.lit(1)).alias("distinct"), F.max("cnt").alias("max_cnt"),
                F.sum(F.when(F.col("cnt") > 1, F.col("cnt") - 1)).alias("dup_extra"),
                count_if(F.col("cnt") > 1).alias("dup_values"),
                F.sum(F.when(F.col("cnt") < t, F.col("cnt"))).alias("rare_sum")).collect():
            self.vs[self.entries[r["entry"]]] = r.asDict()
        w = self.want
        tops, listed = {}, []
        for i, (c, kind) in enumerate(self.entries):
            s = self.vs.get((c, kind))
            if s is None:
                continue
            if (kind == PREFIX or ("DUPLICATE" in w and kind == self._dup_kind(c) and self._duplicated(c))
                    or kind == RAW and ("MISSING_VALUE" in w and self._needs_mode(c) or "LOW_VARIANCE" in w and self._one_sided(c))):
                tops[i] = s["max_cnt"]
            if kind == RAW and "INCONSISTENT" in w and self._few_categories(c):
                listed.append(i)
        for i, text in least_values(self.df, self.entries, v, tops).items():
            self.vs[self.entries[i]]["mode"] = text
        if listed:  # at most INCONSISTENT_MAX_DISTINCT values a column
            keys = v.where(F.col("entry").isin(listed))
            counts = {(r["entry"], r["h1"], r["h2"]): r["cnt"] for r in keys.collect()}
            for r in fetch_values(self.df, self.entries, keys, listed):
                self.vs[self.entries[r["entry"]]].setdefault("values", []).append(
                    (counts[r["entry"], r["h1"], r["h2"]], value_text(r["v"])))
        v.unpersist()

    def pass2_aggs(self) -> dict:
        """Counters that need pass-1 literals (z-score, round numbers); evaluated in
        the same scan as the order statistics."""
        a: dict[str, Column] = {}
        self.z_cols, self.round_cols, self.ex2 = [], {}, {}
        want_z = bool(self.want & {"OUTLIER", "OUTLIER_IQR"})
        for c in self.of("numeric"):
            n, mean, std = self.p1[f"{c}|n"], self.p1[f"{c}|mean"], self.p1[f"{c}|std"]
            d = _q(c).cast("double")
            if n >= 4 and std is not None and std != 0 and want_z:
                a[f"{c}|z"] = count_if(F.abs(d - F.lit(mean)) / F.lit(std) > K.ZSCORE_LIMIT)
                self.z_cols.append(c)
            if ("NUMERIC_ROUND_NUMBER" in self.want and not K.is_id_name(c) and n >= K.ROUND_MIN_ROWS
                    and mean is not None and std is not None and mean != 0 and not std < abs(mean) * K.ROUND_MIN_CV):
                div = 1000.0 if abs(mean) >= 1000 else 100.0
                hit = d % F.lit(div) == 0.0
                a[f"{c}|rnd"] = count_if(hit)
                self.ex2[f"{c}|rnd_ex"] = (d, hit)
                self.round_cols[c] = div
        return {**a, **self._example_aggs(self.ex2)}

    def iqr_requests(self) -> list:
        """Nearest-rank Q1/Q3 and the two middle values of every numeric column with 4+
        values; columns with a z-score record are dropped afterwards."""
        if "OUTLIER_IQR" not in self.want:
            return []
        reqs = []
        for c in self.of("numeric"):
            n = self.p1[f"{c}|n"]
            if n < 4:
                continue
            e = f"CAST(`{c}` AS DOUBLE)"
            reqs += [Q.Request(f"{c}|q1", e, Q.nearest_rank(n, 0.25), n),
                     Q.Request(f"{c}|q3", e, Q.nearest_rank(n, 0.75), n),
                     Q.Request(f"{c}|m1", e, (n - 1) // 2, n), Q.Request(f"{c}|m2", e, n // 2, n)]
        return reqs

    def iqr_aggs(self, qs: dict) -> dict:
        """Outside-fence counters for the IQR rule (fences as literals)."""
        self.ex3 = {}
        if "OUTLIER_IQR" not in self.want:
            return {}
        flagged = {r["column"] for r in self.records if r["anomaly_type"] == "OUTLIER"}
        a, self.fences, self.ex3 = {}, {}, {}
        for c in self.of("numeric"):
            if c in flagged or self.p1[f"{c}|n"] < 4:
                continue
            q1, q3 = qs[f"{c}|q1"], qs[f"{c}|q3"]
            if q1 is None or q3 is None or q3 - q1 == 0:
                continue
            iqr = q3 - q1
            lo, hi = q1 - K.IQR_FACTOR * iqr, q3 + K.IQR_FACTOR * iqr
            d = _q(c).cast("double")
            out = (d < F.lit(lo)) | (d > F.lit(hi))
            a[f"{c}|iqr"] = count_if(out)
            self.ex3[f"{c}|iqr_ex"] = (d, out)
            self.fences[c] = (q1, q3, iqr, lo, hi, (qs[f"{c}|m1"] + qs[f"{c}|m2"]) / 2.0)
        return {**a, **self._example_aggs(self.ex3)}

    def iqr_emit(self, vals: dict):
        for c, (q1, q3, iqr, lo, hi, med) in getattr(self, "fences", {}).items():
            cnt = vals[f"{c}|iqr"]
            if not cnt:
                continue
            ex = str(vals[f"{c}|iqr_ex"])
            self.emit(c, "OUTLIER_IQR", cnt,
                      say(cnt, "outside the quartile fences", example=ex, low=f"{lo:.2f}", high=f"{hi:.2f}",
                          q1=f"{q1:.2f}", q3=f"{q3:.2f}", spread=f"{iqr:.2f}"), ex, str(med))

    # ----------------------------------------------------------------- D1
    def missing(self):
        for c in self.cols:
            nulls = self.p1[f"{c}|nulls"]
            if not nulls:
                continue
            k, n = self.kind[c], self.p1[f"{c}|n"]
            if k == "numeric":
                fill = "0" if n == 0 else str(float(self.p1[f"{c}|mean"]))
            elif k in ("string", "boolean"):
                fill = "" if n == 0 else self.vs.get((c, RAW), {}).get("mode")
            else:
                fill = "null"
            if K.is_phone_name(c) or K.is_address_name(c):
                fill = None
            self.emit(c, "MISSING_VALUE", nulls, say(nulls, "empty"), None, fill)

    # ----------------------------------------------------------------- D2, D7
    def outliers(self):
        for c in self.z_cols:
            cnt = self.p2.get(f"{c}|z")
            if cnt:
                self.emit(c, "OUTLIER", cnt, say(cnt, "far from the mean"), None,
                          str(float(self.p1[f"{c}|mean"])))

    def date_outliers(self):
        for c in self.of("date"):
            cnt = self.p1.get(f"{c}|yr")
            if cnt:
                ex = str(self.p1[f"{c}|yr_ex"])
                self.emit(c, "OUTLIER", cnt,
                          say(cnt, "with an unlikely year", example=ex, first=K.DATE_MIN_YEAR, last=K.DATE_MAX_YEAR), ex, None)

    # ----------------------------------------------------------------- D3
    def duplicates(self):
        for c in self.cols:
            if self.kind[c] == "date":
                continue
            if not self._duplicated(c):
                continue
            s = self.vs[(c, self._dup_kind(c))]
            extra, ex = int(s["dup_extra"]), s["mode"]
            self.emit(c, "DUPLICATE", extra,
                      say(extra, "repeating an earlier one", example=ex, values=s["dup_values"]), ex, K.LABEL_DUPLICATE)

    # ----------------------------------------------------------------- D4, D5
    def formats(self):
        for c in self.of("string"):
            if self.p1[f"{c}|n"] == 0 or f"{c}|fmt" not in self.p1:
                continue
            cnt = self.p1[f"{c}|fmt"]
            if not cnt:
                continue
            email = K.is_email_name(c)
            hint = "email address" if email else "phone number"
            ex = self.p1[f"{c}|fmt_ex"]
            self.emit(c, "FORMAT_INVALID", cnt,
                      say(cnt, f"not a well-formed {hint}", example=ex), ex, K.LABEL_EMAIL_INVALID if email else K.LABEL_PHONE_INVALID)

    # ----------------------------------------------------------------- D6
    def inconsistent(self):
        for c in self.of("string"):
            if not self._few_categories(c):
                continue
            s = self.vs[(c, RAW)]
            ranked = sorted(((-n, x.encode()), n, x) for n, x in s["values"])
            common = [x for _, n, x in ranked if n >= self.thr[c]]
            rare = [x for _, n, x in ranked if n < self.thr[c]]
            rare_sum = int(s["rare_sum"])
            self.emit(c, "INCONSISTENT", rare_sum,
                      say(rare_sum, "of a rare category", example=rare[0], common=common[:5]), rare[0],
                      common[0] if common else None)

    # ----------------------------------------------------------------- D8, D10, D11
    def text_rules(self):
        for c in self.of("string"):
            if self.p1[f"{c}|n"] == 0:
                continue
            if "WHITESPACE_ONLY" in self.want and self.p1[f"{c}|ws"]:
                cnt = self.p1[f"{c}|ws"]
                self.emit(c, "WHITESPACE_ONLY", cnt,
                          say(cnt, "blank but not null"), repr(self.p1[f"{c}|ws_ex"]), None)
            if "SUSPICIOUS_PLACEHOLDER" in self.want and self.p1[f"{c}|ph"]:
                cnt, ex = self.p1[f"{c}|ph"], self.p1[f"{c}|ph_ex"]
                self.emit(c, "SUSPICIOUS_PLACEHOLDER", cnt,
                          say(cnt, "standing in for a missing one", example=ex), ex, K.LABEL_PLACEHOLDER)
            if "LEADING_TRAILING_WHITESPACE" in self.want and self.p1[f"{c}|pad"]:
                cnt, raw, fix = self.p1[f"{c}|pad"], self.p1[f"{c}|pad_ex"], self.p1[f"{c}|pad_fix"]
                self.emit(c, "LEADING_TRAILING_WHITESPACE", cnt,
                          say(cnt, "padded with white space", example=repr(raw)), raw, fix)

    # ----------------------------------------------------------------- D9
    def swaps(self):
        cols = [c for c in self.of("string") if self.p1[f"{c}|n"] > 0]
        if not cols:
            return
        def rules(v: Column) -> dict[str, Column]:
            st, nonempty = ustrip(v), v != ""
            return {
                "date": nonempty & v.rlike(K.RE_SWAP_DATE),
                "phone": nonempty & st.rlike(K.RE_SWAP_PHONE) & (digit_count(v) >= 7),
                "phone_email": nonempty & st.rlike(K.RE_SWAP_PHONE_IN_EMAIL) & ~v.contains("@"),
                "email_addr": nonempty & v.rlike(K.RE_SWAP_EMAIL_PREFIX),
                "id_addr": nonempty & st.rlike(K.RE_SWAP_ID_IN_ADDRESS),
                "locality": nonempty & st.rlike(K.RE_SWAP_LOCALITY),
            }

        # every non-null value, in shared scans, by the rules that the column's name lets apply
        asked = {c: [name for name, on in (("date", K.is_name_name(c)), ("phone", not K.is_phone_name(c)),
                                           ("phone_email", K.is_email_name(c)), ("email_addr", K.is_address_name(c)),
                                           ("id_addr", K.is_address_name(c)), ("locality", K.is_name_name(c))) if on] for c in cols}
        hits = {f"{c}|{name}": rules(_q(c))[name] for c in cols for name in asked[c]}
        got = self._with_examples({k: count_if(x) for k, x in hits.items()},
                                  {f"{k}_ex": (_q(k.rpartition("|")[0]), x) for k, x in hits.items()})
        stats = {c: {"n": self.p1[f"{c}|n"], **{name: got[f"{c}|{name}"] for name in asked[c]},
                     **{f"{name}_ex": got[f"{c}|{name}_ex"] for name in asked[c]}} for c in cols}
        for c in cols:
            s = stats[c]
            is_name, is_phone = K.is_name_name(c), K.is_phone_name(c)
            is_email, is_addr = K.is_email_name(c), K.is_address_name(c)
            found = None
            if is_name and self.p1.get(f"{c}|em"):
                found = ("EMAIL_EN_NOMBRE", self.p1[f"{c}|em"], self.p1[f"{c}|em_ex"])
            if found is None and is_name and s["date"]:
                found = ("FECHA_EN_NOMBRE", s["date"], s["date_ex"])
            if found is None and not is_phone and s["phone"] and s["phone"] / max(s["n"], 1) > K.SWAP_PHONE_SHARE:
                found = ("TELEFONO_EN_COLUMNA_INCORRECTA", s["phone"], s["phone_ex"])
            if found is None and is_email and s["phone_email"]:
                found = ("TELEFONO_EN_EMAIL", s["phone_email"], s["phone_email_ex"])
            if found is None and is_addr and s["email_addr"]:
                found = ("EMAIL_EN_DIRECCION", s["email_addr"], s["email_addr_ex"])
            if found is None and is_addr and s["id_addr"]:
                found = ("ID_EN_DIRECCION", s["id_addr"], s["id_addr_ex"])
            if found is None and is_name and s["locality"]:
                found = ("LOCALIDAD_EN_NOMBRE", s["locality"], s["locality_ex"])
            if found is None:
                continue
            kind, cnt, ex = found
            self.emit(c, "CROSS_FIELD_SWAP", cnt,
                      say(cnt, "that look like another field's", example=ex, rule=kind), ex, K.LABEL_WRONG_FIELD)

    # ----------------------------------------------------------------- D12
    def date_logic(self):
        for s, e in self.date_pairs():
            cnt = self.p1[f"{s}>{e}|inv"]
            if not cnt:
                continue
            ex = self.p1[f"{s}>{e}|inv_ex"]
            es, ee = str(ex["s"]), str(ex["e"])
            self.emit(s, "DATE_LOGICAL", cnt,
                      say(cnt, f"later than {e}", example=f"{es} > {ee}"),
                      f"{s}={es} | {e}={ee}", None, related=e)

    # ----------------------------------------------------------------- D13
    def round_numbers(self):
        for c, div in self.round_cols.items():
            cnt, n = self.p2[f"{c}|rnd"], self.p1[f"{c}|n"]
            ratio = cnt / n
            if ratio <= K.ROUND_SHARE:
                continue
            ex = str(self.p2[f"{c}|rnd_ex"])
            self.emit(c, "NUMERIC_ROUND_NUMBER", cnt,
                      say(cnt, f"divisible by {int(div)}", example=ex, share=f"{ratio:.0%}"), ex, None)

    # ----------------------------------------------------------------- D14, D15
    def low_variance(self):
        for c in self.cols:
            if K.is_id_name(c):
                continue
            n = self.p1[f"{c}|n"]
            if self.kind[c] == "numeric":
                mean, std = self.p1[f"{c}|mean"], self.p1[f"{c}|std"]
                if n <= K.LOW_VAR_MIN_ROWS or mean is None or std is None or mean == 0:
                    continue
                cv = std / abs(mean)
                if cv >= K.LOW_VAR_CV:
                    continue
                self.emit(c, "LOW_VARIANCE", n,
                          say(n, "nearly constant", mean=f"{mean:.4f}", variation=f"{cv:.4f}"),
                          str(round(mean, 4)), None)
            elif self.kind[c] == "string":
                if not self._one_sided(c):
                    continue
                s = self.vs[(c, RAW)]
                share, top = s["max_cnt"] / n, s["mode"]
                self.emit(c, "LOW_VARIANCE", n,
                          say(n, "mostly one and the same", example=top, share=f"{share:.0%}"), top, K.LABEL_LOW_VARIANCE)

    # ----------------------------------------------------------------- D17, D18
    def sequence_candidates(self) -> list:
        """(column, dominant prefix, its count) for text columns that look sequential."""
        if "SEQUENCE_GAP" not in self.want:
            return []
        chosen = []
        for c in self.of("string"):
            n, s, prefixes = self.p1[f"{c}|n"], self.vs.get((c, RAW)), self.vs.get((c, PREFIX))
            if prefixes is None or s["distinct"] / n < K.SEQ_UNIQUE_RATIO:
                continue
            # dominant prefix: highest count, ties to the smallest prefix
            dom = prefixes["max_cnt"]
            if dom / n >= K.SEQ_PREFIX_SHARE and dom >= 2:
                chosen.append((c, prefixes["mode"], dom))
        return chosen

    def num_expr(self, c: str, prefix: str) -> str:
        return seq_number(f"`{c}`", prefix)

    def sequence_requests(self, chosen) -> list:
        """Quartiles by index ``sorted[int(n*q)]`` of each sequence column's numbers."""
        rq = []
        for c, prefix, dom in chosen:
            e = self.num_expr(c, prefix)
            rq += [Q.Request(f"{c}|s{nm}", e, Q.floor_index(dom, qq), dom)
                   for nm, qq in (("q1", 0.25), ("q3", 0.75), ("p10", 0.10), ("p90", 0.90))]
        return rq

    def sequence_aggs(self, chosen, qs: dict) -> dict:
        """Fence, range and out-of-range counters of every sequence column."""
        a, self.seq_fence = {}, {}
        for c, prefix, dom in chosen:
            num = F.expr(self.num_expr(c, prefix))
            iqr, lo, hi = seq_fences({nm: qs[f"{c}|s{nm}"] for nm in ("q1", "q3", "p10", "p90")})
            self.seq_fence[c] = (iqr, lo, hi)
            inside = seq_inside(num, lo, hi)
            a.update({f"{c}|cmin": F.min(F.when(inside, num)), f"{c}|cmax": F.max(F.when(inside, num)),
                      f"{c}|mn": F.min(num), f"{c}|mx": F.max(num),
                      f"{c}|out": count_if(num.isNotNull() & ~inside), f"{c}|outex": F.min(F.when(~inside, num))})
        return a

    def sequence_emit(self, chosen, row: dict):
        """Out-of-range values, or else the holes between min and max."""
        for c, prefix, dom in chosen:
            iqr, lo, hi = self.seq_fence[c]
            mn, mx = seq_int(row[f"{c}|mn"]), seq_int(row[f"{c}|mx"])
            width = len(seq_digits(mn))
            if row[f"{c}|out"]:
                cmin, cmax = (seq_int(row[f"{c}|cmin"]), seq_int(row[f"{c}|cmax"])) if iqr > 0 else (lo, hi)
                if cmin is None:
                    cmin, cmax = mn, mx
                example = f"{prefix}{row[f'{c}|outex'][10:].zfill(width)}"
                count = row[f"{c}|out"]
            else:
                present, first = holes(self.df, F.expr(self.num_expr(c, prefix)))
                count = (mx - mn + 1) - present
                if count <= 0:
                    continue
                first = seq_int(first)
                example = f"{prefix}{seq_digits(first + 1).zfill(width)}"
                cmin, cmax = mn, mx
            cmin, cmax = seq_digits(cmin), seq_digits(cmax)
            # the record's number is a 64-bit one; the description has all of it
            self.emit(c, "SEQUENCE_GAP", min(count, 2**63 - 1),
                      say(seq_digits(count), "missing from a sequence", example=example, first=f"{prefix}{cmin}", last=f"{prefix}{cmax}"),
                      f"{prefix}|{cmin}|{cmax}|{example}", K.LABEL_SEQUENCE)

    # ----------------------------------------------------------------- run
    def run(self) -> list[dict]:
        """Scans: pass 1 (+ a keyed fetch of example rows), V, one pass for the z-score and
        round-number counters together with the order statistics, one pass for the IQR
        and sequence counters, and the counters of the wrong-field rules."""
        w = self.want
        self.df = spread(self.df)
        self.pass1()
        needs_v = w & {"MISSING_VALUE", "DUPLICATE", "INCONSISTENT", "LOW_VARIANCE", "SEQUENCE_GAP"}
        self.vs, self.thr = {}, {}
        if needs_v:
            self.build_v()
        if "MISSING_VALUE" in w:
            self.missing()
        if "DUPLICATE" in w:
            self.duplicates()
        if "FORMAT_INVALID" in w:
            self.formats()
        if "INCONSISTENT" in w:
            self.inconsistent()
        self.text_rules()
        if "DATE_LOGICAL" in w:
            self.date_logic()
        if "LOW_VARIANCE" in w:
            self.low_variance()
        chosen = self.sequence_candidates()
        # one scan: z-score and round-number counters plus every order statistic
        counters = self.pass2_aggs()
        res = Q.kth_smallest(self.df, self.iqr_requests() + self.sequence_requests(chosen), extra=counters)
        self.p2 = {k: res.pop(k) for k in counters}
        # the round-number examples are resolved together with the IQR ones below
        self.outliers()
        if "OUTLIER" in w or "OUTLIER_IQR" in w:
            self.date_outliers()
        # one scan: IQR outside-fence counters and sequence fences
        last = {**self.iqr_aggs(res), **self.sequence_aggs(chosen, res)}
        vals = run_aggs(self.df, last) if last else {}
        # one keyed scan for every example found by position in passes 2 and 3
        both = {**self.p2, **vals}
        both = self._resolve_examples(both, {**self.ex2, **self.ex3})
        self.p2 = {k: both[k] for k in list(self.p2) + list(self.ex2) if k in both}
        vals = {k: both[k] for k in list(vals) + list(self.ex3) if k in both}
        if "NUMERIC_ROUND_NUMBER" in w:
            self.round_numbers()
        self.iqr_emit(vals)
        self.sequence_emit(chosen, vals)
        if "CROSS_FIELD_SWAP" in w:
            self.swaps()
        return [r for r in self.records if r["anomaly_type"] in w]


def detect_records(df: DataFrame, dataset_id: str = "dataset", order_by=None, types=None) -> list[dict]:
    """Anomaly records as dicts.  Without ``order_by`` the row order is taken from the
    scan (``monotonically_increasing_id``, split-layout dependent) and used only to
    pick "first" examples; the key column itself is not examined."""
    if order_by is None:
        from ..sources.io import ORDER_COL, with_order_key
        det = Detector(with_order_key(df), dataset_id, ORDER_COL, types)
        det.cols = [c for c in det.cols if c != ORDER_COL]
        return det.run()
    return Detector(df, dataset_id, order_by, types).run()


def detect_anomalies(df: DataFrame, dataset_id: str = "dataset", order_by=None, types=None) -> DataFrame:
    """Anomaly records (one per column and type) as a DataFrame with ``ANOMALY_SCHEMA``."""
    recs = detect_records(df, dataset_id, order_by, types)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = [tuple(r[f.name] if f.name != "created_at" else now for f in ANOMALY_SCHEMA.fields) for r in recs]
    return df.sparkSession.createDataFrame(rows, ANOMALY_SCHEMA)
