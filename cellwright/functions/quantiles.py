"""Exact order statistics without gathering a column in one task.

The reference takes quantiles with the *nearest rank* rule (index
``round((n - 1) * q)``), and a few detectors index a sorted list directly
(``sorted[int(n * q)]``).  Both reduce to "the k-th smallest value" (0-based).

``kth_smallest`` answers many such requests in a handful of aggregate passes:

* requests over at most ``exact_limit`` values sort those values in one aggregate and take
  element ``k``, exactly and in the column's own type;
* above that, KLL sketches narrow a value bracket around the k-th element.  A sketch is built for
  every task, merged by LEAVES buckets of partitions and those into one, so no task merges the
  sketches of the whole table.  Two cut points are read off it a little below and above the
  element's rank.  The next pass counts exactly how many values fall below and at the cut points,
  and at the same time lists the values between them, or sketches them where they are still too
  many: normally the element is among them and the pass was not in vain.  If not, the bracket
  moves to the side on which it is.  Requests with equal brackets share sketch and list, and a
  pass takes at most SKETCH_ITEMS retained sketch items a task, further columns go to the next.

The error of the sketch decides how many passes are needed, never the result.  NaN is the
largest value on either way, as Spark sorts it, and is counted beside the sketch.  Decimals are
sketched by their distance from the bracket's lower end; texts (digits only, compared byte by
byte) by the 15 digits (a bigint holds them) after what all values of the bracket begin with.
Memory per task stays bounded by the sketches and by ``exact_limit`` values a bracket, whatever
the table size.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, replace
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_LIMIT = 10_000
#: Least and greatest size parameter of a sketch.
ACCURACY = 200
MAX_ACCURACY = 32_768
LEAVES = 64
SKETCH_ITEMS = 1 << 18
#: Expressions per aggregate, to stay below the JIT method-size limit.
AGG_CHUNK = 120
#: A bracket is so many rank errors of its sketch wide, those of the cut points included.
BRACKET_ERRORS = 8
#: Even steps that a sketch made beside the counts is read at.
STEPS = 2_000


def nearest_rank(n: int, q: float) -> int:
    """0-based index of the nearest-rank quantile (round half away from zero)."""
    return int(math.floor((n - 1) * q + 0.5))


def floor_index(n: int, q: float) -> int:
    """0-based index ``int(n * q)`` clamped to the last element."""
    return min(n - 1, max(0, int(n * q)))


@dataclass
class Request:
    name: str
    expr: str   # SQL expression of the value; null rows are ignored
    k: int      # 0-based rank among the non-null values
    n: int      # number of non-null values


def _sql_num(v) -> str:
    if isinstance(v, float):
        if math.isnan(v):
            return "CAST('NaN' AS DOUBLE)"
        if math.isinf(v):
            return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, Decimal):
        return format(v, "f")
    return f"'{v}'" if isinstance(v, str) else str(v)


@dataclass
class Bracket:
    """The values of ``expr`` strictly between lo and hi (None: no bound)."""
    expr: str
    lo: object = None
    hi: object = None
    head: str = ""     # what all texts of the bracket begin with

    def key(self):
        return self.expr, repr(self.lo), repr(self.hi)

    def values(self) -> str:
        conds = [f"({self.expr}) {op} {_sql_num(v)}" for op, v in ((">", self.lo), ("<", self.hi)) if v is not None]
        return f"CASE WHEN {' AND '.join(conds)} THEN ({self.expr}) END" if conds else f"({self.expr})"


def rank_error(k: int) -> float:
    """Normalised rank error of a KLL sketch of size k (99 % of the time)."""
    return 2.296 / k ** 0.9021


def sketch_size(n: int, limit: int, least: int) -> int:
    """Sketch size whose bracket holds at most ``limit`` of n values."""
    want = (2.296 * BRACKET_ERRORS * n / limit) ** (1 / 0.9021)
    return int(min(MAX_ACCURACY, max(least, math.ceil(want))))


class _Sketch:
    """Sketch of a bracket: how its values become numbers, and numbers cut points again."""

    def __init__(self, bracket: Bracket, kind: str, scale: int, size: int):
        self.b, self.kind, self.scale, self.size = bracket, kind, scale, size
        self.base = bracket.lo if kind == "decimal" and bracket.lo is not None else None

    @property
    def form(self) -> str:
        return "double" if self.kind in ("double", "decimal") else "bigint"

    def column(self) -> Column:
        v = self.b.values()
        if self.kind == "string":
            v = f"CAST(rpad(substring({v}, {len(self.b.head) + 1}, 15), 15, '0') AS BIGINT)"
        elif self.kind == "decimal":
            v = f"CAST({v} - {_sql_num(self.base)} AS DOUBLE)" if self.base is not None else f"CAST({v} AS DOUBLE)"
        elif self.kind == "double":
            v = f"nullif(CAST({v} AS DOUBLE), CAST('NaN' AS DOUBLE))"
        else:
            v = f"CAST({v} AS BIGINT)"
        return F.expr(v)

    def points(self, found: str, ranks: list[float]) -> Column:
        arr = ", ".join(f"CAST({x!r} AS DOUBLE)" for x in ranks)
        return F.expr(f"CASE WHEN kll_sketch_get_n_{self.form}({found}) > 0 "
                      f"THEN kll_sketch_get_quantile_{self.form}({found}, array({arr})) END")

    def cut(self, x, upper: bool):
        if self.kind == "string":  # not above the values of the lower cut, above all of the upper
            return self.b.head + (f"{x:015d}:" if upper else f"{x:015d}".rstrip("0"))
        if self.kind == "decimal":
            with localcontext() as ctx:
                ctx.prec = 120
                unit = Decimal(1).scaleb(-self.scale)
                if abs(Decimal(x) / unit) >= 2 ** 53:  # not every decimal here is a double: step aside
                    x = math.nextafter(x, math.inf if upper else -math.inf)
                return (Decimal(repr(x)) + (self.base or 0)).quantize(unit)
        return x


def _leaf_sketches(df: DataFrame, sketches: list[_Sketch], counts: list[str], lists: list[Bracket]) -> DataFrame:
    """One row: k0.. the merged sketches, n0.. the sums of the conditions, l0.. the values."""
    leaf = df.select(F.pmod(F.spark_partition_id(), F.lit(LEAVES)).alias("leaf"),
                     *[s.column().alias(f"s{i}") for i, s in enumerate(sketches)],
                     *[F.expr(c).alias(f"c{i}") for i, c in enumerate(counts)],
                     *[F.expr(b.values()).alias(f"v{i}") for i, b in enumerate(lists)])
    leaf = leaf.groupBy("leaf").agg(
        *[F.expr(f"kll_sketch_agg_{s.form}(s{i}, {s.size})").alias(f"k{i}") for i, s in enumerate(sketches)],
        F.count("*").alias("rows"),
        *[F.count_if(f"c{i}").alias(f"n{i}") for i in range(len(counts))],
        *[F.collect_list(f"v{i}").alias(f"l{i}") for i in range(len(lists))])
    return leaf.agg(
        *[F.expr(f"kll_merge_agg_{s.form}(k{i})").alias(f"k{i}") for i, s in enumerate(sketches)],
        F.sum("rows").alias("rows"),
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(counts))],
        *[F.array_sort(F.flatten(F.collect_list(f"l{i}"))).alias(f"l{i}") for i in range(len(lists))])


@dataclass
class _State:
    req: Request
    bracket: Bracket
    below: int      # values at or under the bracket's lower end
    cnt: int        # values in the bracket
    cuts: tuple | None = None


def kth_smallest(df: DataFrame, requests: list[Request], exact_limit: int = EXACT_LIMIT,
                 accuracy: int = ACCURACY, extra: dict | None = None) -> dict:
    """Exact k-th smallest value for every request, computed together.

    ``extra`` (name -> aggregate Column) is evaluated along with them: in the same scan where
    every request ranges over few values, else in one of its own.
    """
    out: dict = {r.name: None for r in requests}
    asked = [r for r in requests if 0 <= r.k < r.n]
    few = [r for r in asked if r.n <= exact_limit]
    named = dict(extra or {})
    exprs = list(dict.fromkeys(r.expr for r in few))
    named |= {f"__sorted{i}_{j}": F.expr(f"element_at(array_sort(collect_list({e})), {r.k + 1})")
              for i, e in enumerate(exprs) for j, r in enumerate(few) if r.expr == e}
    place = {f"__sorted{exprs.index(r.expr)}_{j}": r.name for j, r in enumerate(few)}
    items = list(named.items())
    for at in range(0, len(items), AGG_CHUNK):
        chunk = items[at:at + AGG_CHUNK]
        row = df.agg(*[e.alias(f"a{i}") for i, (_, e) in enumerate(chunk)]).first()
        out |= {place.get(name, name): row[f"a{i}"] for i, (name, _) in enumerate(chunk)}
    many = [r for r in asked if r.n > exact_limit]
    if many:
        out |= _narrow(df, many, exact_limit, accuracy)
    return out


def _narrow(df: DataFrame, requests: list[Request], limit: int, accuracy: int) -> dict:
    # a projection of its own: an expression is computed once a row, not again for each count
    names = {e: f"`x{i}`" for i, e in enumerate(dict.fromkeys(r.expr for r in requests))}
    df = df.select(*[F.expr(e).alias(x.strip("`")) for e, x in names.items()])
    requests = [replace(r, expr=names[r.expr]) for r in requests]
    types = {e: df.schema[e.strip("`")].dataType for e in names.values()}
    kinds = {e: {"float": "double", "double": "double", "decimal": "decimal", "string": "string"}.get(t.typeName(), "bigint")
             for e, t in types.items()}
    heads = _common_heads(df, [e for e in types if kinds[e] == "string"])
    state = {r.name: _State(r, Bracket(r.expr, head=heads.get(r.expr, "")), 0, r.n) for r in requests}
    out: dict = {}

    while state:
        # what the pass needs: sketches of brackets without cut points; for the others counts at the
        # cut points, and the values between them, as a list or as the next sketch
        sketches: dict = {}
        lists: dict = {}
        counts: dict = {}
        room = SKETCH_ITEMS

        def sketch(b: Bracket, cnt: int, held: int) -> bool:
            size = sketch_size(cnt, limit, accuracy)
            if b.key() not in sketches:
                if size > held and sketches:
                    return False
                scale = getattr(types[b.expr], "scale", 0)
                sketches[b.key()] = _Sketch(b, kinds[b.expr], scale, size)
            return True

        active = []
        for st in state.values():
            if st.cuts is None:
                if sketch(st.bracket, st.cnt, room - sum(x.size for x in sketches.values())):
                    active.append(st)
                continue
            lo, hi, width = st.cuts
            inner = _inner(st)
            for op, v in (("<", lo), ("<=", lo), ("<", hi), ("<=", hi)):
                counts.setdefault((st.req.expr, op, repr(v)), f"({st.req.expr}) {op} {_sql_num(v)}")
            if width <= limit:
                lists.setdefault(inner.key(), inner)
            else:
                sketch(inner, width, room)
            active.append(st)

        keys, marks, got = list(sketches), list(counts), list(lists)
        one = _leaf_sketches(df, [sketches[k] for k in keys], [counts[k] for k in marks], [lists[k] for k in got])
        wanted, spans = [], {}
        for j, st in enumerate(active):
            r = st.req
            if st.cuts is None:
                n, below, b = st.cnt, F.lit(st.below), st.bracket
            else:
                b, n = _inner(st), None
                below = F.col(f"n{marks.index((r.expr, '<=', repr(st.cuts[0])))}")
                if b.key() in lists:  # the element, if it is in the list
                    i = F.lit(r.k) - below
                    arr = f"l{got.index(b.key())}"
                    wanted.append(F.when((i >= 0) & (i < F.size(arr)), F.get(arr, i.cast("int"))).alias(f"e{j}"))
                    continue
            sk = sketches[b.key()]
            err = (BRACKET_ERRORS / 2 - 1) * rank_error(sk.size)
            # the rank in the bracket is known in the pass for new sketches only; one that was made
            # beside the counts gives even steps, of which the driver takes two
            steps = ([max(0.0, (r.k - st.below) / n - err), min(1.0, (r.k - st.below) / n + err)] if n is not None
                     else [x / STEPS for x in range(STEPS + 1)])
            spans[j] = (sk, err)
            wanted.append(sk.points(f"k{keys.index(b.key())}", steps).alias(f"p{j}"))
        row = one.select(*[F.col(f"n{i}") for i in range(len(marks))], *wanted).first()
        seen = {m: row[f"n{i}"] or 0 for i, m in enumerate(marks)}

        for j, st in enumerate(active):
            r = st.req
            if st.cuts is None:
                st.cuts = _cuts(spans[j][0], row[f"p{j}"], spans[j][1], st.cnt)
                continue
            lo, hi, width = st.cuts
            lt_lo, le_lo, lt_hi, le_hi = (seen[r.expr, op, repr(v)] for op, v in (("<", lo), ("<=", lo), ("<", hi), ("<=", hi)))
            inner = _inner(st)
            end = st.below + st.cnt
            st.cuts = None
            if lt_lo <= r.k < le_lo or lt_hi <= r.k < le_hi:  # the element equals a cut point
                out[r.name] = lo if r.k < le_lo else hi
                del state[r.name]
            elif le_lo <= r.k < lt_hi:
                st.bracket, st.below, st.cnt = inner, le_lo, lt_hi - le_lo
                if inner.key() in lists:
                    out[r.name] = row[f"e{j}"]
                    del state[r.name]
                elif j in spans:
                    sk, err = spans[j]
                    at = (r.k - le_lo) / st.cnt
                    points = row[f"p{j}"]
                    if points:
                        a = max(0, math.floor((at - err) * STEPS))
                        b = min(STEPS, math.ceil((at + err) * STEPS))
                        st.cuts = _cuts(sk, [points[a], points[b]], (b - a) / STEPS / 2 + err, st.cnt)
                    else:
                        st.cuts = _cuts(sk, None, err, st.cnt)
            elif r.k < lt_lo:                           # under the lower cut point
                st.bracket = Bracket(r.expr, st.bracket.lo, lo, st.bracket.head)
                st.cnt = lt_lo - st.below
            else:                                       # over the upper one
                st.bracket = Bracket(r.expr, hi, st.bracket.hi, st.bracket.head)
                st.below, st.cnt = le_hi, end - le_hi
    return out


def _inner(st: _State) -> Bracket:
    lo, hi, _ = st.cuts
    head = os.path.commonprefix([lo, hi]) if isinstance(lo, str) else ""
    return Bracket(st.req.expr, lo, hi, head)


def _cuts(sk: _Sketch, points, err: float, cnt: int) -> tuple:
    """Cut points and about how many values are strictly between them."""
    if not points:  # no sketch: nothing but NaN is left
        return float("nan"), float("nan"), 0
    lo, hi = sk.cut(points[0], False), sk.cut(points[1], True)
    return lo, hi, 0 if lo == hi else math.floor(min(1.0, 2 * err + 2 * rank_error(sk.size)) * cnt)


def _common_heads(df: DataFrame, exprs: list[str]) -> dict:
    """What all texts of a column begin with: the whole text if they are equal."""
    if not exprs:
        return {}
    row = df.agg(*[F.expr(f"{f}({e})").alias(f"{f}{i}") for i, e in enumerate(exprs) for f in ("min", "max")]).first()
    return {e: os.path.commonprefix([row[f"min{i}"], row[f"max{i}"]]) for i, e in enumerate(exprs)}
