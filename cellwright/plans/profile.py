"""The two shared frames every detector reads.

* **Profile** – aggregates over the table, built as lists of named expressions so
  that many detectors share ONE scan.  Only O(columns) numbers come back.
* **V, the value-count frame** - ``(column, kind, h1, h2, p, cnt)``: the distinct values of the
  columns that a rule can still concern, by 128-bit hash, with their counts.  Nothing but
  fixed-width numbers is shuffled: ``p`` is a number that does not decrease with the value and
  settles most ties; the few values that a record shows are fetched afterwards by their hash.
  ``kind`` is RAW for the value itself, KEY for the normalised duplicate key of e-mail and phone
  columns, and PREFIX for the prefix of sequence texts.
"""

from __future__ import annotations

import functools
import os

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import dup_key, py_str
from ..functions.types import dtypes, is_integral, is_numeric

AGG_CHUNK = 120  # expressions per aggregate, to stay below the JIT method-size limit


def order_column(order_by) -> Column:
    if order_by is None:
        raise ValueError("order_by is required (first-hit examples follow row order)")
    if isinstance(order_by, str):
        return F.col(f"`{order_by}`")
    if len(order_by) == 1:
        return F.col(f"`{order_by[0]}`")
    return F.struct(*[F.col(f"`{c}`") for c in order_by])


def run_aggs(df: DataFrame, named: dict[str, Column]) -> dict:
    """Evaluate named aggregate expressions, a chunk per scan; returns name -> value."""
    out = {}
    items = list(named.items())
    for start in range(0, len(items), AGG_CHUNK):
        chunk = items[start:start + AGG_CHUNK]
        row = df.agg(*[e.alias(f"a{i}") for i, (_, e) in enumerate(chunk)]).collect()[0]
        for i, (name, _) in enumerate(chunk):
            out[name] = row[f"a{i}"]
    return out


RAW, KEY, PREFIX = 0, 1, 2
#: Values of one column and kind that are fetched by a list of hashes; more meet them in a join.
MAX_FETCH = 1_000


def counted_value(df_types: dict, column: str, kind: int) -> Column:
    """The value of a column that V counts for a kind; null where the row has none."""
    x = F.col(f"`{column}`")
    if kind == KEY:
        return dup_key(x, column)
    if kind == PREFIX:
        return F.when(x.rlike(K.RE_SEQUENCE), F.regexp_extract(x, K.RE_SEQUENCE, 1))
    return x if is_numeric(df_types[column]) else py_str(x, df_types[column])


def _is_number(types: dict, column: str, kind: int) -> bool:
    return kind == RAW and is_numeric(types[column])


def _hashes(v: Column) -> list[Column]:
    return [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2")]


def _place(v: Column, number: bool, head: int) -> Column:
    """A number that does not decrease with the value: the number itself, or the six bytes of a
    text that follow the ``head`` bytes all texts begin with."""
    if number:
        return v.cast("double")
    six = F.rpad(F.hex(F.substring(v.cast("binary"), head + 1, 6)), 12, "0")
    return F.conv(six, 16, 10).cast("double")


def text_heads(df: DataFrame, entries: list[tuple]) -> dict:
    """Bytes that all texts of an entry (column, kind) have in common at their start."""
    types = dtypes(df)
    texts = [e for e in entries if not _is_number(types, *e)]
    if not texts:
        return {}
    row = df.agg(*[f(counted_value(types, *e)).alias(f"{n}{i}") for i, e in enumerate(texts)
                   for f, n in ((F.min, "a"), (F.max, "b"))]).first()
    return {e: len(os.path.commonprefix([(row[f"a{i}"] or "").encode(), (row[f"b{i}"] or "").encode()]))
            for i, e in enumerate(texts)}


def value_counts(df: DataFrame, entries: list[tuple]) -> DataFrame:
    """V for the given (column, kind) entries; ``entry`` is the entry's place in the list."""
    types, heads = dtypes(df), text_heads(df, entries)
    rows = []
    for i, (c, kind) in enumerate(entries):
        v = F.col(f"v{i}")
        rows.append(F.struct(F.lit(i).alias("entry"), *_hashes(v), _place(v, _is_number(types, c, kind), heads.get((c, kind), 0)).alias("p"),
                             v.isNotNull().alias("ok")))
    # a projection of its own: every value is computed once, not again for each hash
    df = df.select(*[counted_value(types, *e).alias(f"v{i}") for i, e in enumerate(entries)])
    return (df.select(F.explode(F.array(*rows)).alias("e")).select("e.*").where("ok")
            .groupBy("entry", "h1", "h2", "p").agg(F.count(F.lit(1)).alias("cnt")))


def _values(df: DataFrame, entries: list[tuple], wanted: list[int]) -> DataFrame:
    """Rows (entry, h1, h2, value, fnum, inum) of the wanted entries."""
    types, rows = dtypes(df), []
    for i in wanted:
        c, kind = entries[i]
        v = F.col(f"v{i}")
        number = _is_number(types, c, kind)
        whole, decimal = number and is_integral(types[c]), isinstance(types[c], T.DecimalType)
        rows.append(F.struct(F.lit(i).alias("entry"), *_hashes(v),
                             F.when(F.lit(not number or decimal), v.cast("string")).alias("value"),
                             F.when(F.lit(number and not whole and not decimal), v.cast("double") if number else F.lit(None)).alias("fnum"),
                             F.when(F.lit(whole), v.cast("bigint") if whole else F.lit(None)).alias("inum"),
                             v.isNotNull().alias("ok")))
    df = df.select(*[counted_value(types, *entries[i]).alias(f"v{i}") for i in wanted])
    return df.select(F.explode(F.array(*rows)).alias("e")).select("e.*").where("ok").drop("ok")


def fetch_values(df: DataFrame, entries: list[tuple], keys: DataFrame, wanted: list[int]) -> list:
    """(entry, h1, h2, typed value) of the listed hashes, at most MAX_FETCH an entry, in one scan."""
    found = _values(df, entries, wanted).join(F.broadcast(keys.select("entry", "h1", "h2")), ["entry", "h1", "h2"])
    return (found.groupBy("entry", "h1", "h2")
            .agg(F.element_at(F.collect_set(F.struct("value", "fnum", "inum")), 1).alias("v")).collect())


def least_values(df: DataFrame, entries: list[tuple], v: DataFrame, tops: dict) -> dict:
    """entry -> the least of the values that V counts ``tops[entry]`` times, as Python's ``str`` has it."""
    if not tops:
        return {}
    def having(more: dict) -> Column:
        return functools.reduce(lambda a, b: a | b, [
            functools.reduce(lambda a, b: a & b, [F.col("entry") == i, F.col("cnt") == tops[i], *x]) for i, x in more.items()])
    least = {r["entry"]: r["p"] for r in v.where(having({i: [] for i in tops})).groupBy("entry").agg(F.min("p").alias("p")).collect()}
    ties = v.where(having({i: [F.col("p").eqNullSafe(F.lit(p))] for i, p in least.items()}))
    sizes = {r["entry"]: r["n"] for r in ties.groupBy("entry").agg(F.count("*").alias("n")).collect()}
    few = [i for i in sizes if sizes[i] <= MAX_FETCH]
    out = {}
    if few:
        for r in fetch_values(df, entries, ties.where(F.col("entry").isin(few)), few):
            out.setdefault(r["entry"], []).append(r["v"])
        out = {i: min(x, key=lambda t: tuple((y is None, y) for y in (t["value"] and t["value"].encode(), t["fnum"], t["inum"])))
               for i, x in out.items()}
    many = [i for i in sizes if sizes[i] > MAX_FETCH]
    if many:
        met = _values(df, entries, many).join(ties.select("entry", "h1", "h2"), ["entry", "h1", "h2"], "left_semi")
        for r in met.groupBy("entry").agg(F.min(F.struct("value", "fnum", "inum")).alias("v")).collect():
            out[r["entry"]] = r["v"]
    return {i: value_text(x) for i, x in out.items()}


def value_text(v) -> str | None:
    """Python ``str`` of a typed value (value / fnum / inum)."""
    if v is None:
        return None
    if v["value"] is not None:
        return v["value"]
    if v["fnum"] is not None:
        return str(float(v["fnum"]))
    return None if v["inum"] is None else str(int(v["inum"]))


def persist(df: DataFrame) -> DataFrame:
    """Keep a frame that several small aggregates read; recomputed from lineage if lost."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
