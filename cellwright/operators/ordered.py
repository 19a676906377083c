"""Order-dependent operators that must not run as one un-partitioned window.

A window with no ``PARTITION BY`` sends the whole table to one task.  Forward and backward fill
(B5/B6) are a segmented prefix scan instead:

1. rows are range-partitioned by group and order key, of any type that sorts (numbers, dates,
   timestamps, texts, several columns); Spark draws the borders, and rows with equal keys stay
   together;
2. every slice (range partition) is filled by itself, with a partitioned window, and written once
   to the shared folder, so that its borders stay as they are;
3. the value that a slice passes on, its last one in fill direction, is one row per slice and
   group.  These rows are scanned as a tree: within blocks of BLOCK slices, over the blocks, and
   the two put together, so no task holds more rows than a block or the blocks;
4. what is still null takes the value carried into its slice.

The result equals the global window.  Null order keys have no place in the order and fail the
job.  Rows that tie on the order key should agree, or the key should have more columns.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = 256


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _keys(names: list[str], df: DataFrame) -> list[Column]:
    """Order key columns whose nulls fail the job."""
    types = dict(df.dtypes)
    return [F.when(_q(n).isNull(), F.raise_error(F.lit(f"order key {n!r} is null")).cast(types[n])).otherwise(_q(n)) for n in names]


def _same(left: list[str], right: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def fill_ordered(df: DataFrame, columns: list[str], order_by: str | list[str], direction: str = "forward",
                 partition_by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Forward / backward fill of ``columns`` along ``order_by`` (leading/trailing nulls stay),
    within the groups of ``partition_by``.  ``slices`` is the number of range partitions, the
    session's number of shuffle partitions by default."""
    if not columns:
        return df
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    fwd = direction == "forward"
    groups = [f"__g{i}" for i in range(len(partition_by or []))]
    keys = [f"__k{i}" for i in range(len(order_by))]
    cells = [f"__c{i}" for i in range(len(df.columns))]
    fill = {cells[df.columns.index(c)]: f"__f{i}" for i, c in enumerate(dict.fromkeys(columns))}

    # every column under a name of our own, so that no name of the table gets in the way
    rows = df.select(*[_q(c).alias(n) for c, n in zip(df.columns, cells)],
                     *[_q(c).alias(n) for c, n in zip(partition_by or [], groups)],
                     *[k.alias(n) for k, n in zip(_keys(order_by, df), keys)])
    by = [*groups, *keys]
    rows = (rows.repartitionByRange(slices, *by) if slices else rows.repartitionByRange(*by)) \
        .withColumn("__slice", F.spark_partition_id())
    forth = [F.col(k).asc() if fwd else F.col(k).desc() for k in keys]
    inside = Window.partitionBy("__slice", *groups).orderBy(*forth).rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.select(*[c for c in cells if c not in fill], *groups, *keys, "__slice",
                               *[F.last(c, ignorenulls=True).over(inside).alias(f) for c, f in fill.items()]), "fill")

    # What a slice passes on.  The tree runs over block numbers that grow in fill direction.
    key = F.struct(*keys)
    pick = F.max_by if fwd else F.min_by
    edges = rows.groupBy("__slice", *groups).agg(
        *[pick(F.col(f), F.when(F.col(f).isNotNull(), key)).alias(f) for f in fill.values()])
    edges = edges.withColumn("__at", F.col("__slice") if fwd else -F.col("__slice")) \
        .withColumn("__block", F.floor(F.col("__at") / BLOCK))
    in_block = Window.partitionBy("__block", *groups).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    whole = edges.groupBy("__block", *groups).agg(
        *[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("__at"))).alias(f) for f in fill.values()])
    over = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = whole.select(F.col("__block").alias("__b"), *[F.col(g).alias(f"b{g}") for g in groups],
                          *[F.last(f, ignorenulls=True).over(over).alias(f"b{f}") for f in fill.values()])
    near = edges.select("__slice", "__block", *groups, *[F.last(f, ignorenulls=True).over(in_block).alias(f) for f in fill.values()])
    carried = near.join(blocks, _same(["__block", *groups], ["__b", *[f"b{g}" for g in groups]])).select(
        F.col("__slice").alias("s__slice"), *[F.col(g).alias(f"s{g}") for g in groups],
        *[F.coalesce(f, f"b{f}").alias(f"s{f}") for f in fill.values()])

    out = rows.join(carried, _same(["__slice", *groups], ["s__slice", *[f"s{g}" for g in groups]]), "left")
    return out.select(*[(F.coalesce(fill[n], f"s{fill[n]}") if n in fill else F.col(n)).alias(c)
                        for c, n in zip(df.columns, cells)])
