"""Records of text files whose records cross lines, found in parallel.

CSV cells may hold line breaks, and a JSON array may be one line of any length.  Spark's own
multi-line reading keeps such a file in one task.  Here the file is read as pieces that end in a
separator (a line break, or for JSON a closing brace), split by split, and a few facts about
every piece say where records end:

* CSV: a record starts at a line that no open quote reaches into.  The number of quotes before it
  must be even; doubled quotes count twice and change nothing.
* JSON: an object ends at a brace outside strings that brings the depth back to zero.  Strings are
  the stretches between quotes without a backslash before them.

Both are prefix sums over the pieces of a file: first within a block (BLOCK_LINES pieces, or what a
split has left), then over the blocks, one small row each; JSON sums the depth for either state a block may
begin in.  Pieces become records inside their block, and what crosses a border is put together
afterwards, from the last record of one block and the heads of the next ones.  The largest
thing in one task is a split, a few blocks, or a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = ["file", "block"]
#: A power of two.  Whole splits as blocks would meet by chance, several of them in one task.
BLOCK_LINES = 1 << 15


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, at, value): the pieces of all files; ``at`` grows within a block.  A block's number
    is the byte its split starts at plus its place among the task's blocks, which is less than the
    bytes of any split that another one of the file follows."""
    lines = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value")
    place = F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / BLOCK_LINES)  # the low 33 bits count a task's rows
    return lines.select("file", (F.col("start") + place).alias("block"), "at", "value")


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _before(*more: str):
    return Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)


def _blocks_before():
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def _whole_records(pieces: DataFrame, joiner: str) -> DataFrame:
    """(file, block, rec, text) from (file, block, rec, at, value).  ``rec`` numbers the records of a
    block; 0 are pieces that go on with the record before them, which is the last one of the
    nearest block that has any."""
    def joined(order: str, value: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]), joiner)

    parts = written(pieces.groupBy(*BLOCK, "rec").agg(joined("at", "value").alias("text")), "records")
    last = parts.groupBy(*BLOCK).agg(F.max("rec").alias("last"))
    last = last.withColumn("owner", F.last(F.when(F.col("last") > 0, F.col("block")), ignorenulls=True).over(_blocks_before()))
    last = last.withColumn("follows", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNotNull())
    parts = parts.join(F.broadcast(last), BLOCK)  # a small row a block; the texts stay where they are
    border = (F.col("rec") == 0) | ((F.col("rec") == F.col("last")) & F.col("follows"))
    inner = parts.where(~border).select(*BLOCK, "rec", "text")
    # of one owner: its last record, then the heads of the blocks after it
    crossing = (parts.where(border)
                .select("file", F.when(F.col("rec") == 0, F.col("owner")).otherwise(F.col("block")).alias("owner"), "block", "rec", "text")
                .groupBy("file", "owner").agg(F.max("rec").alias("rec"), joined("block", "text").alias("text")))
    return inner.unionByName(crossing.select("file", F.coalesce("owner", F.lit(-1)).alias("block"), "rec", "text"))


def csv_records(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """(file, block, rec, text): the records of CSV files, in order of the first three."""
    lines = _pieces(spark, path, "\n").withColumn("odd", _count(F.col("value"), quote) % 2)
    blocks = lines.groupBy(*BLOCK).agg(F.sum("odd").alias("odd")).select(
        *BLOCK, _sum_before(F.col("odd"), _blocks_before()).alias("quotes"))
    starts = ((F.col("quotes") + _sum_before(F.col("odd"), _before())) % 2 == 0).cast("long")
    lines = lines.join(blocks, BLOCK).withColumn("starts", starts)
    lines = lines.withColumn("rec", _sum_before(F.col("starts"), _before()) + F.col("starts"))
    out = _whole_records(lines.select(*BLOCK, "rec", "at", "value"), "\n")
    return out.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, rec, text): the objects of files that hold objects, in an array or one after
    the other, each in one line.  Anything else between them fails the job."""
    pieces = _pieces(spark, path, "}").withColumn("plain", F.regexp_replace("value", r"(?s)\\.", ""))

    def depth(inside: int) -> Column:
        """What a piece that begins inside a string (1) or outside (0) adds to the depth."""
        text = F.concat(F.lit('"'), "plain") if inside else F.col("plain")
        outside = F.regexp_replace(text, '"[^"]*("|$)', "")
        closes = ((_count(F.col("plain"), '"') + inside) % 2 == 0).cast("long")
        return _count(outside, "{") - closes

    pieces = pieces.select(*BLOCK, "at", "value", (_count(F.col("plain"), '"') % 2).alias("odd"),
                           depth(0).alias("d0"), depth(1).alias("d1"))

    def added(begin: Column) -> tuple[Column, Column]:
        """State of a piece (inside a string at its start, at its end) is known from its block's."""
        start = (begin + _sum_before(F.col("odd"), _before())) % 2
        return start, F.when(start == 0, F.col("d0")).otherwise(F.col("d1"))

    sums = pieces.select(*BLOCK, "odd", *[added(F.lit(s))[1].alias(f"s{s}") for s in (0, 1)])
    sums = sums.groupBy(*BLOCK).agg(F.sum("odd").alias("odd"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    sums = sums.withColumn("begin", _sum_before(F.col("odd"), _blocks_before()) % 2)
    sums = sums.withColumn("sum", F.when(F.col("begin") == 0, F.col("s0")).otherwise(F.col("s1")))
    blocks = written(sums.select(*BLOCK, "begin", _sum_before(F.col("sum"), _blocks_before()).alias("depth")), "blocks")

    start, add = added(F.col("begin"))
    pieces = pieces.join(blocks, BLOCK).withColumn("start", start).withColumn("add", add)
    # a piece opens a record where the one before it, be it in another block, has closed one
    starts = ((F.col("depth") + _sum_before(F.col("add"), _before()) == 0) & (F.col("start") == 0)).cast("long")
    pieces = pieces.withColumn("starts", starts)
    pieces = pieces.withColumn("rec", _sum_before(F.col("starts"), _before()) + F.col("starts"))
    out = _whole_records(pieces.select(*BLOCK, "rec", "at", F.concat("value", F.lit("}")).alias("value")), "")
    out = out.withColumn("text", F.regexp_replace("text", r"^[\x{FEFF}\s,\[]+", ""))
    bad = ~F.col("text").startswith("{") & ~F.col("text").rlike(r"^[\s\]]*\}?$")
    out = out.withColumn("text", F.when(bad, F.raise_error(F.concat(F.lit("no object but: "), F.left("text", F.lit(60))))).otherwise(F.col("text")))
    return out.where(F.col("text").startswith("{")).withColumn("text", F.regexp_replace("text", r"[\r\n]+", " "))
