"""Sources, sinks and table inspection.

Readers return lazy DataFrames; nothing here collects data rows.  The only values
that reach the driver are per-column statistics (A7) and schema metadata (A6).
"""

from __future__ import annotations

import csv
import io
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import reference_dtype_name
from ..functions.text import count_if
from ..session import scratch_path, written
from .records import csv_records, json_records

ORDER_COL = "__row_order"

# FIXED VALUES: file suffix -> format, for reading and for writing.
READ_FORMATS = {"csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "parquet": "parquet", "pq": "parquet"}
WRITE_FORMATS = {"csv": "csv", "txt": "csv", "json": "json", "parquet": "parquet"}


class FormatError(ValueError):
    pass


def detect_format(path: str, explicit: str | None = None) -> str:
    """Pick the format: an explicit name wins, else the case-insensitive suffix (A5)."""
    if explicit:
        fmt = READ_FORMATS.get(explicit.lower())
        if fmt is None:
            raise FormatError(f"Unsupported format: {explicit}")
        return fmt
    suffix = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    fmt = READ_FORMATS.get(suffix)
    if fmt is None:
        raise FormatError(f"Cannot determine format of {path!r}")
    return fmt


def with_order_key(df: DataFrame, name: str = ORDER_COL) -> DataFrame:
    """Attach a file-order key directly on a scan.

    ``monotonically_increasing_id`` is unique and increases with file position within
    a split; it depends on the split layout, so callers with a real key should pass
    it as ``order_by`` instead.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def _open_quotes(spark: SparkSession, path: str, quote: str, encoding: str) -> bool:
    """Does any line leave a quote open?  Then some cell holds a line break."""
    lines = spark.read.option("encoding", encoding).text(path)
    odd = (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))) % 2 == 1
    return not lines.where(odd).isEmpty()


def read_csv(spark: SparkSession, path: str, *, separator: str = ",", quote: str = '"',
             has_header: bool = True, encoding: str = "utf-8", schema: T.StructType | str | None = None,
             infer_schema: bool = True, multiline: bool | None = None, mode: str = "FAILFAST",
             order_key: bool = False) -> DataFrame:
    """Read CSV (A1).  Dates are tried during inference.

    Types are inferred from the whole input, so a text that first appears in the last
    row makes its column a text column.  A given ``schema`` skips inference; a cell that
    does not fit it, or a row with too few or too many cells, fails the job instead of
    becoming null (``mode``).  A quote inside a quoted cell is doubled.

    Cells with line breaks need records put together from lines; ``multiline=None`` finds out
    with one scan of the lines, and does so only where a line leaves a quote open.  UTF-8
    files are then read in parallel (``records.csv_records``), other encodings by
    Spark's multi-line reading, which keeps a file in one task.  Headerless files get the
    column names ``column_1..column_n``.
    """
    if multiline is None:
        multiline = bool(quote) and _open_quotes(spark, path, quote, encoding)
    if multiline and quote and encoding.lower().replace("-", "") == "utf8":
        return _csv_across_lines(spark, path, separator, quote, has_header, schema, infer_schema, mode, order_key)
    r = (spark.read.option("sep", separator).option("quote", quote).option("escape", quote)
         .option("header", has_header).option("encoding", encoding).option("multiLine", multiline)
         .option("preferDate", True).option("mode", mode))
    if schema is not None:
        r = r.schema(schema)
    elif infer_schema:
        r = r.option("inferSchema", True)
    df = r.csv(path)
    if not has_header and schema is None:
        df = df.toDF(*[f"column_{i + 1}" for i in range(len(df.columns))])
    return with_order_key(df) if order_key else df


def _csv_across_lines(spark, path, separator, quote, has_header, schema, infer_schema, mode, order_key) -> DataFrame:
    """CSV whose cells hold line breaks: records found in parallel, then parsed one by one."""
    options = {"sep": separator, "quote": quote, "escape": quote, "preferDate": "true", "mode": mode}
    rows = written(csv_records(spark, path, quote), "csv-records")
    place = F.struct("block", "rec")
    firsts = rows.groupBy("file").agg(F.min(place).alias("place"), F.min_by("text", place).alias("text"))
    first = firsts.orderBy("file").first()
    head = next(csv.reader(io.StringIO(first["text"], newline=""), delimiter=separator, quotechar=quote)) if first else []
    if has_header:
        names = _safe_names(head)
        firsts = firsts.select(F.col("file").alias("f"), F.col("place").alias("p"))
        rows = rows.join(firsts, (F.col("file") == F.col("f")) & (place == F.col("p")), "left_anti")
    else:
        names = [f"column_{i + 1}" for i in range(len(head))]
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        if infer_schema and names:
            # Spark's own rules see the records with the breaks inside cells as blanks, which leaves
            # every text a text
            flat = scratch_path(spark, "csv-flat")
            rows.select(F.regexp_replace("text", "[\r\n]+", " ")).write.text(flat)
            found = spark.read.options(**{**options, "mode": "PERMISSIVE"}).option("inferSchema", True).csv(flat)
            types = [f.dataType for f in found.schema.fields]
            schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)]) if types else schema
    parsed = F.from_csv("text", _ddl(schema), options)
    if order_key:  # blocks of all files in order, then the record
        blocks = rows.select("file", "block").distinct().select("file", "block", (F.row_number().over(
            Window.orderBy("file", "block")) - 1).alias("n"))
        rows = rows.join(blocks, ["file", "block"])
        return rows.select((F.shiftleft(F.col("n").cast("long"), 33) + F.col("rec")).alias(ORDER_COL), parsed.alias("r")) \
            .select("r.*", ORDER_COL)
    return rows.select(parsed.alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _safe_names(head: list[str]) -> list[str]:
    """Column names of a header: empty ones are numbered, repeated ones get their place."""
    low = [h.lower() for h in head]
    return [f"_c{i}" if not h else f"{h}{i}" if low.count(h.lower()) > 1 else h for i, h in enumerate(head)]


def _json_lines(spark: SparkSession, path: str) -> bool:
    """Is every line that is not blank an object of its own?"""
    v = F.trim("value")
    lines = spark.read.text(path).where(v != "")
    return lines.where(~(v.startswith("{") & v.endswith("}"))).isEmpty()


def read_json(spark: SparkSession, path: str, *, multiline: bool | None = None,
              schema: T.StructType | str | None = None, mode: str = "FAILFAST", order_key: bool = False) -> DataFrame:
    """Read JSON (A2): JSON lines, or one document (an array of objects) per file.

    ``multiline=None`` tells them apart with one scan of the lines.  Reading lines as
    documents would keep one record of each file, so asking for that is an error.
    The objects of documents are found in parallel, however long a file or a line is
    (``records.json_records``), and written once as JSON lines to the shared folder.
    """
    lines = _json_lines(spark, path)
    if multiline is None:
        multiline = not lines
    elif multiline and lines and spark.read.text(path).where(F.trim("value") != "").groupBy(
            F.input_file_name()).count().where("count > 1").limit(1).count():
        raise FormatError(f"{path!r} holds JSON lines, not one document per file")
    reader = spark.read.option("mode", mode)
    if schema is not None:
        reader = reader.schema(schema)
    if multiline:
        lines_path = scratch_path(spark, "json-lines")
        (json_records(spark, path).repartitionByRange("file", "block", "rec")
         .sortWithinPartitions("file", "block", "rec").select("text").write.text(lines_path))
        path = lines_path
    df = reader.json(path)
    return with_order_key(df) if order_key else df


def read_parquet(spark: SparkSession, path: str, *, order_key: bool = False) -> DataFrame:
    """Read Parquet (A3); types preserved, filters and projections pushed to the scan."""
    df = spark.read.parquet(path)
    return with_order_key(df) if order_key else df


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    fmt = detect_format(path, fmt)
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt == "json":
        return read_json(spark, path, **options)
    return read_parquet(spark, path, **options)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", *, mode: str = "overwrite",
                header: bool = True) -> str:
    """Write CSV / JSON / Parquet (A4).  Unknown format names fall back to Parquet.

    Spark writes a directory of part files (JSON as JSON lines), one per task, so a
    large table is written in parallel rather than through one process.
    """
    fmt = WRITE_FORMATS.get((fmt or "parquet").lower(), "parquet")
    writer = df.write.mode(mode)
    if fmt == "csv":
        (writer.option("header", header).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)
    return fmt


def output_key(dataset_id: str, job_id: str, fmt: str) -> str:
    fmt = (fmt or "parquet").lower()
    ext = {"txt": "csv"}.get(fmt, fmt if fmt in WRITE_FORMATS else "parquet")
    return f"processed/{dataset_id}/{job_id}/output.{ext}"


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: name, Spark type and the reference's dtype name."""
    rows = [(i, f.name, f.dataType.simpleString(), reference_dtype_name(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    schema = "position INT, column_name STRING, spark_type STRING, dtype STRING"
    return df.sparkSession.createDataFrame(rows, schema)


def table_stats(df: DataFrame) -> DataFrame:
    """Row count, column count and null count per column, from one aggregate.

    Long form: one row per column.  The aggregate is a single scan with partial
    aggregation; only O(columns) numbers leave the executors.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [count_if(F.col(f"`{c}`").isNull()).alias(f"__n{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    per_col = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                                           F.col(f"__n{i}").alias("null_count")) for i, c in enumerate(cols)]))
    return wide.select(
        F.col("__rows").alias("row_count"),
        F.lit(len(cols)).cast("bigint").alias("column_count"),
        per_col.alias("e"),
    ).select("row_count", "column_count", "e.*")


def sample_rows(df: DataFrame, n: int = 100, seed: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows (all rows when the table has at most ``n``), repeatable.

    Rows are ranked by a seeded hash of ``key`` (all columns by default) and the
    ``n`` smallest kept.  The n-th smallest hash comes from the exact order statistics
    and one filtered scan keeps the rows at or below it, so no task merges every
    partition's top ``n`` rows.
    """
    from ..functions import quantiles as Q
    key_cols = [F.col(f"`{c}`") for c in (key or df.columns)]
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed if seed is not None else 0), *key_cols))
    total = df.count()
    if total <= n:
        return df
    thr = Q.kth_smallest(hashed, [Q.Request("t", "`__h`", n - 1, total)])["t"]
    picked = hashed.where(F.col("__h") <= F.lit(thr))
    # equal hashes at the threshold (rare): order them by the key and keep n
    return picked.orderBy("__h", *key_cols).limit(n).drop("__h")


def preview(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in order, dates and timestamps as ISO text."""
    out = df.orderBy(*order_by) if order_by else df
    out = out.limit(n)
    sel = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            # Python isoformat: microseconds only when they are not zero.
            c = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
                .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        sel.append(c.alias(f.name))
    return out.select(*sel)
