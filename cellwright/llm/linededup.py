"""Line dedup: a line stays in the first document that has it and goes from all later ones.

The key of a line is the line without space and the controls 0x09-0x0D at either end, A-Z
lower-cased.  Keys of at least ``min_chars`` code points that stand in two documents or more
lose all their lines but those in the least doc_id.

1. Every line of such a length becomes (document, position, 128-bit hash of its key); the
   texts stay behind.
2. The hashes are range-partitioned and sorted by document and position inside a partition.
   One stream over a hash's rows carries its first document along: rows of any other document
   are dropped.
3. A hash that holds many rows would be one long stretch.  Rows are counted in BUCKETS hash
   buckets; those of heavy buckets are dealt to slices by document, and step 2 runs inside the
   slices.  Only the rows of a slice's own first document (a few for every slice) go through
   step 2 once more, now by hash alone.  Nothing is joined back.
4. What comes back for a document is a run-length coded bitmap of its lines: lengths of runs,
   kept and dropped in turn, the first one kept (0 if the first line goes).  Documents that
   keep every line have none.

Built-in functions only.  The one broadcast are the slices of heavy buckets, at most BUCKETS / 4
rows whatever the input.

Defined results: a null or empty text is one empty line, which never goes.  Rows with one doc_id
are one document, and lose nothing to each other; repeated rows are each listed.  A null doc_id
is a document that comes after all others.  An empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pick, table, text_key

MIN_CHARS = 10
BUCKETS = 1 << 16
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def line_hashes(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """(doc_id, key, n_lines, pos, h1, h2): one row per line whose key is long enough."""
    return (docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(doc_id, text).alias("key"),
                        lines_of(F.col(f"`{text}`")).alias("lines"))
            .select("doc_id", "key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
            .select("doc_id", "key", "n_lines", "pos", line_key(F.col("line")).alias("k"))
            .where(F.char_length("k") >= min_chars)
            .select("doc_id", "key", "n_lines", "pos", F.xxhash64("k").alias("h1"),
                    F.xxhash64(F.lit(1), "k").alias("h2")))


def later_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows, with ``later``: another document of the same stretch comes first.  Stretches lie
    in ranges of ``by``, sorted by document and position."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("pos")]
    stream = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.repartitionByRange(*by)
            .withColumn("first", F.first(F.struct("doc_id")).over(stream))
            .withColumn("later", ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).drop("first"))


def line_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 min_chars: int = MIN_CHARS, slices: int | None = None) -> DataFrame:
    """(doc_id, key, n_lines, n_dropped, runs) of the documents that lose lines; ``key`` is
    ``text_key(doc_id, text)``.  ``slices`` is about the number of parts of a hash that all rows
    share (the number of shuffle partitions by default); it changes no result."""
    spark = docs.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(line_hashes(docs, text, doc_id, min_chars), "line-hashes")
    bucket = F.pmod("h1", F.lit(BUCKETS)).cast("int").alias("bucket")
    counts = materialise(rows.groupBy(bucket).agg(F.count("*").alias("n")), "line-buckets")  # at most BUCKETS rows
    total = counts.agg(F.sum("n")).first()[0] or 0
    each = max(1, total // slices)
    heavy = counts.where((F.col("n") > each) & (F.col("n") * BUCKETS > 4 * total)).select(
        "bucket", F.ceil(F.col("n") / each).alias("slices"))

    dealt = (rows.withColumn("bucket", bucket).join(F.broadcast(heavy), "bucket", "left")
             .withColumn("slice", F.coalesce(F.pmod(F.xxhash64("key"), "slices"), F.lit(-1))).drop("bucket", "slices"))
    seen = materialise(later_rows(dealt, ["h1", "h2", "slice"]).where("later OR slice >= 0"), "line-first")
    again = later_rows(seen.where("NOT later").drop("later"), ["h1", "h2"]).where("later")
    dropped = seen.where("later").unionByName(again).select("doc_id", "key", "n_lines", "pos")

    # Neighbouring positions form runs; a run also knows the kept lines before it.
    doc = ["doc_id", "key", "n_lines"]
    at = Window.partitionBy(*doc).orderBy("pos")
    runs = (dropped.groupBy(*doc, "pos").agg(F.lit(1).alias("one"))
            .withColumn("island", F.col("pos") - F.row_number().over(at))
            .groupBy(*doc, "island").agg(F.min("pos").alias("pos"), F.count("*").cast("int").alias("n"))
            .withColumn("kept", F.col("pos") - F.lag(F.col("pos") + F.col("n"), 1, 0).over(at)))
    return (runs.groupBy(*doc)
            .agg(F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("pos", "kept", "n"))).alias("r"),
                 F.max(F.col("pos") + F.col("n")).alias("end"))
            .select(*doc, "n_dropped", F.concat(F.flatten(F.transform("r", lambda x: F.array(x["kept"], x["n"]))),
                                                F.array(F.col("n_lines") - F.col("end"))).alias("runs")))


def kept_text(text: Column, runs: Column) -> Column:
    """The lines of a text that its bitmap keeps, joined again."""
    mask = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.array_join(F.zip_with(lines_of(text), mask, lambda line, keep: F.when(keep, line)), "\n")


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, runs (null if all lines stay) and kept,
    the text without the dropped lines."""
    bitmaps = line_bitmaps(docs, text, doc_id, min_chars).select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_dropped", "runs")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_key(doc_id, text).alias("key"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    return (rows.join(bitmaps, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
            .select("doc_id", F.size(lines_of(F.col("t"))).cast("long").alias("n_lines"),
                    F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "runs",
                    F.when(F.col("runs").isNull(), F.col("t")).otherwise(kept_text(F.col("t"), F.col("runs"))).alias("kept")))


def op11_line_dedup(spark, sf_dir):
    out = dedup_lines(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key
      FROM l),
f AS (SELECT key, min(doc_id) AS owner, count(DISTINCT doc_id) AS docs FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(f.docs >= 2 AND f.owner <> k.doc_id, false) AS gone
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

QUERIES = {"op11_line_dedup": op11_line_dedup}
ORACLES = {"op11_line_dedup": ORACLE}
