"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwright.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Words are runs of anything but space and the controls 0x09-0x0D.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_CHAR_RE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller never clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def words_of(text: Column) -> Column:
    """Array of words of a text; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def text_key(*cols: str) -> Column:
    """64-bit key of a row's content.  Used with ``doc_id`` as the identity of a document:
    rows equal in both have the same text, so they also get the same result."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols])


#: Bounds of an Arrow batch that goes to a Python worker: texts can be long, and what a worker once
#: took for a batch stays with it through all steps that follow.
BATCH_ROWS, BATCH_BYTES = 2_000, 2 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and keep Arrow batches of texts small."""
    ship_package(spark)
    for name, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: the lineage ends
    there, and the rows outlive the executors that made them.  Shuffle files of finished steps
    go when the driver collects its garbage, so it is asked to."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch_folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


__all__ = ["SPACE_RE", "WORD_CHAR_RE", "ensure_checkpoint_dir", "materialise", "pick", "prepare",
           "release", "scratch_path", "table", "text_key", "words_of"]
