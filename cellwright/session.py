"""Session helpers: one place for the settings every job in the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a cluster deployment should carry too: adaptive execution re-plans
# shuffles at run time, splits skewed join partitions and coalesces small ones.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "cellwright",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system and is used as is.  Only
    when it is unset (local tests) do we set our own under the temp folder.
    """
    current = (spark.conf.get("spark.checkpoint.dir", None)
               or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
               or spark.sparkContext.getCheckpointDir())
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="cellwright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "cellwright", f"{name}-{uuid.uuid4().hex}")


def written(df, name: str):
    """Write an intermediate table to the shared folder and read it back: what non-deterministic
    columns say stays so, the lineage ends there, and the rows outlive the executors that made them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tasks with fewer rows than this are not worth dividing, and a written slice holds about so many.
SLICE_ROWS = 50_000
MOST_SLICE_ROWS = 250_000


def spread(df, name: str = "spread"):
    """The same rows with the work on them dealt evenly over the cores.  A compact file of few row
    groups keeps millions of rows in a handful of tasks; where one task has more than its share,
    the rows are dealt out and written once for all the passes that follow.  Else ``df`` itself."""
    from pyspark.sql import functions as F
    parts = df.groupBy(F.spark_partition_id().alias("p")).count()
    total, most = parts.agg(F.sum("count"), F.max("count")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not total or most <= max(SLICE_ROWS, 2 * total // cores):
        return df
    return written(df.repartition(max(2 * cores, -(-total // MOST_SLICE_ROWS))), name)


def cut_lineage(df, spark: SparkSession | None = None):
    """Cut a long lineage with a reliable checkpoint in the shared folder.

    Reliable checkpoints survive executor loss (unlike local checkpoints), which is
    what a 1000-executor job needs before re-reading a derived frame many times.
    """
    spark = spark or df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cellwright`` importable on executors (needed where Python runs per group,
    e.g. the keyed state of the job feed).  A zip of the package is added with
    ``addPyFile``; Spark distributes it to every executor.  Done once per context."""
    import zipfile
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    # the zip is written by this driver process: use the shared folder when it is a
    # plain path, else the driver's own temp folder (Spark serves the file itself)
    local = base if "://" not in base or base.startswith("file:") else tempfile.mkdtemp(prefix="cellwright-")
    local = local.replace("file://", "").replace("file:", "")
    target = os.path.join(local, f"cellwright-pkg-{uuid.uuid4().hex}.zip")
    os.makedirs(local, exist_ok=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("cellwright", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(target)
    _SHIPPED.add(key)
