"""Session helpers: shipping the package to executors and cutting lineage in a shared folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_CLEANED: set[str] = set()

#: Spark's setting that shuffle files go when the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors through the driver's file server, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset in a local session, as in tests, a folder of this machine is
    chosen; on a cluster that would be a folder nobody else sees, so it is an error there.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder; all of them go when the program ends."""
    root = f"{shared_folder(spark)}/tables"
    if root not in _CLEANED:
        _CLEANED.add(root)

        def clean() -> None:
            with contextlib.suppress(Exception):  # the session may be gone; then the folder's owner clears it
                remove(spark, root)

        atexit.register(clean)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, rows_per_file: int = 0) -> DataFrame:
    """``df`` written as Parquet at ``path`` and read again: its lineage ends there, and its size is known.

    A reader decodes some thousand rows of a file at once, so rows of megabytes need files of few rows:
    ``rows_per_file`` (0: any number). Shuffle files of the step go when it is written: nothing reads them again.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and cut its lineage.

    Unlike ``DataFrame.checkpoint`` the result has the table's real size and not the
    estimate of the plan behind it, which grows with every join of a loop.
    """
    return written(df, scratch(df.sparkSession, "step"), rows_per_file)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the session's cores where its files have fewer splits than that; else as it is.

    For rows that many more are made of in the same stage, as k-mers of texts: the shuffle of
    the rows is small against what follows.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
