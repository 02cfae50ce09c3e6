"""Tables in the folder that the driver and all executors share: they end a lineage, whichever executor is lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or that of ``setCheckpointDir``.

    Where neither is set, a local session (tests) gets a temporary folder; on a cluster that is an error, as executors would
    not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    The shuffle files behind it are dropped as soon as it is written.  ``dropped`` deletes such a table; what is left goes
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    _place(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned, once nothing reads them any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _place(t.sparkSession, folder, lambda fs, p: fs.delete(p, True))


def _place(spark: SparkSession, path: str, act) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    act(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place)
