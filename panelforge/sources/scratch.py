"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a local master without one gets a temporary folder, a cluster an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet and read back: later jobs read files and nothing is kept in memory.

    A table that this function gave is given back as it is.
    """
    if hasattr(df, "written_at"):
        return df
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression="zstd")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def sweep(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables of :func:`written` that nothing reads any more, and of shuffles whose plans are gone.

    Spark deletes a shuffle's files when the driver collects its plan as garbage, which a large heap may put off.
    """
    context = spark.sparkContext
    for df in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jvm.System.gc()
