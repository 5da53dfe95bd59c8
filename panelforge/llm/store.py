"""Shared storage and Arrow settings used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch.  Texts may be long, so batches stay short; every operator
#: cuts a batch into blocks of bytes again before it allocates work arrays.
ARROW_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, or the one set on the context.

    Where neither is set a local folder serves a local master, as in tests; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return (found or context.getCheckpointDir()).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with files that every executor can read, so a lost
    executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables of :func:`save` that nothing reads any more, and of shuffles that led to them.

    Spark deletes a shuffle's files when the driver collects its plan as garbage, which a large heap may put off.
    """
    context = tables[0].sparkSession.sparkContext
    for df in tables:
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    context._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short enough for tables with very long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def vocabulary(name: str) -> str:
    """File of a public tokenizer by its name, looked up where it is called: in the worker; an absolute path is its own."""
    import public_tokenizers

    return name if name.startswith("/") else public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
