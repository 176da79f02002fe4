"""The folder that driver and executors share, and tables written there to cut the lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a temporary folder; a cluster
    without it is refused, as a machine-local folder would lose files there.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewake-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidewake/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the application's own folder that nothing has used yet."""
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder, in a folder for each value of ``by``, and read it again.

    A lost executor then costs its running tasks, not the steps before. The
    path is kept on the frame, for :func:`drop_saved`; tables that a returned
    frame still reads stay until :func:`clean_up`.
    """
    path = new_path(df.sparkSession, tag)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewake_path = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into the session's number of shuffle partitions, for maps whose rows cost far more time
    than bytes: partitions of a given number are not put together again for being small."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks open it themselves, where the shared folder is mounted on every machine; None on another file system."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.toUri().getPath() if where.getFileSystem(sc._jsc.hadoopConfiguration()).getUri().getScheme() == "file" else None


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def drop_saved(df: DataFrame) -> None:
    """Delete what :func:`saved` wrote, once nothing reads it any more."""
    path = getattr(df, "_tidewake_path", None)
    if path:
        delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that this application saved. Frames made of them are void afterwards."""
    delete(spark, own_dir(spark))
