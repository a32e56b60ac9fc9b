"""The shared folder of the cluster and tables written to it, which cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors see: the setting ``spark.checkpoint.dir``.

    Where it is unset, a local session takes its checkpoint folder or a new temporary one; a cluster
    raises ``ValueError``, as a folder of one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lociforge-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/lociforge-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, safe from lost executors.

    The shuffle files that the writing took are given back at its end.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame | None) -> None:
    """Delete a table of :func:`materialise` that no later step reads any more. Other tables are left alone."""
    if df is None:
        return
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    own = f"/lociforge-{spark.sparkContext.applicationId}/"
    for folder in {name[: name.rindex("/")] for name in df.inputFiles() if own in name}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of a table by name, whatever characters the names have."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tasks_for(spark: SparkSession, size: int | None, share: int = 64 << 20) -> int:
    """Tasks for work of a known size, for a repartition by number: adaptive execution leaves those alone."""
    return max(spark.sparkContext.defaultParallelism, -(-(size or 0) // share))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lociforge-"), "lociforge.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
