"""What the operators share: the shared folder of a run, written intermediate tables, files in that folder, neighbours."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from pulseloom.session import ensure_checkpoint_dir


_MADE: list[str] = []  # folders of this driver, for ``remove_runs``


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the shared folder that ``spark.checkpoint.dir`` names."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def remove_runs(spark: SparkSession) -> int:
    """Removes the intermediate tables and files of all runs so far; for after their results are written elsewhere."""
    removed, conf = 0, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        removed += bool(target.getFileSystem(conf).delete(target, True))
    return removed


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, and survives a lost executor."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Removes a table that ``stored`` wrote, once all that was made of it is written as well.

    Shuffle files are removed when the driver collects its garbage, which it may not do for long: it is asked to as well.
    """
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def file_system(uri: str):
    """The pyarrow file system of ``uri`` and the path in it; for tasks, which may not have a JVM at hand."""
    from pyarrow import fs
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, chunks, attempt: str) -> None:
    """Writes under a name of this task attempt, then renames: a file under its final name is always whole.

    A repeated or speculative attempt replaces the file by the same bytes.
    """
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{attempt}"
    with system.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(part, f"{path}/{name}")


def read_file(folder: str, name: str) -> bytes:
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as source:
        return source.read()


def attempt_name() -> tuple[int, str]:
    """Partition number, and a name that no other attempt of a task has."""
    from pyspark import TaskContext
    task = TaskContext.get()
    return (task.partitionId(), f"{task.stageId()}-{task.taskAttemptId()}") if task else (0, f"local-{os.getpid()}")


def next_smaller(ids: DataFrame, id_col: str, extra: list[str]) -> DataFrame:
    """``ids`` with ``next_<id_col>``: the greatest smaller id; after the smallest follows the greatest.

    Sorted by range, so no task sees more than its range; only the border of each partition is looked up elsewhere.
    ``ids`` must hold each id once and no null.
    """
    ranged = ids.select(id_col, *extra).repartitionByRange(F.col(id_col)).withColumn("_p", F.spark_partition_id())
    ranged = stored(ranged, "ranged")  # the split by range is fixed from here on
    inside = Window.partitionBy("_p").orderBy(id_col)
    last = ranged.groupBy("_p").agg(F.max(id_col).alias("_last"))  # one row per partition
    order = Window.partitionBy(F.lit(0)).orderBy("_p")
    before = last.select(F.col("_p"), F.coalesce(
        F.lag("_last").over(order), F.max("_last").over(Window.partitionBy(F.lit(0)))).alias("_before"))
    return (ranged.withColumn("_n", F.lag(id_col).over(inside)).join(before, "_p")
            .select(id_col, *extra, F.coalesce("_n", "_before").alias(f"next_{id_col}")))
