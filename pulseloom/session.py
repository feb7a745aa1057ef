"""Session construction and lineage control."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "pulseloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session the cluster gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PULSELOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder iterative operators cut lineage into.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a folder of
    its own: a machine-local folder would lose the data together with the machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pulseloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that a loop's plan does not grow and a lost executor costs no replay."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: list[str] = []  # folders of this driver, for ``remove_stored``


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the same folder and read back.

    Like ``cut``, for loops of many rounds: the optimizer knows nothing of a table's past (constraints of a checkpoint grow from
    round to round), but its size, so that small tables are joined without a shuffle.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote, once all that was made of them is written as well.

    Shuffle files go when the driver collects its garbage, here and in the JVM, which it may not do for long: it is asked to as well.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for table in tables for f in table.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        target.getFileSystem(conf).delete(target, True)
    gc.collect()
    jvm.System.gc()


def remove_stored(spark: SparkSession) -> int:
    """Removes the tables written so far; for after their results are written elsewhere."""
    removed, conf = 0, spark.sparkContext._jsc.hadoopConfiguration()
    while _STORED:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        removed += bool(target.getFileSystem(conf).delete(target, True))
    return removed
