"""Writing results: documents, post side tables, stage tables, vector tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulseloom.operators import sets
from pulseloom.operators.embedding import embed
from pulseloom.session import stored


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").json(path)


def posts_by_id(posts: DataFrame) -> DataFrame:
    """Side table of posts keyed by session and id: what a run attaches to its document, whole at any size."""
    return posts.select("session_id", F.col("id").alias("post_id"), F.struct(*[c for c in posts.columns if c != "session_id"]).alias("post"))


class StageTables:
    """One parquet table per stage of a run, in a folder all executors share. A finished stage is read, not repeated."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def done(self, stage: str) -> bool:
        return path_exists(self.spark, self.path(stage) + "/_SUCCESS")

    def read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage))

    def forget(self, stage: str) -> None:
        """Takes a stage for unfinished from now on."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(stage) + "/_SUCCESS")
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, False)

    def run(self, stages: dict[str, Callable[["StageTables"], DataFrame]], start: str | None = None, end: str | None = None,
            stop_when_empty: tuple[str, ...] = ()) -> list[str]:
        """Build the stages from ``start`` (default: the first unfinished) to ``end``, but no more after an empty result of
        one of ``stop_when_empty``. Stages after a rebuilt one count as unfinished until they are built again.

        Returns the stages that were built.
        """
        names = list(stages)
        first = names.index(start) if start else next((i for i, n in enumerate(names) if not self.done(n)), len(names))
        last = names.index(end) if end else len(names) - 1
        built = []
        for name in names[first:]:
            self.forget(name)
        for name in names[first:last + 1]:
            stages[name](self).write.mode("overwrite").parquet(self.path(name))
            built.append(name)
            if name in stop_when_empty and self.read(name).limit(1).count() == 0:
                break
        return built


class SessionStages:
    """Stages of many sessions, finished one by one: a dataset per stage, partitioned by run, and a record of what is complete.

    A stage is built for the sessions that have no valid record of it, and only their rows are written, as the partition of that run.
    Rows count only if their session's record names the run: what a failed run leaves behind, or what a session had before it was
    built again, is never read, and runs that no record names any more are removed. So the number of files follows the data and the
    runs, not the sessions. Records are only appended; the latest of a stage and session holds.
    """

    RECORD = "stage string, session_id {kind}, run long, valid boolean"

    def __init__(self, spark: SparkSession, folder: str, kind: str = "long"):
        self.spark, self.folder, self.kind = spark, folder, kind

    def path(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def _records(self) -> DataFrame:
        path, schema = f"{self.folder}/records", self.RECORD.format(kind=self.kind)
        log = self.spark.read.schema(schema).parquet(path) if path_exists(self.spark, path) else self.spark.createDataFrame([], schema)
        return log.groupBy("stage", "session_id").agg(F.max_by(F.struct("run", "valid"), "run").alias("_r")).select("stage", "session_id", "_r.*")

    def _note(self, sessions: DataFrame, stages: list[str], run: int, valid: bool) -> None:
        rows = sessions.select(F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"), "session_id", F.lit(run).cast("long").alias("run"), F.lit(valid).alias("valid"))
        rows.write.mode("append").parquet(f"{self.folder}/records")

    def _next_run(self) -> int:
        return (self._records().agg(F.max("run")).first()[0] or 0) + 1

    def done(self, stage: str) -> DataFrame:
        """``session_id, run`` of the sessions that are complete."""
        return self._records().filter((F.col("stage") == stage) & F.col("valid")).select("session_id", "run")

    def read(self, stage: str, sessions: DataFrame | None = None) -> DataFrame:
        """The complete sessions' rows, or those of some of them; runs that built none of them are not opened."""
        wanted = self.done(stage) if sessions is None else self.done(stage).join(sessions.select("session_id"), "session_id", "left_semi")
        schema = self.spark.read.parquet(f"{self.folder}/schemas").filter(F.col("stage") == stage).agg(F.max_by("schema", "run")).first()[0]
        rows = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(self.path(stage))  # no session may have a row
        own = wanted.select("session_id", F.col("run").alias("_run"))
        return rows.join(own, ["session_id", "_run"], "left_semi").drop("_run")

    def forget(self, sessions: DataFrame, stages: list[str]) -> None:
        """Takes the stages of these sessions for unfinished from now on."""
        self._note(sessions.select("session_id").distinct(), stages, self._next_run(), False)

    def run(self, stages: dict[str, Callable[["SessionStages", DataFrame], DataFrame]], sessions: DataFrame) -> dict[str, int]:
        """Build each stage for those of ``sessions`` that lack it; ``{stage: sessions built}``.

        A stage function gets the sessions to build (``session_id``) and returns rows of these only. Rebuilding a stage of a
        session makes its later ones unfinished.
        """
        names, built = list(stages), {}
        for k, name in enumerate(names):
            todo = stored(sessions.select("session_id").distinct().join(self.done(name), "session_id", "left_anti"))
            built[name] = todo.count()
            if not built[name]:
                continue
            run = self._next_run()
            rows = stages[name](self, todo).withColumn("_run", F.lit(run).cast("long"))
            # a file holds the rows of many sessions, a large session's lie in several
            rows.hint("rebalance", "session_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run").parquet(self.path(name))
            self.spark.createDataFrame([(name, run, rows.schema.json())], "stage string, run long, schema string").write.mode("append").parquet(f"{self.folder}/schemas")
            self._note(todo, [name], run, True)
            if names[k + 1:]:
                self._note(todo, names[k + 1:], run, False)
            self._tidy(name)
        return built

    def _tidy(self, stage: str) -> None:
        """Removes the runs of a stage that no session's record names any more. There are as many rows here as runs at most."""
        named = {r[0] for r in self._records().filter(F.col("stage") == stage).select("run").distinct().collect()}
        if not path_exists(self.spark, self.path(stage)):  # no row so far
            return
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(stage))
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for found in files.listStatus(folder):
            name = found.getPath().getName()
            if name.startswith("_run=") and int(name.removeprefix("_run=")) not in named:
                files.delete(found.getPath(), True)


class BucketedTable:
    """A table in a fixed number of partitions by key, changed where keys change: partitions without a changed key are not touched.

    ``bucket`` gives the partition of a row from its key columns alone, a whole number below ``buckets``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 256, bucket: Column | None = None):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if bucket is None else bucket

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", self.bucket.cast("int"))

    def _write(self, rows: DataFrame) -> None:
        self._placed(rows).hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._write(rows)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("_bucket")

    def change(self, changed: DataFrame, rebuild: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the partitions that may hold the keys of ``changed`` by ``rebuild`` of their rows; the partitions' numbers.

        New rows are whole before any old ones go. A partition left without rows is removed.
        """
        touched = sorted(r[0] for r in self._placed(changed.select(*self.keys)).select("_bucket").distinct().collect())  # at most all buckets
        if touched:
            old = self.spark.read.parquet(self.path).filter(F.col("_bucket").isin(touched)).drop("_bucket")
            new = stored(rebuild(old))
            self._write(new)
            left = {r[0] for r in self._placed(new).select("_bucket").distinct().collect()}
            for number in set(touched) - left:
                target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_bucket={number}")
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return touched

    def insert_or_update(self, fresh: DataFrame, updated: list[str]) -> list[int]:
        return self.change(fresh, lambda old: sets.insert_or_update(old, fresh, self.keys, updated))

    def patch(self, changes: DataFrame) -> list[int]:
        return self.change(changes, lambda old: sets.patch(old, changes, self.keys))

    def delete(self, removed: DataFrame) -> list[int]:
        return self.change(removed, lambda old: old.join(removed.select(*self.keys).distinct(), self.keys, "left_anti"))


def append_vectors(rows: DataFrame, path: str) -> None:
    """Append to a vector table, creating it on the first write."""
    rows.write.mode("append").parquet(path)


def catcher_vectors(catchers: DataFrame, sessions: DataFrame, embedder=None, dims: int = 256) -> DataFrame:
    """Trend catchers as searchable rows: ``trend - angle`` with its vector."""
    texts = catchers.join(sessions.select("session_id", F.col("seed").alias("topic")), "session_id").select(
        F.sha2(F.concat_ws("/", F.col("session_id").cast("string"), F.col("place").cast("string")), 256).alias("id"),
        F.concat("trend", F.lit(" - "), "angle").alias("text"), "session_id", "topic", F.lit(1.0).alias("score"))
    return embed(texts, "text", "vector", embedder, dims)
