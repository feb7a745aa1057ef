"""Streaming forms: first-seen posts, running token totals, mention volume over time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from pulseloom.operators.aggregates import TOKENS


def first_seen(posts: DataFrame, id_cols: list[str], event_time: str, late: str = "1 day") -> DataFrame:
    """Each post once, the first time it arrives; state older than the watermark is forgotten."""
    return posts.withWatermark(event_time, late).dropDuplicatesWithinWatermark(id_cols)


def running_tokens(usage: DataFrame) -> DataFrame:
    """Token totals by session, stage and model, updated as calls are traced."""
    sums = [F.sum(F.coalesce(c, F.lit(0).cast("bigint"))).alias(c) for c in TOKENS]
    return usage.groupBy("session_id", "stage", "model").agg(*sums)


def mention_volume(posts: DataFrame, topic: str, event_time: str, window: str = "1 day", late: str | None = None) -> DataFrame:
    """Mentions per topic and window; give ``late`` on a stream to close windows."""
    if late is not None:
        posts = posts.withWatermark(event_time, late)
    return posts.groupBy(topic, F.window(event_time, window).alias("_w")).agg(F.count("*").alias("mentions")).select(
        topic, F.col("_w.start").alias("window_start"), "mentions")


def volume_growth(volume: DataFrame, topic: str) -> DataFrame:
    """Change against the topic's window before: one row per window, so a topic's history is short."""
    before = F.lag("mentions").over(Window.partitionBy(topic).orderBy("window_start"))
    return volume.withColumn("previous", before).withColumn("growth", growth(F.col("mentions"), F.col("previous")))


def growth(now: Column, before: Column) -> Column:
    return F.when(before > 0, (now - before) / before)


def streamed_growth(posts: DataFrame, topic: str, event_time: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """``topic, window_start, mentions, previous, growth`` of a stream, a row as soon as a window of a topic closes (append mode).

    State per topic is the counts of its open windows and the count of the last one that closed; a timer at the end of
    the earliest open window wakes it when the watermark has passed. Rows are counted inside each task before they meet by topic, so a
    topic that everybody mentions sends a row per task and window.
    """
    import pandas as pd

    name = "string"
    rows = posts.select(F.col(topic).cast(name).alias("topic"), F.unix_micros(F.window(event_time, window).start).alias("w"),
                        F.unix_micros(F.window(event_time, window).end).alias("e"), F.col(event_time).cast("timestamp").alias("at"))

    def counted(batches):
        for batch in batches:
            if batch.num_rows:
                sums = pa.Table.from_batches([batch]).group_by(["topic", "w", "e"]).aggregate([("at", "max"), ("at", "count")])
                yield from sums.rename_columns(["topic", "w", "e", "at", "n"] if sums.column_names[0] == "topic" else ["at", "n", "topic", "w", "e"]).select(
                    ["topic", "w", "e", "at", "n"]).to_batches()

    partial = rows.mapInArrow(counted, "topic string, w long, e long, at timestamp, n long").withWatermark("at", late)

    def close(key, parts, state):
        starts, ends, counts, before = state.get if state.exists else ([], [], [], None)
        open_ = {s: [e, n] for s, e, n in zip(starts, ends, counts)}
        for part in parts:
            for s, e, n in part.groupby(["w", "e"], as_index=False)["n"].sum().itertuples(index=False):
                open_.setdefault(int(s), [int(e), 0])[1] += int(n)
        passed = state.getCurrentWatermarkMs() * 1000
        done = []
        for s in sorted(s for s, (e, _) in open_.items() if e <= passed):
            n = open_.pop(s)[1]
            done.append((key[0], s, n, before, (n - before) / before if before else None))
            before = n
        left = sorted(open_)
        state.update((left, [open_[s][0] for s in left], [open_[s][1] for s in left], before))
        if left:
            state.setTimeoutTimestamp(max(open_[left[0]][0] // 1000, passed // 1000 + 1))
        out = pd.DataFrame(done, columns=["topic", "w", "mentions", "previous", "growth"])
        yield out.astype({"w": "int64", "mentions": "int64", "previous": "Int64", "growth": "float64"})

    closed = partial.groupBy("topic").applyInPandasWithState(
        close, "topic string, w long, mentions long, previous long, growth double",
        "starts array<long>, ends array<long>, counts array<long>, before long", "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select(F.col("topic").alias(topic), F.timestamp_micros("w").alias("window_start"), "mentions", "previous", "growth")


def latest_of_key(rows: DataFrame, keys: list[str], epoch: str) -> DataFrame:
    """The newest row of each key out of the updates that a stream has written batch by batch."""
    rest = [c for c in rows.columns if c not in (*keys, epoch)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), epoch).alias("_row")).select(*keys, "_row.*")
