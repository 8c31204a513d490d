"""Keyed writes and state over streams. Offsets and checkpoints take the place of row claims and leases."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plotwright.operators.relational import first_per, insert_ignore


def once_only(stream: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """The first event of each key within the watermark: claims that nobody else repeats."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def insert_ignore_sink(path: str, keys: list[str], order: list):
    """A foreachBatch function that appends the first row of each key that the target folder hasn't got. A batch that is run again adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            target = spark.read.parquet(path)
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            target = spark.createDataFrame([], batch.schema)
        new = insert_ignore(target, batch, keys, order)
        new.write.mode("append").parquet(path)

    return write


def ordered_sink(path: str, order: list):
    """A foreachBatch function that appends each batch in order, under its number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).orderBy(*order).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def seen_with_ttl(stream: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """key, ts, fresh: whether the key wasn't seen in the `seconds` before. A key's state ends with its time."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for f in frames for t in f["t"]):
            fresh = last is None or t - last > seconds
            last = t if fresh else last
            out.append((k[0], t, fresh))
        state.update((last,))
        if state.getCurrentWatermarkMs() <= (last + seconds) * 1000:
            state.setTimeoutTimestamp(int((last + seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "t", "fresh"])

    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", f"{seconds} seconds")
    slim = timed.select(F.col(key).cast("string").alias("key"), F.unix_timestamp("__ts").alias("t"), "__ts")
    return slim.groupBy("key").applyInPandasWithState(step, "key string, t long, fresh boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def refusal_blocks(stream: DataFrame, key: str, order: str, refused: str, limit: int) -> DataFrame:
    """key, n, refusals: after each event, how many refusals stand in a row; blocked from `limit` on."""

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("n")
        out = []
        for n, bad in zip(rows["n"], rows["bad"]):
            run = run + 1 if bad else 0
            out.append((k[0], n, run, run >= limit))
        state.update((run,))
        yield pd.DataFrame(out, columns=["key", "n", "refusals", "blocked"])

    slim = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("n"), F.col(refused).alias("bad"))
    return slim.groupBy("key").applyInPandasWithState(step, "key string, n long, refusals int, blocked boolean", "run int", "append", GroupStateTimeout.NoTimeout)


def refusal_runs(events: DataFrame, key: str, order: str, refused: str, limit: int) -> DataFrame:
    """The same in batch: gaps and islands, in one window per key."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    island = F.count_if(~F.col(refused)).over(w)
    run = F.count_if(F.col(refused)).over(Window.partitionBy(key, "__island").orderBy(order))
    return events.withColumn("__island", island).withColumn("refusals", run).withColumn("blocked", F.col("refusals") >= limit).drop("__island")


def reuse_gap(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events whose key was last seen more than `seconds` before (or never): batch form of a reuse window."""
    from pyspark.sql import Window

    last = F.lag(F.unix_timestamp(F.col(ts).cast("timestamp"))).over(Window.partitionBy(key).orderBy(ts))
    return events.withColumn("__gap", F.unix_timestamp(F.col(ts).cast("timestamp")) - last).where(F.col("__gap").isNull() | (F.col("__gap") > seconds)).drop("__gap")


def stale_batches(batches: DataFrame, beat: str, now, seconds: int) -> DataFrame:
    """Open batches whose last beat is older than the limit."""
    return batches.where((F.col("state") == "running") & (F.unix_timestamp(now) - F.unix_timestamp(F.col(beat).cast("timestamp")) > seconds))


def latest_state(moves: DataFrame, key: str, order: list, state: str) -> DataFrame:
    """Where each key stands after its last move."""
    return first_per(moves, [key], order).select(key, state)
