"""Streams in several batches: keyed writes stay idempotent, state lives across batches."""

import glob
import os

from pyspark.sql import functions as F

from plotwright.streaming import state as S

#: A watermark begins at second 0, so events are later.
START = 10_000
SCHEMA = "k string, n long, ts timestamp, bad boolean"


def batches(spark, path, rows):
    """A file per batch, in order of their times."""
    for i, part in enumerate(rows):
        known = set(glob.glob(f"{path}/in/*.parquet"))
        spark.createDataFrame(part, "k string, n long, s long, bad boolean").select("k", "n", F.timestamp_seconds(F.col("s") + START).alias("ts"), "bad").coalesce(1).write.mode("append").parquet(f"{path}/in")
        for f in set(glob.glob(f"{path}/in/*.parquet")) - known:
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(spark, path, out):
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{path}/out").collect()]


ROWS = [[("a", 1, 0, True), ("b", 2, 1, False)], [("a", 3, 50, True), ("c", 4, 60, True)], [("a", 5, 200, True), ("b", 6, 201, False), ("a", 7, 202, False)]]


def test_insert_ignore_over_batches(spark, tmp_path):
    s = batches(spark, tmp_path, ROWS)
    sink = S.insert_ignore_sink(f"{tmp_path}/t", ["k"], [F.col("n")])
    s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {(r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert got == {("a", 1), ("b", 2), ("c", 4)}
    sink(spark.read.parquet(f"{tmp_path}/in"), 0)  # a batch that is run again
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_ordered_sink_overwrites_its_batch(spark, tmp_path):
    write = S.ordered_sink(f"{tmp_path}/o", ["n"])
    one = spark.createDataFrame([(2,), (1,)], "n long")
    write(one, 0)
    write(one, 0)
    assert spark.read.parquet(f"{tmp_path}/o").count() == 2


def test_refusals_across_batches(spark, tmp_path):
    got = run(spark, tmp_path, S.refusal_blocks(batches(spark, tmp_path, ROWS), "k", "n", "bad", 3))
    assert sorted(got) == [("a", 1, 1, False), ("a", 3, 2, False), ("a", 5, 3, True), ("a", 7, 0, False), ("b", 2, 0, False), ("b", 6, 0, False), ("c", 4, 1, False)]


def test_batch_form_agrees(spark):
    flat = spark.createDataFrame([r for b in ROWS for r in b], "k string, n long, s long, bad boolean")
    got = [(r.k, r.n, r.refusals, r.blocked) for r in S.refusal_runs(flat, "k", "n", "bad", 3).collect()]
    assert sorted(got) == [("a", 1, 1, False), ("a", 3, 2, False), ("a", 5, 3, True), ("a", 7, 0, False), ("b", 2, 0, False), ("b", 6, 0, False), ("c", 4, 1, False)]


def test_state_with_a_time_limit(spark, tmp_path):
    got = run(spark, tmp_path, S.seen_with_ttl(batches(spark, tmp_path, ROWS), "k", "ts", 100))
    assert {(k, t): fresh for k, t, fresh in got if k == "a"} == {("a", START): True, ("a", START + 50): False, ("a", START + 200): True, ("a", START + 202): False}


def test_once_only(spark, tmp_path):
    got = run(spark, tmp_path, S.once_only(batches(spark, tmp_path, ROWS[:2]), "k", "ts", "1 hour").select("k", "n"))
    assert {k for k, _ in got} == {"a", "b", "c"} and len(got) == 3


def test_reuse_gap(spark):
    flat = spark.createDataFrame([r for b in ROWS for r in b], "k string, n long, s long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.n for r in S.reuse_gap(flat, "k", "ts", 100).collect()) == [1, 2, 4, 5, 6]
