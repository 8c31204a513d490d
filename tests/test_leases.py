"""Leases: every verdict, a lost worker, batches of a stream against one pass, timers."""

import random
import time

from pyspark.sql import functions as F

from plotwright.streaming.leases import OUT, answer, leases

SCHEMA = "k string, n long, who string, fin boolean, ts timestamp"


def plain(rows, lease, ttl):
    held, out = {}, {}
    for k, n, who, fin, t in sorted(rows, key=lambda r: (r[4], r[1])):
        out[n], held[k] = answer(held.get(k), who, fin, t, lease, ttl)
    return out


def write(spark, path, part):
    spark.createDataFrame(part, "k string, n long, who string, fin boolean, ts long").withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{path}/in")


def stream(spark, path, lease, ttl, clock=False):
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return leases(s, "k", "n", "who", "fin", "ts", lease, ttl, clock).writeStream.option("checkpointLocation", f"{path}/state").option("path", f"{path}/out")


def told(spark, path):
    return [tuple(r) for r in spark.read.schema(OUT).parquet(f"{path}/out").select("key", "n", "worker", "verdict").collect()]


def run(spark, path, batches, lease, ttl):
    for part in batches:
        write(spark, path, part)
        stream(spark, path, lease, ttl).trigger(availableNow=True).start().awaitTermination(120)
    return told(spark, path)


def test_verdicts():
    log = [("a", False, 0, "claimed"), ("b", False, 5, "busy"), ("b", True, 6, "lost"), ("b", False, 11, "taken_over"), ("a", True, 12, "lost"), ("b", True, 30, "finished"), ("c", False, 40, "done"), ("c", False, 131, "again"), ("c", True, 132, "finished"), ("a", True, 133, "lost")]
    held = None
    for who, fin, t, want in log:
        got, held = answer(held, who, fin, t, 10, 100)
        assert got == want, (who, t)
    assert answer(("a", 0, True), "b", False, 10**9, 10, None)[0] == "done"


def test_stream_over_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), n, rng.choice("abc"), rng.random() < 0.3, 1_700_000_000 + n * rng.choice([1, 30])) for n in range(120)]
    rows.sort(key=lambda r: r[4])
    got = run(spark, str(tmp_path), [rows[:40], rows[40:80], rows[80:]], 600, 900)
    assert {n: v for _, n, _, v in got if n is not None} == plain(rows, 600, 900)


def test_a_lost_worker_is_replaced_once(spark, tmp_path):
    t = 1_700_000_000
    rows = [[("x", 1, "dead", False, t)], [("x", 2, "b", False, t + 61), ("x", 3, "c", False, t + 62)], [("x", 4, "dead", True, t + 63), ("x", 5, "b", True, t + 64), ("x", 6, "c", False, t + 65)]]
    got = run(spark, str(tmp_path), rows, 60, None)
    assert [v for _, n, _, v in sorted(r for r in got if r[1])] == ["claimed", "taken_over", "busy", "lost", "finished", "done"]


def test_timers(spark, tmp_path):
    """A lease that runs out on the clock is told of once, and stays with its holder until another one asks."""
    t, path = 1_700_000_000, str(tmp_path)
    write(spark, path, [("x", 1, "a", False, t)])
    q = stream(spark, path, 1, None, True).trigger(processingTime="1 second").start()
    try:
        for _ in range(120):
            time.sleep(1)
            if any(r[3] == "expired" for r in (told(spark, path) if (tmp_path / "out" / "_spark_metadata").exists() else [])):
                break
        write(spark, path, [("x", 2, "c", False, t + 2)])
        for _ in range(120):
            time.sleep(1)
            if any(r[1] == 2 for r in told(spark, path)):
                break
    finally:
        q.stop()
    got = told(spark, path)
    assert [r for r in got if r[3] == "expired" and r[2] == "a"] == [("x", None, "a", "expired")]
    assert [r[3] for r in got if r[1] == 2] == ["taken_over"]
