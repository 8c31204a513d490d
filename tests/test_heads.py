"""The store of heads: batches against one scan, replays, broken batches, and what is read."""

import pytest
from pyspark.sql import functions as F

from plotwright.operators import identity as I
from plotwright.operators.heads import HeadStore
from plotwright.sources.listings import CITIES, listings


@pytest.fixture(scope="module")
def every(spark):
    # few enough to compare with a plain scan, alike enough to match
    all_ = listings(spark, "/root/testdata/sf0.01").where("id < 240")
    return all_.withColumn("price", F.when(F.col("price").isNotNull(), F.round(F.col("price") / 20000) * 20000)).withColumn("area", F.when(F.col("area").isNotNull(), F.round(F.col("area") / 60) * 60 + 40)).withColumn("rooms", F.lit(2)).withColumn("city", F.lit("Madrid")).persist()


def heads(df):
    return sorted(tuple(r) for r in df.select("id", "head_id").collect())


def test_batches_are_one_scan(spark, every, tmp_path):
    whole = heads(I.first_heads(every, I.object_pairs(every, CITIES)))
    assert len({h for _, h in whole}) < len(whole)
    store = HeadStore(spark, f"file://{tmp_path}/s", CITIES, buckets=8)
    cuts = [(0, 90), (91, 150), (151, 239)]
    for n, (a, z) in enumerate(cuts):
        got = heads(store.attach(every.where(F.col("id").between(a, z)), n))
        assert got == [r for r in whole if a <= r[0] <= z]
    assert heads(store.links()) == whole
    # A batch that comes again adds nothing, whatever is in it; a new session over the folder knows what is done.
    again = HeadStore(spark, f"file://{tmp_path}/s", CITIES, buckets=8)
    assert again.done() == [0, 1, 2] and heads(again.attach(every, 1)) == [r for r in whole if 91 <= r[0] <= 150]
    assert heads(again.links()) == whole
    # Listings that come again in a later batch keep their link; an empty batch is done as well.
    assert heads(again.attach(every.where("id in (3, 100)"), 3)) == [] and heads(again.attach(every.where("false"), 4)) == []
    assert heads(again.links()) == whole and again.done() == [0, 1, 2, 3, 4]


def test_a_broken_batch_is_written_over(spark, every, tmp_path):
    path = f"file://{tmp_path}/s"
    store = HeadStore(spark, path, CITIES, buckets=8)
    store.attach(every.where("id <= 60"), 0)
    # Rows of a batch that never ended: no "done" names it.
    spark.createDataFrame([(61, 61), (62, 1)], "id long, head_id long").write.parquet(f"{path}/links/batch=1")
    assert heads(store.links())[-1][0] == 60
    store.attach(every.where("id between 61 and 120"), 1)
    assert heads(store.links()) == heads(I.first_heads(every.where("id <= 120"), I.object_pairs(every.where("id <= 120"), CITIES)))


def test_reads_only_buckets_of_its_keys(spark, every, tmp_path):
    store = HeadStore(spark, f"file://{tmp_path}/s", CITIES, buckets=64)
    store.attach(every.where("id <= 200"), 0)
    keyed = lambda df: I.prepare(df, CITIES).select(F.explode(I.block_keys()).alias("k")).select("k.key")
    total = store.table("keys", "key string, weak boolean, head_id long, batch int, bucket int").count()
    few = keyed(every.where("id = 201 and price is not null and address = ''").limit(1))
    one = keyed(every.where("id = 202"))
    read = [store.stored_keys(k, [0]).count() for k in (few, one)]
    assert max(read) < total and min(read) < total / 2
    plan = store.stored_keys(one, [0])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]


def test_nulls(spark, every, tmp_path):
    store = HeadStore(spark, f"file://{tmp_path}/s", CITIES, buckets=4)
    odd = every.where("id <= 20").unionByName(every.where("id = 5").withColumn("id", F.lit(None).cast("long"))).unionByName(every.where("id = 6"))
    assert len(heads(store.attach(odd, 0))) == 21
