"""Clusters kept across batches: new listings join the heads that are already stored, or become heads themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.operators import identity as I
from plotwright.session import durable

#: Folders that keys and heads are dealt to; a batch reads those of its own keys.
BUCKETS = 256
#: What contradicts a pair most often, which travels with the keys.
FACTS = {"price": "double", "area": "double", "rooms": "int", "deal": "string", "currency": "string", "floor": "int"}


class HeadStore:
    """Heads of clusters in a folder that outlives the session.

    Three tables, each written batch by batch: `heads` (a head's listing as the rules compare it, by bucket of its id),
    `keys` (its block keys, by bucket of the key, sorted) and `links` (every listing and its head). A batch is written in
    whole under its number and named in `done` last, so one that is run again finds itself done, and one that broke off
    is written over. Batches come in the order of ids, each with ids above those before it; then the heads are those of
    one scan over everything. A row may come again in a later batch and gets the link that it has.

    Only folders of buckets that a batch's own keys fall in are read, and of these the rows that meet a key.
    """

    def __init__(self, spark: SparkSession, path: str, cities: list[str], optional: tuple = (), id: str = "id", buckets: int = BUCKETS):
        self.spark, self.path, self.cities, self.optional, self.id, self.buckets = spark, path.rstrip("/"), cities, optional, id, buckets

    def done(self) -> list[int]:
        """Numbers of the batches that were written whole."""
        if not self._there("done"):
            return []
        return sorted(r.batch for r in self.spark.read.schema("batch int").parquet(f"{self.path}/done").distinct().collect())  # one for each batch

    def _there(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def table(self, name: str, schema, batches: list[int] | None = None) -> DataFrame:
        """All rows of a table that whole batches wrote."""
        batches = self.done() if batches is None else batches
        whole = [f"{self.path}/{name}/batch={b}" for b in batches if self._there(f"{name}/batch={b}")]
        if not whole:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*whole)

    def bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def links(self) -> DataFrame:
        """id and head_id of every listing so far."""
        return self.table("links", "id long, head_id long").select("id", "head_id")

    def stored_keys(self, keyed: DataFrame, batches: list[int]) -> DataFrame:
        """Stored keys of the buckets that these keys fall in."""
        schema = "key string, weak boolean, head_id long, f struct<" + ",".join(f"{c}:{kind}" for c, kind in FACTS.items()) + ">, batch int, bucket int"
        touched = [r.bucket for r in keyed.select(self.bucket("key").alias("bucket")).distinct().collect()]  # BUCKETS at most
        return self.table("keys", schema, batches).where(F.col("bucket").isin(touched))

    def attach(self, batch: DataFrame, number: int) -> DataFrame:
        """id and head_id of a batch's listings; a batch that is done already adds nothing.

        A listing joins the first stored head that it matches; the others are scanned among themselves, in order of id.
        Null ids are no listings; equal ids are one. Rows of one id must be equal.
        """
        links = "id long, head_id long, batch int"
        done = self.done()
        if number in done:
            return self.table("links", links, [number]).select("id", "head_id")
        known = self.links()
        new = batch.where(F.col(self.id).isNotNull()).dropDuplicates([self.id]).join(known.select(F.col("id").alias(self.id)), self.id, "left_anti")
        ready = durable(I.prepare(new, self.cities))
        facts = F.struct(*[F.col(c).cast(kind).alias(c) for c, kind in FACTS.items()])
        keyed = durable(ready.select(F.col(self.id).alias("id"), facts.alias("f"), F.explode(I.block_keys(self.optional)).alias("k")).select("id", "f", "k.key", "k.weak"))
        attached = durable(self._attached(ready, keyed, done))
        rest = ready.join(attached.select(F.col("id").alias(self.id)), self.id, "left_anti")
        loose = new.join(attached.select(F.col("id").alias(self.id)), self.id, "left_anti")
        scanned = durable(I.clusters(loose, self.cities, self.optional, self.id))
        linked = attached.unionByName(scanned)
        heads = scanned.where("id = head_id").select(F.col("id").alias(self.id))
        linked.write.mode("overwrite").parquet(f"{self.path}/links/batch={number}")
        stored = rest.join(heads, self.id).withColumn("bucket", self.bucket(self.id))
        stored.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/heads/batch={number}")
        keys = keyed.join(heads.withColumnRenamed(self.id, "id"), "id").select("key", "weak", F.col("id").alias("head_id"), "f").withColumn("bucket", self.bucket("key"))
        # By key, not by bucket alone, so a bucket may have several files, each with a range of its keys.
        keys.repartitionByRange("bucket", "key", "head_id").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/batch={number}")
        self.spark.createDataFrame([(number,)], "batch int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/done/number={number}")
        return self.table("links", links, [number]).select("id", "head_id")

    def _attached(self, ready: DataFrame, keyed: DataFrame, done: list[int]) -> DataFrame:
        """id and head_id of the new listings that match a stored head: the smallest one."""
        none = self.spark.createDataFrame([], "id long, head_id long")
        if not done:
            return none
        stored = self.stored_keys(keyed, done).select("key", F.col("weak").alias("weak_"), "head_id", F.col("f").alias("g"))
        a, b = F.col("f"), F.col("g")
        known = lambda x: F.coalesce(a[x] != b[x], F.lit(False))
        against = known("deal") | known("currency") | known("rooms") | known("floor")
        if I.same_parcels not in self.optional:
            against = against | F.coalesce(~I.X.close(a["price"], b["price"], I.PRICE), F.lit(False)) | F.coalesce(~I.X.close(a["area"], b["area"], I.AREA), F.lit(False))
        met = keyed.join(stored, "key").where(~(F.col("weak") & F.col("weak_")) & ~against & (F.col("id") != F.col("head_id"))).select("id", "head_id").distinct()
        met = durable(met)
        wanted = [r.bucket for r in met.select(self.bucket("head_id").alias("bucket")).distinct().collect()]  # BUCKETS at most
        schema = T.StructType([*ready.schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        heads = self.table("heads", schema, done).where(F.col("bucket").isin(wanted))
        side = lambda df, n, key: df.select(F.col(self.id).alias(key), F.struct(*[c for c in ready.columns if c != self.id]).alias(n))
        both = met.join(side(ready, "a", "id"), "id").join(side(heads, "b", "head_id"), "head_id")
        return both.where(I.judged(self.optional)).groupBy("id").agg(F.min("head_id").alias("head_id"))
