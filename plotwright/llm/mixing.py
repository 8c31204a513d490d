"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.llm.common import durable, fresh

#: A broadcast of rates is allowed up to this many table entries (8 bytes each); beyond it the join is salted.
BROADCAST_ENTRIES = 1_000_000
SALTS = 64
#: A document with more copies than this is written in blocks of so many, which are shuffled before they are repeated.
SPLIT = 4096


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of MD5 over the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_p(k: Column, rate: Column) -> Column:
    """P(X = k). Small k by the definition; others by Stirling's series and the logarithm of rate / k near 1, which loses nothing where both are large."""
    small = F.exp(k * F.ln(rate) - rate) / F.factorial(F.least(k, F.lit(20)).cast("int"))
    stirling = (1 / 12 - (1 / 360 - F.lit(1 / 1260) / k / k) / k / k) / k
    large = F.exp(k * F.log1p((rate - k) / k) - (rate - k) - stirling) / F.sqrt(F.lit(2 * math.pi) * k)
    return F.coalesce(F.when(k == 0, F.exp(-rate)).when(k <= 20, small).otherwise(large), F.lit(0.0))


def poisson_tables(rates: DataFrame, of: str, rate: str) -> DataFrame:
    """of, rate, low, step, ends: the distribution function of each rate from `low` on, at the end of every block of `step` numbers.

    The numbers reach 12 deviations and 30 to both sides of the rate, beyond which less than 2**-52 lies. Blocks are an
    eighth of a deviation long, so a table has 500 entries at most whatever the rate, and each of its blocks is summed in
    a row of its own. The last entry is 1.
    """
    r = F.col(rate)
    reach = 12 * F.sqrt(r) + 30
    low, step = F.greatest(F.floor(r - reach), F.lit(0)).cast("long"), F.greatest(F.floor(F.sqrt(r) / 8), F.lit(1)).cast("long")
    known = rates.select(of, rate, low.alias("low"), step.alias("step"), F.ceil((F.ceil(r + reach) - low + 1) / step).alias("blocks"))
    each = known.select(of, rate, "low", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    k = F.col("low") + F.col("block") * F.col("step")
    each = each.withColumn("first", k).withColumn("p", poisson_p(k, r))
    add = lambda acc, i: F.struct((acc["p"] * F.col(rate) / (F.col("first") + i)).alias("p"), (acc["sum"] + acc["p"] * F.col(rate) / (F.col("first") + i)).alias("sum"))
    mass = F.when(F.col("step") > 1, F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("step") - 1), F.struct(F.col("p").alias("p"), F.col("p").alias("sum")), add, lambda acc: acc["sum"])).otherwise(F.col("p"))
    rows = each.groupBy(of, rate, "low", "step").agg(F.array_sort(F.collect_list(F.struct("block", mass.alias("mass")))).alias("masses"))
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x["mass"]))
    sums = rows.withColumn("sums", F.aggregate("masses", F.array().cast("array<double>"), grow))
    whole = F.element_at("sums", -1)
    return sums.select(of, rate, "low", "step", F.transform("sums", lambda x: x / whole).alias("ends"), whole.alias("whole"))


def poisson_inverse(draw: Column, table: Column) -> Column:
    """The smallest number whose distribution function reaches draw. table: a row of poisson_tables as struct(rate, low, step, ends, whole)."""
    block = F.size(F.filter(table["ends"], lambda e: e < draw)).cast("long")
    first = table["low"] + block * table["step"]
    start = F.struct(poisson_p(first, table["rate"]).alias("p"), F.coalesce(F.try_element_at(table["ends"], F.nullif(block.cast("int"), F.lit(0))), F.lit(0.0)).alias("sum"), F.lit(0).cast("long").alias("n"))

    def walk(acc, i):
        total = acc["sum"] + acc["p"] / table["whole"]
        return F.struct((acc["p"] * table["rate"] / (first + i + 1)).alias("p"), total.alias("sum"), (acc["n"] + (total < draw).cast("long")).alias("n"))

    inside = F.aggregate(F.sequence(F.lit(0).cast("long"), table["step"] - 2), start, walk, lambda acc: acc["n"])
    return F.when(table["step"] > 1, first + inside).otherwise(first)


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source (null is one): its code points and its mean repetition rate, so that the expected mix has `epochs` times the corpus in code points, split by weight. A source without any code points keeps rate 1, since no rate moves its share."""
    sizes = durable(docs.groupBy(F.col(source).alias("__source")).agg(F.sum(F.char_length(F.coalesce(F.col(text), F.lit("")))).cast("double").alias("__size")))
    given = F.lit(None).cast("double")
    for name, weight in weights.items():
        given = F.when(F.col("__source") == name, F.lit(float(weight))).otherwise(given)
    sizes = sizes.withColumn("__weight", F.coalesce(given, F.lit(float(default_weight))))
    total = sizes.where("__size > 0").agg(F.sum("__size"), F.sum("__weight")).first()
    if not total or not total[0]:
        return sizes.withColumn("__rate", F.lit(1.0))
    return sizes.withColumn("__rate", F.when(F.col("__size") > 0, F.lit(epochs * total[0]) * F.col("__weight") / F.lit(total[1]) / F.col("__size")).otherwise(1.0))


def mix_sources(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 42, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All columns of docs plus n_copies, copy_no (from 1) and mix_key, in an order shuffled over the whole corpus.

    Every document is repeated as often as a Poisson variable with its source's rate says, whose uniform number is a
    hash of the seed, the key and the text: the same document has the same count in every run, wherever it is computed.
    Rows with the same key and text have the same count and the same mix_key for each copy; a null key, source or text
    counts as a value of its own (text: empty). Columns of docs with the added names (in any case of letters) are
    replaced. A text of any length is carried whole. Partitions are dealt by mix_key and by a number that no two rows
    share, so neither rows without a key nor equal rows meet in one task; ties of the hash can't matter, since it orders
    copies only within a partition. A document with very many copies is dealt over tasks in blocks. An empty table gives
    an empty one.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_copies", "copy_no", "mix_key")])
    of, table, draw, salt, part, block, body, row = (fresh(docs.columns, c) for c in ("__of", "__table", "__draw", "__salt", "__part", "__block", "__body", "__row"))
    rates = source_rates(docs, weights, default_weight, epochs, source, text).select(F.col("__source").alias(of), F.col("__rate").alias("rate"))
    tables = durable(poisson_tables(rates, of, "rate").select(of, F.struct("rate", "low", "step", "ends", "whole").alias(table)))
    size = tables.agg(F.sum(F.size(f"{table}.ends")), F.max(F.col(f"{table}.low") + F.col(f"{table}.step") * F.size(f"{table}.ends"))).first()
    same = F.col(source).eqNullSafe(F.col(of))
    if (size[0] or 0) <= BROADCAST_ENTRIES:
        joined = docs.join(F.broadcast(tables), same, "left")
    else:
        spread = docs.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        tables = tables.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = spread.join(tables, same & (F.col(salt) == F.col(part)), "left").drop(salt, part)
    joined = joined.withColumn(body, F.md5(F.coalesce(F.col(text), F.lit(""))))
    held = [*docs.columns, body]
    out = joined.withColumn(draw, uniform(seed, F.col(key), F.col(body))).withColumn("n_copies", poisson_inverse(F.col(draw), F.col(table))).where("n_copies > 0").select(*held, "n_copies")
    one, n = F.lit(1).cast("long"), F.col("n_copies")
    copies = lambda df, first, last: df.select(*held, "n_copies", F.explode(F.sequence(first, last)).alias("copy_no"))
    if (size[1] or 0) <= SPLIT:  # no source's numbers get there
        out = copies(out, one, n)
    else:
        blocks = out.where(n > SPLIT).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / SPLIT))))
        blocks = blocks.repartition(F.col(block), F.monotonically_increasing_id())
        out = copies(out.where(n <= SPLIT), one, n).unionByName(copies(blocks, F.col(block) * SPLIT + 1, F.least(n, (F.col(block) + 1) * SPLIT)))
    out = out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(str(seed + 1)), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(body), F.col("copy_no").cast("string"))))
    # Hashes decide the partition and the place in it, which permutes the whole corpus without a sampling pass.
    dealt = out.withColumn(row, F.monotonically_increasing_id()).repartition(F.col("mix_key"), F.col(row))
    return dealt.sortWithinPartitions("mix_key").drop(body, row)


#: Production mix: shares of code points in the result, by source; sources that aren't named get the default.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
DEFAULT_WEIGHT, EPOCHS, SEED = 1.0, 1.0, 42


def op1_poisson_mix(spark, sf_dir):
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS, DEFAULT_WEIGHT, EPOCHS, SEED)


ORACLE = """
with recursive sz as (
  select source, sum(length(coalesce(text, '')))::double as size,
         (case source when 'src0' then 4.0 when 'src1' then 2.0 when 'src2' then 2.0 when 'src3' then 0.5 else 1.0 end)::double as weight
  from documents group by source),
tot as (select sum(size) as size, sum(weight) as weight from sz where size > 0),
r as (select source, case when sz.size > 0 then 1.0::double * tot.size * sz.weight / tot.weight / sz.size else 1.0::double end as rate from sz, tot),
p(source, rate, k, log_p, cdf) as (
  select source, rate, 0, -rate, exp(-rate) from r
  union all
  select source, rate, k + 1, log_p + ln(rate / (k + 1)), cdf + exp(log_p + ln(rate / (k + 1))) from p where k < ceil(rate + 12 * sqrt(rate) + 30)),
l as (select source, list(cdf order by k) as cdf from p group by source),
d as (
  select documents.*, len(list_filter(l.cdf, lambda c: c < ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint / 4503599627370496.0)) as n_copies
  from documents join l on documents.source is not distinct from l.source),
e as (select *, unnest(range(1, n_copies + 1)) as copy_no from d where n_copies > 0)
select doc_id, text, lang, source, n_chars, n_copies::bigint as n_copies, copy_no::bigint as copy_no,
       md5('43:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, '')) || ':' || copy_no::varchar) as mix_key
from e
"""
