"""Listings in the engine's canonical shape, derived from the driver's parts (the driver has no table of listings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.session import spread, table

CITIES = ["Madrid", "Valencia", "Alicante", "Sevilla"]
HOSTS = ["idealista.com", "fotocasa.es", "pisos.com"]
KINDS = ["apartment", "house", "land", "studio"]

SQL = """(select p_partkey as id, case when p_partkey % 17 = 0 then null else round(p_retailprice * (1 + p_size % 9), 0) end::double as price,
  case when p_partkey % 11 = 0 then 'USD' else 'EUR' end as currency, case when p_partkey % 13 = 0 then null else p_size * 5.0 end::double as area,
  nullif(p_size % 6, 0)::int as rooms, case p_partkey % 3 when 0 then 'rent' when 1 then 'sale' end as deal,
  (['apartment', 'house', 'land', 'studio'])[p_partkey % 4 + 1] as kind, (['Madrid', 'Valencia', 'Alicante', 'Sevilla'])[p_size % 5 + 1] as city,
  case when p_partkey % 4 = 0 then 'Calle ' || split_part(p_name, ' ', 1) || ' ' || p_size else '' end as address, split_part(p_name, ' ', 2) as district,
  'https://www.' || (['idealista.com', 'fotocasa.es', 'pisos.com'])[p_partkey % 3 + 1] || '/inmueble/' || (100000 + p_partkey) as url,
  (['idealista.com', 'fotocasa.es', 'pisos.com'])[p_partkey % 3 + 1] as site,
  case when p_partkey % 6 = 0 then p_size % 5 end::int as floor, p_brand as agency, p_name as title from part)"""


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda xs, i: F.get(F.array(*map(F.lit, xs)), i.cast("int"))
    word = lambda i: F.split("p_name", " ")[i]
    site = pick(HOSTS, k % 3)
    return spread(table(spark, sf_dir, "part")).select(
        k.alias("id"), F.when(k % 17 != 0, F.round(F.col("p_retailprice") * (1 + size % 9), 0)).alias("price"),
        F.when(k % 11 == 0, "USD").otherwise("EUR").alias("currency"), F.when(k % 13 != 0, size * 5.0).alias("area"),
        F.nullif(size % 6, F.lit(0)).alias("rooms"), F.when(k % 3 == 0, "rent").when(k % 3 == 1, "sale").alias("deal"),
        pick(KINDS, k % 4).alias("kind"), pick(CITIES, size % 5).alias("city"),
        F.when(k % 4 == 0, F.concat_ws(" ", F.lit("Calle"), word(0), size)).otherwise("").alias("address"), word(1).alias("district"),
        F.concat(F.lit("https://www."), site, F.lit("/inmueble/"), (100000 + k).cast("string")).alias("url"), site.alias("site"),
        F.when(k % 6 == 0, size % 5).alias("floor"), F.col("p_brand").alias("agency"), F.col("p_name").alias("title"),
    )
