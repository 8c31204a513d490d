"""What several corpus operators need: durable cuts of lineage, column guards, salts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.session import durable, shared_dir, spread  # noqa: F401

#: Words are runs of anything but ASCII white space.
NOT_WORD = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, over all cores even if the file is small; for operators in free style."""
    return spread(documents(spark, sf_dir))


#: A key is hot if it has more than this share of the rows, so there are at most 1 / HOT hot keys at any size; fewer than HOT_FLOOR rows are never hot.
HOT, HOT_FLOOR = 1e-4, 64


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with per_key (one row for each key; n: how many of the `total` rows have it) on key, without n.

    Hot keys, of which there are at most 1 / HOT, are broadcast, so their rows stay where they are; the others are
    shuffled. Null keys join nothing.
    """
    least = max(HOT_FLOOR, int(total * HOT))
    hot = F.broadcast(per_key.where(F.col(n) > least).drop(n))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.where(F.col(n) <= least).drop(n), key)
    return rows.join(hot, key).unionByName(cold)


def ascii_lower(text):
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text):
    """Array of words; null where the text has none."""
    return F.split(F.nullif(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit("")), NOT_WORD, -1)


def fresh(columns: list[str], name: str) -> str:
    """name, lengthened until none of columns has it (Spark doesn't tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
