"""A judge of texts behind a memo: each text is judged once over all runs, within a budget."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotwright.session import durable

#: A judge gets a list of texts and gives a verdict for each, or None.
Judge = Callable[[list[str]], list]
MEMO = "digest string, verdict string"
BATCH = 64


def memo_of(spark: SparkSession, path: str) -> DataFrame:
    """digest and verdict of all texts that were judged; of verdicts that two runs gave at once, one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], MEMO)
    return spark.read.schema(MEMO + ", run string").parquet(path).groupBy("digest").agg(F.min("verdict").alias("verdict"))


def judge_texts(rows: DataFrame, judge: Judge, path: str, version: str, text: str = "text", budget: float = float("inf"), per_call: float = 1.0, per_char: float = 0.0, verdict: str = "verdict") -> DataFrame:
    """rows with a verdict: the judge's for their text, null for a null text, an unanswered one, or one beyond the budget.

    The memo lies in the folder `path` and is keyed by the judge's version and the text's SHA-256, so a text that stands
    many times, or was judged in an earlier run, costs nothing. The budget bounds the cost of a run's calls (per_call +
    characters * per_char each): new texts are taken by digest as long as they fit; the others wait for the next run. A
    text without an answer isn't remembered. Verdicts are texts. The judge runs in tasks, on Arrow batches of BATCH texts;
    a task that is lost asks again for its texts, and a run that broke off leaves nothing behind. A column of the
    verdict's name is replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop(verdict)
    digest = F.sha2(F.concat_ws(":", F.lit(version), F.col(text)), 256)
    known = memo_of(spark, path)
    asked = rows.where(F.col(text).isNotNull()).select(digest.alias("digest"), F.col(text).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    new = asked.join(known, "digest", "left_anti")
    if budget != float("inf"):
        most = int(budget // per_call) if per_call > 0 else None
        costs = new.select("digest", (F.lit(per_call) + F.char_length("text") * F.lit(per_char)).alias("cost"))
        if most is not None:  # no more can be paid for, so the window is bounded by the budget
            costs = costs.orderBy("digest").limit(most)
        paid = costs.withColumn("sum", F.sum("cost").over(Window.orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= budget)
        new = new.join(paid.select("digest"), "digest")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), BATCH):
                part = b.slice(i, BATCH)
                told = judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if v is None else str(v) for v in told], pa.string())], names=["digest", "verdict"])

    answers = durable(new.select("digest", "text").mapInArrow(ask, MEMO)).where("verdict is not null")
    if answers.limit(1).count():
        answers.write.parquet(f"{path}/run={uuid.uuid4().hex}")  # appears whole or not at all
    memo = memo_of(spark, path).select(F.col("digest").alias("__digest"), F.col("verdict").alias(verdict))
    return rows.withColumn("__key", digest).join(memo, F.col("__key") == F.col("__digest"), "left").drop("__key", "__digest")
