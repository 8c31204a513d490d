import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from plotwright.llm import mixing, near_dedup
from plotwright.llm.queries import ORACLES, QUERIES

from .test_queries import documents, roots5


def same_as_sql(spark, name, path, tables):
    con = duckdb.connect()
    for t in tables:
        columns = "doc_id, text, lang, source, n_chars" if t == "documents" else "*"
        con.sql(f"create view {t} as select {columns} from read_parquet('{path}/{t}.parquet{'' if 'testdata' in path else '/*.parquet'}')")
    con.execute(ORACLES[name])
    columns = [c[0] for c in con.description]
    found = QUERIES[name](spark, path).select(*columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, con.fetchall()))


def test_op1(spark, odd, sf):
    same_as_sql(spark, "op1_poisson_mix", sf, ["documents"])
    same_as_sql(spark, "op1_poisson_mix", odd, ["documents"])


def test_op1_reaches_its_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 100) as text", "if(id % 10 = 0, 'small', 'large') as source")
    out = mixing.mix_sources(docs, {"small": 3.0, "large": 1.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["small"] / sum(n.values()) - 0.75) < 0.02 and abs(sum(n.values()) / 20_000 - 1) < 0.05
    order = np.array([r.doc_id for r in out.select("doc_id").collect()])
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.05


def test_op1_large_rates(spark):
    rows = [(i, "y" if i else "x" * 10**6, "b" if i else "a") for i in range(50)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {})
    n = out.where("source = 'b'").count()
    assert abs(n / 500_024 - 1) < 0.01


def test_op8(spark, odd, sf):
    same_as_sql(spark, "op8_perspective_rotation", sf, ["conversations"])
    same_as_sql(spark, "op8_perspective_rotation", odd, ["conversations"])


def test_op1_any_rate(spark):
    """The inverse against sums from zero, and at rates that no array could hold against the normal curve."""
    from statistics import NormalDist

    draws = [1e-9, 0.001, 0.1, 0.5, 0.77, 0.999]
    rates = [0.0, 0.01, 0.7, 3.0, 57.3, 190.0, 250.0, 1e6, 1e9, 1e12]
    tables = mixing.poisson_tables(spark.createDataFrame([(r,) for r in rates], "rate double").withColumn("of", F.col("rate")), "of", "rate")
    tables = tables.select("of", F.struct("rate", "low", "step", "ends", "whole").alias("t"), F.explode(F.array(*map(F.lit, draws))).alias("u"))
    for r in tables.select("of", "u", F.size("t.ends").alias("n"), mixing.poisson_inverse(F.col("u"), F.col("t")).alias("k")).collect():
        z = NormalDist().inv_cdf(r.u)
        if r.of <= 250:
            k, total = 0, math.exp(-r.of)
            while total < r.u:
                k += 1
                total += math.exp(k * math.log(r.of) - r.of - math.lgamma(k + 1))
            assert r.k == k, r
        else:
            assert abs(r.k - (r.of + z * math.sqrt(r.of) + (z * z - 1) / 6)) < 2 + 1e-6 * math.sqrt(r.of), r
        assert r.n <= 500


def test_op1_many_copies_of_one_document(spark, monkeypatch):
    """Blocks change nothing but where copies are made."""
    docs = spark.createDataFrame([(1, "x", "small", "a"), (2, "y" * 900, "large", "b")], "doc_id long, text string, source string, COPY_NO string")
    whole = sorted(map(tuple, mixing.mix_sources(docs, {}, epochs=3.0).select("doc_id", "n_copies", "copy_no", "mix_key").collect()))
    monkeypatch.setattr(mixing, "SPLIT", 7)
    assert sorted(map(tuple, mixing.mix_sources(docs, {}, epochs=3.0).select("doc_id", "n_copies", "copy_no", "mix_key").collect())) == whole
    assert abs(len(whole) / 1353 - 1) < 0.15


def test_op8_pieces(spark, odd, monkeypatch):
    """Dialogues over many pieces, with a turn without a number, names that differ in signs alone, and parts."""
    from plotwright.llm import chat

    rows = [(1, i if i % 7 else i // 50, f"p {i % 3}" if i % 2 else f"p_{i % 3}", f"text {i} ü") for i in range(400)] + [(1, None, "é", "late"), (1, -3, "system", "first"), (None, 1, "p", "x")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", docs.toArrow())
    want = sorted(map(repr, con.sql(ORACLES["op8_perspective_rotation"]).fetchall()))
    monkeypatch.setattr(chat, "PIECE", 900)
    found = chat.perspective_dialogues(docs)
    assert sorted(map(repr, map(tuple, found.collect()))) == want and found.count() == 8
    monkeypatch.setattr(chat, "PART", 3000)
    parts = {}
    for r in chat.perspective_dialogues(docs).orderBy("part").collect():
        parts.setdefault((r.conv_id, r.perspective), []).append(r)
    whole = {(r.conv_id, r.perspective): r for r in found.collect()}
    assert len(parts[1, "é"]) > 3
    for k, some in parts.items():
        assert "".join(r.rendered for r in some) == whole[k].rendered and sum(r.n_turns for r in some) == whole[k].n_turns
        own = lambda r: [r.rendered[int(a) : int(b)] for a, b in (x.split("-") for x in r.loss_spans.split(",") if x)]
        assert [x for r in some for x in own(r)] == own(whole[k])


def test_op8_spans_hold_the_own_turns(spark, odd):
    rows = QUERIES["op8_perspective_rotation"](spark, odd).where("conv_id = 1").collect()
    assert {r.perspective for r in rows} == {"ann", "bob", "unknown"}
    for r in rows:
        own = [r.rendered[int(a) : int(b)] for a, b in (s.split("-") for s in r.loss_spans.split(",") if s)]
        assert own == {"ann": ["hello<|im_end|>"], "bob": ["< |im_end|> hi<|im_end|>"], "unknown": ["<|im_end|>"]}[r.perspective]


def test_keep_one_leaves_one_row_of_each_component(spark, odd):
    """That of the smallest doc_id, null last; components are told apart by what is in them, so an id may stay twice."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = near_dedup.keep_one(docs)
    rows, best = documents(spark, odd), {}
    for (i, _), (_, root) in zip(rows, roots5(rows)):
        key = (i is None, i or 0)
        best[root] = min(best.get(root, key), key)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == sorted(best.values())


def test_pipeline_stage_by_stage(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS), name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    whole = corpus_pipeline.run(spark, odd)
    assert sorted(map(repr, map(tuple, whole.collect()))) == sorted(map(repr, map(tuple, docs.collect())))


def test_pipeline_keeps_most_clean_documents(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = spark.read.parquet(f"{path}/labels.parquet").where("quality = 1 and toxic = 0").join(docs, "doc_id").select(*docs.columns)
    left = corpus_pipeline.quality(spark, docs, path).join(clean.select("doc_id"), "doc_id", "left_semi").count()
    assert left > 0.95 * clean.count()


def test_pipeline_on_nothing(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_mix_without_ids_is_no_hot_key(spark):
    """A third of the rows without an id, and as many equal ones: partitions stay alike, and rows of different texts draw for themselves."""
    docs = spark.range(6000).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 1, F.lit(7)).otherwise(F.col("doc_id")))
    mixed = mixing.mix_sources(docs, {}, epochs=2.0)
    sizes = [r["count"] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1.3 * sum(sizes) / len(sizes)
    assert mixed.where("doc_id is null").select("n_copies").distinct().count() > 3
