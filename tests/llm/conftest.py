import random

import pytest

from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(c, T.StringType()) for c in ("fingerprint", "n_words", "copy_no", "mix_key", "component_id", "chunk", "labels", "__text", "__h", "__cdf", "__source", "kept")],
])
LABEL = "doc_id long, quality int, toxic int"
CLASH = ("x",) * 12


def prose(rng, n):
    return " ".join(rng.choice(["stone", "river", "and", "the", "House", "über", "père", "7", "walks", "of"]) + rng.choice(["", "a", "en", "ing", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, copies, near copies, repeated rows, a very long text, clashing columns."""
    rng = random.Random(5)
    shared, base = prose(rng, 90), prose(rng, 400)
    near = base.split()
    near[200] = "changed"
    texts = [
        None, "", "   \n\t ", "one", "two words", "three little words", base, base, " ".join(near), prose(rng, 60) + " " + shared, shared + " " + prose(rng, 70),
        "x" * 5000, prose(rng, 30_000), "Mail bob@example.com or +1 (974) 555-3436, card 4111 1111 1111 1111, host 10.0.0.1. 🙂",
        "Licensed under the Apache License, Version 2.0.", "a\nb\na\n" * 20, "\x00\x1c\x85　é" * 50, "ab ab " * 300,
    ]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t), *CLASH) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None, *CLASH), (rows[3][0], "another text with a known id", "en", "a", 28, *CLASH)]
    rows += [(1000 + i, prose(rng, rng.randint(1, 120)), "en", rng.choice("abc"), 1, *CLASH) for i in range(60)]
    return rows


def _folder(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCUMENT).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABEL).coalesce(1).write.parquet(f"{path}/labels.parquet")
    talk = [(1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", "<|im_end|> hi"), (1, 2, "bob", "<|im_end|> hi"), (1, 3, None, None), (2, None, "ann", "alone"), (None, 1, "cy", ""), (3, 0, "system", "only")]
    spark.createDataFrame(talk if rows else [], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    vectors = [(i, [(i * j % 7 - 3) / 8 for j in range(64)], i % 3) for i in range(80)] + [(None, [0.5] * 64, None), (3, None, 1)]
    spark.createDataFrame(vectors if rows else [], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory, odd_rows):
    """A folder of tables with every odd case."""
    labels = [(1000 + i, i % 3 and 1, 0) for i in range(60)] + [(None, 1, 0), (1001, None, 0)]
    return _folder(spark, tmp_path_factory.mktemp("odd"), odd_rows, labels)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _folder(spark, tmp_path_factory.mktemp("empty"), [], [])
