"""Deep merge against recursion by hand, the judge's memo and budget, stems against a plain search, replayed epochs."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwright.functions import specs
from plotwright.operators import matching as M
from plotwright.operators.judge import judge_texts, memo_of

def struct(**kinds):
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


S, D = T.StringType(), T.DoubleType()
KIND = struct(a=S, n=D, xs=T.ArrayType(S), u=T.ArrayType(S), m=T.MapType(S, S), mode=S, p=struct(c=S, r=D, q=struct(z=S, ys=T.ArrayType(T.IntegerType()))))


def made(rng, kind=KIND):
    if rng.random() < 0.2:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: made(rng, f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [made(rng, kind.elementType) or (0 if isinstance(kind.elementType, T.IntegerType) else "x") for _ in range(rng.randint(0, 3))]
    if isinstance(kind, T.MapType):
        return {rng.choice("kl"): rng.choice(["", "v", "w"]) for _ in range(rng.randint(0, 2))}
    return rng.choice(["", " ", "s", "t"]) if isinstance(kind, T.StringType) else rng.choice([0, 1, 2]) * (1.0 if isinstance(kind, T.DoubleType) else 1)


def says(x):
    return any(map(says, x.values())) if isinstance(x, dict) and not set(x) <= {"k", "l"} else len(x) > 0 if isinstance(x, (list, dict)) else x.strip() != "" if isinstance(x, str) else x is not None


def merged(a, b, kind=KIND, at=""):
    if at == "mode":
        return a
    if isinstance(kind, T.StructType):
        if a is None and b is None:
            return None
        return {f.name: merged((a or {}).get(f.name), (b or {}).get(f.name), f.dataType, f"{at}.{f.name}".strip(".")) for f in kind.fields}
    if isinstance(kind, T.MapType):
        return None if a is None and b is None else {k: b[k] if (b or {}).get(k, "").strip() else (a or {}).get(k) for k in {**(a or {}), **(b or {})}}
    if at == "u":
        return None if a is None and b is None else list(dict.fromkeys([*(a or []), *(b or [])]))
    return b if says(b) else a


def test_deep_merge(spark):
    rng = random.Random(6)
    rows = [(i, made(rng), made(rng)) for i in range(400)]
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("a", KIND), T.StructField("b", KIND)])
    df = spark.createDataFrame(rows, schema).withColumn("m", specs.deep_merge(F.col("a"), F.col("b"), KIND, keep=("mode",), gather=("u",)))
    got = {r.i: r.m.asDict(True) if r.m else None for r in df.select("i", "m").collect()}
    assert got == {i: merged(a, b) for i, a, b in rows}


def test_still_open(spark):
    df = spark.createDataFrame([(("x", None, [], None, None, "", ("", 1.0, (None, []))),)], T.StructType([T.StructField("s", KIND)]))
    asked = F.array(*map(F.lit, ("a", "n", "xs", "p", "p.c", "p.q", "p.q.z", "zzz", "n")))
    assert df.select(specs.still_open(F.col("s"), KIND, asked)).first()[0] == ["n", "xs", "p.c", "p.q", "p.q.z"]


def test_judge_asks_once(spark, tmp_path):
    texts = [f"text {i % 40}" for i in range(200)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("verdict", F.lit("old"))

    def judge(batch):
        return [None if not x else x[-1] for x in batch]

    def never(batch):
        raise RuntimeError("asked")

    path = f"file://{tmp_path}/memo"
    first = judge_texts(docs, judge, path, "v1", budget=10.0, per_call=1.0)
    assert memo_of(spark, path).count() in (9, 10) and first.where("verdict is not null").select("text").distinct().count() in (9, 10)  # the empty text may be among the ten
    judge_texts(docs, judge, path, "v1")
    again = judge_texts(docs.where("text != ''"), never, path, "v1")
    assert {r.text: r.verdict for r in again.collect()} == {f"text {i}": str(i)[-1] for i in range(40)}
    assert again.count() == 200 and memo_of(spark, path).count() == 40
    # A new version of the judge knows nothing; without a budget nothing is asked.
    assert judge_texts(docs, never, path, "v2", budget=0.0).where("verdict is not null").count() == 0
    # By characters: the texts that fit, by digest.
    chars = judge_texts(docs, judge, f"{path}2", "v1", budget=30.0, per_call=1.0, per_char=1.0)
    assert 3 <= chars.where("verdict is not null").select("text").distinct().count() <= 4


def test_stem_hits(spark):
    rng = random.Random(3)
    stems = [("inmo", "topic"), ("inmobil", "topic"), ("Valen", "places"), ("квар", "topic"), ("café", "off"), ("a", "off"), ("", "off"), (None, "off")]
    texts = [" ".join(rng.choice(["Inmobiliaria", "valencia", "квартира", "CAFÉ", "x", "inmo", "ático", "vale"]) for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for most in (1000, 0):
        got = {r.id: (r.places, r.topic, r.off) for r in M.stem_hits(df, spark.createDataFrame(stems, "stem string, kind string"), "id", "text", ("places", "topic", "off"), most).collect()}
        fold = lambda x: x.lower().replace("é", "e").replace("á", "a")
        want = {i: tuple(len({fold(s) for s, k in stems if s and k == kind and any(fold(w).startswith(fold(s)) for w in (t or "").split())}) for kind in ("places", "topic", "off")) for i, t in enumerate(texts)}
        assert got == want
