"""Names of a table in texts, against a plain search; regions of places, against the rule by hand."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from plotwright.operators import places as P


def key(x):
    plain = "".join(c for c in unicodedata.normalize("NFKD", (x or "").lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W_]+", plain))


def plain_hits(text, names):
    words, out, i = key(text).split(), [], 0
    longest = max((n.count(" ") + 1 for n in names), default=0)
    while i < len(words):
        n = next((n for n in range(longest, 0, -1) if " ".join(words[i : i + n]) in names and i + n <= len(words)), 0)
        if n:
            out.append((" ".join(words[i : i + n]), i, n))
        i += n or 1
    return out


def table(rng, n):
    words = ["San", "Juan", "de", "Alicante", "La", "Vila", "Joiosa", "Sant", "Muro", "Alcoi", "Elche", "Elx", "Santa", "Pola", "Àgost", "d'Or", "Вега", "Баха"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)], words


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_phrase_hits(spark, most):
    rng = random.Random(most + 1)
    names, words = table(rng, 60)
    names += [None, "", " - ", names[0], names[1].upper()]
    texts = [" ".join(rng.choice([*words, "y", "casa", ",", "en-"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "..."]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1), (3, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, at int").repartition(3)
    found = P.phrase_hits(docs, spark.createDataFrame([(n,) for n in names], "name string"), most=most)
    known = {key(n) for n in names} - {""}
    want = sorted(((i, *h) for i, t, _, _ in rows for h in plain_hits(t, known)), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want and want
    shuffled = any(k in found._jdf.queryExecution().executedPlan().toString() for k in ("SortMergeJoin", "ShuffledHashJoin"))
    assert shuffled == (most == 0)


def test_a_hundred_thousand_names(spark):
    """Names as a table, not as a pattern each: the plan's size doesn't depend on how many there are."""
    names = spark.range(100_000).select(F.concat(F.lit("town "), F.col("id").cast("string"), F.lit(" upon river")).alias("name"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("near Town"), (F.col("id") * 700).cast("string"), F.lit("upon River, not Town 5 upon")).alias("text"))
    got = P.phrase_hits(docs, names).collect()
    assert sorted((r.doc_id, r.key) for r in got) == [(i, f"town {i * 700} upon river") for i in range(143)]


TOWNS = {"Marina Baixa": ["Finestrat", "Villajoyosa", "La Vila Joiosa", "Villajoyosa / La Vila Joiosa"], "Alacantí": ["Agost", "Alicante", "Alacant", "Alicante / Alacant"], "Alt Vinalopó": ["Sax", "Saix", "Villena"], "Vinalopó Mitjà": ["Sax", "Saix", "Elda"]}
PLACES = [
    ("Finestrat Pueblo, Finestrat, Alicante", ["Marina Baixa"]), ("Alicante", None), ("Alicante / Alacant", ["Alacantí"]), ("VILLAJOYOSA/La Vila Joiosa", ["Marina Baixa"]), ("Sax", ["Alt Vinalopó", "Vinalopó Mitjà"]), ("Sax (Villena)", ["Alt Vinalopó"]),
    ("Sax, Elda", ["Vinalopó Mitjà"]), ("Elda, Finestrat", None), ("Madrid", None), ("", None), (None, None), ("Àgost; 03698", ["Alacantí"]), ("Elda / Nowhere", ["Vinalopó Mitjà"]), ("Elda / Agost", None), ("Calle 1, Elda1, Sax 0", None), ("x1, Agost", ["Alacantí"]), ("Alicante, Agost", ["Alacantí"]),
]


def test_regions_of_places(spark):
    rows = spark.createDataFrame([(i, p, "x") for i, (p, _) in enumerate(PLACES)], "id int, place string, key string")
    towns = spark.createDataFrame([(r, n) for r, ns in TOWNS.items() for n in ns], "region string, name string")
    provinces = spark.createDataFrame([("Alicante",), ("Alacant",), ("Valencia",)], "name string")
    got = dict(P.regions_of_places(rows, towns, provinces).collect())
    assert [got[i] for i in range(len(PLACES))] == [w for _, w in PLACES]


def test_places_in(spark):
    gazetteer = spark.createDataFrame([("Elche", "Elche"), ("Elche", "Elx"), ("Sax", "Sax"), ("Sax 2", "Sax")], "place string, name string")
    docs = spark.createDataFrame([(1, "de Elx a ELCHE"), (2, "sax"), (3, None)], "doc_id int, text string")
    assert sorted(map(tuple, P.places_in(docs, gazetteer).collect())) == [(1, "Elche"), (2, "Sax"), (2, "Sax 2")]
