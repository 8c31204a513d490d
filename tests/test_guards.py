"""Guards of the classifier, row by row, and rankings that are cut before they are made."""

from pyspark.sql import functions as F

from plotwright.operators import identity as I
from plotwright.operators import matching as M
from plotwright.operators import relational as R

FLAT = dict(price=900.0, currency="EUR", area=60.0, rooms=2, deal="rent", kind="apartment", city="Valencia", place_unverified=None, auction=None, rental_term=None, seasonal=None, comarcas=None)
SCHEMA = "id long, price double, currency string, area double, rooms int, deal string, kind string, city string, place_unverified boolean, auction boolean, rental_term string, seasonal boolean, comarcas array<string>"


def test_guards(spark):
    cases = [
        ({"deal": "rent"}, {"rental_term": "temporary", "seasonal": True}, ("exact", None)),  # nobody asked
        ({"deal": "rent", "rental_term": "long"}, {"rental_term": "temporary"}, ("similar", "deal_kind")),
        ({"deal": "rent", "rental_term": "long"}, {"seasonal": True}, ("exact", None)),
        ({"deal": "rent", "seasonal_guard": True}, {"seasonal": True}, ("similar", "deal_kind")),
        ({"deal": "rent", "seasonal_excluded": True, "seasonal_guard": True}, {"seasonal": True}, ("excluded", "seasonal")),
        ({"deal": "rent", "seasonal_excluded": True, "city": "Madrid"}, {"seasonal": True}, ("other", "location")),  # a place elsewhere ends it
        ({"deal": "sale", "auction_guard": True}, {"deal": "sale", "auction": True}, ("similar", "deal_kind")),
        ({"deal": "rent", "auction_guard": True}, {"auction": True}, ("exact", None)),
        ({"place_guard": True, "amount": 500.0, "is_max": True, "currency": "EUR"}, {"place_unverified": True}, ("other", "price")),
        ({"rooms": 1, "studio_zero": True}, {"kind": "studio", "rooms": 1}, ("similar", "unverified")),
        ({"rooms": 1, "studio_zero": True}, {"kind": "studio", "rooms": None}, ("other", "rooms")),
        ({"rooms": 1}, {"kind": "studio", "rooms": None}, ("exact", None)),
        ({"rooms": 2, "rooms_delta": 2, "studio_zero": True}, {"kind": "studio", "rooms": 0}, ("exact", "approved_deviation")),
        ({"comarcas": ["a"], "nearby": ["b"]}, {"comarcas": ["a", "c"]}, ("exact", None)),
        ({"comarcas": ["a"], "nearby": ["b"]}, {"comarcas": ["b"]}, ("exact", "approved_deviation")),
        ({"comarcas": ["a"], "nearby": ["b"]}, {"comarcas": ["c"]}, ("other", "location")),
        ({"comarcas": ["a"], "nearby": ["b"]}, {}, ("exact", None)),
        ({"max_area": 55.0, "area_pct": 20.0}, {}, ("exact", "approved_deviation")),
    ]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    offers = spark.createDataFrame([tuple(({"id": i} | FLAT | x)[n] for n in names) for i, (_, x, _) in enumerate(cases)], SCHEMA)
    wanted = [{"request_id": i} | r for i, (r, _, _) in enumerate(cases)]
    got = M.graded(offers, wanted).where("id = request_id").select("id", "bucket", "why").collect()
    assert {r.id: (r.bucket, r.why) for r in got} == {i: want for i, (_, _, want) in enumerate(cases)}


def test_leading_hits_are_enough_for_the_merge(spark):
    rows = [(k, b, i) for b, keys in {"x": [1, 1, 1, 2, 3, 1, 4], "y": [2, 5, 5, 6, 1], "z": []}.items() for i, k in enumerate(keys)]
    hits = spark.createDataFrame(rows, "k long, b string, at long")
    for most in range(1, 8):
        merged = lambda h: [tuple(r) for r in R.merge_hits(R.nth(h, ["b"], [F.col("at")], "rank"), "k", "rank", "b", most).select("k", "b", "rank").collect()]  # noqa: E731,B023
        assert merged(R.leading(hits, "k", "b", "at", most)) == merged(hits)


def test_chunks_of_a_long_key(spark):
    df = spark.range(50).select("id", (F.col("id") % 2).alias("k"))
    got = {r.id: (r.window_no, r.state) for r in R.chunk_assign(df, "id", ["k"], [F.col("id")], 4, 10, 3).collect()}
    assert got == {i: ((i // 2 + 3) // 4 + 1, "queued") if i // 2 < 7 else (None, "skipped") for i in range(50)}


def test_stop_words_are_folded(spark):
    df = spark.createDataFrame([("улица Ленина район Сокол, ático en Ruzafa",)], "x string")
    assert sorted(df.select(I.place_tokens(F.col("x"), ["Madrid"]).alias("t")).first().t) == ["ruzafa", "ленина", "сокол"]
