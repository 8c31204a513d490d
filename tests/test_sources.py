import json

from pyspark.sql import functions as F

from plotwright.functions import answers as A
from plotwright.functions import clauses as C, text as X
from plotwright.operators import html
from plotwright.operators import matching as M
from plotwright.sources import hits, jsonld, providers, social


def items(spark, *rows):
    return spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r,) for r in rows], "item string")


def test_providers(spark):
    rows = {
        "idealista": {"url": "https://www.idealista.com/inmueble/1/", "price": 250000, "size": 90, "rooms": 3, "municipality": "Valencia", "operation": "sale", "propertyType": "flat", "latitude": 39.4, "longitude": -0.3},
        "fotocasa": {"url": "https://www.fotocasa.es/1/d", "transaction": {"type": "sale", "price": 1.5e5}, "surface": 70, "location": {"level5Name": "Sueca"}, "agency": {"name": "Sol"}},
        "pisos": {"detailUrl": "https://www.pisos.com/comprar/x-1234567/", "price": 99, "priceCurrency": "eur", "terrainAreaSqm": 900, "propertyType": "terreno", "transactionType": "venta", "city": "Gandia"},
        "habitaclia": {"detailUrl": "https://www.habitaclia.com/i1.htm", "price": 0, "rooms": "", "city": "Reus", "transactionType": "alquiler"},
        "milanuncios": {"url": "https://www.milanuncios.com/a-123456.htm", "price": 5, "tag_bedrooms": "2", "tag_sqm": "60", "cityName": "Elche"},
        "yaencontre": {"url": "https://www.yaencontre.com/inmueble-1", "price": 7, "area": 50, "address": {"qualifiedName": "Calle Mayor, Xativa"}, "family": "house", "operation": "buy"},
    }
    got = {p: providers.listings(items(spark, r, {"url": "https://evil.test/"}, "broken{"), p).collect() for p, r in rows.items()}
    assert all(len(v) == 1 for v in got.values())
    one = {p: v[0] for p, v in got.items()}
    assert (one["idealista"].price, one["idealista"].kind, one["idealista"].deal) == (250000.0, "apartment", "sale")
    assert (one["fotocasa"].area, one["fotocasa"].advertiser, one["fotocasa"].rooms) == (70.0, "Sol", None)
    assert (one["pisos"].kind, one["pisos"].area, one["pisos"].currency) == ("land", 900.0, "EUR")
    assert (one["habitaclia"].price, one["habitaclia"].deal) == (None, "rent")
    assert (one["milanuncios"].rooms, one["yaencontre"].city) == (2, "Xativa")
    assert providers.listings(items(spark, {"detailUrl": "https://www.habitaclia.com/i1.htm", "noResults": True}), "habitaclia").count() == 0


def test_social(spark):
    rows = items(spark, {"text": "Flat 900 € or 950 €", "url": "https://f.test/p/1", "time": "2024-05-01T10:00:00Z", "price": {"amount": 900, "currency": "eur"}}, {"text": "", "url": "https://f.test/p/2"}, {"error": "This group is private", "groupUrl": "https://f.test/g/1"}, {"error": "404"}, {"text": "x", "url": "ftp://f.test"})
    posts = social.posts(rows)
    (p, q) = posts.orderBy("post_url").collect()[::-1]
    assert p.needs_split and p.price_amount == 900 and p.price_currency == "EUR" and p.published_at.hour == 10
    good, bad = social.checked(posts)
    assert good.count() == 1 and [r.broken for r in bad.collect()] == ["url"]
    assert {r.code for r in social.errors(rows).collect()} == {"group_private", "group_not_found"}


PAGE = """<html><head><title> A  flat </title><meta name=description content="Nice"><meta property="og:title" content="T">
<script type="application/ld+json">{"@type":"Apartment","name":"Flat","offers":{"price":"250.000 €","priceCurrency":"eur"},"floorSize":{"value":90,"unitCode":"MTK"},"numberOfRooms":3,"address":{"streetAddress":"C/ Sol 1","addressLocality":"Valencia"},"url":"/ad/1"};</script>
<script type="application/ld+json">{broken</script><script>var x="</p>";</script></head>
<body><p>Hello <b>world</b></p><a href="/ad/1">first</a><a href="https://o.test/">out</a><a href="/ad/1#x">again</a><a href="/ad/2">two</a></body></html>"""
LIST = '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"@type":"ListItem","url":"/ad/7"},{"@type":"ListItem","url":"https://h.test/ad/8"}]}</script>'
TAGS = '<meta property="product:price:amount" content="1,200"><meta property="product:price:currency" content="eur"><meta property="og:title" content="Room">'


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://h.test/x", PAGE), (2, "https://h.test/l", LIST), (3, "https://h.test/t", TAGS), (4, "https://h.test/n", None)], "page_id long, url string, html string")
    parsed = html.parse_pages(pages)
    by = {r.page_id: r for r in parsed.collect()}
    assert (by[1].title, by[1].description, by[1].body) == ("A flat", "Nice", "Hello world\nfirstoutagaintwo") and by[4].title == ""
    assert [(r.link) for r in html.page_links(parsed.where("page_id = 1"), 9).orderBy("pos").collect()] == ["https://h.test/ad/1", "https://h.test/ad/2"]
    found = {r.page_id: r for r in jsonld.listings(parsed).collect()}
    f = found[1]
    assert (f.title, f.price, f.currency, f.area, f.rooms, f.address, f.link) == ("Flat", 250000.0, "EUR", 90.0, 3, "C/ Sol 1, Valencia", "https://h.test/ad/1")
    assert (found[3].price, found[3].type) == (1200.0, "opengraph") and set(found) == {1, 3}
    links = jsonld.item_links(parsed)
    assert [r.link for r in links.orderBy("pos").collect()] == ["https://h.test/ad/7", "https://h.test/ad/8"]
    children = spark.createDataFrame([(9, "http://www.h.test/ad/8/?utm_source=x")], "page_id long, url string")
    assert jsonld.index_cards(links, children).collect()[0].child_id == 9


def test_hits_source(spark):
    hits.register(spark)
    answers = {"flats": {"one": [{"url": f"https://h.test/{i}"} for i in range(25)], "two": [{"url": "https://h.test/3"}]}}
    got = spark.read.format("hits").option("answers", json.dumps(answers)).option("pages", 2).load()
    assert got.count() == 21 and got.agg(F.max("page")).first()[0] == 2
    from plotwright.operators.relational import merge_hits

    assert [r.url for r in merge_hits(got, "url", "rank", "engine", 3).collect()] == ["https://h.test/0", "https://h.test/3", "https://h.test/1"]


def test_paged_hits(spark):
    have = {"a": 25, "b": 10, "c": 0}
    asked = lambda q, n: [{"url": f"https://h.test/{q}/{i}"} for i in range(have[q])][(n - 1) * 10 : n * 10]
    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,), ("",)], "query string")
    got = hits.paged_hits(queries, {"one": asked, "two": lambda q, n: asked(q, n)[:3]}, 2)
    want = [("a", "one", i // 10 + 1, i + 1) for i in range(20)] + [("b", "one", 1, i + 1) for i in range(10)] + [(q, "two", 1, i + 1) for q in "ab" for i in range(3)]
    assert sorted(map(tuple, got.select("query", "engine", "page", "rank").collect())) == sorted(want)


def scalar(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_scalars(spark):
    assert scalar(spark, X.locale_number, "1.234,5", "1,234.5", "12,5", "0", "x", "1 234", "1.234.567,8", "1234.567", "12.34.5", "1.500", "1,5 m", "") == [1234.5, 1234.5, 12.5, None, None, 1234.0, 1234567.8, 1234.567, None, 1500.0, None, None]
    assert scalar(spark, X.main_price, "199.000 €", "1200 € + 3000 €", "€ 5000 and 5000 euros", "500 €", None) == [199000.0, None, 5000.0, None, None]
    assert scalar(spark, lambda x: C.deal(C.reading(x, "signals")["signals"]), "Se vende piso", "piso en alquiler", "venta y alquiler", None) == ["sale", "rent", None, None]
    assert [len(x) for x in scalar(spark, lambda x: X.phone_hashes(C.reading(x, "phones")["phones"]), "+34 600 111 222 / 600111222", "12 34", None)] == [1, 0, 0]
    assert scalar(spark, lambda x: C.reading(x, "zones")["zones"], "N.Z. 8.1.A y norma zonal 3") == [["3", "8.1.a"]]
    assert scalar(spark, X.house_number, "Calle Sol 12, 3", "Plaza Mayor") == ["12", None]
    assert scalar(spark, X.strong_ref, "ab12", "2024", "12345", "word") == [True, False, True, False]
    assert scalar(spark, lambda x: X.past_event(X.dates_named(x), F.lit("2024-06-01").cast("date")), "on 01.05.2024", "2024-05-01 and 2024-07-01", "soon") == [True, False, False]
    assert scalar(spark, X.clean_query, '  "flats"  in   X. ', "a", None) == ["flats in X", None, None]
    assert scalar(spark, lambda x: X.mentions(x, ["Málaga"]), "in MALAGA now", "#málaga", "malagas") == [True, True, False]
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (5.0, 0.0, 1.0, 1.0)], "w double, s double, e double, n double")
    assert [r[0] is not None for r in df.select(X.sane_box(*map(F.col, "wsen"))).collect()] == [True, False]


def test_answers(spark):
    assert [(v.role, v.confidence) for v in scalar(spark, lambda x: A.verdicts(x, F.lit(3)), '[{"role":"buyer","confidence":1.5},{"role":"king"}]')[0]] == [("buyer", 1.0), ("other", 0.0), ("other", 0.0)]
    assert [v.role for v in scalar(spark, lambda x: A.verdicts(x, F.lit(2)), "nonsense")[0]] == ["other", "other"]
    assert scalar(spark, lambda x: A.answers(x, ["q"])["q"], '{"q":{"p":0.4}}', '{"q":"70%"}', '{"q":85}', "{}") == [0.4, 0.7, 0.85, None]
    r = scalar(spark, A.result, '```json\n{"relevant":true,"confidence":2,"deal_type":"SALE","price_currency":"eur"}\n```', "[]", '{"confidence":1}')
    assert (r[0].confidence, r[0].deal_type, r[0].price_currency) == (1.0, "sale", "EUR") and r[1] is None and r[2] is None
    g = scalar(spark, A.goal_plan, "buy a flat with 3 rooms up to 250k from 80 m2")[0]
    assert (g.deal, g.rooms, g.amount, g.min_area) == ("sale", 3, 250000.0, 80.0)
    df = spark.createDataFrame([(("a", ""), ("", "b"))], "o struct<x:string,y:string>, n struct<x:string,y:string>")
    assert tuple(df.select(A.merged_spec(F.col("o"), F.col("n"), ["x", "y"])).first()[0]) == ("a", "b")


def test_review(spark):
    df = spark.createDataFrame([("fail", "no lift", "There is NO  lift"), ("fail", "no lift", "there is no lift here"), ("pass", "", "")], "s string, q string, t string")
    assert [r[0] for r in df.select(M.quoted_fail(F.col("s"), F.col("q"), F.col("t"))).collect()] == ["unknown", "fail", "pass"]
