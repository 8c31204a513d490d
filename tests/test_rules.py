from pyspark.sql import functions as F

from plotwright.operators import matching as M
from plotwright.operators import rules as S


def scalar(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]



def test_hits(spark):
    none = lambda x: F.lit("")
    assert scalar(spark, lambda x: S.figures(S.signals(x, none(x))), "piso 120 m2", "desde 90.000 €", "precio") == [True, True, False]
    assert scalar(spark, lambda x: S.evidence(S.signals(x, none(x))), "Piso en venta", "Pisos 3 hab", "Casa bonita", "news 100 €", "Квартира 50 м2", "Ático con tres habitaciones", "Obra nueva en venta", "дома, две комнаты") == [True, True, False, False, True, True, True, True]
    strict = lambda x: S.host_allowed(x, "strict", none(x), none(x), ("a.test",))
    assert scalar(spark, strict, "b.a.test", "c.test") == [True, False]
    assert scalar(spark, lambda x: S.host_allowed(F.lit("c.test"), "off", x, none(x)), "Piso en venta", "x") == [True, False]
    assert scalar(spark, lambda x: S.host_allowed(F.lit("www.idealista.com"), "soft", x, none(x)), "x") == [True]
    assert scalar(spark, lambda x: S.non_listing_path(F.lit("www.a.test"), x, {"a.test": ("/news/",)}), "/news/1", "/x") == [True, False]
    assert scalar(spark, lambda x: S.looks_blocked(F.lit("t"), x), "Please solve the CAPTCHA", "captcha " * 400, "hello") == [True, False, False]
    keep = lambda x: S.keep_query(x, F.lit("web"), True, ("x",), ("f.test",))
    assert scalar(spark, keep, "site:old.f.test flats", "site:g.test flats", "flats") == [False, True, True]


def test_places(spark):
    assert scalar(spark, lambda x: S.foreign_tld(x, F.lit("ES")), "a.fr", "a.es", "a.com", "a.io", None) == [True, False, False, False, False]
    table = {"finestrat": ["Marina Baixa"], "sax": ["Alto Vinalopo", "Medio Vinalopo"], "elda": ["Medio Vinalopo"]}
    regions = lambda x: S.regions_of(x, table)
    assert scalar(spark, regions, "Finestrat, Alicante", "Sax / Elda", "Finestrat (Elda)", "nowhere") == [["Marina Baixa"], ["Medio Vinalopo"], [], []]
    side = lambda x: S.region_side(regions(x), F.array(F.lit("Marina Baixa")), F.array(F.lit("Medio Vinalopo")))
    assert scalar(spark, side, "Finestrat", "Elda", "x") == ["in", "nearby", "unknown"]
    assert scalar(spark, lambda x: S.place_conflict(F.lit("Valencia"), x, ["Valencia", "Madrid"]), "flat in Madrid", "Madrid and Valencia", "flat") == [True, False, False]
    assert scalar(spark, lambda x: S.city_center(x)["lat"], "Sevilla", "x") == [37.3891, None]
    judge = lambda x: S.reach_judge(x, F.lit(""), {"fund": "fund", "investor": "invest"}, ["Valencia"])
    assert [(r.kind, r.relevant) for r in scalar(spark, judge, "Fund invests in València", "Investor", "x Valencia")] == [("fund", True), ("investor", False), ("other", False)]


def test_text_rules(spark):
    assert scalar(spark, S.min_area_of, "plot from 2.000 m2", "1,5 ha or more", "от 20 соток", "2000 m2") == [2000.0, 15000.0, 2000.0, None]
    assert scalar(spark, S.parcels, "Referencia catastral: 9872023VH5797S0001WX.", "9872023VH5797S0001WX", None) == [["9872023VH5797S0001WX"], [], []]
    assert scalar(spark, S.new_build, "Obra nueva en la playa", "Residencial Las Palmas", "uso residencial", "Residencial Unifamiliar", "precio de promoción", None) == [True, True, False, False, False, False]
    assert scalar(spark, lambda x: S.not_an_offer(F.lit("sale"), x), "25 anuncios de pisos", "average price here", "a flat") == [True, True, False]
    assert scalar(spark, lambda x: S.social_query_key(F.lit("tag"), x), "#Pisos, Málaga!") == ["tag:pisos malaga"]
    assert scalar(spark, lambda x: S.matched_share(x, ["sea", "pool"]), "near the sea", "sea and pool", "") == [0.5, 1.0, 0.0]
    links = scalar(spark, lambda x: S.profile_link(x, {"net.test": "net"}), "https://www.net.test/in/Ana.Gil/", "https://net.test/a/b", "https://o.test/ana")
    assert links[0].key == "net:ana.gil" and links[1:] == [None, None]
    groups = scalar(spark, lambda x: S.group_page(x, "face.test"), "https://www.face.test/groups/My.Group/", "https://face.test/groups/x/posts/1", "https://face.test/groups/feed")
    assert groups[0].key == "my.group" and groups[1:] == [None, None]


def test_declined_and_tickets(spark):
    df = spark.createDataFrame([(2, 90.0, 150_000.0, "Elche")], "rooms int, area double, price double, city string").select(F.struct("*").alias("x"))
    r = M.requests(spark, [{"request_id": 1, "rooms": 3, "amount": 120_000.0, "is_max": True, "min_area": 100.0, "city": "Valencia"}])[0]
    say = lambda *w: df.select(S.declined(F.col("x"), r, F.array(*map(F.lit, w)).cast("array<string>"))).first()[0]
    assert (say("rooms", "budget"), say("budget"), say("area"), say("place"), say()) == ("rooms", "price", None, "location", None)
    one = spark.range(1)
    short = lambda high, cur: one.select(S.ticket_short(F.lit(high), F.lit(cur), F.lit(50_000.0), F.lit("EUR"))).first()[0]
    assert (short(10_000.0, "EUR"), short(60_000.0, "EUR"), short(10_000.0, "USD")) == (True, False, False)
    foreign = lambda c, p: one.select(S.foreign(F.lit(c), F.lit(p), F.lit("a.com"), F.lit(None).cast("string"), F.lit("ES"), F.lit("EUR"), {"FR": ["francia"]})).first()[0]
    assert (foreign("FR", ""), foreign(None, "Niza, Francia"), foreign(None, "Valencia")) == (True, True, False)


def test_halves_and_streaks(spark):
    one = spark.range(1)
    assert one.select(S.round_halves(F.array(F.lit(1), F.lit(2), F.lit(4)), F.lit(6))).first()[0] == ["a", "b", "a", "b", "b"]
    rows = spark.createDataFrame([(1, True, 7), (2, False, 8), (3, True, 9), (4, True, 9), (5, True, 4)], "n int, ok boolean, seed int").withColumn("g", F.lit(1))
    assert S.seeded_streak(rows, ["g"], [F.desc("n")], F.col("ok"), "seed").first().streak == 2
    cost = one.select(S.model_cost(F.lit(None).cast("double"), F.lit(1000), F.lit(500), F.lit(2.0), F.lit(4.0))).first()[0]
    assert cost == 0.004
    assert S.one_per_message(rows, ["g"], [F.col("n")], 2).count() == 2
