"""What texts, answers, vendor rows and URLs say, on texts written from the driver's columns: the SQL twins know the answer from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwright.functions import answers as A
from plotwright.functions import clauses as S
from plotwright.functions import text as X
from plotwright.functions import urls as U
from plotwright.operators import identity as I
from plotwright.operators import matching as M
from plotwright.operators import rules as R
from plotwright.plans.registry import plan
from plotwright.plans.web import NORMAL
from plotwright.session import spread
from plotwright.session import table as t
from plotwright.sources import hits, jsonld, providers, social

c = F.col
K, SIZE = "cast(p_partkey as string)", "cast(p_size as string)"


def written(spark, sf, name, inputs):
    """The table with input columns by expressions that both engines read alike."""
    return spread(t(spark, sf, name)).select("*", *[F.expr(e).alias(n) for n, e in inputs.items()])


def written_sql(name, inputs):
    return f"(select *, {', '.join(f'{e} as {n}' for n, e in inputs.items())} from {name})"


# Search hits: two engines answer each nation's name, ten hits a page, two pages read.
@plan("""select n_name as query, engine, (i // 10 + 1)::int as page, (i + 1)::int as rank, 'https://site' || i || '.test/' || n_name as url, engine || ' ' || i as title, '' as snippet
  from (select n_name, engine, unnest(range(0, least(20, n_nationkey % m))) as i from nation, (values ('cse', 14), ('serp', 31)) e(engine, m))""")
def search_hits(spark, sf):
    """The hits of two backends for the nations' names, two pages each; a name's number says how many there are."""

    def backend(engine, m):
        def page(query, n):
            every = range(int(query.rsplit("_", 1)[1]) % m)
            return [{"url": f"https://site{i}.test/{query}", "title": f"{engine} {i}"} for i in every[(n - 1) * hits.PAGE : n * hits.PAGE]]

        return page

    return hits.paged_hits(t(spark, sf, "nation"), {e: backend(e, m) for e, m in (("cse", 14), ("serp", 31))}, 2, "n_name")


_NODE = f"""'{{"@type":"Apartment","name":"' || p_name || '","offers":{{"price":"' || case p_partkey % 3 when 0 then {SIZE} || '000.00' when 1 then {SIZE} || '.000 EUR' else '1,' || lpad({SIZE}, 3, '0') end || '","priceCurrency":"eur"}},"floorSize":{{"value":' || cast(p_size * 7 as string) || ',"unitCode":"' || case p_partkey % 5 when 0 then 'FTK ft' else 'MTK' end || '"}},"numberOfRooms":' || cast(p_size % 6 as string) || ',"address":{{"streetAddress":"Calle ' || {SIZE} || '","addressLocality":"Madrid","addressCountry":{{"name":"ES"}}}},"url":"/ad/' || {K} || '"}}'"""
_BLOB = {"node": _NODE}
_BLOBS = {"blob": "case p_partkey % 4 when 0 then node when 1 then '[' || node || ',' || node || ']' when 2 then '{\"@graph\":[' || node || ']}' else '{broken' end"}


@plan("""select p_partkey as page_id, case when p_partkey % 4 = 3 then -1 else 0 end as pos, p_name as title,
  case when p_partkey % 4 = 3 then p_size + 0.5 when p_partkey % 3 < 2 then p_size * 1000.0 else 1000.0 + p_size end::double as price, case when p_partkey % 4 = 3 then 'USD' else 'EUR' end as currency,
  case when p_partkey % 4 = 3 then null when p_partkey % 5 = 0 then round(p_size * 7 * 0.092903, 1) else p_size * 7 end::double as area, case when p_partkey % 4 < 3 then p_size % 6 end::int as rooms,
  case when p_partkey % 4 < 3 then 'Calle ' || p_size || ', Madrid, ES' end as address, case when p_partkey % 4 < 3 then 'https://www.site.test/ad/' || p_partkey else 'https://www.site.test/list' end as link,
  case when p_partkey % 4 < 3 then 'apartment' else 'opengraph' end as type from part""")
def jsonld_listings(spark, sf):
    """Listings of pages that carry a node, an array that has it twice, a graph, or only OpenGraph tags beside broken JSON."""
    p = written(spark, sf, "part", _BLOB).select("*", F.expr(_BLOBS["blob"]).alias("blob"))
    og = F.create_map(*map(F.lit, ("og:title",)), c("p_name"), F.lit("product:price:amount"), F.concat(c("p_size").cast("string"), F.lit(",5")), F.lit("product:price:currency"), F.lit("usd"))
    none = F.create_map().cast("map<string,string>")
    parsed = p.select(c("p_partkey").alias("page_id"), F.lit("https://www.site.test/list").alias("url"), F.array("blob").alias("jsonld"), F.when(c("p_partkey") % 4 == 3, og).otherwise(none).alias("og"))
    return jsonld.listings(parsed).select("page_id", "pos", "title", "price", "currency", "area", "rooms", "address", "link", "type")


@plan(f"""with n as (select page_id, norm from {NORMAL}), m as (select p.page_id, 0 as pos, a.norm from n p join n a on a.page_id = p.page_id + 1 union all select p.page_id, 1, b.norm from n p join n b on b.page_id = p.page_id + 2)
  select m.page_id, m.pos, k.page_id as child_id from m join n k using (norm)""")
def index_cards(spark, sf):
    """Pages that list the two after them, joined to those by identity."""
    n = t(spark, sf, "pages").select("page_id", "url")
    after = lambda i: n.select((c("page_id") - i).alias("page_id"), c("url").alias(f"u{i}"))
    both = n.join(after(1), "page_id").join(after(2), "page_id", "left")
    entry = lambda k, u: F.when(c(u).isNotNull(), F.concat(F.lit(f'{{"{k}":"'), c(u), F.lit('"}')))
    blob = F.concat(F.lit('{"@type":"ItemList","itemListElement":['), F.concat_ws(",", entry("url", "u1"), entry("item", "u2")), F.lit("]}"))
    found = jsonld.index_cards(jsonld.item_links(both.select("page_id", "url", F.array(blob).alias("jsonld"))), n)
    return found.select("page_id", "pos", "child_id")


_PRICE, _TITLE = "cast(case when p_partkey % 10 = 0 then 0 else p_size * 1000 end as string)", "p_name"
_q = lambda **f: "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in f.items()) + " || '}'"
_s = lambda x: f"""'"' || {x} || '"'"""
_ad = lambda host: _s(f"'https://www.{host}/ad/' || {K}")
_AREA, _ROOMS, _REF = "cast(p_size * 7 as string)", "cast(p_size % 6 as string)", _s(f"'R' || {K}")
# Rows as each vendor writes them.
VENDORS = {
    "fotocasa": _q(url=_ad("fotocasa.es"), title=_s(_TITLE), transaction=_q(price=_PRICE, type=_s("'SALE'")), surface=_AREA, rooms=_ROOMS, street=_s("'Calle 1'"), location=_q(level5Name=_s("'Gandia'"), level2Name=_s("'Valencia'")), agencyReference=_REF, propertyType=_s("'FLAT'")),
    "yaencontre": _q(url=_ad("yaencontre.com"), title=_s(_TITLE), price=_PRICE, area=_AREA, rooms=_ROOMS, address=_q(qualifiedName=_s("'Calle 1, Gandia'")), reference=_REF, family=_s("'house'"), operation=_s("'rent'")),
    "idealista": _q(url=_ad("idealista.com"), suggestedTexts=_q(title=_s(_TITLE)), priceInfo=_q(price=_q(amount=_PRICE)), size=_AREA, rooms=_ROOMS, address=_s("'Calle 1'"), municipality=_s("'Gandia'"), province=_s("'Valencia'"), externalReference=_REF, propertyType=_s("'penthouse'"), operation=_s("'sale'")),
    "pisos": _q(detailUrl=_ad("pisos.com"), title=_s(_TITLE), price=_PRICE, priceCurrency=_s("'eur'"), usableAreaSqm=_AREA, rooms=_ROOMS, fullAddress=_s("'Calle 1'"), city=_s("'Gandia'"), province=_s("'Valencia'"), adId=_REF, propertyType=_s("'terreno'"), transactionType=_s("'venta'")),
    "habitaclia": _q(detailUrl=_ad("habitaclia.com"), title=_s(_TITLE), price=_PRICE, areaSqm=_AREA, rooms=_ROOMS, location=_s("'Calle 1'"), city=_s("'Gandia'"), province=_s("'Valencia'"), agencyRef=_REF, propertyType=_s("'estudio'"), transactionType=_s("'alquiler'")),
    "milanuncios": _q(url=_ad("milanuncios.com"), title=_s(_TITLE), price=_PRICE, tag_sqm=_AREA, tag_bedrooms=_ROOMS, cityName=_s("'Gandia'"), provinceName=_s("'Valencia'"), id=_REF, categorySlug=_s("'locales'"), sellType=_s("'supply'")),
}
_CANON = [("fotocasa", "fotocasa.es", "apartment", "sale"), ("yaencontre", "yaencontre.com", "house", "rent"), ("idealista", "idealista.com", "apartment", "sale"), ("pisos", "pisos.com", "land", "sale"), ("habitaclia", "habitaclia.com", "studio", "rent"), ("milanuncios", "milanuncios.com", "commercial", "sale")]


@plan(f"""select p_partkey, provider, 'https://www.' || host || '/ad/' || p_partkey as url, p_name as title, case when p_partkey % 10 > 0 then p_size * 1000.0 end::double as price, 'EUR' as currency, (p_size * 7)::double as area,
  nullif(p_size % 6, 0)::int as rooms, 'Gandia' as city, case when provider <> 'yaencontre' then 'Valencia' end as province, 'R' || p_partkey as reference, kind, deal
  from part, (values {", ".join(map(str, _CANON))}) v(provider, host, kind, deal) where not (provider = 'habitaclia' and p_partkey % 8 = 0)""")
def provider_listings(spark, sf):
    """Six vendors' rows as listings; of one vendor, every eighth says that nothing was found."""
    out = None
    for name, item in VENDORS.items():
        e = item if name != "habitaclia" else f"""case when p_partkey % 8 = 0 then '{{"noResults":true,"detailUrl":"https://www.habitaclia.com/x"}}' else {item} end"""
        found = providers.listings(written(spark, sf, "part", {"item": e}).select("p_partkey", "item"), name)
        found = found.select("p_partkey", "provider", "url", "title", "price", "currency", "area", "rooms", "city", "province", "reference", "kind", "deal")
        out = found if out is None else out.unionByName(found)
    return out


_C = "cast(conv_id as string) || '-' || cast(turn as string)"
_POST = {"item": f"""case when conv_id % 5 = 0 then '{{"error":"' || case turn % 3 when 0 then 'Group is private' when 1 then 'Not found' else 'timeout' end || '","groupUrl":"https://fb.test/g/' || {_C} || '"}}'
  else '{{"' || case when turn % 2 = 0 then 'text' else 'message' end || '":"Flat ' || cast(conv_id * 100 as string) || ' € or ' || cast(turn * 50 as string) || ' eur","' || case when turn % 3 = 0 then 'url' else 'postUrl' end || '":"https://fb.test/p/' || {_C} || '","time":"2024-05-01 10:00:00","price":{{"amount":' || cast(conv_id as string) || ',"currency":"eur"}},"location":" Gandia "}}' end"""}


@plan("""select post_url, raw_text, timestamptz '2024-05-01 10:00:00+00' as published_at, conv_id::double as price_amount, 'EUR' as price_currency, 'Gandia' as location_text, conv_id * 100 <> turn * 50 as needs_split, sha256(raw_text) as content_hash
  from (select *, 'https://fb.test/p/' || conv_id || '-' || turn as post_url, 'Flat ' || conv_id * 100 || ' € or ' || turn * 50 || ' eur' as raw_text from conversations where conv_id % 5 <> 0)""".replace("timestamptz '2024-05-01 10:00:00+00'", "timestamp '2024-05-01 10:00:00'"))
def social_posts(spark, sf):
    """Usable posts of dataset rows; reports of errors are no posts."""
    found = social.posts(written(spark, sf, "conversations", _POST))
    return found.withColumn("published_at", c("published_at").cast("timestamp_ntz"))


@plan("""select 'https://fb.test/g/' || conv_id || '-' || turn as group_url, case turn % 3 when 0 then 'group_private' when 1 then 'group_not_found' else 'actor_error' end as code from conversations where conv_id % 5 = 0""")
def social_errors(spark, sf):
    return social.errors(written(spark, sf, "conversations", _POST))


@plan("""select o_custkey, o_orderkey, k::int as message_no from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 3""")
def digest_messages(spark, sf):
    """The three dearest orders of each customer as numbered messages."""
    return R.one_per_message(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), c("o_orderkey")], 3).select("o_custkey", "o_orderkey", "message_no")


_HIT = {
    "title": f"case p_partkey % 5 when 0 then 'Piso en venta ' || {SIZE} || '000 €' when 1 then 'Casa de ' || {SIZE} || '0 m2' when 2 then 'House for sale' when 3 then 'Weather news ' || {SIZE} else 'Vivienda de 3 habitaciones' end",
    "host": "case p_partkey % 3 when 0 then 'www2.idealista.com' when 1 then 'site.test' else 'pisos.com' end",
    "host2": "'site.' || case p_partkey % 4 when 0 then 'es' when 1 then 'de' when 2 then 'io' else 'com' end",
    "country": "case p_partkey % 7 when 0 then 'fr' when 1 then 'es' end",
    "place": "case p_partkey % 6 when 1 then 'Niza, Francia' else 'Frances Street' end",
    "currency": "case p_partkey % 11 when 0 then 'USD' when 1 then 'EUR' end",
    "kind": "case p_partkey % 6 when 0 then 'catalog' when 1 then 'wanted' when 2 then 'offer' end",
    "summary": f"case when p_partkey % 8 = 0 then cast(p_size + 10 as string) || ' anuncios en la zona' else 'Piso ' || {SIZE} end",
    "wall": "case when p_partkey % 9 = 0 then 'Access denied' else 'Piso' end",
    "body": "repeat('word ', case when p_partkey % 2 = 0 then 400 else 10 end)",
    "query": "case p_partkey % 4 when 0 then 'flats site:facebook.com' when 1 then 'flats site:m.facebook.com' when 2 then 'flats site:notfacebook.com' else 'flats' end",
    "platform": "case when p_partkey % 5 = 0 then 'facebook' end",
}
_e, _f = "p_partkey % 5 <> 3", "p_partkey % 5 < 2"


@plan(f"""select p_partkey, {_f} as figures, {_e} as evidence, p_partkey % 3 <> 1 or ({_e}) as allowed_off, p_partkey % 3 <> 1 or ({_f}) as allowed_on, p_partkey % 3 = 2 as allowed_strict, p_partkey % 4 = 1 as tld,
  p_partkey % 7 = 0 or p_partkey % 6 = 1 or p_partkey % 4 = 1 or p_partkey % 11 = 0 as foreign_one, p_partkey % 6 = 1 as named, p_partkey % 6 < 2 or p_partkey % 8 = 0 as no_offer, p_partkey % 9 = 0 and p_partkey % 2 = 1 as wall,
  p_partkey % 4 >= 2 and p_partkey % 5 <> 0 as kept from part""")
def hit_rules(spark, sf):
    """Predicates on search hits."""
    h = written(spark, sf, "part", _HIT).withColumn("shown", R.signals(c("title"), c("p_brand")))
    names = {"fr": ["france", "francia"], "pt": ["portugal"]}
    brand = c("p_brand")
    return h.select(
        "p_partkey", R.figures(c("shown")).alias("figures"), R.evidence(c("shown")).alias("evidence"), R.host_allowed(c("host"), "off", c("title"), brand).alias("allowed_off"),
        R.host_allowed(c("host"), "on", c("title"), brand).alias("allowed_on"), R.host_allowed(c("host"), "strict", c("title"), brand, ("pisos.com",)).alias("allowed_strict"), R.foreign_tld(c("host2"), F.lit("es")).alias("tld"),
        R.foreign(c("country"), c("place"), c("host2"), c("currency"), F.lit("es"), F.lit("EUR"), names).alias("foreign_one"), X.mentions(c("place"), names["fr"]).alias("named"), R.not_an_offer(c("kind"), c("summary")).alias("no_offer"),
        R.looks_blocked(c("wall"), c("body")).alias("wall"), R.keep_query(c("query"), c("platform"), True, ("facebook",), ("facebook.com",)).alias("kept"),
    )


_TEXTS = {
    "body": f"'Parcela de ' || {SIZE} || '00 m2 y casa construida de ' || cast(p_size * 5 as string) || ' m²; precio ' || {SIZE} || '000 €. Tel +34 600 ' || lpad(cast(p_partkey % 1000 as string), 3, '0') || ' ' || lpad(cast(p_size * 7 as string), 3, '0')",
    "plan_text": "'Norma zonal 8.' || cast(p_size % 9 + 1 as string) || ' aqui'",
    "cadastre": f"case when p_partkey % 2 = 0 then 'Referencia catastral: ' else 'Numero: ' end || lpad({K}, 7, '0') || 'vk4704s0001jt'",
    "build": "case p_partkey % 4 when 0 then 'Obra nueva en el centro' when 1 then 'Precio de promoción' when 2 then 'Residencial Los Pinos' else 'suelo residencial Intensiva' end",
    "number": f"{SIZE} || case p_partkey % 3 when 0 then '.500' when 1 then ',5' else ',500.25' end",
    "offer": "case p_partkey % 3 when 0 then 'Se alquila piso' when 1 then 'Se vende casa' else 'Se vende o se alquila' end",
    "term": "case p_partkey % 3 when 0 then 'alquiler de temporada' when 1 then 'larga estancia' else 'piso' end",
    "auction": "case p_partkey % 4 when 0 then 'Subasta judicial' when 1 then 'Sin subasta' when 2 then 'No es una subasta' else 'No hay prisa, venta normal y pronto en subasta' end",
    "season": "case p_partkey % 3 when 0 then 'Solo alquiler de temporada' when 1 then 'no es alquiler vacacional' else 'larga estancia' end",
    "ticket": f"'Ticket from ' || {SIZE} || 'k to ' || cast(p_size + 10 as string) || 'k €'",
    "goal": f"case p_partkey % 3 when 0 then 'desde ' || {SIZE} || '0 m2' when 1 then {SIZE} || ' ha or more' else 'house' end",
    "quote": "repeat('x', p_size) || ' term ' || repeat('y', 30)",
}


@plan("""select p_partkey, p_size * 100.0::double as plot_area, greatest(p_size * 100, p_size * 5)::double as largest, 2 as n_areas, p_partkey % 2 = 0 as conflict, p_size * 1000.0::double as price, [p_size * 1000.0::double] as amounts,
  [sha256('600' || lpad((p_partkey % 1000)::varchar, 3, '0') || lpad((p_size * 7)::varchar, 3, '0'))] as phones, ['8.' || (p_size % 9 + 1)] as zones,
  case when p_partkey % 2 = 0 then [lpad(p_partkey::varchar, 7, '0') || 'VK4704S0001JT'] else []::varchar[] end as parcels, p_partkey % 2 = 0 and p_partkey % 4 in (0, 2) as new_build,
  'group:pisos brand ' || split_part(p_brand, '#', 2) as query_key, case p_partkey % 3 when 0 then p_size * 1000 + 500.0 when 1 then p_size + 0.5 else p_size * 1000 + 500.25 end::double as number,
  case p_partkey % 3 when 0 then 'rent' when 1 then 'sale' end as deal, case p_partkey % 3 when 0 then 'short' when 1 then 'long' end as term, p_partkey % 4 in (0, 3) as auction, p_partkey % 3 = 0 as season,
  p_size * 1000.0::double as ticket_low, (p_size + 10) * 1000.0::double as ticket_high, 'EUR' as ticket_currency, p_size + 10 < 30 as short, case p_partkey % 3 when 0 then p_size * 10.0 when 1 then p_size * 10000.0 end::double as min_area,
  [repeat('x', least(p_size, 9)::int) || ' term ' || repeat('y', 9)] as windows,
  list_sort(list_filter([p_size * 100, 2, p_size * 5, 34, 600], lambda x: x < 1000).list_transform(lambda x: x::varchar) || [lpad((p_partkey % 1000)::varchar, 3, '0'), lpad((p_size * 7)::varchar, 3, '0')]) as numbers from part""")
def post_facts(spark, sf):
    """Facts read from texts that were written from a row's numbers."""
    read = {"body": ("areas", "stated", "amounts", "phones"), "plan_text": ("zones",), "offer": ("signals",), "auction": ("auction",), "season": ("seasonal",), "ticket": ("ranges",)}
    p = written(spark, sf, "part", _TEXTS).withColumns({f"read_{k}": S.reading(c(k), *v) for k, v in read.items()})
    p = p.withColumns({"areas": c("read_body.areas"), "range": F.get("read_ticket.ranges", F.lit(0))})
    stated, none = F.when(c("p_partkey") % 2 == 0, c("p_size") * 20).otherwise(c("p_size") * 60), F.lit(None)
    numbers = I.prepare(p.select(c("p_partkey").alias("id"), "body", *[F.lit(None).cast("string").alias(x) for x in ("city", "address", "district", "title", "agency")]), []).select(c("id").alias("p_partkey"), "numbers")
    read = p.select(
        "p_partkey", S.plot_area(c("areas")).alias("plot_area"), S.largest_area(c("areas")).alias("largest"), F.size("areas").alias("n_areas"), S.area_conflict(none, stated, none, none, c("read_body.stated")).alias("conflict"), X.main_price(c("body")).alias("price"),
        c("read_body.amounts").alias("amounts"), X.phone_hashes(c("read_body.phones")).alias("phones"), c("read_plan_text.zones").alias("zones"), R.parcels(c("cadastre")).alias("parcels"), R.new_build(c("build")).alias("new_build"),
        R.social_query_key(F.lit("group"), F.concat(F.lit("¡Pisos, "), c("p_brand"), F.lit("!"))).alias("query_key"), X.locale_number(c("number")).alias("number"), S.deal(c("read_offer.signals")).alias("deal"), S.rental_term(c("term")).alias("term"),
        c("read_auction.auction").alias("auction"), c("read_season.seasonal").alias("season"), c("range.low").alias("ticket_low"), c("range.high").alias("ticket_high"), c("range.currency").alias("ticket_currency"),
        R.ticket_short(c("range.high"), c("range.currency"), F.lit(30000.0), F.lit("EUR")).alias("short"), R.min_area_of(c("goal")).alias("min_area"), F.transform(S.quote_windows(c("quote"), [["term"]], 10), lambda q: q["quote"]).alias("windows"),
    )
    return read.join(numbers, "p_partkey")


_PLACES = {
    "place": "case p_partkey % 4 when 0 then 'Calle 5, Madrid' when 1 then 'Gandía, Valencia' when 2 then 'Madrid / Gandia' else 'Nowhere' end",
    "city": "case p_partkey % 3 when 0 then 'Madrid' when 1 then 'Sevilla' else 'Paris' end",
    "said": "case p_partkey % 4 when 0 then 'Piso en Valencia' when 1 then 'Piso en Madrid y Valencia' when 2 then 'Piso en Madrid' else 'Piso' end",
    "firm": "case p_partkey % 3 when 0 then 'Inmobiliaria Sol' when 1 then 'Fondo Norte' else 'Blog' end",
    "quote": "case p_partkey % 3 when 0 then 'MADRID y' when 1 then 'Bilbao' else ' ' end",
}


@plan("""select p_partkey, case p_partkey % 4 when 0 then ['M'] when 1 then ['V'] else []::varchar[] end as regions, case p_partkey % 4 when 0 then 'nearby' when 1 then 'in' else 'unknown' end as side,
  case p_partkey % 3 when 0 then 40.4168 when 1 then 37.3891 end::double as lat, case p_partkey % 3 when 0 then -3.7038 when 1 then -5.9845 end::double as lon,
  case when p_size > 5 then -p_size end::double as west, case when p_size > 5 then p_size - 20 end::double as north,
  p_partkey % 3 = 0 and p_partkey % 4 = 0 as conflict, case p_partkey % 3 when 0 then 'agency' when 1 then 'fund' else 'other' end as kind, p_partkey % 4 < 2 and p_partkey % 3 < 2 as relevant, case when p_partkey % 4 < 2 then 0.6 else 0.4 end::double as confidence,
  case p_partkey % 4 when 0 then 1.0 when 1 then 1.0 when 2 then 0.5 else 0.5 end::double as share, case when p_partkey % 3 = 0 and p_partkey % 4 = 1 then 'fail' else 'unknown' end as status from part""")
def place_facts(spark, sf):
    """Places, regions, boxes and judgements on texts that name them."""
    p = written(spark, sf, "part", _PLACES)
    regions = R.regions_of(c("place"), {"madrid": ["M"], "valencia": ["V", "C"], "gandia": ["V"]})
    s = c("p_size").cast("double")
    box, center, judged = X.sane_box(-s, s - 30, s - 10, s - 20), R.city_center(c("city")), R.reach_judge(c("firm"), c("said"), {"agency": "inmobiliaria", "fund": "fondo"}, ["valencia"])
    wanted, near = F.array(F.lit("V")), F.array(F.lit("M"))
    return p.select(
        "p_partkey", regions.alias("regions"), R.region_side(regions, wanted, near).alias("side"), center["lat"].alias("lat"), center["lon"].alias("lon"), box["west"].alias("west"), box["north"].alias("north"),
        R.place_conflict(c("city"), c("said"), ["Madrid", "Valencia"]).alias("conflict"), judged["kind"].alias("kind"), judged["relevant"].alias("relevant"), judged["confidence"].alias("confidence"),
        R.matched_share(c("said"), ["piso", "valencia"]).alias("share"), M.quoted_fail(F.lit("fail"), c("quote"), c("said")).alias("status"),
    )


_ANSWER = {
    "judged": f"""case when p_partkey % 5 = 0 then 'no json' else '[{{"role":"buyer","confidence":' || {SIZE} || 'e-2}},{{"role":"alien","confidence":0.9}}]' end""",
    "said": f"""'{{"relevant":{{"p":"' || {SIZE} || '%"}},"fit":' || {SIZE} || '}}'""",
    "found": f"""case when p_partkey % 6 = 0 then '{{"confidence":1}}' else '```json {{"relevant":true,"confidence":1.7,"deal_type":"SALE","price_currency":"eur","rooms":' || {SIZE} || '}} ```' end""",
    "goal": f"'Quiero ' || case when p_partkey % 2 = 0 then 'comprar' else 'alquilar' end || ' casa de ' || {SIZE} || ' hab hasta ' || {SIZE} || '000 desde ' || cast(p_size * 10 as string) || ' m2'",
    "old_city": "case when p_partkey % 3 = 0 then 'Madrid' end",
    "new_city": "case when p_partkey % 2 = 0 then '' else 'Valencia' end",
}


@plan("""select p_partkey, case when p_partkey % 5 = 0 then ['other', 'other', 'other'] else ['buyer', 'other', 'other'] end as roles, case when p_partkey % 5 = 0 then 0.0 else (p_size || 'e-2')::double end as sure, (p_size / 100.0)::double as relevant,
  case when p_size = 1 then 1.0 else p_size / 100.0 end::double as fit, case when p_partkey % 6 > 0 then '{"relevant":true,"confidence":1.0,"price_currency":"EUR","deal_type":"sale","rooms":' || p_size || ',"original_post_link":"https://x.test/' || p_partkey || '"}' end as payload,
  case when p_partkey % 2 = 0 then 'sale' else 'rent' end as deal, p_size as rooms, p_size * 1000.0::double as amount, p_size * 10.0::double as min_area, case when p_partkey % 2 = 0 then case when p_partkey % 3 = 0 then 'Madrid' end else 'Valencia' end as city,
  'JSON-LD: {"id":' || p_partkey || ',"brand":"' || p_brand || '"}' as line from part""")
def judge_answers(spark, sf):
    """Model answers, with their drift, as strict values."""
    p = written(spark, sf, "part", _ANSWER)
    v, r, g = A.verdicts(c("judged"), F.lit(3)), A.result(c("found")), A.goal_plan(c("goal"))
    said = A.answers(c("said"), ["relevant", "fit"])
    merged = A.merged_spec(F.struct(c("old_city").alias("city")), F.struct(c("new_city").alias("city")), ["city"])
    return p.select(
        "p_partkey", F.transform(v, lambda x: x["role"]).alias("roles"), F.get(v, F.lit(0))["confidence"].alias("sure"), said["relevant"].alias("relevant"), said["fit"].alias("fit"), A.payload(r, F.concat(F.lit("https://x.test/"), c("p_partkey").cast("string"))).alias("payload"),
        g["deal"].alias("deal"), g["rooms"].alias("rooms"), g["amount"].alias("amount"), g["min_area"].alias("min_area"), merged["city"].alias("city"), jsonld.facts_line(F.struct(c("p_partkey").alias("id"), c("p_brand").alias("brand"))).alias("line"),
    )


_LINKS = {
    "grp": f"'https://www.facebook.com/groups/' || case p_partkey % 4 when 0 then 'Grp' || {K} || '/' when 1 then 'feed' when 2 then 'abc/posts/1' else 'x.' || {K} end",
    "who": f"case p_partkey % 3 when 0 then 'https://www.linkedin.com/in/Name' || {K} || '/' when 1 then 'https://www.linkedin.com/company/x/y' else 'https://other.test/in/Name' end",
    "ad": f"'https://www.fotocasa.es/' || case p_partkey % 3 when 0 then 'en/' else '' end || 'piso/' || lpad({K}, 7, '1')",
    "other": f"'https://fotocasa.es/' || case p_partkey % 2 when 0 then 'es/' else '' end || 'piso/' || lpad({K}, 7, '1') || case when p_partkey % 5 = 0 then '/2' else '' end",
    "site": "case p_partkey % 3 when 0 then 'm.fotocasa.es' when 1 then 'notfotocasa.es' else 'www.pisos.com' end",
    "body": f"case p_partkey % 4 when 0 then 'Desde ' || {SIZE} || ' € y ' || {SIZE} || ' m²' when 1 then {SIZE} || ' eur' else {SIZE} || ' m2' end",
}


@plan("""select p_partkey, case p_partkey % 4 when 0 then 'grp' || p_partkey when 3 then 'x.' || p_partkey end as group_key, case p_partkey % 4 when 0 then 'https://www.facebook.com/groups/grp' || p_partkey || '/' when 3 then 'https://www.facebook.com/groups/x.' || p_partkey || '/' end as group_url,
  case when p_partkey % 3 = 0 then 'linkedin:name' || p_partkey end as profile, case when p_partkey % 3 = 0 then 'https://linkedin.com/in/Name' || p_partkey end as profile_url,
  (p_partkey % 3 = 0 or p_partkey % 2 = 0) and p_partkey % 5 <> 0 as versions, p_partkey % 3 <> 1 as portal, case when p_partkey % 4 = 0 or p_partkey % 7 = 0 then 'listing' else 'unknown' end as page_kind,
  p_partkey % 3 = 0 and p_partkey % 2 = 1 as editorial from part""")
def link_rules(spark, sf):
    """Identities and classes of links."""
    p = written(spark, sf, "part", _LINKS)
    g, w = R.group_page(c("grp"), "facebook.com"), R.profile_link(c("who"), {"linkedin.com": "linkedin"})
    path = F.when(c("p_partkey") % 2 == 0, "/pisos/x").otherwise("/Blog/x")
    return p.select(
        "p_partkey", g["key"].alias("group_key"), g["url"].alias("group_url"), w["key"].alias("profile"), w["url"].alias("profile_url"), U.language_versions(c("ad"), c("other")).alias("versions"), U.known_portal(c("site")).alias("portal"),
        U.classify_page(F.lit("https://site.test/x"), c("p_partkey") % 7 == 0, c("body")).alias("page_kind"), R.non_listing_path(c("site"), path, {"fotocasa.es": ("/blog", "/noticias")}).alias("editorial"),
    )


@plan("""select event_id, round(case when event_id % 3 = 0 then value else (user_id * 100 * 1.5 + event_id * 6.0) / 1e6 end, 9) as cost, bit_count(xor(event_id, user_id)) as bits from events""")
def model_costs(spark, sf):
    """Stated costs, else tokens by price; and the Hamming distance of two numbers."""
    e = t(spark, sf, "events")
    stated = F.when(c("event_id") % 3 == 0, c("value"))
    cost = R.model_cost(stated, c("user_id") * 100, c("event_id"), F.lit(1.5), F.lit(6.0))
    return e.select("event_id", F.round(cost, 9).alias("cost"), I.hamming(c("event_id"), c("user_id")).alias("bits"))


_REFUSED = "case p_partkey % 4 when 0 then 'rooms' when 1 then 'budget' when 2 then 'area' else 'place' end"


@plan("""select p_partkey, case when p_partkey % 4 = 0 and r > 0 and r < 3 then 'rooms' when p_partkey % 4 = 1 and price > 20000 and (price - 20000) / 20000 > 0.1 + 1e-9 then 'price'
  when p_partkey % 4 = 2 and (area / 100 < 0.9 - 1e-9 or area > 200 * 1.1 + 1e-9) then 'area' when p_partkey % 4 = 3 and city not in ('Madrid', 'Alicante') then 'location' end as why
  from (select p_partkey, p_size % 6 as r, p_size * 1000.0 as price, p_size * 5.0 as area, (['Madrid', 'Valencia', 'Alicante', 'Sevilla'])[p_size % 4 + 1] as city from part)""")
def declined_compromises(spark, sf):
    """What a person has refused and the listing would be."""
    s = c("p_size")
    x = F.struct((s % 6).alias("rooms"), (s * 1000.0).alias("price"), (s * 5.0).alias("area"), F.get(F.array(*map(F.lit, ("Madrid", "Valencia", "Alicante", "Sevilla"))), s % 4).alias("city"))
    none = F.lit(None).cast("double")
    r = F.struct(F.lit(3).alias("rooms"), F.lit(20000.0).alias("amount"), F.lit(True).alias("is_max"), none.alias("budget_pct"), F.lit(100.0).alias("min_area"), F.lit(200.0).alias("max_area"), none.alias("area_pct"), F.lit("Madrid").alias("city"), F.array(F.lit("Alicante")).alias("nearby"))
    return t(spark, sf, "part").select("p_partkey", R.declined(x, r, F.array(F.expr(_REFUSED))).alias("why"))


# Halves of a search: a supplier's round i of 8 finds something unless 5 divides its key times i.
@plan("""with recursive s(k, i, last, gone_a, gone_b, halves) as (
    select s_suppkey, 0, 'b', false, false, '' from supplier
    union all
    select k, i + 1, coalesce(here, last), gone_a or (here = 'a' and not found), gone_b or (here = 'b' and not found), halves || coalesce(here, '')
    from (select *, case when last = 'b' and not gone_a or gone_b and not gone_a then 'a' when not gone_b then 'b' end as here, (k * (i + 1)) % 5 <> 0 as found from s where i < 8))
  select k as s_suppkey, halves from s where i = 8""")
def search_halves(spark, sf):
    """Which half wrote each round, for every supplier."""
    filled = F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: (c("s_suppkey") * i) % 5 != 0)
    return t(spark, sf, "supplier").select("s_suppkey", F.array_join(R.round_halves(filled, F.lit(8)), "").alias("halves"))
