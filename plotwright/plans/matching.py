"""Grades, scores, gates and rankings of derived listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotwright.functions import specs
from plotwright.functions import text as X
from plotwright.operators import matching as M
from plotwright.operators.judge import judge_texts
from plotwright.plans.registry import plan
from plotwright.session import shared_dir, spread
from plotwright.session import table as t
from plotwright.sources.listings import SQL, listings

WANTED = [
    {"request_id": 1, "amount": 6000.0, "is_max": True, "currency": "EUR", "deal": "sale", "city": "Valencia", "rooms": 3, "min_area": 100.0},
    {"request_id": 2, "amount": 4000.0, "is_max": False, "currency": "EUR", "budget_pct": 15.0, "area_pct": 20.0, "min_area": 120.0, "max_area": 200.0, "rooms": 4, "rooms_delta": 1, "city": "Madrid", "nearby": ["Alicante"]},
    {"request_id": 3, "currency": "USD", "kind": "house", "min_price": 3000.0, "rooms": 2},
]
_R = """(values (1, 6000.0, true, 'EUR', 'sale', null, 'Valencia', 100.0, null, 3, null, null, null, null, ''), (2, 4000.0, false, 'EUR', null, null, 'Madrid', 120.0, 200.0, 4, null, 15.0, 20.0, 1, 'Alicante'),
  (3, null, null, 'USD', null, 'house', null, null, null, 2, 3000.0, null, null, null, '')) r(request_id, amount, is_max, rcur, rdeal, rkind, rcity, min_area, max_area, rrooms, min_price, bpct, apct, delta, nearby)"""
GRADED = f"""(with j as (select l.*, r.*, (price - amount) / amount as off, area / min_area as ratio, coalesce(apct / 100.0, 0.1)::double as atol, coalesce(bpct / 100.0, 0.1)::double as band from {SQL} l, {_R}),
  s as (select *, case when min_area is null then 0 when area > 0 then case when ratio >= 1 - atol - 1e-9 then 0 when ratio >= least(0.75, 1 - atol - 0.15) - 1e-9 then 1 else 3 end else 1 end as a_rank,
    case when min_area is null or area is null then 0.0 else greatest(0.0, 1 - ratio) end as a_dist, case when min_area is null then null when area > 0 then case when ratio >= 1 - atol - 1e-9 then case when apct > 0 and ratio < 1 - 1e-9 then 'approved_deviation' end else 'area' end else 'area_unknown' end as a_why,
    coalesce(area > max_area * (1 + atol) + 1e-9, false) as too_large, coalesce(rooms > 0 and rooms < rrooms, false) as fewer, coalesce(rooms > 0 and rooms < rrooms and rooms >= rrooms - delta, false) as allowed,
    coalesce(price < min_price * 0.9 - 1e-9 and currency = rcur, false) as cheap, coalesce(nearby <> '' and city = nearby, false) as near, coalesce(city <> rcity, false) and not coalesce(nearby <> '' and city = nearby, false) as away,
    case when amount is null then 0 when price is null or currency <> rcur then 2 when is_max and off <= 0 then 0 when abs(off) <= band + 1e-9 then 0 when abs(off) <= (case when bpct is null then 0.25 else greatest(0.25, band + 0.15) end) + 1e-9 then 1 else 2 end as b_rank,
    case when amount is null then 0.0 when price is null or currency <> rcur then 'infinity'::double when is_max and off <= 0 then 0.0 else abs(off) end as b_dist,
    coalesce(amount is not null and price is not null and currency = rcur and not (is_max and off <= 0) and abs(off) <= band + 1e-9 and bpct > 0, false) as b_ok from j),
  m as (select *, case when too_large or (fewer and not allowed) or cheap then case when a_rank < 2 then 2 else a_rank end else a_rank end as f_rank,
    case when (too_large or (fewer and not allowed) or cheap) and a_rank < 2 then 'infinity'::double else a_dist end as f_dist,
    case when a_rank < 2 and too_large then 'area_max' when a_rank < 2 and fewer and not allowed then 'rooms' when a_rank < 2 and cheap then 'price' else a_why end as f_why from s),
  v as (select *, case when away then 2 else b_rank end as l_rank, case when away then 'infinity'::double else b_dist end as l_dist, case when away then 'location' when b_rank > 0 then 'price' end as l_why from m),
  w as (select *, case when l_rank > f_rank or (l_rank = f_rank and l_dist > f_dist) then l_rank else f_rank end as rank, case when l_rank > f_rank or (l_rank = f_rank and l_dist > f_dist) then l_dist else f_dist end as dist,
    case when l_rank > f_rank or (l_rank = f_rank and l_dist > f_dist) then l_why else f_why end as wy from v)
  select *, case when coalesce(deal <> rdeal, false) then 'excluded' when coalesce(kind <> rkind, false) then 'excluded' when a_rank = 3 then 'excluded' else (['exact', 'similar', 'other', 'excluded'])[rank + 1] end as bucket,
    case when coalesce(deal <> rdeal, false) or coalesce(kind <> rkind, false) then 'infinity'::double when a_rank = 3 then a_dist else dist end as distance,
    case when coalesce(deal <> rdeal, false) then 'deal' when coalesce(kind <> rkind, false) then 'type' when a_rank = 3 then a_why when rank = 0 then case when coalesce(a_why = 'approved_deviation', false) or allowed or near or coalesce(apct > 0 and area > max_area + 1e-9, false) or (not away and b_ok) then 'approved_deviation' end else wy end as why from w)"""


@plan(f"select id, request_id::bigint as request_id, bucket, round(least(distance, 1e9), 9) as distance, why from {GRADED}")
def bucket_classifier(spark, sf):
    g = M.graded(listings(spark, sf), WANTED)
    return g.select("id", "request_id", "bucket", F.round(F.least("distance", F.lit(1e9)), 9).alias("distance"), "why")


GUARDED = [
    {"request_id": 11, "deal": "sale", "rooms": 1, "studio_zero": True, "auction_guard": True, "place_guard": True},
    {"request_id": 12, "deal": "rent", "rental_term": "long", "seasonal_guard": True, "comarcas": ["centro"], "nearby": ["costa"]},
    {"request_id": 13, "deal": "rent", "rooms": 2, "rooms_delta": 2, "studio_zero": True, "seasonal_excluded": True},
]


@plan(f"""with l as (select *, left(district, 1) < 'i' as unsure, contains(title, 'b') as auctioned, contains(title, 'k') as short, contains(title, 'z') as season, case when left(title, 1) < 'g' then 'centro' when left(title, 1) < 'm' then 'costa' when left(title, 1) < 's' then 'sierra' end as comarca from {SQL}),
  v as (select id, 11 as request_id, case when deal = 'rent' then 'deal' when kind = 'studio' and rooms is null then 'rooms' when kind = 'studio' and rooms = 1 then 'unverified' when unsure then 'location_unknown' when auctioned then 'deal_kind' end as why from l
    union all select id, 12, case when deal = 'sale' then 'deal' when comarca = 'sierra' then 'location' when short or season then 'deal_kind' when comarca = 'costa' then 'approved_deviation' end from l
    union all select id, 13, case when deal = 'sale' then 'deal' when short or season then 'seasonal' when rooms = 1 or (rooms is null and kind = 'studio') then 'approved_deviation' end from l)
  select id, request_id::bigint as request_id, case when why is null or why = 'approved_deviation' then 'exact' when why in ('deal', 'seasonal') then 'excluded' when why in ('rooms', 'location') then 'other' else 'similar' end as bucket, why from v""")
def guarded_offers(spark, sf):
    """Grades under the guards that a request may ask for; the flags are read off the listings' titles and districts."""
    has = lambda letter: F.contains("title", F.lit(letter))
    first = F.left("title", F.lit(1))
    comarca = F.when(first < "g", "centro").when(first < "m", "costa").when(first < "s", "sierra")
    flagged = listings(spark, sf).withColumns({"place_unverified": F.left("district", F.lit(1)) < "i", "auction": has("b"), "rental_term": F.when(has("k"), "temporary"), "seasonal": has("z"), "comarcas": F.when(comarca.isNotNull(), F.array(comarca))})
    return M.graded(flagged, GUARDED).select("id", "request_id", "bucket", "why")


@plan("""select o_orderkey, case when o_totalprice <= 200000 then 'exact' when (o_totalprice - 200000) / 200000 <= 0.1 + 1e-9 then 'exact' when (o_totalprice - 200000) / 200000 <= 0.25 + 1e-9 then 'similar' else 'other' end as bucket from orders""")
def budget_bucket(spark, sf):
    v = M.budget_match(F.col("o_totalprice"), F.lit(200000.0), F.lit(True), F.lit(None).cast("double"))
    return t(spark, sf, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, M.BUCKETS)), v["rank"]).alias("bucket"))


_SCORE = """round_even(0.4 * (case when amount is null then 0.5 when price is null or currency <> rcur then 0.3 when off <= 0 then case when is_max then 1.0 else greatest(0.0, 1 - abs(off)) end else greatest(0.0, 1 - 4 * off) end)
  + 0.15 * (case when rrooms is null then 0.5 when rooms is null then 0.4 when rooms = rrooms then 1.0 when rooms > rrooms then 0.8 else 0.2 end)
  + 0.15 * (case when min_area is null then case when area is not null then 0.6 else 0.5 end when area is null then 0.4 when area / min_area >= 1 then 1.0 when area / min_area >= 0.9 then 0.7 else 0.1 end)
  + 0.3 * ((price is not null)::int + (area is not null)::int + (rooms is not null)::int + (coalesce(city, '') <> '')::int + 1 + (id % 2 = 0)::int) / 6.0, 4)::double"""


@plan(f"""select request_id::bigint as request_id, id, bucket, score from (select *, {_SCORE} as score, row_number() over (partition by request_id order by case when bucket = 'exact' then 0 else 1 end, {_SCORE} desc, price nulls last, id) as k from {GRADED} where bucket <> 'excluded') where k <= 20""")
def card_rank(spark, sf):
    """The twenty best cards of each request."""
    from plotwright.operators.relational import last_n

    g = M.graded(listings(spark, sf), WANTED).where("bucket <> 'excluded'")
    g = g.withColumn("score", M.card_score(F.col("x"), F.col("r"), F.col("id") % 2 == 0))
    order = [F.when(F.col("bucket") == "exact", 0).otherwise(1), F.desc("score"), F.col("x.price").asc_nulls_last(), F.col("id")]
    return last_n(g, ["request_id"], order, 20).select("request_id", "id", "bucket", "score")


@plan(f"""select request_id::bigint as request_id, bucket, coalesce(why, '-') as why, count(*) as n from {GRADED} group by 1, 2, 3""")
def grade_reasons(spark, sf):
    return M.graded(listings(spark, sf), WANTED).groupBy("request_id", "bucket", F.coalesce("why", F.lit("-")).alias("why")).agg(F.count("*").alias("n"))


@plan(f"""select id, request_id::bigint as request_id, distance from (select *, row_number() over (partition by request_id order by distance, id) as k from (select id, request_id, round(least(distance, 1e9), 9) as distance from {GRADED} where bucket in ('similar', 'other') and coalesce(why, '') <> 'rooms')) where k <= 15""")
def held_closest(spark, sf):
    """Held ones closest first; rooms are not what they miss, and an unknown reason is no such reason."""
    from plotwright.operators.relational import last_n

    g = M.graded(listings(spark, sf), WANTED).where(F.col("bucket").isin("similar", "other") & ~F.col("why").eqNullSafe(F.lit("rooms")))
    g = g.select("id", "request_id", F.round(F.least("distance", F.lit(1e9)), 9).alias("distance"))
    return last_n(g, ["request_id"], [F.col("distance").asc_nulls_last(), F.col("id")], 15)


_P = "(event_id % 101) / 100.0::double as relevant, (event_id * 7 % 101) / 100.0::double as offer, (event_id * 3 % 101) / 100.0::double as fit, (event_id * 11 % 101) / 100.0::double as actionable, (event_id * 13 % 101) / 100.0::double as credible, (event_id * 17 % 101) / 250.0::double as spam, (event_id % 5) / 4.0::double as sure, (['exact', 'similar', 'other', 'excluded'])[event_id % 4 + 1] as b"


@plan(f"""select event_id, case when b = 'excluded' then 'discard' when spam > 0.35 or credible < 0.55 then 'discard' when sure < 0.5 then 'hold' when relevant >= 0.7 and offer >= 0.65 then case when fit >= 0.6 and b = 'exact' then 'send' else 'hold' end when relevant >= 0.5 then 'hold' else 'discard' end as action,
  case when b = 'excluded' then 'rules:excluded' when spam > 0.35 then 'jev:spam' when credible < 0.55 then 'jev:not_credible' when sure < 0.5 then 'jev:low_confidence' when relevant >= 0.7 and offer >= 0.65 then case when fit >= 0.6 and b = 'exact' then 'gate:send' else 'gate:near' end when relevant >= 0.5 then 'gate:weak' else 'jev:irrelevant' end as reason,
  round(0.4 * relevant + 0.25 * fit + 0.2 * actionable + 0.15 * credible, 2) as score from (select event_id, {_P} from events)""")
def decision_gate(spark, sf):
    k = F.col("event_id")
    p = {n: (k * m % 101) / d for n, m, d in (("relevant", 1, 100.0), ("offer", 7, 100.0), ("fit", 3, 100.0), ("actionable", 11, 100.0), ("credible", 13, 100.0), ("spam", 17, 250.0))}
    sure = dict.fromkeys(("relevant", "offer", "fit"), (k % 5) / 4.0)
    bucket = F.get(F.array(*map(F.lit, M.BUCKETS)), (k % 4).cast("int"))
    raw = 0.4 * p["relevant"] + 0.25 * p["fit"] + 0.2 * p["actionable"] + 0.15 * p["credible"]
    g = t(spark, sf, "events").select("event_id", M.gate(bucket, F.lit(None).cast("string"), p, sure).alias("g"), F.round(raw, 2).alias("score"))
    return g.select("event_id", "g.action", "g.reason", "score")


@plan("""select c_custkey, case when c_custkey % 3 = 0 then least(60, s) else least(100, s) end as points from (select c_custkey, (case when c_mktsegment = 'BUILDING' then 40 else 0 end + case when c_nationkey < 10 then 20 else 0 end + case when c_acctbal > 5000 then 15 else 0 end
  + case when c_acctbal between 1000 and 9000 then 15 else 0 end + case when c_custkey % 2 = 0 then 10 else 0 end + case when c_custkey % 5 = 0 then 5 else 0 end) as s from customer)""")
def contact_points(spark, sf):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    return t(spark, sf, "customer").select("c_custkey", M.contact_score(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") < 10, bal > 5000, bal.between(1000, 9000), k % 2 == 0, k % 5 == 0, k % 3 != 0).alias("points"))


@plan("""select p_partkey, case when reason is not null then 'rejected' when age <= 14 then 'discovered' when age <= 90 then 'rejected' else 'rejected' end as state, coalesce(reason, case when age <= 14 then null when age <= 90 then 'inactive' else 'dead' end) as why from (
  select p_partkey, p_size * 3.0 as age, case when p_partkey % 4 = 0 then 'no_location' when s >= 0.6 then null when p_partkey % 5 = 0 then 'off_topic' else 'no_vertical_match' end as reason from (
  select *, greatest(0.0, least(1.0, 0.4 + case when p_partkey % 3 > 0 then 0.4 + 0.1 * (p_partkey % 3 - 1) else 0 end - case when p_partkey % 5 = 0 then 0.5 else 0 end)) as s from part))""")
def group_states(spark, sf):
    k = F.col("p_partkey")
    rel = M.group_relevance(F.when(k % 4 == 0, 0).otherwise(1), (k % 3).cast("int"), F.when(k % 5 == 0, 1).otherwise(0), F.lit(False))
    act = M.visit_activity(F.lit("ACTIVE_READ"), F.col("p_size") * 3.0)
    return t(spark, sf, "part").select("p_partkey", M.group_decision(rel["reason"], act).alias("d")).select("p_partkey", "d.state", "d.why")


@plan("""select o_orderkey, case when o_orderkey % 7 = 0 then 'excluded' when o_orderkey % 5 = 0 then 'other' when o_orderkey % 3 = 0 then 'similar' else 'exact' end as bucket from orders""")
def review_buckets(spark, sf):
    k = F.col("o_orderkey")
    item = lambda fail, unknown, must: F.struct(F.when(fail, "fail").when(unknown, "unknown").otherwise("pass").alias("status"), F.lit(must).alias("mandatory"))
    never = F.lit(False)
    return t(spark, sf, "orders").select("o_orderkey", M.review_bucket(F.array(item(k % 7 == 0, k % 3 == 0, True), item(k % 5 == 0, never, False))).alias("bucket"))


@plan("""select conv_id, turn, case when regexp_matches(text, 'sell') or length(text) > 600 then 'seller' when regexp_matches(text, 'tion') then 'investor' when regexp_matches(text, 'the|le') then case when conv_id % 2 = 0 then 'tenant' else 'buyer' end else 'other' end as role from conversations""")
def lead_roles(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", M.lead_role(F.col("text"), "sell", "tion", "the|le", F.col("conv_id") % 2 == 0).alias("role"))


@plan("""select l_suppkey, case when greatest(sent, least(5, n)) > 0 then round(good::double / greatest(sent, least(5, n)), 6) end as score from (select l_suppkey, count(*) as n, count(*) filter (where l_returnflag = 'R') as sent, count(*) filter (where l_returnflag = 'R' and l_discount > 0.05) as good from lineitem group by 1)""")
def run_scores(spark, sf):
    g = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("sent"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)).alias("good"))
    return g.select("l_suppkey", F.round(M.run_score(F.col("good"), F.col("sent"), F.col("n")), 6).alias("score"))


@plan("""select p_partkey, case when contains(regexp_replace(p_name || p_size || p_brand, '[^0-9]', '', 'g'), p_size::varchar) then p_size end as size from part""")
def backed_facts(spark, sf):
    text = F.concat(F.col("p_name"), F.col("p_size").cast("string"), F.col("p_brand"))
    return t(spark, sf, "part").select("p_partkey", M.backed(F.col("p_size"), text).alias("size"))


@plan(f"""select id, case when coalesce(deal <> 'sale', false) then 'deal' when coalesce(area < 100 * 0.75 - 1e-9, false) then 'area' end as reason from {SQL}""")
def task_prefilter(spark, sf):
    from plotwright.operators import rules as S

    none = F.lit(None).cast("double")
    return listings(spark, sf).select("id", S.prefilter(F.col("deal"), F.col("area"), F.lit("sale"), F.lit(100.0), none).alias("reason"))


@plan(f"""select agency, arg_max(id, (coalesce(price, 0), id)) as id, count(*) as n_sources from {SQL} group by 1""")
def best_per_agency(spark, sf):
    from plotwright.operators import rules as S

    known = listings(spark, sf).select("agency", F.coalesce("price", F.lit(0.0)).alias("price"), "id")
    return S.best_per_person(known, "agency", "price", ["id"]).select("agency", "id", "n_sources")


@plan(f"""select site, max(title) filter (where length(title) = m) as title, list_sort(list(distinct city) filter (where city is not null)) as engines from (select *, max(length(title)) over (partition by site) as m from {SQL}) group by 1""")
def merged_hits(spark, sf):
    from plotwright.operators import rules as S

    return S.merged_hits(listings(spark, sf), "site", "title", "city")


# Stems of places, topics and what is off topic: beginnings of the words at three places of the benchmark's items.
_STEMS = """(select distinct substr(w[1], 1, 4) as stem, 'places' as kind from b where len(w) >= 1 union select distinct substr(w[3], 1, 5), 'topic' from b where len(w) >= 3 union select distinct substr(w[5], 1, 6), 'off' from b where len(w) >= 5)"""


@plan(f"""with b as (select regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') as w from benchmark), s as materialized {_STEMS},
  d as (select doc_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+'))) as word from documents),
  h as (select distinct doc_id, stem, kind from d, (values (1), (2), (3), (4), (5), (6)) l(n) join s on true where length(word) >= n and length(stem) = n and substr(word, 1, n) = stem),
  c as (select doc_id, count(*) filter (where kind = 'places') as places, count(*) filter (where kind = 'topic') as topic, count(*) filter (where kind = 'off') as off from h group by 1),
  r as (select d.doc_id, coalesce(places, 0)::int as places, coalesce(topic, 0)::int as topic, coalesce(off, 0)::int as off from documents d left join c using (doc_id))
  select *, case when places > 0 then round(greatest(0.0, least(1.0, 0.4 + case when topic > 0 then 0.4 + 0.1 * least(topic - 1, 2) else 0 end - 0.5 * off)), 3) else 0.0 end::double as score from r""")
def group_words(spark, sf):
    """Relevance of every document by the words of a dictionary that begin its words."""
    w = X.words(X.fold(F.col("text")))
    b = t(spark, sf, "benchmark").select(w.alias("w"))
    stem = lambda at, n, kind: b.where(F.size("w") >= at).select(F.substr(F.get("w", F.lit(at - 1)), F.lit(1), F.lit(n)).alias("stem"), F.lit(kind).alias("kind"))
    hits = M.stem_hits(spread(t(spark, sf, "documents")), stem(1, 4, "places").union(stem(3, 5, "topic")).union(stem(5, 6, "off")), "doc_id", "text", ("places", "topic", "off"))
    return hits.withColumn("score", M.group_relevance(F.col("places"), F.col("topic"), F.col("off"), F.lit(False))["score"])


@plan("""select p_partkey, coalesce(nullif(trim(b.title), ''), a.title) as title, coalesce(nullif(b.city, ''), a.city) as city, coalesce(b.radius, a.radius) as radius, case when len(b.rooms) > 0 then b.rooms else a.rooms end as rooms,
  list_sort(list_distinct(list_concat(a.must, b.must))) as must, a.mode as mode,
  list_filter(['title', 'place.city', 'place.radius'], lambda p: case p when 'title' then coalesce(nullif(trim(coalesce(nullif(trim(b.title), ''), a.title)), ''), '') = '' when 'place.city' then coalesce(nullif(b.city, ''), nullif(a.city, '')) is null else coalesce(b.radius, a.radius) is null end) as open
  from (select p_partkey, {'title': split_part(p_name, ' ', 1), 'city': case when p_size > 20 then split_part(p_name, ' ', 2) end, 'radius': case when p_size > 35 then p_size * 1.0 end::double, 'rooms': string_split(p_name, ' ')[1:2], 'must': string_split(p_name, ' ')[2:3], 'mode': p_brand} as a,
    {'title': case when p_size % 2 = 0 then '  ' else p_brand end, 'city': case when p_size < 10 then '' when p_size < 30 then p_brand end, 'radius': case when p_size < 25 then p_size / 2.0 end::double, 'rooms': case when p_size > 12 then string_split(p_brand, '#') else [] end, 'must': string_split(p_name, ' ')[1:2]} as b from part)""")
def merged_specs(spark, sf):
    """Specifications of parts, merged field by field over three levels, and what they leave open."""
    size, brand, none = F.col("p_size"), F.col("p_brand"), F.array().cast("array<string>")
    word = F.split("p_name", " ")
    old = F.struct(
        F.get(word, F.lit(0)).alias("title"), F.struct(F.when(size > 20, F.get(word, F.lit(1))).alias("city"), F.struct(F.when(size > 35, size * 1.0).cast("double").alias("radius")).alias("zone")).alias("place"),
        F.slice(word, 1, 2).alias("rooms"), F.slice(word, 2, 2).alias("must"), brand.alias("mode"),
    )
    new = F.struct(
        F.when(size % 2 == 0, "  ").otherwise(brand).alias("title"),
        F.struct(F.when(size < 10, "").when(size < 30, brand).alias("city"), F.when(size < 25, F.struct((size / 2.0).cast("double").alias("radius"))).alias("zone")).alias("place"),
        F.when(size > 12, F.split(brand, "#")).otherwise(none).alias("rooms"), F.slice(word, 1, 2).alias("must"), F.lit("other").alias("mode"),
    )
    p = t(spark, sf, "part").select("p_partkey", old.alias("old"), new.alias("new"))
    kind = p.schema["old"].dataType
    p = p.withColumn("m", specs.deep_merge(F.col("old"), F.col("new"), kind, keep=("mode",), gather=("must",)))
    asked = F.array(*map(F.lit, ("title", "place.city", "place.zone.radius", "unknown")))
    left = F.transform(specs.still_open(F.col("m"), kind, asked), lambda x: F.replace(x, F.lit("zone."), F.lit("")))
    return p.select("p_partkey", "m.title", "m.place.city", "m.place.zone.radius", "m.rooms", F.sort_array("m.must").alias("must"), "m.mode", left.alias("open"))


@plan(r"""select doc_id, case when text is null then null when len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) = 0 then null when len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w in ('the', 'die', 'la', 'les'))) > 4 then 'yes' else 'no' end as verdict from documents""")
def judged_texts(spark, sf):
    """Verdicts of a judge on every document: a first run within a budget, a second one for the rest, a third one that asks nothing."""

    def judge(texts):
        import regex

        words = [regex.findall(r"[\p{L}\p{N}]+", x.lower()) for x in texts]
        return [None if not w else "yes" if sum(x in ("the", "die", "la", "les") for x in w) > 4 else "no" for w in words]

    docs, path = spread(t(spark, sf, "documents")).select("doc_id", "text"), f"{shared_dir(spark)}/memo-{uuid.uuid4().hex}"
    for budget in (200.0, float("inf"), 0.0):
        told = judge_texts(docs, judge, path, "v1", budget=budget, per_call=1.0, per_char=0.001)
    return told.select("doc_id", "verdict")
