"""Text scalars on documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwright.functions import clauses as C
from plotwright.functions import text as X
from plotwright.operators import places
from plotwright.plans.registry import plan
from plotwright.session import spread
from plotwright.session import table as t

_q = lambda x: "'" + x.replace("'", "''") + "'"


def _contains(low: str, found) -> str:
    return "(" + " or ".join(f"contains({low}, {_q(w)})" for w in found) + ")"


LOW = "lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))"


@plan(f"""select doc_id, case when length({LOW}) < 30 then 'insufficient_content' when doc_id % 7 = 0 and doc_id % 2 = 0 then 'stale' when {_contains(LOW, X.SPAM)} then 'spam_signal'
  when not {_contains(LOW, X.RELEVANCE["real_estate"])} then 'irrelevant_keywords' else 'accepted' end as reason from documents""")
def evidence_filter(spark, sf):
    """Posts are dated by their number here: every 7th has a date, half of those are old."""
    d = spread(t(spark, sf, "documents"))
    published = F.when(F.col("doc_id") % 7 == 0, F.when(F.col("doc_id") % 2 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-05-01"))).cast("timestamp")
    return d.select("doc_id", X.evidence_reason(F.col("text"), published, F.lit("2024-06-01").cast("timestamp")).alias("reason"))


@plan("""select doc_id, case when regexp_matches(lower(text), '[а-яіїєґ]') then 'ru' when contains(lower(text), ' el ') or contains(lower(text), ' la ') or contains(lower(text), ' piso')
  or contains(lower(text), ' alquiler') or contains(lower(text), ' en ') then 'es' when regexp_matches(lower(text), '[a-z]') then 'en' else 'unknown' end as guess from documents""")
def lang_guess(spark, sf):
    return spread(t(spark, sf, "documents")).select("doc_id", X.language(F.col("text")).alias("guess"))


@plan(r"""select doc_id, sha256(strip_accents(lower(text))) as folded_sha256, len(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) as n_words from documents""")
def folded_text(spark, sf):
    return spread(t(spark, sf, "documents")).select("doc_id", F.sha2(X.fold(F.col("text")), 256).alias("folded_sha256"), F.size(X.words(X.fold(F.col("text")))).cast("long").alias("n_words"))


_SIZE = "cast(p_size as string)"
_NUMBER = f"""case p_partkey % 10 when 0 then {_SIZE} || ',200' when 1 then {_SIZE} || '.200 €' when 2 then {_SIZE} || ',5 млн' when 3 then 'from ' || {_SIZE} || 'k' when 4 then {_SIZE} || '.5' when 5 then '0,' || {_SIZE} || ' ha'
  when 6 then {_SIZE} || '.200.000' when 7 then {_SIZE} || ',200,000.50' when 8 then {_SIZE} || ' 345' else 'none' end"""


@plan("""select p_partkey, case p_partkey % 10 when 0 then p_size * 1000 + 200 when 1 then p_size * 1000 + 200 when 2 then p_size * 1e6 + 5e5 when 3 then p_size * 1000 when 4 then p_size + 0.5 when 5 then ('0.' || p_size)::double
  when 6 then p_size * 1e6 + 2e5 when 7 then p_size * 1e6 + 200000.5 when 8 then p_size * 1000 + 345 end::double as v from part""")
def number_parse(spark, sf):
    """Numbers in ten ways of writing, back from the text."""
    return t(spark, sf, "part").select("p_partkey", X.parse_number(F.expr(_NUMBER)).alias("v"))


@plan("""select p_partkey, '~' || replace(format('{:,}', round_even(p_retailprice * 37, 0)::bigint), ',', ' ') || ' ' || case p_partkey % 3 when 0 then '€' when 1 then '$' else 'CHF' end as money,
  case when p_size % 10 = 1 and p_size % 100 <> 11 then 'комната' when p_size % 10 between 2 and 4 and p_size % 100 not between 12 and 14 then 'комнаты' else 'комнат' end as rooms_word,
  case p_partkey % 4 when 0 then 'EUR' when 1 then 'USD' when 2 then 'GBP' end as code from part""")
def money_text(spark, sf):
    k = F.col("p_partkey") % 3
    c = F.when(k == 0, "EUR").when(k == 1, "USD").otherwise("CHF")
    raw = F.get(F.array(*map(F.lit, (" euros ", "$", "gbp", "coins"))), F.col("p_partkey").cast("int") % 4)
    return t(spark, sf, "part").select("p_partkey", X.money(F.col("p_retailprice") * 37, c).alias("money"), X.plural(F.col("p_size"), "комната", "комнаты", "комнат").alias("rooms_word"), X.currency_code(raw).alias("code"))


_TOK = "list_distinct(list_transform(list_filter(regexp_extract_all(strip_accents(lower(text)), 'site:[a-z0-9.-]+|\\d+|[\\p{L}]+'), lambda w: w not in (" + ", ".join(map(_q, X.QUERY_STOP)) + ")), lambda w: case when regexp_matches(w, '^\\d') then w else left(w, 5) end))"


@plan(f"select item_id, left(array_to_string(list_sort({_TOK}), ' '), 400) as query_key from benchmark")
def query_keys(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", X.query_key(F.col("text")).alias("query_key"))


@plan(r"""select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+\d[\d ().-]{6,}\d')) > 0 as has_contact,
  least(3, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+\d[\d ().-]{6,}\d')))) as n_contacts from documents""")
def contact_mask(spark, sf):
    """How many contacts a text has; the contacts themselves stay masked."""
    m = X.masked_contacts(F.col("text"))
    return spread(t(spark, sf, "documents")).select("doc_id", (F.size(m) > 0).alias("has_contact"), F.size(m).cast("long").alias("n_contacts"))


@plan("""select a.s_suppkey, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(la2 - la1) / 2), 2) + cos(radians(la1)) * cos(radians(la2)) * pow(sin(radians(lo2 - lo1) / 2), 2))), 3) as km
  from (select s_suppkey, (s_suppkey * 7 % 170 - 85)::double as la1, (s_suppkey * 13 % 350 - 175)::double as lo1, 40.4168::double as la2, -3.7038::double as lo2 from supplier) a""")
def distance_km(spark, sf):
    k = F.col("s_suppkey")
    d = X.haversine((k * 7 % 170 - 85).cast("double"), (k * 13 % 350 - 175).cast("double"), F.lit(40.4168), F.lit(-3.7038))
    return t(spark, sf, "supplier").select("s_suppkey", F.round(d, 3).alias("km"))


_N = "cast(user_id % 50 + 1 as string)"
_STAMP = f"""case event_id % 9 when 0 then {_N} || ' h' when 1 then 'ayer' when 2 then 'hace ' || {_N} || ' días' when 3 then 'just now' when 4 then day when 5 then {_N} || ' weeks' when 6 then 'unknown' when 7 then {_N} || ' min' else {_N} || ' meses' end"""


@plan("""select event_id, round(a, 6) as age, coalesce(a <= 14, false) as recent, coalesce(a > 14, false) as stale from (select event_id, case event_id % 9 when 0 then n / 24.0 when 1 then 1.0 when 2 then n when 3 then 0.0
  when 4 then date_diff('day', ts::date, date '2024-06-01') when 5 then n * 7 when 7 then n / 1440.0 when 8 then n * 30 end::double as a from (select *, user_id % 50 + 1 as n from events))""")
def relative_age(spark, sf):
    """Ages of stamps in nine ways of writing."""
    e = t(spark, sf, "events").withColumn("day", F.date_format("ts", "d.M.yyyy"))
    e = e.select("event_id", X.age_days(F.expr(_STAMP), F.lit("2024-06-01").cast("timestamp")).alias("a"))
    return e.select("event_id", F.round("a", 6).alias("age"), X.recent(F.col("a"), 14).alias("recent"), X.stale(F.col("a"), 14).alias("stale"))


@plan("""select o_orderkey, strftime(o_orderdate, '%Y-%m-%d')::date as listed, o_orderdate::date < date '1997-06-01' as past from orders where o_orderkey % 5 <> 0
  union all select o_orderkey, null, false from orders where o_orderkey % 5 = 0""")
def listing_dates(spark, sf):
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy/MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    named = X.dates_named(F.concat(F.lit("on "), raw, F.lit(".")))
    return t(spark, sf, "orders").select("o_orderkey", X.listing_date(raw).alias("listed"), X.past_event(named, F.lit("1997-06-01").cast("date")).alias("past"))


@plan("""select conv_id, turn, 'conv:' || sha256('real_estate:' || conv_id || '-' || turn) as finding_key, sha256(coalesce(text, '')) as content_hash from conversations""")
def content_keys(spark, sf):
    c = t(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.concat(F.lit("conv:"), F.sha2(F.concat_ws("", F.lit("real_estate:"), "conv_id", F.lit("-"), "turn"), 256)).alias("finding_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


PLACES = ["the", "ist", "le", "que"]


@plan("select doc_id, list_filter([" + ", ".join(f"case when regexp_matches(' ' || strip_accents(lower(text)) || ' ', '[^\\p{{L}}\\p{{N}}_]{p}[^\\p{{L}}\\p{{N}}_]') then '{p}' end" for p in PLACES) + "], lambda v: v is not null) as places from documents")
def places_named(spark, sf):
    return spread(t(spark, sf, "documents")).select("doc_id", X.find_places(F.col("text"), PLACES).alias("places"))


@plan("""select p_partkey, trim(regexp_replace(regexp_replace(lower(p_brand || ' S.L.'), '\\b(s\\.?\\s?l\\.?|s\\.?\\s?a\\.?)(\\W|$)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) as agency,
  case when length(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g')) >= 3 then regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') else '' end as ref,
  true as strong from part""")
def agency_keys(spark, sf):
    p = t(spark, sf, "part")
    r = X.ref_key(F.col("p_brand"))
    return p.select("p_partkey", X.agency_key(F.concat("p_brand", F.lit(" S.L."))).alias("agency"), r.alias("ref"), X.strong_ref(r).alias("strong"))


# Names of one to three words, cut out of the benchmark's items.
_NAMES = """(select distinct array_to_string(w[a:z], ' ') as key from (select regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') as w from benchmark), (values (1, 2), (4, 6), (8, 8), (5, 5)) c(a, z) where len(w) >= z)"""


@plan(f"""with recursive n as materialized (select key, len(string_split(key, ' ')) as n from {_NAMES}),
  d as (select doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}]+') as w from documents),
  hits as materialized (select doc_id, i as pos, n.n, n.key from (select doc_id, w, unnest(range(0, len(w))) as i from d) join (values (1), (2), (3)) l(k) on i + k <= len(w) join n on n.n = k and n.key = array_to_string(w[i + 1:i + k], ' ')),
  held as (select doc_id, min(pos) as pos, arg_max(n, (-pos) * 10 + n) as n, arg_max(key, (-pos) * 10 + n) as key from hits group by doc_id
    union all select h.doc_id, min(h.pos), arg_max(h.n, (-h.pos) * 10 + h.n), arg_max(h.key, (-h.pos) * 10 + h.n) from held join hits h on h.doc_id = held.doc_id and h.pos >= held.pos + held.n group by h.doc_id)
  select doc_id, key, pos::int as pos, n::int as n_words from held""")
def phrases_named(spark, sf):
    """Names of a table in all documents: the longest at each place, from left to right."""
    w = X.words(X.fold(F.col("text")))
    runs = [F.when(F.size("w") >= z, F.array_join(F.slice("w", a, z - a + 1), " ")) for a, z in ((1, 2), (4, 6), (8, 8), (5, 5))]
    names = t(spark, sf, "benchmark").select(w.alias("w")).select(F.explode(F.array(*runs)).alias("name"))
    return places.phrase_hits(spread(t(spark, sf, "documents")), names)


# Places of customers: their nation alone, with another one, beside a slash, or in a province's name.
_PLACE = """(select c_custkey, case c_custkey % 5 when 0 then 'Calle 1, ' || a.n_name when 1 then lower(a.n_name) || ' (' || b.n_name || ')' when 2 then a.n_name || '/' || b.n_name when 3 then a.n_name || 'X; x' else a.n_name || ' | ' || a.n_name end as place
  from customer join nation a on c_nationkey = a.n_nationkey join nation b on b.n_nationkey = (c_nationkey * 3 + c_custkey % 2) % 25)"""


@plan(f"""with p as (select c_custkey, unnest(string_split_regex(place, '[,;()|/]')) as part from {_PLACE}),
  f as (select distinct c_custkey, n_name, r_name from p join nation on lower(trim(part)) = lower(n_name) join region on n_regionkey = r_regionkey where n_nationkey % 6 <> 0)
  select c_custkey, case when count(distinct r_name) = 1 then [min(r_name)] end as regions from (select c_custkey from customer) left join f using (c_custkey) group by c_custkey""")
def place_regions(spark, sf):
    """The region that all nations named by a customer's place have in common; every sixth nation's name is a province's as well and alone is no town."""
    n = t(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    c = t(spark, sf, "customer")
    k = F.col("c_custkey")
    rows = c.join(F.broadcast(a), F.col("c_nationkey") == F.col("ka")).join(F.broadcast(b), F.col("kb") == (F.col("c_nationkey") * 3 + k % 2) % 25)
    place = (
        F.when(k % 5 == 0, F.concat(F.lit("Calle 1, "), "a")).when(k % 5 == 1, F.concat(F.lower("a"), F.lit(" ("), "b", F.lit(")"))).when(k % 5 == 2, F.concat("a", F.lit("/"), "b"))
        .when(k % 5 == 3, F.concat("a", F.lit("X; x"))).otherwise(F.concat("a", F.lit(" | "), "a"))
    )
    towns = n.join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))
    return places.regions_of_places(rows.select(k, place.alias("place")), towns, n.where("n_nationkey % 6 = 0").select(F.col("n_name").alias("name")), "c_custkey")


def _planted(sentence: str, text: str, k: int) -> str:
    """text with a sentence at a place that a hash of the id chooses; both engines read it alike."""
    cut = f"cast(floor(length({text}) * ((doc_id * {7919 + 2 * k} + {k}) % 997) / 997.0) as int)"
    return f"substr({text}, 1, {cut}) || '. ' || {sentence} || '. ' || substr({text}, {cut} + 1)"


_N = "((doc_id * 31 + 7) % 90000 + 12)"
_SIZE = f"case when doc_id % 3 = 0 or {_N} < 1000 then cast({_N} as varchar(9)) else cast(cast(floor({_N} / 1000.0) as int) as varchar(9)) || '.' || lpad(cast({_N} % 1000 as varchar(9)), 3, '0') end"
_OWNER = "case (doc_id * 17) % 11 when 0 then 'parcela' when 1 then 'terreno' when 2 then 'finca' when 3 then 'casa' when 4 then 'chalet' when 5 then 'vivienda' when 6 then 'piso' when 7 then 'loft' when 8 then 'terraza' when 9 then 'garaje' else 'bonita' end"
_AREA = f"case (doc_id * 13) % 7 when 0 then {_OWNER} || ' de ' || {_SIZE} || ' m2' when 1 then {_SIZE} || ' m2 de ' || {_OWNER} when 2 then {_OWNER} || ', ' || {_SIZE} || ' m2' when 3 then '3 banos en ' || {_OWNER} || ' de ' || {_SIZE} || ' m2' when 4 then {_OWNER} || ' a ' || {_SIZE} || ' m2 de la playa' when 5 then 'casa de 90 m2, ' || {_OWNER} || ' de ' || {_SIZE} || ' m2' else {_OWNER} || ' de ' || {_SIZE} || ' km' end"
_AUCTION = "case (doc_id * 19) % 8 when 0 then 'venta en subasta' when 1 then 'no es una subasta' when 2 then 'sin subasta' when 3 then 'no procede de la subasta' when 4 then 'casa en puja' when 5 then 'no hay prisa, pronto en subasta' when 6 then 'ni subasta ni puja, pero subasta' else 'casa' end"
_LOW, _HIGH = "((doc_id * 37) % 3000 + 1)", "((doc_id * 41) % 900 + 5)"
_TICKET = f"case (doc_id * 23) % 6 when 0 then '€' || cast({_LOW} as varchar(9)) || ' - €' || cast({_HIGH} as varchar(9)) || 'k' when 1 then cast({_LOW} as varchar(9)) || 'k a ' || cast({_HIGH} as varchar(9)) || 'M EUR' when 2 then '$' || cast({_LOW} as varchar(9)) || ' to $' || cast({_HIGH} as varchar(9)) when 3 then '€' || cast({_LOW} as varchar(9)) || ' - €' || cast({_HIGH} as varchar(9)) || 'k al mes' when 4 then '€' || cast({_LOW} as varchar(9)) || ' - $' || cast({_HIGH} as varchar(9)) || 'k' else cast({_LOW} as varchar(9)) || ' - ' || cast({_HIGH} as varchar(9)) || 'k' end"
_TEXT = "translate(coalesce(text, ''), '€$£', 'xxx')"  # amounts of the document's own would be read as well, by both, but not by a short pattern


def _told(kind: str) -> str:
    return f"case when {kind} in ('parcela', 'terreno', 'finca') then 'plot' when {kind} in ('casa', 'chalet', 'vivienda') then 'built' when {kind} in ('piso', 'loft') then 'flat' when {kind} in ('terraza', 'garaje') then 'part' end"


@plan(rf"""with a as (select doc_id, {_planted(_AREA, _TEXT, 11)} as text from documents), b as (select doc_id, {_planted(_AUCTION, "text", 5)} as text from a), d as materialized (select doc_id, {_planted(_TICKET, "text", 3)} as text from b),
  h as (select doc_id, unnest(regexp_extract_all(text, '(?:[a-z]+ (?:de|a) )?[0-9][0-9.]* m2(?: de [a-z]+)?')) as hit from d),
  k as (select doc_id, replace(regexp_extract(hit, '([0-9][0-9.]*) m2', 1), '.', '')::double as m2, regexp_extract(hit, '^[a-z]+ (de|a) ', 1) as link, coalesce({_told("regexp_extract(hit, 'm2 de ([a-z]+)$', 1)")}, case when regexp_extract(hit, '^[a-z]+ (de) ', 1) = 'de' then {_told("regexp_extract(hit, '^([a-z]+) de ', 1)")} end) as kind from h),
  s as (select doc_id, list_sort(list(kind || ' ' || m2::bigint)) as areas from k where link <> 'a' and kind <> 'part' group by doc_id),
  r as (select doc_id, regexp_extract(text, '([€$]?[0-9]+k?)(?: - | a | to )([€$]?[0-9]+[kM]?)((?: EUR| al mes)?)', ['lo', 'hi', 'tail']) as x from d),
  v as (select doc_id, x.tail as tail, left(x.lo, 1) as sa, left(x.hi, 1) as sb, contains(x.lo, 'k') as lk, regexp_extract(x.lo, '[0-9]+')::double * case when contains(x.lo, 'k') then 1e3 else 1 end as lo,
    regexp_extract(x.hi, '[0-9]+')::double * case when contains(x.hi, 'k') then 1e3 when contains(x.hi, 'M') then 1e6 else 1 end as hi from r where x.lo <> ''),
  w as (select *, (sa in ('€', '$') or sb in ('€', '$') or tail = ' EUR') and not (sa in ('€', '$') and sb in ('€', '$') and sa <> sb) as one from v)
  select d.doc_id, coalesce(s.areas, []) as areas,
    len(regexp_extract_all(text, '\b(?:subasta|puja)\b')) > len(regexp_extract_all(text, '\b(?:sin|ni|no es una|no procede de la) (?:subasta|puja)\b')) as auction,
    case when one and tail <> ' al mes' and hi > lo and not (not lk and lo < 1000 and lo * 1000 <= hi) then lo end as low, case when one and tail <> ' al mes' and hi > lo then hi end as high
  from d left join s using (doc_id) left join w using (doc_id)""")
def planted_clauses(spark, sf):
    """Areas with owners, auctions and ticket ranges read from whole documents, in which sentences stand at random places. One that another cuts in its figure may say an area of 0, which is told as it is written."""
    d = spread(t(spark, sf, "documents")).select("doc_id", F.expr(_planted(_AREA, _TEXT, 11)).alias("text"))
    for sentence, k in ((_AUCTION, 5), (_TICKET, 3)):
        d = d.select("doc_id", F.expr(_planted(sentence, "text", k)).alias("text"))
    d = d.withColumn("r", C.reading(F.col("text"), "written", "auction", "ranges"))
    areas = F.array_sort(F.transform("r.written", lambda a: F.concat_ws(" ", a["kind"], a["m2"].cast("long").cast("string"))))
    first = F.get("r.ranges", F.lit(0))
    return d.select("doc_id", areas.alias("areas"), "r.auction", first["low"].alias("low"), first["high"].alias("high"))
