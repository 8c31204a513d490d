"""Grading listings against requests, scores and gates, as CASE trees over one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotwright.functions import text as X
from plotwright.functions.urls import let
from plotwright.session import durable, sized

BUCKETS = ("exact", "similar", "other", "excluded")
FAR = float("inf")
BUDGET, CEILING, AREA, AREA_FLOOR, EPS = 0.10, 0.25, 0.10, 0.75, 1e-9
REQUEST = "request_id long, amount double, is_max boolean, currency string, deal string, kind string, city string, country string, min_area double, max_area double, rooms int, min_price double, budget_pct double, area_pct double, rooms_delta int, nearby array<string>, comarcas array<string>, studio_zero boolean, place_guard boolean, auction_guard boolean, rental_term string, seasonal_guard boolean, seasonal_excluded boolean"
# What a listing may also tell: an unconfirmed place, an auction, the term and the season of a let, the comarcas of its place.
OFFERED = {"offer": "string", "country": "string", "place_unverified": "boolean", "auction": "boolean", "rental_term": "string", "seasonal": "boolean", "comarcas": "array<string>"}


def verdict(rank: int | Column, distance, why=None) -> Column:
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    return F.struct((F.lit(rank) if isinstance(rank, int) else rank).alias("rank"), d.cast("double").alias("distance"), F.lit(why).cast("string").alias("why"))


def worse(a: Column, b: Column) -> Column:
    """The farther verdict; the first where both are as far."""
    return F.when((b["rank"] > a["rank"]) | ((b["rank"] == a["rank"]) & (b["distance"] > a["distance"])), b).otherwise(a)


def budget_match(price: Column, amount: Column, is_max: Column, pct: Column) -> Column:
    """Within the band exact, up to the ceiling similar, else other; a maximum has no lower edge."""
    offset = (price - amount) / amount
    distance = F.abs(offset)
    band = F.coalesce(pct / 100, F.lit(BUDGET))
    ceiling = F.when(pct.isNull(), F.lit(CEILING)).otherwise(F.greatest(F.lit(CEILING), band + 0.15))
    approved = F.when(pct > 0, F.lit("approved_deviation"))
    exact = F.struct(F.lit(0).alias("rank"), distance.alias("distance"), approved.alias("why"))
    return F.when(is_max & (offset <= 0), verdict(0, 0.0)).when(distance <= band + EPS, exact).when(distance <= ceiling + EPS, verdict(1, distance, "price")).otherwise(verdict(2, distance, "price"))


def area_match(area: Column, least: Column, pct: Column) -> Column:
    """From nine tenths of the minimum exact, from three quarters similar, below excluded; pct replaces the tenth."""
    ratio = area / least
    distance = F.greatest(F.lit(0.0), 1 - ratio)
    tolerance = F.coalesce(pct / 100, F.lit(AREA))
    floor = F.least(F.lit(AREA_FLOOR), 1 - tolerance - 0.15)
    approved = F.when((pct > 0) & (ratio < 1 - EPS), F.lit("approved_deviation"))
    exact = F.struct(F.lit(0).alias("rank"), distance.alias("distance"), approved.alias("why"))
    return F.when(ratio >= 1 - tolerance - EPS, exact).when(ratio >= floor - EPS, verdict(1, distance, "area")).otherwise(verdict(3, distance, "area"))


def classify(x, r) -> Column:
    """Verdict of listing x (price, currency, area, rooms, deal, kind, city and what OFFERED names) on request r.

    Contradictions exclude in a fixed order: not one offer, deal, type, country. Otherwise the farthest of area, rooms,
    price floor, place, guards and budget decides; approved deviations stay exact with that reason. Unknown is never a
    contradiction: an unknown area is similar, an unknown price with a budget is other. A place elsewhere, by city or by
    comarca, ends the comparison. Guards act where the request asks for them: an unconfirmed place, an auction for a
    sale, a temporary or seasonal let for a rent are similar, or excluded if season lets are; a studio that names no
    rooms has none, and its one room against one may be the studio itself.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    approved = lambda v: no(v["why"] == "approved_deviation")
    plain = verdict(0, 0.0)
    tol = F.coalesce(r["area_pct"] / 100, F.lit(AREA))
    area = F.when(r["min_area"].isNull(), plain).when(x["area"] > 0, area_match(x["area"], r["min_area"], r["area_pct"])).otherwise(verdict(1, 0.0, "area_unknown"))
    fewer = no((x["rooms"] > 0) & (x["rooms"] < r["rooms"]))
    allowed = fewer & no(x["rooms"] >= r["rooms"] - r["rooms_delta"])
    single = no(r["studio_zero"] & (r["rooms"] > 0) & (x["kind"] == "studio") & (x["rooms"].isNull() | (x["rooms"] <= 0) | ((x["rooms"] == 1) & (r["rooms"] == 1))))
    bare = single & no((r["rooms_delta"] > 0) & (r["rooms"] - r["rooms_delta"] <= 0))
    lets = no(x["rental_term"] == "temporary")
    season = lets | no(x["seasonal"])
    renting, selling = no(r["deal"] == "rent"), no(r["deal"] == "sale")
    next_to = no(F.array_contains(r["nearby"], x["city"]))
    near = r["city"].isNotNull() & next_to
    by_comarca = no(F.size(r["comarcas"]) > 0) & no(F.size(x["comarcas"]) > 0) & ~near & ~no(F.arrays_overlap(x["comarcas"], r["comarcas"]))
    beside = by_comarca & (next_to | no(F.arrays_overlap(x["comarcas"], r["nearby"])))
    away = (no(x["city"] != r["city"]) & ~near) | (by_comarca & ~beside)
    larger = no((r["area_pct"] > 0) & (x["area"] > r["max_area"] + EPS))
    currency = F.coalesce(x["currency"], r["currency"])
    cheap = no((x["price"] < r["min_price"] * (1 - BUDGET) - EPS) & (currency == r["currency"]))

    def rest(a):
        steps = [
            F.when(no(x["area"] > r["max_area"] * (1 + tol) + EPS), verdict(2, FAR, "area_max")).otherwise(plain),
            F.when(bare, plain).when(single & no(x["rooms"] == 1), verdict(1, 0.0, "unverified")).when(single | (fewer & ~allowed), verdict(2, FAR, "rooms")).otherwise(plain),
            F.when(cheap, verdict(2, FAR, "price")).otherwise(plain),
        ]
        first = reduce(lambda acc, v: let(acc, lambda p: worse(p, v)), steps, a)
        budget = F.when(r["amount"].isNull(), plain).when(x["price"].isNull() | (currency != r["currency"]), verdict(2, FAR, "price")).otherwise(budget_match(x["price"], r["amount"], r["is_max"], r["budget_pct"]))
        guard = (
            F.when(no(r["seasonal_excluded"]) & renting & season, verdict(3, FAR, "seasonal")).when(no(r["place_guard"] & x["place_unverified"]), verdict(1, 0.0, "location_unknown"))
            .when((no(r["auction_guard"] & x["auction"]) & selling) | (renting & ((no(r["rental_term"] == "long") & lets) | (no(r["seasonal_guard"]) & season))), verdict(1, 0.0, "deal_kind")).otherwise(plain)
        )
        # A place elsewhere ends the comparison before guards and budget.
        last = F.when(away, verdict(2, FAR, "location")).otherwise(let(guard, lambda p: let(budget, lambda q: worse(p, q))))
        full = let(first, lambda p: let(last, lambda q: worse(p, q)))
        eased = approved(a) | larger | bare | (allowed & ~single) | near | beside | (~away & approved(budget))
        mark = lambda v: F.when(v["rank"] == 0, F.struct(v["rank"].alias("rank"), v["distance"].alias("distance"), F.when(eased, F.lit("approved_deviation")).alias("why"))).otherwise(v)
        return F.when(a["rank"] == 3, a).otherwise(let(full, mark))

    out = let(area, rest)
    return (
        F.when(no(x["offer"].isin("catalog", "wanted", "other")), verdict(3, FAR, "kind")).when(no(x["deal"] != r["deal"]), verdict(3, FAR, "deal"))
        .when(no(x["kind"] != r["kind"]), verdict(3, FAR, "type")).when(no(x["country"] != r["country"]), verdict(3, FAR, "foreign")).otherwise(out)
    )


def requests(spark: SparkSession, rows: list[dict]) -> Column:
    """The requests (a handful, given by people) as an array of structs for explode, instead of a join."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(REQUEST)
    cells = lambda r: [F.lit(r.get(f.name)).cast(f.dataType) if f.name not in ("nearby", "comarcas") else F.array(*map(F.lit, r.get(f.name, []))).cast("array<string>") for f in schema]
    return F.array(*[F.struct(*[c.alias(f.name) for c, f in zip(cells(r), schema)]) for r in rows])


def graded(listings: DataFrame, wanted: list[dict]) -> DataFrame:
    """One row per listing and request: id, request_id, bucket, distance, why, and both sides as structs x and r."""
    for name, kind in OFFERED.items():
        if name not in listings.columns:
            listings = listings.withColumn(name, F.lit(None).cast(kind))
    pairs = listings.select("id", F.struct(*listings.columns).alias("x"), F.explode(requests(listings.sparkSession, wanted)).alias("r"))
    pairs = pairs.withColumn("v", classify(F.col("x"), F.col("r")))
    return pairs.select("id", F.col("r.request_id").alias("request_id"), F.get(F.array(*map(F.lit, BUCKETS)), F.col("v.rank")).alias("bucket"), F.col("v.distance").alias("distance"), F.col("v.why").alias("why"), "x", "r")


def card_score(x, r, evidence: Column) -> Column:
    """0 to 1: budget 40 %, rooms 15 %, area 15 %, share of known facts 30 %, rounded half to even."""
    over = (x["price"] - r["amount"]) / r["amount"]
    same = F.coalesce(x["currency"], r["currency"]) == r["currency"]
    under = F.when(r["is_max"], 1.0).otherwise(1 - F.abs(over))
    budget = F.when(r["amount"].isNull(), 0.5).when(x["price"].isNull() | ~same, 0.3).when(over <= 0, F.greatest(F.lit(0.0), under)).otherwise(F.greatest(F.lit(0.0), 1 - 4 * over))
    rooms = F.when(r["rooms"].isNull(), 0.5).when(x["rooms"].isNull(), 0.4).when(x["rooms"] == r["rooms"], 1.0).when(x["rooms"] > r["rooms"], 0.8).otherwise(0.2)
    ratio = x["area"] / r["min_area"]
    area = F.when(r["min_area"].isNull(), F.when(x["area"].isNotNull(), 0.6).otherwise(0.5)).when(x["area"].isNull(), 0.4).when(ratio >= 1, 1.0).when(ratio >= 0.9, 0.7).otherwise(0.1)
    known = sum((F.when(c, 1).otherwise(0) for c in (x["price"].isNotNull(), x["area"].isNotNull(), x["rooms"].isNotNull(), F.coalesce(x["city"], F.lit("")) != "", F.coalesce(x["url"], F.lit("")) != "", F.coalesce(evidence, F.lit(False)))), F.lit(0))
    return F.bround(0.4 * budget + 0.15 * rooms + 0.15 * area + 0.3 * known / 6, 4)


def rank_cards(cards: DataFrame, most: int) -> DataFrame:
    """Exact ones first, best score, cheapest (unknown last), earliest: one order for a bounded report."""
    return cards.orderBy(F.when(F.col("bucket") == "exact", 0).otherwise(1), F.desc("score"), F.col("x.price").asc_nulls_last(), "id").limit(most)


def gate_score(p: dict[str, Column]) -> Column:
    """Weighted answers; null if one is missing."""
    return F.bround(0.4 * p["relevant"] + 0.25 * p["fit"] + 0.2 * p["actionable"] + 0.15 * p["credible"], 3)


def gate(bucket: Column, why: Column, p: dict[str, Column], sure: dict[str, Column]) -> Column:
    """send, hold or discard with bucket and reason. p: probabilities of the answers, sure: confidences."""
    out = lambda action, b, reason: F.struct(F.lit(action).alias("action"), (b if isinstance(b, Column) else F.lit(b).cast("string")).alias("bucket"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    no = lambda c: F.coalesce(c, F.lit(False))
    held = F.when(bucket == "exact", "similar").otherwise(bucket)
    unsure = reduce(lambda a, b: a | b, [~no(sure[k] >= 0.5) for k in ("relevant", "offer", "fit")])
    good = (p["relevant"] >= 0.7) & (p["offer"] >= 0.65)
    return (
        F.when(bucket == "excluded", out("discard", "excluded", F.concat(F.lit("rules:"), F.coalesce(why, F.lit("excluded"))))).when(no(p["spam"] > 0.35), out("discard", None, "jev:spam"))
        .when(no(p["credible"] < 0.55), out("discard", None, "jev:not_credible")).when(unsure, out("hold", held, "jev:low_confidence"))
        .when(good & (p["fit"] >= 0.6) & (bucket == "exact"), out("send", "exact", "gate:send")).when(good, out("hold", held, "gate:near"))
        .when(p["relevant"] >= 0.5, out("hold", "other", "gate:weak")).otherwise(out("discard", None, "jev:irrelevant"))
    )


def contact_score(kind: Column, place: Column, asset: Column, ticket: Column, reachable: Column, active: Column, page: Column) -> Column:
    """40, 20, 15, 15, 10 and 5 points for what is true; without a page read at most 60."""
    points = sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in ((kind, 40), (place, 20), (asset, 15), (ticket, 15), (reachable, 10), (active, 5))), F.lit(0))
    return F.when(F.coalesce(page, F.lit(False)), F.least(points, F.lit(100))).otherwise(F.least(points, F.lit(60)))


def group_relevance(places: Column, topic: Column, off: Column, in_name: Column) -> Column:
    """score and reason of a group: a place is required; topic words raise, off-topic words lower the score."""
    raw = 0.4 + F.when(topic > 0, 0.4 + 0.1 * F.least(topic - 1, F.lit(2)) + F.when(in_name, 0.1).otherwise(0.0)).otherwise(0.0) - 0.5 * off
    score = F.when(places > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)).otherwise(0.0)
    reason = F.when(places == 0, "no_location").when(score >= 0.6, F.lit(None)).when(off > 0, "off_topic").otherwise("no_vertical_match")
    return F.struct(score.alias("score"), reason.alias("reason"))


def visit_activity(state: Column, age: Column) -> Column:
    """Activity of a group from what a visit saw: its state, or the newest dated post's age in days."""
    return F.when(state == "INACCESSIBLE", "INACCESSIBLE").when(state == "UNKNOWN", "UNKNOWN").when(age <= 14, "ACTIVE").when(age <= 90, "INACTIVE").when(age.isNotNull(), "DEAD").when(state == "INACTIVE", "INACTIVE").otherwise("UNKNOWN")


def group_decision(reason: Column, activity: Column) -> Column:
    return F.when(reason.isNotNull(), F.struct(F.lit("rejected").alias("state"), reason.alias("why"))).when(activity == "INACTIVE", F.struct(F.lit("rejected").alias("state"), F.lit("inactive").alias("why"))).when(activity == "DEAD", F.struct(F.lit("rejected").alias("state"), F.lit("dead").alias("why"))).otherwise(F.struct(F.lit("discovered").alias("state"), F.lit(None).cast("string").alias("why")))


def lead_role(text: Column, seller: str, invest: str, interest: str, tenant: Column) -> Column:
    """seller (or very long), investor, tenant or buyer, else other: the first pattern decides."""
    return F.when(text.rlike(seller) | (F.char_length(text) > 600), "seller").when(text.rlike(invest), "investor").when(text.rlike(interest), F.when(tenant, "tenant").otherwise("buyer")).otherwise("other")


def review_bucket(criteria: Column, hold_mandatory: bool = True) -> Column:
    """Bucket from an array of struct(status, mandatory): a failed mandatory one excludes, a failed one is other, an unknown mandatory one is similar."""
    failed = lambda c: c["status"] == "fail"
    excluded = F.exists(criteria, lambda c: failed(c) & c["mandatory"])
    unknown = F.exists(criteria, lambda c: (c["status"] == "unknown") & c["mandatory"])
    return F.when(excluded, "excluded").when(F.exists(criteria, failed), "other").when(unknown & F.lit(hold_mandatory), "similar").otherwise("exact")


def quoted_fail(status: Column, quote: Column, text: Column) -> Column:
    """A fail must quote words that stand in the text; otherwise it is unknown."""
    from plotwright.functions.text import fold

    real = (F.length(F.trim(F.coalesce(quote, F.lit("")))) > 0) & F.contains(fold(text), fold(F.trim(quote)))
    return F.when((status == "fail") & ~F.coalesce(real, F.lit(False)), "unknown").otherwise(status)


def backed(value: Column, text: Column) -> Column:
    """A number that the text's digits don't hold is nulled."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")
    return F.when(F.contains(digits, value.cast("long").cast("string")), value)


def run_score(good: Column, sent: Column, available: Column) -> Column:
    """Good cards over what was sent or could have been (five at most); null without either."""
    base = F.greatest(sent, F.least(F.lit(5), available))
    return F.when(base > 0, good / base)


def stem_hits(texts: DataFrame, stems: DataFrame, id: str, text: str, kinds: tuple[str, ...], most: int = 1_000_000) -> DataFrame:
    """id and, for each kind, how many stems of a table (stem, kind) begin a word of the text.

    A text's distinct words meet the table by their beginnings of the stems' lengths, so the table may have any size: it is
    broadcast up to `most` rows (counted), else joined by hash. Null and empty stems hit nothing; rows of one id count
    together; a text without words has zeros. Stems and texts are folded.
    """
    known = durable(stems.select(X.fold(F.col("stem")).alias("stem"), "kind").where("stem != ''").distinct())
    lengths = sorted(r.n for r in known.select(F.char_length("stem").alias("n")).distinct().collect())  # as many as a word has letters
    words = texts.select(F.col(id).alias("id"), F.explode(F.array_distinct(X.words(X.fold(F.col(text))))).alias("word"))
    begins = words.select("id", F.explode(F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("word")), lambda n: F.substr("word", F.lit(1), n))).alias("stem")).distinct()
    hits = begins.join(sized(known, most), "stem").groupBy("id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    every = texts.select(F.col(id).alias("id")).distinct().join(hits, "id", "left")
    return every.select(F.col("id").alias(id), *[F.coalesce(k, F.lit(0)).cast("int").alias(k) for k in kinds])
