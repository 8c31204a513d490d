"""Predicates and small rules on hits, pages, posts and payloads; gazetteers and lists come as parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwright.functions import clauses as C
from plotwright.functions import text as X
from plotwright.functions import urls as U
from plotwright.functions.urls import let

CATALOG = r"(?iu)\b[1-9]\d+\s+(?:объявлени|предложени|anuncios|listings|ads\b|results|resultados)|средн[\p{L}]+ (?:стоимост|цен)|average price|precio medio"
WALL = ("captcha", "datadome", "are you a robot", "access denied", "unusual traffic")
GENERIC_TLD = ("io", "co", "me", "tv", "ai", "eu", "cc", "ly", "to", "fm", "gg", "app")
CENTERS = {"madrid": (40.4168, -3.7038), "valencia": (39.4699, -0.3763), "alicante": (38.3452, -0.4810), "sevilla": (37.3891, -5.9845)}


def signals(title: Column, snippet: Column) -> Column:
    """What a hit shows of a listing, as clauses.signals_of tells it."""
    return C.reading(F.concat_ws(" ", title, snippet), "signals")["signals"]


def figures(shown: Column) -> Column:
    """A hit states a price or an area with its unit."""
    return shown["price"] | shown["area"]


def evidence(shown: Column) -> Column:
    """A hit names a property and states a figure, rooms (counted in digits or words) or a deal."""
    return shown["property"] & (shown["price"] | shown["area"] | shown["rooms"] | shown["deal"])


def host_allowed(host: Column, policy: str, title: Column, snippet: Column, allowed: tuple[str, ...] = (), known: tuple[str, ...] = ()) -> Column:
    """strict: the allowed sites only; otherwise known portals, and others by evidence (off) or evidence and figures."""
    if policy == "strict" and allowed:
        return U.under(host, list(allowed))
    shown = signals(title, snippet)
    return U.known_portal(host, known) | (evidence(shown) if policy == "off" else evidence(shown) & figures(shown))


def non_listing_path(host: Column, path: Column, editorial: dict[str, tuple[str, ...]]) -> Column:
    """An editorial path of a portal."""
    each = [U.under(host, [h]) & reduce(lambda a, b: a | b, [F.startswith(F.lower(path), F.lit(p)) for p in paths]) for h, paths in editorial.items()]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def looks_blocked(title: Column, text: Column, most: int = 1500) -> Column:
    body = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", " ")
    low = F.lower(F.concat_ws(" ", title, body))
    return (F.char_length(body) < most) & reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in WALL])


def keep_query(text: Column, platform: Column, paid_mode: bool, platforms: tuple[str, ...], hosts: tuple[str, ...]) -> Column:
    """False for a search of a social site that a paid source reads anyway."""
    if not paid_mode:
        return F.lit(True)
    named = F.regexp_extract_all(F.lower(text), F.lit(r"site:([a-z0-9.-]+)"), F.lit(1))
    return ~F.coalesce(platform.isin(*platforms), F.lit(False)) & ~F.exists(named, lambda h: U.under(h, list(hosts)))


def foreign_tld(host: Column, country: Column) -> Column:
    """A country's two-letter ending that isn't the asked country's; unsure is false."""
    tld = F.regexp_extract(F.lower(F.regexp_replace(host, r"\.+$", "")), r"\.([a-z]{2})$", 1)
    target = F.when(F.lower(country) == "gb", "uk").otherwise(F.lower(country))
    return F.coalesce((tld != "") & ~tld.isin(*GENERIC_TLD) & (tld != target), F.lit(False))


def foreign(country: Column, place: Column, host: Column, currency: Column, wanted: Column, wanted_currency: Column, names: dict[str, list[str]]) -> Column:
    """Clearly elsewhere: another country stated, named in the place, by the host's ending, or by the currency. names: words of each country."""
    named = F.lit(False)
    for code, words in names.items():
        named = named | (X.mentions(place, words) & (wanted != code))
    no = lambda c: F.coalesce(c, F.lit(False))
    return no(country != wanted) | no(named) | foreign_tld(host, wanted) | no(currency != wanted_currency)


def not_an_offer(kind: Column, summary: Column, vertical: str | None = None) -> Column:
    """A catalogue, a wanted post or a summary of prices."""
    odd = (kind == "catalog") | (kind.isin("wanted", "other") if vertical != "investors" else F.lit(False))
    return F.coalesce(odd, F.lit(False)) | F.coalesce(summary.rlike(CATALOG), F.lit(False))


def prefilter(deal: Column, plot: Column, wanted_deal: Column, least: Column, pct: Column) -> Column:
    """deal or area if the post certainly contradicts the task; unknown never does."""
    tolerance = F.coalesce(pct / 100, F.lit(0.10))
    floor = F.least(F.lit(0.75), 1 - tolerance - 0.15)
    return F.when(deal != wanted_deal, "deal").when(plot < least * floor - 1e-9, "area")


def declined(x, r, refused: Column) -> Column:
    """The first compromise that a person has refused and the listing would be: rooms, price, area or location."""
    from plotwright.operators.matching import area_match, budget_match

    on = lambda w: F.array_contains(refused, w)
    no = lambda c: F.coalesce(c, F.lit(False))
    tolerance = F.coalesce(r["area_pct"] / 100, F.lit(0.10))
    return (
        F.when(on("rooms") & no((x["rooms"] > 0) & (x["rooms"] < r["rooms"])), "rooms")
        .when(on("budget") & no((x["price"] > r["amount"]) & (budget_match(x["price"], r["amount"], r["is_max"], r["budget_pct"])["rank"] > 0)), "price")
        .when(on("area") & (no(area_match(x["area"], r["min_area"], r["area_pct"])["rank"] > 0) | no(x["area"] > r["max_area"] * (1 + tolerance) + 1e-9)), "area")
        .when(on("place") & no((x["city"] != r["city"]) & ~F.array_contains(r["nearby"], x["city"])), "location")
    )


def ticket_short(high: Column, currency: Column, least: Column, wanted: Column) -> Column:
    """The range ends below the least ticket, in the same currency."""
    return F.coalesce((currency == wanted) & (high < least), F.lit(False))


def region_side(regions: Column, wanted: Column, nearby: Column) -> Column:
    """in, nearby, out or unknown, from the regions that a place belongs to."""
    return F.when(F.coalesce(F.size(regions), F.lit(0)) <= 0, "unknown").when(F.arrays_overlap(regions, wanted), "in").when(F.arrays_overlap(regions, nearby), "nearby").otherwise("out")


def regions_of(place: Column, table: dict[str, list[str]]) -> Column:
    """Regions common to all towns of the table that the place's parts name; empty without one or with towns apart."""
    parts = F.transform(F.split(X.fold(place), r"[,/()]"), lambda p: F.trim(p))
    keys = F.map_from_arrays(F.array(*map(F.lit, table)), F.array(*[F.array(*map(F.lit, v)) for v in table.values()]))
    found = F.filter(F.transform(parts, lambda p: F.try_element_at(keys, p)), lambda v: v.isNotNull())
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(found, F.get(found, F.lit(0)), lambda a, b: F.array_intersect(a, b)))


def reach_judge(title: Column, snippet: Column, kinds: dict[str, str], names: list[str]) -> Column:
    """kind by the first pattern, relevance by the place, a confidence."""
    text = F.concat_ws(" ", title, snippet)
    kind = F.lit("other")
    for k, pattern in reversed(kinds.items()):
        kind = F.when(F.lower(text).rlike(pattern), k).otherwise(kind)
    near = X.mentions(text, names)
    return F.struct(kind.alias("kind"), (near & (kind != "other")).alias("relevant"), F.when(near, 0.6).otherwise(0.4).alias("confidence"))


def place_conflict(stated: Column, text: Column, gazetteer: list[str]) -> Column:
    """The text names places of the gazetteer and the stated one isn't among them."""
    return let(X.find_places(text, gazetteer), lambda p: F.coalesce((F.size(p) > 0) & stated.isin(*gazetteer) & ~F.array_contains(p, stated), F.lit(False)))


def matched_share(x: Column, terms: list[str]) -> Column:
    """Share of the requested terms in the text."""
    return sum((F.when(X.mentions(x, [w]), 1).otherwise(0) for w in terms), F.lit(0)) / max(1, len(terms))


def min_area_of(x: Column) -> Column:
    """The least area that a task's text asks for, in square metres: "from 2000 m2", "2 ha or more"."""
    num, unit = r"(\d{1,3}(?:[ .,]\d{3})+|\d+(?:[.,]\d+)?)", r"(м²|м2|m²|m2|sqm\b|sq\.?\s*m|metros?|сот[\p{L}]*|га\b|ha\b|hect[\p{L}]*)"
    before = rf"(?iu)(?:от|від|не менее|min(?:imum)?|from|at least|desde|a partir de|al menos|>=|≥)\s*{num}\s*{unit}"
    after = rf"(?iu){num}\s*{unit}\s*(?:\+|or\s+more|and\s+more|o\s+m[aá]s|y\s+m[aá]s|и\s+больше|или\s+больше)"
    pick = lambda i: F.coalesce(F.nullif(F.regexp_extract(x, before, i), F.lit("")), F.nullif(F.regexp_extract(x, after, i), F.lit("")))
    raw, u = pick(1), F.lower(pick(2))
    n = F.when(raw.rlike(r"^\d{1,3}(?:[ .,]\d{3})+$"), F.regexp_replace(raw, "[ .,]", "")).otherwise(F.replace(raw, F.lit(","), F.lit("."))).try_cast("double")
    m2 = n * F.when(u.rlike("^сот"), 100).when(u.rlike("^(?:га|ha|hect)"), 10_000).otherwise(1)
    return F.when(m2.between(1, 1e8), m2)


def parcels(x: Column) -> Column:
    """Cadastral references with the word for them at most 40 characters before."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?is)catastr.{0,40}?(?<![0-9a-z])((?:\d{5}[a-z]\d{8}|\d{7}[a-z]{2}\d{4}[a-z])\d{4}[a-z]{2})(?![0-9a-z])"), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(found, F.upper)))


def new_build(x: Column) -> Column:
    """Names a new development; a zoning or a promotional price isn't one."""
    words = x.rlike(r"(?iu)(?<![\p{L}\p{N}_])(?:obra\s+nueva|(?:complejo|conjunto)\s+residencial)(?![\p{L}\p{N}_])") | x.rlike(r"(?iu)(?<!precio\sde\s)(?<![\p{L}\p{N}_])promoci[oó]n(?![\p{L}\p{N}_])")
    name = x.rlike(r"(?<![\p{L}\p{N}_])(?<!(?i:uso|usos|suelo|zona|urbanizaci[oó]n)[\s:]{1,2})(?:[Rr]esidencial|RESIDENCIAL)\s+(?!(?i:unifamiliar|plurifamiliar|multifamiliar|intensiva|extensiva))\p{Lu}")
    return F.coalesce(words | name, F.lit(False))


def social_query_key(kind: Column, x: Column) -> Column:
    """A query without case, accents, signs and hashes, under its kind."""
    return F.concat(kind, F.lit(":"), F.array_join(X.words(X.fold(x)), " "))


def profile_link(href: Column, hosts: dict[str, str]) -> Column:
    """struct(network, key, url) of a profile page; null for other paths. hosts: site to network."""
    name = F.lower(F.regexp_extract(U.path(href), r"^/(?:in/|@)?([A-Za-z0-9_.-]{2,})/?$", 1))
    network = F.lit(None).cast("string")
    for h, n in hosts.items():
        network = F.when(U.under(U.site(href), [h]), n).otherwise(network)
    return F.when((name != "") & network.isNotNull(), F.struct(network.alias("network"), F.concat(network, F.lit(":"), name).alias("key"), U.normalize(href).alias("url")))


def group_page(url: Column, host: str, reserved: tuple[str, ...] = ("feed", "discover", "joins", "create", "search")) -> Column:
    """struct(key, url) of a group's own page on a site; null for its sub-pages."""
    key = F.lower(F.regexp_extract(U.path(F.trim(url)), r"^/groups/([A-Za-z0-9.]+)/?$", 1))
    plain = U.scheme(F.trim(url)).isin("http", "https") & U.under(U.site(F.trim(url)), [host]) & ~F.contains(U.authority(F.trim(url)), F.lit("@"))
    return F.when(plain & (F.replace(key, F.lit("."), F.lit("")) != "") & ~key.isin(*reserved), F.struct(key.alias("key"), F.concat(F.lit(f"https://www.{host}/groups/"), key, F.lit("/")).alias("url")))


def city_center(city: Column) -> Column:
    keys = F.map_from_arrays(F.array(*map(F.lit, CENTERS)), F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in CENTERS.values()]))
    return F.try_element_at(keys, X.fold(city))


def model_cost(stated: Column, prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """The stated cost, else tokens by their prices per million."""
    return F.when(stated >= 0, stated).otherwise((prompt * price_in + completion * price_out) / 1e6)


def round_halves(filled: Column, rounds: Column) -> Column:
    """Which of two halves (a, b) wrote each round: they alternate, and a round without a query ends its half."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("b").alias("last"), F.array().cast("array<string>").alias("gone"))

    def step(acc, i):
        other = F.when(acc["last"] == "a", "b").otherwise("a")
        here = F.when(~F.array_contains(acc["gone"], other), other).when(~F.array_contains(acc["gone"], acc["last"]), acc["last"])
        ended = F.when(here.isNotNull() & ~F.array_contains(filled, i), F.array_append(acc["gone"], here)).otherwise(acc["gone"])
        return F.struct(F.when(here.isNotNull(), F.array_append(acc["out"], here)).otherwise(acc["out"]).alias("out"), F.coalesce(here, acc["last"]).alias("last"), ended.alias("gone"))

    return F.aggregate(F.sequence(F.lit(1), rounds), start, step, lambda acc: acc["out"])


def best_per_person(contacts: DataFrame, key: str, score: str, order: list[str]) -> DataFrame:
    """The best contact of each person, with all their sources."""
    rest = [c for c in contacts.columns if c != key]
    return contacts.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), *[F.col(o) for o in order])).alias("c"), F.count("*").alias("n_sources")).select(key, "c.*", "n_sources")


def merged_hits(hits: DataFrame, key: str, body: str, engine: str) -> DataFrame:
    """One row per page: the longest body and all engines."""
    return hits.groupBy(key).agg(F.max_by(body, F.struct(F.char_length(body), F.col(body))).alias(body), F.sort_array(F.collect_set(engine)).alias("engines"))


def seeded_streak(batches: DataFrame, keys: list[str], newest_first: list[Column], passed: Column, seed: str) -> DataFrame:
    """The trailing run of passes, each with a seed that the run hasn't had; a missing seed ends it."""
    again = F.row_number().over(Window.partitionBy(*keys, seed).orderBy(*newest_first)) > 1
    marked = batches.withColumn("__ok", passed & F.col(seed).isNotNull() & ~again)
    bad = F.sum(F.when(F.col("__ok"), 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("__bad", bad).groupBy(*keys).agg(F.count_if(F.col("__bad") == 0).alias("streak"))


def one_per_message(entries: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """One message for each finding, the first `most` of each digest, numbered."""
    from plotwright.operators.relational import last_n, nth

    return nth(last_n(entries, keys, order, most), keys, order, "message_no")
