"""Listings in JSON-LD blobs and OpenGraph tags of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions import urls
from plotwright.functions.urls import let

BLOBS, CHARS, LISTINGS = 20, 200_000, 50
# Types of a listing.
TYPES = ("apartment", "house", "singlefamilyresidence", "residence", "accommodation", "product", "offer", "realestatelisting", "landparcel", "place")


def amount(raw: Column) -> Column:
    """A positive number of 480000, "480000.00", "480.000 EUR" or "1,200"; null otherwise."""
    found = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, r"(\d[\d\s .,]*)", 1), r"[\s ]", ""), r"[.,]+$", "")

    def value(x):
        marks = F.length(F.regexp_replace(x, "[^.,]", ""))
        plain = F.when((marks > 1) | x.rlike(r"[.,]\d{3}$"), F.regexp_replace(x, "[.,]", "")).otherwise(F.replace(x, F.lit(","), F.lit(".")))
        return plain.try_cast("double")

    number = let(found, value)
    return F.when(number > 0, F.round(number, 2))


def area(raw: Column, unit: Column) -> Column:
    """Square metres of a number with a unit (feet and hectares are turned)."""
    u = F.lower(F.coalesce(unit, raw, F.lit("")))
    n = amount(raw)
    return F.when(u.rlike("ft"), F.round(n * 0.092903, 1)).when(u.rlike(r"^ha[rs]?$|\dha$|\sha$|hect"), F.round(n * 10_000, 1)).otherwise(n)


def address(get) -> Column:
    """The different parts of a nested address, comma joined; get maps a path to a column."""
    parts = [F.coalesce(get(f"address.{k}.name"), get(f"address.{k}")) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
    nested = F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")), ", ")
    plain = get("address")
    return F.when(nested != "", F.left(nested, F.lit(300))).when(~F.startswith(F.coalesce(plain, F.lit("")), F.lit("{")), plain)


def listings(parsed: DataFrame) -> DataFrame:
    """page_id, url, pos and the facts of every listing node of the pages' JSON-LD, else of their OpenGraph tags.

    parsed: the output of parse_pages. Blobs may be one node, an array or a graph; list items without a node of their
    own are in item_links. Broken JSON gives nothing. Equal listings of a page count once.
    """
    blob = parsed.select("page_id", "url", F.posexplode(F.slice("jsonld", 1, BLOBS)).alias("blob", "raw"))
    blob = blob.withColumn("j", F.regexp_replace(F.trim(F.left("raw", F.lit(CHARS))), r";$", ""))
    array_of = lambda c: F.from_json(c, "array<string>")
    graph, items = F.get_json_object("j", "$.@graph"), F.get_json_object("j", "$.itemListElement[*].item")
    nodes = F.when(F.startswith("j", F.lit("[")), array_of(F.col("j"))).when(graph.isNotNull(), array_of(graph)).when(items.isNotNull() & F.startswith(items, F.lit("[")), array_of(items)).when(items.isNotNull(), F.array(items)).otherwise(F.array("j"))
    each = blob.select("page_id", "url", "blob", F.posexplode(nodes).alias("node", "n"))
    get = lambda path: F.nullif(F.trim(F.get_json_object("n", f"$.{path}")), F.lit(""))
    first = lambda *paths: F.coalesce(*map(get, paths))
    kind = F.lower(F.regexp_replace(F.coalesce(first("@type[0]", "@type"), F.lit("")), r'["\[\]]', ""))
    price = amount(first("offers.price", "offers[0].price", "offers.lowPrice", "price", "offers.priceSpecification.price"))
    facts = F.struct(
        F.left(first("name", "title"), F.lit(300)).alias("title"), price.alias("price"), F.upper(first("offers.priceCurrency", "offers[0].priceCurrency", "priceCurrency")).alias("currency"),
        area(first("floorSize.value", "floorSize"), first("floorSize.unitCode", "floorSize.unitText")).alias("area"), first("numberOfRooms.value", "numberOfRooms", "numberOfBedrooms").try_cast("int").alias("rooms"),
        address(get).alias("address"), F.coalesce(urls.absolute(F.col("url"), first("url", "@id")), F.col("url")).alias("link"), F.left(first("description"), F.lit(1500)).alias("description"), kind.alias("type"),
    )
    found = each.select("page_id", "url", (F.col("blob") * 10_000 + F.col("node")).alias("pos"), facts.alias("f")).where(F.col("f.type").isin(*TYPES) & (F.col("f.price").isNotNull() | F.col("f.area").isNotNull()))
    found = found.groupBy("page_id", "url", "f").agg(F.min("pos").alias("pos"))
    og = lambda k: F.nullif(F.trim(F.col("og")[k]), F.lit(""))
    card = F.struct(
        F.left(og("og:title"), F.lit(300)).alias("title"), amount(F.coalesce(og("product:price:amount"), og("og:price:amount"))).alias("price"), F.upper(F.coalesce(og("product:price:currency"), og("og:price:currency"))).alias("currency"),
        F.lit(None).cast("double").alias("area"), F.lit(None).cast("int").alias("rooms"), F.lit(None).cast("string").alias("address"), F.coalesce(urls.absolute(F.col("url"), og("og:url")), F.col("url")).alias("link"),
        F.left(og("og:description"), F.lit(1500)).alias("description"), F.lit("opengraph").alias("type"),
    )
    tagged = parsed.select("page_id", "url", F.lit(-1).alias("pos"), card.alias("f")).where("f.price is not null").join(found.select("page_id").distinct(), "page_id", "left_anti")
    both = found.select("page_id", "url", "pos", "f").unionByName(tagged.select("page_id", "url", "pos", "f"))
    from plotwright.operators.relational import last_n

    return last_n(both, ["page_id"], [F.col("pos")], LISTINGS).select("page_id", "url", "pos", "f.*")


def item_links(parsed: DataFrame) -> DataFrame:
    """page_id, pos and link of list items that only name a page."""
    blob = parsed.select("page_id", "url", F.explode(F.slice("jsonld", 1, BLOBS)).alias("j"))
    raw = F.from_json(F.get_json_object("j", "$.itemListElement"), "array<struct<url:string,item:string>>")
    each = blob.select("page_id", "url", F.posexplode(raw).alias("pos", "i"))
    return each.select("page_id", "pos", urls.absolute(F.col("url"), F.coalesce("i.url", F.when(~F.startswith("i.item", F.lit("{")), F.col("i.item")))).alias("link")).where("link is not null")


def facts_line(facts: Column) -> Column:
    """One line of a listing's facts for the top of a post."""
    return F.concat(F.lit("JSON-LD: "), F.to_json(facts))


def index_cards(items: DataFrame, pages: DataFrame) -> DataFrame:
    """List items joined to the pages they name, by URL identity."""
    named = items.withColumn("k", urls.key(F.col("link")))
    return named.join(pages.select(F.col("page_id").alias("child_id"), urls.key(F.col("url")).alias("k")), "k").drop("k")
