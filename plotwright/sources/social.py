"""Social dataset rows: posts, error reports, and the contract of an acquired post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.operators.relational import split_contract

# Fields in which vendors keep the same thing.
TEXT, URL, TIME = ("text", "message", "postText", "caption"), ("url", "postUrl", "facebookUrl", "link"), ("time", "date", "timestamp", "publishedTime")
POST = "post_url string, raw_text string, published_at timestamp, price_amount double, price_currency string, location_text string, needs_split boolean, content_hash string"


def _first(item: str, paths: tuple[str, ...]):
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(item, f"$.{p}")), F.lit("")) for p in paths])


def errors(rows: DataFrame, item: str = "item") -> DataFrame:
    """Rows that report an error instead of a post: group_url and code."""
    said = F.lower(_first(item, ("error", "errorDescription")))
    code = F.when(said.rlike("private|join|login|member"), "group_private").when(said.rlike("not found|unavailable|removed|404"), "group_not_found").otherwise("actor_error")
    return rows.where(said.isNotNull()).select(_first(item, ("groupUrl", "inputUrl", "url")).alias("group_url"), code.alias("code"))


def posts(rows: DataFrame, item: str = "item") -> DataFrame:
    """Usable posts in the contract's columns; rows without text or address, and error reports, are left out."""
    text, url = _first(item, TEXT), _first(item, URL)
    prices = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d[\d.,]*)\s*(?:€|eur)"), F.lit(1)))
    when = F.coalesce(F.try_to_timestamp(_first(item, TIME)), F.timestamp_seconds(_first(item, TIME).try_cast("double")))
    body = F.left(text, F.lit(50_000))
    return rows.where(text.isNotNull() & url.isNotNull() & _first(item, ("error", "errorDescription")).isNull()).select(
        url.alias("post_url"), body.alias("raw_text"), when.alias("published_at"), _first(item, ("price.amount", "priceAmount")).try_cast("double").alias("price_amount"),
        F.upper(_first(item, ("price.currency", "priceCurrency"))).alias("price_currency"), _first(item, ("location",)).alias("location_text"), (F.size(prices) >= 2).alias("needs_split"), F.sha2(body, 256).alias("content_hash"),
    )


def checked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts that keep the contract, and the others with the rule they break. Unknown is null; an empty string is a breach."""
    rules = {
        "text": F.char_length("raw_text").between(1, 50_000), "url": F.col("post_url").rlike("^https?://"), "currency": F.col("price_currency") != "",
        "price": F.col("price_amount") > 0, "hash": F.col("content_hash").rlike("^[0-9a-f]{64}$"),
    }
    return split_contract(found, rules)
