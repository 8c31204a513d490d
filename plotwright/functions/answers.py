"""Answers of judges: what a model returned as JSON, read strictly, with a defined result for every drift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotwright.functions.urls import let


def verdicts(content: Column, n: Column) -> Column:
    """n verdicts (role, confidence) of a JSON array; a missing or broken one is other with 0."""
    kind = "array<struct<role:string,confidence:double>>"
    other = F.struct(F.lit("other").alias("role"), F.lit(0.0).alias("confidence"))

    def one(v):
        good = F.coalesce(v["role"].isin("buyer", "tenant", "investor", "seller", "other"), F.lit(False))
        return F.when(good, F.struct(v["role"].alias("role"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v["confidence"], F.lit(0.0)))).alias("confidence"))).otherwise(other)

    # The text is read once, not once a use.
    return let(F.coalesce(F.from_json(content, kind), F.array().cast(kind)), lambda got: F.transform(F.sequence(F.lit(0), n - 1), lambda i: one(F.get(got, i))))


def probability(raw: Column) -> Column:
    """0 to 1 of a number, a percent number or a percent text."""
    n = F.regexp_replace(raw, "%", "").try_cast("double")
    share = F.when(F.contains(raw, F.lit("%")) | (n > 1), n / 100).otherwise(n)
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def answers(content: Column, questions: list[str]) -> dict[str, Column]:
    """p of each question of {"q": {"p": ..}} or {"q": ..}; null where unanswered."""
    get = lambda q: F.coalesce(F.get_json_object(content, f"$.{q}.p"), F.get_json_object(content, f"$.{q}"))
    return {q: probability(get(q)) for q in questions}


RESULT = "relevant boolean, confidence double, summary string, category string, reason string, price_amount double, price_currency string, deal_type string, property_type string, rooms int, area_m2 double, location string"


def result(content: Column) -> Column:
    """The analysis of a post: code fences off, then strict types; null if it isn't an object or lacks relevant."""
    body = F.regexp_replace(F.regexp_replace(F.trim(content), r"^```(?:json)?\s*", ""), r"\s*```$", "")

    def strict(r):
        deal = F.when(F.lower(r["deal_type"]).isin("sale", "rent"), F.lower(r["deal_type"]))
        sure = F.when(r["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["confidence"])))
        return F.when(r["relevant"].isNotNull(), r.withField("deal_type", deal).withField("confidence", sure).withField("price_currency", F.upper(r["price_currency"])))

    return let(F.from_json(body, RESULT), strict)  # read once, not once a field and rule


def payload(r: Column, url: Column) -> Column:
    """A finding's payload: the known fields of a result with its page, as JSON."""
    return F.to_json(let(r, lambda x: x.withField("original_post_link", url)))


def merged_spec(old: Column, new: Column, fields: list[str]) -> Column:
    """A struct with new values over old ones; empty never overwrites."""
    empty = lambda v: v.isNull() | (v.cast("string") == "") | (v.cast("string") == "[]")
    return F.struct(*[F.when(empty(new[f]), old[f]).otherwise(new[f]).alias(f) for f in fields])


def goal_plan(text: Column) -> Column:
    """What a task's text asks for: deal, rooms, most money, least area."""
    from plotwright.functions import text as X

    low = F.lower(text)
    deal = F.when(low.rlike("rent|alquil|аренд|сниму|снять"), "rent").when(low.rlike("buy|compr|купл|купить|sale|venta"), "sale")
    rooms = F.regexp_extract(low, r"(\d+)\s*(?:rooms?|bed|hab|dorm|комнат)", 1).try_cast("int")
    amount = X.parse_number(F.nullif(F.regexp_extract(low, r"(?:up to|under|hasta|max|до)\s*([\d.,\s]+(?:k|mln|млн|тыс)?)", 1), F.lit("")))
    least = F.nullif(F.regexp_extract(low, r"(?:from|at least|desde|от|min)\s*(\d[\d.,]*)\s*(?:m2|m²|м2|м²|sqm)", 1), F.lit(""))
    return F.struct(deal.alias("deal"), rooms.alias("rooms"), amount.alias("amount"), X.locale_number(least).alias("min_area"))
