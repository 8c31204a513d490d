"""Vendor rows, kept as JSON strings, to canonical listings: one set of paths per vendor, no code per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions import urls

CANONICAL = ("url", "title", "price", "currency", "area", "rooms", "address", "city", "province", "description", "advertiser", "reference", "kind", "deal", "latitude", "longitude")


@dataclass(frozen=True)
class Provider:
    """JSON paths of the canonical fields; the first that is there counts."""

    host: str
    paths: dict[str, tuple[str, ...]]
    empty_marker: str | None = None
    currency: str = "EUR"


# Where vendors keep their fields.
PROVIDERS = {
    "fotocasa": Provider("fotocasa.es", {
        "url": ("url",), "title": ("title",), "price": ("transaction.price",), "area": ("surface",), "rooms": ("rooms",), "address": ("street",), "city": ("location.level5Name",),
        "province": ("location.level2Name",), "description": ("description",), "advertiser": ("agency.name",), "reference": ("agencyReference",), "kind": ("propertyType",),
        "deal": ("transaction.type",), "latitude": ("location.latitude",), "longitude": ("location.longitude",)}),
    "yaencontre": Provider("yaencontre.com", {
        "url": ("url",), "title": ("title", "address.qualifiedName"), "price": ("price",), "area": ("area",), "rooms": ("rooms",), "address": ("address.qualifiedName",), "city": ("address.qualifiedName",),
        "description": ("description",), "advertiser": ("owner.name",), "reference": ("reference",), "kind": ("family",), "deal": ("operation",), "latitude": ("address.geoLocation.lat",), "longitude": ("address.geoLocation.lon",)}),
    "idealista": Provider("idealista.com", {
        "url": ("url",), "title": ("suggestedTexts.title",), "price": ("price", "priceInfo.price.amount"), "area": ("size",), "rooms": ("rooms",), "address": ("address",), "city": ("municipality",), "province": ("province",),
        "description": ("description",), "advertiser": ("contactInfo.commercialName",), "reference": ("externalReference",), "kind": ("propertyType",), "deal": ("operation",), "latitude": ("latitude",), "longitude": ("longitude",)}),
    "pisos": Provider("pisos.com", {
        "url": ("detailUrl",), "title": ("title",), "price": ("price",), "currency": ("priceCurrency",), "area": ("areaSqm", "usableAreaSqm", "terrainAreaSqm"), "rooms": ("rooms",), "address": ("fullAddress",), "city": ("city",),
        "province": ("province",), "description": ("shortDescription",), "advertiser": ("advertiserName",), "reference": ("adId",), "kind": ("propertyType",), "deal": ("transactionType",), "latitude": ("latitude",), "longitude": ("longitude",)}),
    "habitaclia": Provider("habitaclia.com", {
        "url": ("detailUrl",), "title": ("title",), "price": ("price",), "currency": ("priceCurrency",), "area": ("areaSqm",), "rooms": ("rooms",), "address": ("location",), "city": ("city",), "province": ("province",),
        "description": ("description", "shortDescription"), "advertiser": ("advertiserName",), "reference": ("agencyRef",), "kind": ("propertyType",), "deal": ("transactionType",), "latitude": ("latitude",), "longitude": ("longitude",)}, empty_marker="noResults"),
    "milanuncios": Provider("milanuncios.com", {
        "url": ("url",), "title": ("title",), "price": ("price",), "area": ("tag_sqm",), "rooms": ("tag_bedrooms",), "address": ("cityName",), "city": ("cityName",), "province": ("provinceName",), "description": ("description",),
        "reference": ("id",), "kind": ("categorySlug",), "deal": ("sellType",), "latitude": ("latitude",), "longitude": ("longitude",)}),
}
# vendors' words for deals and kinds.
DEALS = {"sale": ("sale", "venta", "buy", "comprar", "supply", "1", "sell"), "rent": ("rent", "alquiler", "alquilar", "letting", "2", "3")}
KINDS = {
    "land": ("land", "terreno", "parcela", "solar", "finca"), "house": ("house", "chalet", "casa", "villa", "adosado", "countryhouse"),
    "studio": ("studio", "estudio"), "apartment": ("flat", "piso", "apartment", "apartamento", "atico", "penthouse", "duplex"), "commercial": ("local", "oficina", "office", "nave", "premises"),
}


def _lookup(raw: Column, table: dict[str, tuple[str, ...]], whole: bool) -> Column:
    low = F.lower(F.trim(raw))
    out = F.lit(None).cast("string")
    for name, found in reversed(table.items()):
        hit = low.isin(*found) if whole else low.rlike("(?<![a-z])(?:" + "|".join(found) + ")")  # a penthouse is no house
        out = F.when(hit, name).otherwise(out)
    return out


def listings(rows: DataFrame, provider: str, item: str = "item") -> DataFrame:
    """Canonical listings of a vendor's rows (JSON strings); rows without a page of the vendor, or that only say that nothing was found, are dropped.

    Empty strings and zero or negative numbers are unknown; broken JSON gives no listing.
    """
    p = PROVIDERS[provider]
    path = lambda name: F.coalesce(*[F.nullif(F.trim(F.get_json_object(item, f"$.{x}")), F.lit("")) for x in p.paths[name]]) if name in p.paths else F.lit(None).cast("string")
    number = lambda name: F.when(path(name).try_cast("double") > 0, path(name).try_cast("double"))
    point = lambda name: path(name).try_cast("double")
    columns = {
        "url": path("url"), "title": path("title"), "price": number("price"), "currency": F.coalesce(F.upper(path("currency")), F.lit(p.currency)), "area": number("area"),
        "rooms": number("rooms").cast("int"), "address": path("address"), "city": F.trim(F.element_at(F.split(path("city"), ","), -1)), "province": path("province"),
        "description": F.regexp_replace(path("description"), r"\s+", " "), "advertiser": path("advertiser"), "reference": path("reference"),
        "kind": _lookup(path("kind"), KINDS, False), "deal": _lookup(path("deal"), DEALS, True), "latitude": point("latitude"), "longitude": point("longitude"),
    }
    rest = [c for c in rows.columns if c != item and c not in CANONICAL]
    out = rows.select(*rest, item, *[c.alias(n) for n, c in columns.items()])
    ok = urls.under(urls.site(F.col("url")), (p.host,))
    if p.empty_marker:
        ok = ok & F.get_json_object(item, f"$.{p.empty_marker}").isNull()
    return out.where(ok).drop(item).withColumn("provider", F.lit(provider))
