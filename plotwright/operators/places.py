"""Places in texts: a table of names as runs of words, the longest at each place, and a hierarchy of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwright.functions import text as X
from plotwright.functions.urls import let
from plotwright.operators.identity import durable
from plotwright.session import sized

#: Rows of a table of names up to which it is broadcast (counted), so that texts aren't shuffled.
BROADCAST = 1_000_000


def name_key(x: Column) -> Column:
    """A name as its words in lower case without accents, between blanks."""
    return F.array_join(X.words(X.fold(x)), " ")


def phrase_hits(texts: DataFrame, names: DataFrame, id: str = "doc_id", text: str = "text", name: str = "name", most: int = BROADCAST) -> DataFrame:
    """id, key, pos (in words) and n_words of the names that stand in texts: runs of whole words, from left to right, of those that overlap the longest.

    names: a table of names of any size. Words that begin a name meet its lengths first, so only runs that may be a name are
    cut out of a text; these meet the names by equality. Both tables are broadcast if they have at most `most` rows, else
    joined by hash. The hits of a text, no more than its words, then settle which of them hold.

    Null or empty texts and names have no hits; a name that stands twice in the table is one key; equal rows of texts are
    rows of their own, with their hits each; a null id is an id. Other columns are left out, so they can't clash.
    """
    known = durable(names.select(name_key(F.col(name)).alias("key")).where("key != ''").distinct())
    first = known.groupBy(F.split_part("key", F.lit(" "), F.lit(1)).alias("word")).agg(F.collect_set(F.size(F.split("key", " "))).alias("lengths"))
    rows = texts.select(F.col(id).alias("id"), F.monotonically_increasing_id().alias("row"), X.words(X.fold(F.col(text))).alias("w"))
    begins = rows.select("id", "row", "w", F.posexplode("w").alias("at", "word")).join(sized(first, most), "word")
    # A run is cut where a word begins one; the text's words end there.
    runs = begins.select("id", "row", "at", F.explode(F.transform(F.filter("lengths", lambda n: F.col("at") + n <= F.size("w")), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", F.col("at") + 1, n), " ").alias("key")))).alias("r"))
    hits = runs.select("id", "row", "at", F.col("r.n").alias("n"), F.col("r.key").alias("key")).join(sized(known, most), "key")
    every = hits.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("m"), "key"))).alias("hits"))
    none = F.array().cast("array<struct<at:int,m:int,key:string>>")

    def step(done, x):
        free = (F.size(done) == 0) | (F.element_at(done, -1)["at"] - F.element_at(done, -1)["m"] <= x["at"])
        return F.when(free, F.concat(done, F.array(x))).otherwise(done)

    held = every.select("id", F.explode(F.aggregate("hits", none, step)).alias("h"))
    return held.select(F.col("id").alias(id), F.col("h.key").alias("key"), F.col("h.at").alias("pos"), (-F.col("h.m")).alias("n_words"))


def places_in(texts: DataFrame, gazetteer: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and place (distinct) of the gazetteer's places that a text names by any of their names; gazetteer: place, name."""
    keyed = gazetteer.select("place", name_key(F.col("name")).alias("key")).where("key != ''").distinct()
    return phrase_hits(texts, gazetteer, id, text).select(id, "key").distinct().join(sized(keyed), "key").select(id, "place").distinct()


def parts_of(x: Column) -> Column:
    """A place's parts between commas and the like; one with a slash as written and, for its names apart, cut there."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[,;()|\n]"), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(name_key(p).alias("whole"), F.filter(F.transform(F.split(p, "/"), name_key), lambda k: k != "").alias("apart")))


def regions_of_places(rows: DataFrame, towns: DataFrame, provinces: DataFrame, id: str = "id", place: str = "place") -> DataFrame:
    """id and regions (sorted; null if unknown) of every row: what all towns named by its place's parts have in common.

    towns: region, name (a town may have several names and regions). A part that is a town's name as written, slash
    included, is that town; else each name beside a slash is one. A province's name alone is no town (provinces: name).
    Towns of different regions, or none: null. Null and empty places are unknown; rows of one id must be equal, and are one.

    Places are short, so each row meets the towns once by equality of names, and rows come together by id.
    """
    known = towns.select(name_key(F.col("name")).alias("key"), "region").where("key != ''").groupBy("key").agg(F.sort_array(F.collect_set("region")).alias("regions"))
    known = sized(known.join(provinces.select(name_key(F.col("name")).alias("key"), F.lit(True).alias("province")).distinct(), "key", "left"))
    each = rows.select(F.col(id).alias("id"), F.posexplode(parts_of(F.col(place))).alias("part", "p"))
    asked = each.select("id", "part", "p.apart", F.explode(F.array_distinct(F.concat(F.array("p.whole"), "p.apart"))).alias("key"), F.col("p.whole").alias("whole"))
    met = asked.join(known, "key").select("id", "part", "key", "regions", "province", (F.col("key") == F.col("whole")).alias("as_written"), (F.size("apart") > 1).alias("slashed"))
    # The official name with its slash outranks the names beside it; a province's name is a town only within such a one.
    held = met.groupBy("id", "part").agg(F.collect_list(F.struct("key", "regions", "as_written", "slashed", F.coalesce("province", F.lit(False)).alias("province"))).alias("m"))
    whole = F.filter("m", lambda x: x["as_written"] & (x["slashed"] | ~x["province"]))
    names = F.when(F.size(whole) > 0, whole).otherwise(F.filter("m", lambda x: ~x["province"]))
    sets = held.select("id", F.explode(F.transform(names, lambda x: x["regions"])).alias("regions")).groupBy("id").agg(F.collect_set("regions").alias("s"))
    common = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.get("s", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    found = sets.select("id", let(common, lambda x: F.when(F.size(x) > 0, F.array_sort(x))).alias("regions"))
    return rows.select(F.col(id).alias("id")).distinct().join(found, "id", "left").select(F.col("id").alias(id), "regions")
