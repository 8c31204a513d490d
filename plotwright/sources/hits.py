"""Search hits, page by page: of a table of queries at pluggable backends, or of a small Python data source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, engine string, page int, rank int, url string, title string, snippet string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = [pa.int32() if c.split()[1] == "int" else pa.string() for c in SCHEMA.split(", ")]
PAGE = 10


class Paged(InputPartition):
    def __init__(self, query: str, engine: str, hits: list):
        self.query, self.engine, self.hits = query, engine, hits


class HitReader(DataSourceReader):
    def __init__(self, options):
        self.answers = json.loads(options.get("answers", "{}"))
        self.pages = int(options.get("pages", "1"))

    def partitions(self):
        return [Paged(q, e, hits) for q, engines in self.answers.items() for e, hits in engines.items()] or [Paged("", "", [])]

    def read(self, partition):
        for i, h in enumerate(partition.hits[: PAGE * self.pages]):
            yield partition.query, partition.engine, i // PAGE + 1, i + 1, h["url"], h.get("title", ""), h.get("snippet", "")


class Hits(DataSource):
    """spark.read.format("hits").option("answers", JSON of query -> engine -> list of hits).option("pages", n). A live backend replaces the reader."""

    @classmethod
    def name(cls):
        return "hits"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return HitReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(Hits)


#: What a search engine is to a plan: the hits of a query's page (from 1), each a dict of url, title and snippet; fewer than PAGE end the pages.
Backend = Callable[[str, int], list]


def paged_hits(queries: DataFrame, backends: dict[str, Backend], pages: int, query: str = "query") -> DataFrame:
    """The hits of every query of a table at every backend, read page by page in the tasks that hold the queries.

    A query's pages end with one that isn't full, or after `pages`. Nothing goes through the driver: queries are rows,
    backends are functions that travel to the tasks. A task that is lost asks its pages again, so a backend should be one
    that may be asked twice. Null and empty queries have no hits; repeated ones are asked once each.
    """
    engines = F.explode(F.array(*map(F.lit, sorted(backends)))).alias("engine")
    asked = queries.select(F.col(query).cast("string").alias("query")).where("query != ''").distinct().select("query", engines)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for page in range(1, pages + 1):
                    found = backends[e](q, page)[:PAGE]
                    rows = [(q, e, page, (page - 1) * PAGE + i + 1, h["url"], h.get("title", ""), h.get("snippet", "")) for i, h in enumerate(found)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)
                    if len(found) < PAGE:
                        break

    return asked.mapInArrow(read, SCHEMA)
