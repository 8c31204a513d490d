"""Pages to title, description, text and links, with the standard parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwright.functions import urls

SCHEMA = "title string, description string, body string, links array<struct<href:string,label:string>>, jsonld array<string>, og map<string,string>"
_LINK = pa.struct([("href", pa.string()), ("label", pa.string())])
_TYPES = [pa.string(), pa.string(), pa.string(), pa.list_(_LINK), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
#: Tags after which text goes on in a new line, and tags whose text isn't shown.
BLOCKS = frozenset("p div br li ul ol tr td table h1 h2 h3 h4 h5 h6 section article header footer nav".split())
HIDDEN = frozenset({"script", "style", "noscript", "template"})


class Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.description, self.parts, self.links, self.jsonld, self.og = "", None, [], [], [], {}
        self.hidden, self.in_title, self.data, self.href, self.label = 0, False, None, None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in HIDDEN:
            self.hidden += 1
            if tag == "script" and a.get("type", "").lower() == "application/ld+json":
                self.data = []
        elif tag == "title":
            self.in_title = True
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").lower()
            if name == "description" and self.description is None:
                self.description = a.get("content", "").strip()
            if name.startswith(("og:", "product:")):
                self.og.setdefault(name, a.get("content", ""))
        elif tag == "a":
            self._close_link()
            self.href, self.label = a.get("href"), []
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
            if tag == "script" and self.data is not None:
                self.jsonld.append("".join(self.data))
                self.data = None
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self._close_link()
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.data is not None:
            self.data.append(data)
        elif self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(data)
            if self.href is not None:
                self.label.append(data)

    def _close_link(self):
        if self.href is not None:
            self.links.append({"href": self.href, "label": " ".join("".join(self.label).split())})
        self.href = None


def parse(html: str | None) -> tuple:
    page = Page()
    page.feed(html or "")
    page.close()
    page._close_link()
    lines = (" ".join(x.split()) for x in "".join(page.parts).split("\n"))
    return " ".join(page.title.split()), page.description, "\n".join(x for x in lines if x), page.links, page.jsonld, list(page.og.items())


def parse_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` and SCHEMA of every page; null and broken pages give what can be read, at least empty strings."""
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    names = [*keep, "title", "description", "body", "links", "jsonld", "og"]

    def run(batches):
        for b in batches:
            whole = pa.Table.from_batches([b])
            for i in range(0, b.num_rows, 256):
                part = whole.slice(i, 256)
                cols = zip(*map(parse, part.column(len(keep)).to_pylist()))
                own = [part.column(k).combine_chunks() for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(c), t) for c, t in zip(cols, _TYPES))], names=names)

    return pages.select(*keep, html).mapInArrow(run, f"{fields}, {SCHEMA}")


def page_links(parsed: DataFrame, most: int, deal: str | None = None, blocked: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, pos, link: each page's first `most` different links to pages of its own site, in order."""
    each = parsed.select("page_id", "url", F.posexplode("links").alias("pos", "l")).withColumn("link", urls.absolute(F.col("url"), F.col("l.href")))
    each = each.withColumns({"__at": urls.site(F.col("link")), "__path": urls.path(F.col("link")), "__own": urls.site(F.col("url"))})
    ok = F.col("link").isNotNull() & (F.col("__at") == F.col("__own")) & urls.fetchable(F.col("link"), blocked, F.col("__at"), F.col("__path"))
    if deal:
        ok = ok & ~urls.deal_conflict(F.col("link"), F.lit(deal))
    from plotwright.operators.relational import first_per, last_n

    return last_n(first_per(each.where(ok), ["page_id", "link"], [F.col("pos")]), ["page_id"], [F.col("pos")], most).select("page_id", "url", "pos", "link")

