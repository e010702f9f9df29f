"""Paged answers of a web service as a table: a Python data source whose partitions read pages, one or several.

    spark.dataSource.register(paged.PagedSource)
    spark.read.format("paged").schema("who string, gender string").option("url", "https://host/query?limit=100&offset={offset}") \\
        .option("pages", 40).option("size", 100).option("items", "results.bindings").option("value", "value").load()

Options:
- ``url``: with ``{page}`` (from 0) or ``{offset}`` (page times size) in it; ``file://`` paths and folders are read as well;
- ``pages``: how many, or ``total`` (a dotted name of the whole's count in the first page), which with ``size`` tells it;
- ``partitions``: at most so many, each with pages in a row (none given: one partition a page; a task costs far more than a short page);
- ``items``: dotted name of the array of rows in a page (empty: the page is the array); ``value``: a name inside each cell;
- ``headers``: JSON of request headers; ``fetch``: ``module:function`` of (url, headers) to bytes, in the place of urllib;
- ``attempts`` and ``wait``: a request that fails with a status of 429 or 5xx, or without an answer, is made again after
  wait seconds, then twice as many, and so on; other answers that fail end the read, as does the last attempt.

An empty page gives no rows, wherever it is; so does one without the array.  A cell that the schema's type can't hold is
null.  Spark runs a partition's pages again elsewhere when its executor is lost.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, StringType, StructType


class Passing(Exception):
    """A failure after which the request may be made again."""


def by_urllib(url: str, headers: dict[str, str]) -> bytes:
    if url.startswith("file:"):
        path = Path(unquote(urlparse(url).path))
        parts = sorted(p for p in path.iterdir() if not p.name.startswith((".", "_"))) if path.is_dir() else [path]
        return b"".join(p.read_bytes() for p in parts)
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        if e.code == 429 or e.code >= 500:
            raise Passing(str(e)) from e
        raise
    except (urllib.error.URLError, TimeoutError) as e:
        raise Passing(str(e)) from e


def fetched(url: str, options: dict[str, str]) -> object:
    """The JSON at a URL; None where there is nothing."""
    fetch = by_urllib
    if options.get("fetch"):
        module, _, name = options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
    headers = json.loads(options.get("headers") or "{}")
    attempts, wait = int(options.get("attempts") or 3), float(options.get("wait") or 1)
    for k in range(attempts):
        try:
            body = fetch(url, headers)
            return json.loads(body) if body.strip() else None
        except Passing:
            if k + 1 == attempts:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("attempts must be 1 or more")


def at(document: object, dotted: str | None) -> object:
    for name in (dotted or "").split(".") if dotted else ():
        document = document.get(name) if isinstance(document, dict) else None
    return document


def cell(value: object, kind: DataType) -> object:
    """The value as the schema has it, or None."""
    if value is None:
        return None
    try:
        if isinstance(kind, ArrayType):
            return [cell(v, kind.elementType) for v in value] if isinstance(value, list) else None
        if isinstance(kind, StringType):
            return value if isinstance(value, str) else json.dumps(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
        if isinstance(kind, (IntegerType, LongType)):
            return int(value)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(value)
    except (TypeError, ValueError):
        return None
    raise ValueError(f"pages can't hold {kind.simpleString()}")


class Page(InputPartition):
    """count pages from page on."""

    def __init__(self, page: int, count: int = 1):
        self.page, self.count = page, count


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options

    def url(self, page: int) -> str:
        return self.options["url"].replace("{page}", str(page)).replace("{offset}", str(page * int(self.options.get("size") or 0)))

    def partitions(self) -> list[Page]:
        if self.options.get("pages"):
            n = int(self.options["pages"])
        elif self.options.get("total") and self.options.get("size"):
            n = max(1, -(-int(at(fetched(self.url(0), self.options), self.options["total"]) or 0) // int(self.options["size"])))
        else:
            raise ValueError("give pages, or total and size")
        parts = min(n, int(self.options.get("partitions") or n))
        starts = [n * k // parts for k in range(parts)] + [n]
        return [Page(a, b - a) for a, b in zip(starts, starts[1:])]

    def read(self, partition: Page) -> Iterator[tuple]:
        for page in range(partition.page, partition.page + partition.count):
            yield from self.rows(page)

    def rows(self, page: int) -> Iterator[tuple]:
        rows = at(fetched(self.url(page), self.options), self.options.get("items"))
        for row in rows if isinstance(rows, list) else []:
            cells = (at(row, f.name) if isinstance(row, dict) else None for f in self.schema.fields)
            if self.options.get("value"):
                cells = (at(c, self.options["value"]) for c in cells)
            yield tuple(cell(c, f.dataType) for c, f in zip(cells, self.schema.fields))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the schema: .schema('name string, ...')")

    def reader(self, schema: StructType) -> PagedReader:
        if not self.options.get("url"):
            raise ValueError("give the url of a page")
        return PagedReader(schema, dict(self.options))


def paged(spark, schema: str, url: str, **options):
    """A table of the pages; options as above, but for partitions, 8 for each core if not given."""
    options.setdefault("partitions", 8 * spark.sparkContext.defaultParallelism)
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").schema(schema).options(url=url, **{k: str(v) for k, v in options.items()}).load()


def knowledge_pages(spark, url: str, who: str = "who", properties: tuple[str, ...] = ("gender",), **options):
    """People with a property from a SPARQL service's JSON pages: who and the properties, the last part of each resource's name, spaces for underscores."""
    from pyspark.sql import functions as F

    names = [who, *properties]
    rows = paged(spark, ", ".join(f"`{n}` string" for n in names), url, items="results.bindings", value="value", **options)
    plain = lambda c: F.replace(F.regexp_extract(F.rtrim(F.col(f"`{c}`"), F.lit("/")), "([^/]*)$", 1), F.lit("_"), F.lit(" "))
    return rows.select(*[plain(n).alias(n) for n in names]).dropDuplicates()


def profile_pages(spark, url: str, **options):
    """username and name of profiles, {"data": [...]} a page."""
    return paged(spark, "username string, name string", url, items="data", **options).dropDuplicates(["username"])
