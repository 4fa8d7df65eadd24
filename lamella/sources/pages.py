"""Listing pages as tables, and as a data source that reads page by page."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def links(pages: DataFrame, html: str = "html", keys: list[str] | None = None) -> DataFrame:
    """keys, pos, href, text of each link, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select(*(keys or []), F.posexplode(found).alias("pos", "tag"))
    return rows.select(*(keys or []), "pos", F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1).alias("href"), F.trim(F.regexp_replace("tag", "<[^>]+>", "")).alias("text"))


def table_rows(pages: DataFrame, html: str = "html", keys: list[str] | None = None) -> DataFrame:
    """keys, pos, cells of each table row."""
    rows = pages.select(*(keys or []), F.posexplode(F.regexp_extract_all(F.col(html), F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("pos", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")))
    return rows.select(*(keys or []), "pos", cells.alias("cells"))


def url_parts(url: Column | str) -> Column:
    """host, path and page number of an address; null where absent."""
    c = F.col(url) if isinstance(url, str) else url
    part = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(part("^https?://([^/:?#]+)").alias("host"), part("^https?://[^/?#]+(/[^?#]*)").alias("path"), part("[?&]page=([0-9]+)").try_cast("int").alias("page"))


def date_range(text: Column | str) -> Column:
    """start and end of ``yyyy.mm.dd ~ yyyy.mm.dd`` (dots or hyphens)."""
    c = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"[.]", "-")
    at = lambda i: F.try_to_date(F.get(F.regexp_extract_all(c, F.lit(r"(\d{4}-\d{1,2}-\d{1,2})"), F.lit(1)), F.lit(i)), "yyyy-M-d")
    return F.struct(at(0).alias("start"), F.coalesce(at(1), at(0)).alias("end"))


class _PagePartition(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _PageReader(DataSourceReader):
    def __init__(self, fetch: Callable[[int], list[tuple]], pages: int):
        self.fetch, self.pages = fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [_PagePartition(i) for i in range(1, self.pages + 1)]

    def read(self, partition: _PagePartition) -> Iterator[tuple]:
        yield from self.fetch(partition.number)


def paged_source(name: str, schema: str, fetch: Callable[[int], list[tuple]]) -> type[DataSource]:
    """A data source with one partition per listing page; ``fetch(page)`` returns the page's rows.

    Spark retries a page's task when the fetch fails. Option ``pages`` is their number.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return _PageReader(fetch, int(self.options.get("pages", "1")))

    return Paged


def attempted(fetch: Callable[[object, int], object], request: object, attempts: int, pause: float, growth: float) -> tuple[object, int, str | None]:
    """(answer, attempts, error): tries up to ``attempts`` times, with pauses that grow by ``growth``; the last error stays."""
    error = None
    for n in range(1, attempts + 1):
        try:
            return fetch(request, n), n, None
        except Exception as found:  # noqa: BLE001 - whatever a server does is a row of the failure table
            error = f"{type(found).__name__}: {found}"
        if n < attempts:
            time.sleep(pause * growth ** (n - 1))
    return None, attempts, error


def fetch_pages(requests: DataFrame, key: str, fetch: Callable[[dict, int], str], lanes: int = 3, delay: float = 1.0, attempts: int = 3, pause: float = 2.0, growth: float = 2.0) -> DataFrame:
    """key, answer, attempts, error for every request: ``fetch(request, attempt)`` gives a page's text or raises.

    At most ``lanes`` tasks ask at once, each with ``delay`` seconds between its requests. A page
    that fails at every attempt is a row with its error and no answer, so it fails no task and can be
    asked again (see ``failed``). Requests are dealt out by key; an empty table asks nothing.
    """
    kind = dict(requests.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            out = []
            for request in batch.to_dict("records"):
                if not first:
                    time.sleep(delay)
                first = False
                out.append((request[key], *attempted(fetch, request, attempts, pause, growth)))
            yield pd.DataFrame(out, columns=[key, "answer", "attempts", "error"])

    return requests.repartition(lanes, key).mapInPandas(run, f"{key} {kind}, answer string, attempts int, error string")


def answered(fetched: DataFrame, schema: str) -> DataFrame:
    """The rows of all good pages, whose answers are JSON arrays of ``schema``."""
    return fetched.where(F.col("error").isNull()).select(F.inline(F.from_json("answer", f"array<struct<{schema}>>")))


def failed(fetched: DataFrame, key: str) -> DataFrame:
    """key, attempts, error of the pages that no attempt gave."""
    return fetched.where(F.col("error").isNotNull()).select(key, "attempts", "error")


def regrouped(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """``parents`` with their children nested as an array of structs, in order of the children's columns; none is an empty array."""
    columns = [c for c in children.columns if c != key]
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))  # the children of one document
    empty = F.array().cast(dict(nested.dtypes)[name])
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, empty))


class _PageStream(DataSourceStreamReader):
    def __init__(self, fetch: Callable[[int], list[tuple]], newest: int, most: int):
        self.fetch, self.newest, self.most = fetch, newest, most

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.newest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pages = range(start["page"] + 1, end["page"] + 1)
        return [InputPartition(list(pages[i : i + self.most])) for i in range(0, len(pages), self.most)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in partition.value:
            yield from self.fetch(page)


def paged_stream(name: str, schema: str, fetch: Callable[[int, dict], list[tuple]]) -> type[DataSource]:
    """A stream over numbered pages: each run reads the pages behind the last commit, up to option ``newest``.

    Offsets are page numbers from 1, kept in the query's checkpoint, so a restart goes on from
    there and no page is read twice into the result. ``fetch(page, options)`` returns a page's rows;
    a task reads at most option ``pagesPerTask`` pages (default 8).
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            options = dict(self.options)
            return _PageStream(lambda page: fetch(page, options), int(options["newest"]), int(options.get("pagespertask", options.get("pagesPerTask", "8"))))

    return Paged
