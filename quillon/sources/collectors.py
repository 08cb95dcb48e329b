"""Collecting paper metadata from two public web services, as Python data sources of Spark.

Each partition is one category or query and pages through its results with the service's pauses, so few partitions ask at a
time. Rows carry the place in which they came, since first records win later on.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.operators.merge import first_by_key
from quillon.sources.records import SCHOLAR_RECORD, atom_entries, atom_records, scholar_records

# Where the services are, how they are paged, and how long to wait.
FEED_URL, FEED_PAGE, FEED_DELAY = "http://export.arxiv.org/api/query", 100, 3
BULK_URL, BULK_FIELDS = "https://api.semanticscholar.org/graph/v1/paper/search/bulk", "title,abstract,year,authors,externalIds,url,citationCount,fieldsOfStudy,venue"
BULK_WAITS, BULK_DELAY = (0, 5, 15, 30, 60, 120), 1


def fetch(url: str, headers: dict[str, str] | None = None) -> tuple[int, str]:
    """Status and text; 0 and the reason if there is no answer."""
    try:
        with urlopen(Request(url, headers=headers or {}), timeout=30) as r:
            return r.status, r.read().decode("utf-8")
    except HTTPError as e:
        return e.code, str(e)
    except (URLError, TimeoutError, OSError) as e:
        return 0, str(e)


def feed_page(url: str, sleep: Callable[[float], None] = time.sleep, get=fetch, delay: float = FEED_DELAY) -> str:
    for attempt in range(3):
        status, text = get(url)
        if status == 200:
            return text
        sleep(delay * (attempt + 1))
    raise RuntimeError("the feed did not answer in 3 attempts")


def feed_pages(category: str, most: int, base: str = FEED_URL, sleep: Callable[[float], None] = time.sleep, get=fetch, delay: float = FEED_DELAY) -> Iterator[str]:
    """Pages of the newest papers of a category. A page without entries is asked for once more, then it is the end."""
    for start in range(0, most, FEED_PAGE):
        query = {"search_query": f"cat:{category}", "start": start, "max_results": min(FEED_PAGE, most - start), "sortBy": "submittedDate", "sortOrder": "descending"}
        url = f"{base}?{urlencode(query)}"
        text = feed_page(url, sleep, get, delay)
        if "<entry" not in text:
            sleep(delay)
            text = feed_page(url, sleep, get, delay)
            if "<entry" not in text:
                return
        yield text
        sleep(delay)


def bulk_answer(params: dict[str, object], base: str = BULK_URL, sleep: Callable[[float], None] = time.sleep, get=fetch, waits: tuple[float, ...] = BULK_WAITS) -> dict:
    key = os.environ.get("S2_API_KEY")
    for wait in waits:
        if wait:
            sleep(wait)
        status, text = get(f"{base}?{urlencode(params)}", {"x-api-key": key} if key else {})
        if status == 200:
            return json.loads(text)
        if status not in (0, 429):
            raise RuntimeError(f"the service answered {status}")
    raise RuntimeError("the service kept limiting the rate")


def _usable(raw: dict) -> bool:
    return bool((raw.get("title") or "").split()) and len(" ".join((raw.get("abstract") or "").split())) >= 100


def bulk_records(query: str, year_from: int, most: int, base: str = BULK_URL, sleep: Callable[[float], None] = time.sleep, get=fetch, waits: tuple[float, ...] = BULK_WAITS, delay: float = BULK_DELAY) -> Iterator[dict]:
    """Objects until so many usable ones came or there is no further page."""
    token, n = None, 0
    while True:
        answer = bulk_answer({"query": query, "fields": BULK_FIELDS, "year": f"{year_from}-"} | ({"token": token} if token else {}), base, sleep, get, waits)
        for raw in answer.get("data") or []:
            if n >= most:
                return
            n += _usable(raw)
            yield raw
        token = answer.get("token")
        if not token or n >= most:
            return
        sleep(delay)


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.options = kind, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, name)) for k, name in enumerate(json.loads(self.options["names"]))]

    def read(self, partition: InputPartition):
        k, name = partition.value
        most, delay = int(self.options.get("most", 600)), float(self.options.get("delay", FEED_DELAY))
        if self.kind == "feed":
            found = feed_pages(name, most, self.options.get("url", FEED_URL), delay=delay)
        else:
            waits = BULK_WAITS if delay else (0,) * len(BULK_WAITS)
            found = (json.dumps(r) for r in bulk_records(name, int(self.options.get("year_from", 2019)), most, self.options.get("url", BULK_URL), waits=waits, delay=min(delay, BULK_DELAY)))
        for n, text in enumerate(found):
            yield k, name, n, text


class PaperFeed(DataSource):
    """Pages of Atom text. Options: names (a JSON list of categories), most, url, delay."""

    @classmethod
    def name(cls) -> str:
        return "paper_feed"

    def schema(self) -> str:
        return "part int, name string, place long, page string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader("feed", dict(self.options))


class PaperBulk(PaperFeed):
    """JSON objects of the bulk search. Options: names (a JSON list of queries), most, year_from, url, delay."""

    @classmethod
    def name(cls) -> str:
        return "paper_bulk"

    def reader(self, schema) -> DataSourceReader:
        return _Reader("bulk", dict(self.options))


def collect_feed(spark: SparkSession, categories: list[str], per_category: int = 600, **options: object) -> DataFrame:
    """Paper records with ord, the first of each id."""
    spark.dataSource.register(PaperFeed)
    pages = spark.read.format("paper_feed").options(names=json.dumps(categories), most=per_category, **options).load()
    entries = atom_entries(pages).withColumn("ord", F.col("part") * (1 << 32) + F.col("place") * 10_000 + F.col("n"))
    return first_by_key(atom_records(entries), "arxiv_id")


def collect_bulk(spark: SparkSession, queries: list[str], per_query: int = 800, year_from: int = 2019, **options: object) -> DataFrame:
    """Paper records with ord, the first of each id."""
    spark.dataSource.register(PaperBulk)
    rows = spark.read.format("paper_bulk").options(names=json.dumps(queries), most=per_query, year_from=year_from, **options).load()
    raw = rows.select((F.col("part") * (1 << 32) + F.col("place")).alias("ord"), F.from_json("page", SCHOLAR_RECORD).alias("r")).select("ord", "r.*")
    return first_by_key(scholar_records(raw), "s2_id")
