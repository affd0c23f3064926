"""A search that answers in pages, as a Python data source: one partition for each query, pages fetched until there are no more.

The endpoint is a folder of answers, ``<query>.jsonl``, a listing a line; a service would be asked the same way. Limits are
those of the service: LIMIT listings a page, no offset past LAST_OFFSET, ``pages`` pages and ``items`` listings at most. A page
shorter than asked for is the last.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LIMIT, LAST_OFFSET = 200, 10_000


class Query(InputPartition):
    def __init__(self, text: str):
        super().__init__(text)


def fetch(folder: str, query: str, offset: int, limit: int) -> list[str]:
    """A page of an answer."""
    with open(os.path.join(folder, f"{query}.jsonl"), encoding="utf-8") as f:
        return [line for i, line in enumerate(f) if offset <= i < offset + limit]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.queries = options["path"], json.loads(options["queries"])
        self.limit = max(1, min(LIMIT, int(options.get("limit", LIMIT))))
        self.pages, self.items = int(options.get("pages", 1_000_000)), int(options.get("items", 1_000_000))

    def partitions(self) -> list[Query]:
        return [Query(q) for q in self.queries]

    def read(self, partition: Query) -> Iterator[tuple]:
        seen = 0
        for page in range(self.pages):
            offset = page * self.limit
            if offset > LAST_OFFSET or seen >= self.items:
                return
            rows = fetch(self.folder, partition.value, offset, self.limit)
            for line in rows[: self.items - seen]:
                yield partition.value, page, line.rstrip("\n")
            seen += len(rows)
            if len(rows) < self.limit:
                return


class PagedSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "query string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def search(spark: SparkSession, folder: str, queries: list[str], **limits: int):
    spark.dataSource.register(PagedSearch)
    reader = spark.read.format("paged_search").option("queries", json.dumps(queries))
    for name, value in limits.items():
        reader = reader.option(name, str(value))
    return reader.load(folder)
