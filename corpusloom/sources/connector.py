"""A data source for paginated registers (SRC-23..28, EXT-01): ``spark.read.format("paged_register")``.

The register's client is a class with ``pages() -> list`` of page keys and ``fetch(key) -> list[dict]``, named as
``module:Class`` in the option ``client``; each partition fetches some pages, with retries and exponential waits.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, source string, url string, title string, content string, doc_type string, number string, metadata string"
#: Answers after which a request is tried again.
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})


class RetryableError(Exception):
    """A failed request, with the status of the answer if there was one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def with_retries(call: Callable[[], list[dict]], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Up to ``tries`` calls, waiting 1, 2, 4 ... times ``wait`` between them; other errors end it at once (SRC-28)."""
    for n in range(tries):
        try:
            return call()
        except RetryableError as e:
            if n + 1 == tries or (e.status is not None and e.status not in RETRY_STATUS):
                raise
            sleep(wait * 2**n)
    return []


class _Pages(InputPartition):
    def __init__(self, keys: list):
        self.keys = keys


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.names = [f.split()[0] for f in SCHEMA.split(", ")]

    def _client(self):
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)()

    def partitions(self) -> list[InputPartition]:
        keys = list(self._client().pages())
        size = max(1, int(self.options.get("pagesperpartition", "10")))
        return [_Pages(keys[i : i + size]) for i in range(0, len(keys), size)] or [_Pages([])]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        client = self._client()
        for key in partition.keys:
            for row in with_retries(lambda key=key: client.fetch(key), wait=float(self.options.get("wait", "1"))):
                yield tuple(row.get(n) for n in self.names)


class PagedRegister(DataSource):
    """The register as a table."""

    @classmethod
    def name(cls) -> str:
        return "paged_register"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the connectors known to a session (SRC-27)."""
    spark.dataSource.register(PagedRegister)


def frontier(exists: Callable[[int], bool], low: int, high: int) -> int:
    """The greatest id that exists, by bisection between one that does and one that doesn't (SRC-25)."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if exists(middle) else (low, middle)
    return low
