"""Paged services as Spark data sources.

Each query of a search is a partition that pages through its results; fetches by id run a
batch of ids in a task. How a page or a record is got is a function of the caller's
(which must be picklable), so that runs can be offline; whether the network may be used is
asked of ``Access`` before anything is registered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from procurespark.sources.protocols import Access, source_name

ITEMS = "query string, position long, payload string"
#: Sources and whether a search may sweep them without a license.
SWEEPABLE = {"protocols.io": False, "europepmc": True}


def sweepable(name: str) -> str:
    """The source's own name, if it may be swept."""
    own = source_name(name)
    if not SWEEPABLE[own]:
        raise ValueError(f"{own} may not be swept; harvest it under its license")
    return own


def pages(fetch: Callable[[str, int, int], dict], query: str, limit: int, page_size: int = 25) -> Iterator[dict]:
    """Items of a numbered search: pages from 1 until the last by ``total_pages``, a short or an empty one, or the limit.

    ``fetch`` takes query, page and page size (clamped to 1..50) and returns ``items`` and ``total_pages``.
    """
    size, page, given = max(1, min(page_size, 50)), 1, 0
    while given < limit:
        body = fetch(query, page, size)
        items = body.get("items") or []
        for item in items[: limit - given]:
            yield item
        given += min(len(items), limit - given)
        if not items or page >= int(body.get("total_pages") or 0) or len(items) < size:
            return
        page += 1


def cursor_pages(fetch: Callable[[str, str | None, int], dict], query: str, limit: int | None, page_size: int = 25, start: str | None = "*") -> Iterator[dict]:
    """Items of a search by cursor, until none is named, it repeats, a page is empty, or the limit.

    ``fetch`` takes query, cursor and page size (clamped to 1..1000 and what is left of the limit)
    and returns ``items`` and ``next``.
    """
    size, cursor, given = max(1, min(page_size, 1000, limit or 1000)), start, 0
    while limit is None or given < limit:
        body = fetch(query, cursor, size if limit is None else min(size, limit - given))
        items = body.get("items") or []
        items = items if limit is None else items[: limit - given]
        yield from items
        given += len(items)
        if not items or not body.get("next") or body["next"] == cursor:
            return
        cursor = body["next"]


@dataclass
class _Query(InputPartition):
    query: str

    def __init__(self, query: str):
        super().__init__(query)
        self.query = query


def search_source(name: str, page_through: Callable[[str], Iterator[dict]]) -> type[DataSource]:
    """A data source ``name`` whose option ``queries`` is a JSON list; ``page_through`` gives a query's items."""

    class Reader(DataSourceReader):
        def __init__(self, queries: list[str]):
            self.queries = queries

        def partitions(self) -> list[InputPartition]:
            return [_Query(q) for q in self.queries] or [_Query("")]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            if partition.value in self.queries:
                for at, item in enumerate(page_through(partition.value)):
                    yield partition.value, at, json.dumps(item)

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ITEMS

        def reader(self, schema) -> DataSourceReader:
            return Reader(json.loads(self.options["queries"]))

    return Search


def search(spark: SparkSession, name: str, queries: list[str], page_through: Callable[[str], Iterator[dict]], access: Access | None = None) -> DataFrame:
    """``query, position, payload`` of all items of all queries; ``access`` is checked if given, as for gated services."""
    if access is not None:
        access.require()
    spark.dataSource.register(search_source(name, page_through))
    return spark.read.format(name).option("queries", json.dumps(queries)).load()


def fetch_each(ids: DataFrame, fetch: Callable[[str], dict], access: Access | None = None) -> DataFrame:
    """The columns of ``ids``, ``payload`` and ``error``: each ``id`` fetched by itself; a failure is an error of its row alone."""
    if access is not None:
        access.require()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            payloads, errors = [], []
            for one in frame["id"]:
                try:
                    held = fetch(one)
                    if not isinstance(held, dict):
                        raise TypeError(f"expected a record for {one}, got {type(held).__name__}")
                    payloads.append(json.dumps(held))
                    errors.append(None)
                except Exception as e:  # one record's failure must not end the run
                    payloads.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(payload=pd.Series(payloads, dtype=object), error=pd.Series(errors, dtype=object))

    return ids.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in ids.dtypes) + ", payload string, error string")
