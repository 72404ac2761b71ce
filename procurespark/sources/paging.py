"""Paged services crawled round by round into a durable store.

A crawl keeps two tables: the cursors that are still open, and the items got so far. A round
asks for the next page of every open cursor at once, in parallel, and commits the items with the cursors
that follow in one unit of work. A run that is stopped goes on from its last round: no page is lost and none counts
twice. A page may open cursors of its own (the variants of each product), which the next round takes up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurespark.operators.snapshots import Store, unit_of_work
from procurespark.sources.protocols import Access

#: ``given`` counts the items that a query and parent have had.
CURSORS = "query string, parent string, cursor string, given long"
ITEMS = "query string, parent string, position long, payload string"
TABLES = {"cursors": CURSORS, "items": ITEMS}
#: A page: its items, the cursor of the next (null on the last), and cursors that begin below an item.
PAGE = "items array<variant>, next string, children array<struct<parent:string,cursor:string>>"

Pages = Callable[[DataFrame], DataFrame]


def fetched_by(fetch: Callable[[str, str | None, str | None, int | None], dict], access: Access | None = None) -> Pages:
    """Pages got by a client's function, in tasks, from query, parent, cursor and how many items are still wanted; it returns ``items``, ``next`` and ``children``.

    A page that fails fails the round, and is asked for again when the crawl goes on.
    """
    if access is not None:
        access.require()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known = lambda v: None if pd.isna(v) else v
            bodies = [json.dumps(fetch(q, known(p), known(c), None if pd.isna(w) else int(w))) for q, p, c, w in zip(frame["query"], frame["parent"], frame["cursor"], frame["wanted"], strict=True)]
            yield frame.assign(body=bodies)

    return lambda cursors: cursors.mapInPandas(run, f"{CURSORS}, wanted long, body string")


def crawl(store: Store, seeds: DataFrame, pages: Pages, limit: int | None = None, rounds: int | None = None) -> int:
    """Crawls until no cursor is open, or for so many ``rounds``; returns how many were done. A crawl that has begun goes on, whatever ``seeds`` says.

    ``seeds`` (``query``, ``cursor``) begins it. ``pages`` gives open cursors their pages, as JSON in ``body``. A query, and each parent
    below it, ends with a page without items, without a next cursor or with the cursor that it had, or at ``limit`` items.
    """
    if not store.newest():
        with unit_of_work(store) as work:
            work.write("cursors", seeds.select("query", F.lit(None).cast("string").alias("parent"), F.col("cursor").cast("string").alias("cursor"), F.lit(0).cast("long").alias("given")))
    done = 0
    while (rounds is None or done < rounds) and not store.read("cursors").isEmpty():
        with unit_of_work(store) as work:
            wanted = (F.lit(limit).cast("long") - F.col("given")).alias("wanted")
            got = work.scratch("pages", pages(work.read("cursors").select("*", wanted)).select("query", "parent", "cursor", "given", "wanted", "body"))
            page = got.select("*", F.from_json("body", PAGE).alias("page")).withColumn("items", F.coalesce("page.items", F.array().cast("array<variant>")))
            page = page.withColumn("items", F.when(F.col("wanted") < F.size("items"), F.slice("items", 1, F.greatest("wanted", F.lit(0)).cast("int"))).otherwise(F.col("items")))
            items = page.select("query", "parent", "given", F.posexplode("items").alias("at", "item"))
            work.append("items", items.select("query", "parent", (F.col("given") + F.col("at")).alias("position"), F.to_json("item").alias("payload")))
            given = F.col("given") + F.size("items")
            more = (F.size("items") > 0) & F.col("page.next").isNotNull() & ~F.col("page.next").eqNullSafe(F.col("cursor"))
            more = more & (given < limit) if limit is not None else more
            following = page.filter(more).select("query", "parent", F.col("page.next").alias("cursor"), given.alias("given"))
            below = page.select("query", F.inline("page.children")).select("query", "parent", "cursor", F.lit(0).cast("long").alias("given"))
            work.write("cursors", following.unionByName(below))
        done += 1
    return done


def numbered(fetch: Callable[[str, int, int], dict], page_size: int = 25) -> Callable[[str, str | None, str | None, int | None], dict]:
    """A service of numbered pages as one of cursors: the last page is that of ``total_pages``, or a short one. The page size is 1 to 50."""
    size = max(1, min(page_size, 50))

    def page(query: str, parent: str | None, cursor: str | None, wanted: int | None) -> dict:
        number = int(cursor or 1)
        body = fetch(query, number, size)
        items = body.get("items") or []
        last = number >= int(body.get("total_pages") or 0) or len(items) < size
        return {"items": items, "next": None if last else str(number + 1)}

    return page


def cursored(fetch: Callable[[str, str | None, int], dict], page_size: int = 25) -> Callable[[str, str | None, str | None, int | None], dict]:
    """A service of cursors, whose page size is 1 to 1000 and no more than is wanted."""

    def page(query: str, parent: str | None, cursor: str | None, wanted: int | None) -> dict:
        size = max(1, min(page_size, 1000, wanted if wanted is not None else 1000))
        body = fetch(query, cursor, size)
        return {"items": body.get("items") or [], "next": body.get("next")}

    return page
