"""Feeds that are given out page by page, as a batch source: a partition for each feed, its pages one after another.

A page is asked for by the cursor that the page before it gave, so the pages of one feed can't be read side by side; feeds are. How a page is
fetched is a callable that is passed in, and so is the look-up of which keys are known, which lets a walk end at the first page without a new one.
A task holds one page at a time. A task that is run again asks for its feed's pages again.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (feed, cursor or None) -> {"items": [...], "next_max_id": cursor or None, "more_available": bool}
Fetch = Callable[[str, str | None], dict]
#: (feed, keys of a page) -> those of them that are known already
Known = Callable[[str, list[str]], Iterable[str]]
PAGE = "feed string, page long, items array<string>, keys array<string>, stopped string"


def walk(feed: str, fetch: Fetch, known: Known | None = None, limit: int | None = None, key: str = "code", wait: float = 0.0) -> Iterator[tuple]:
    """feed, page (from 1), items (JSON), keys, stopped of each page of one feed; stopped is limit, known or end on the last page and null before.

    After each page the walk ends at limit keys; else where all its keys are known (a page without keys never ends it so); else where the feed
    says that there is no more. Only end means that the walk is complete.
    """
    cursor, page, seen = None, 0, 0
    while True:
        got, page = fetch(feed, cursor), page + 1
        items = [entry.get("media", entry) for entry in got.get("items") or []]
        keys = sorted({str(x[key]) for x in items if x.get(key)})
        seen += sum(1 for x in items if x.get(key))
        cursor = got.get("next_max_id")
        full_up = bool(limit) and seen >= limit
        stale = not full_up and known is not None and bool(keys) and set(keys) <= set(known(feed, keys))
        stopped = "limit" if full_up else "known" if stale else "end" if not (got.get("more_available") and cursor) else None
        yield feed, page, [json.dumps(x, ensure_ascii=False) for x in items], keys, stopped
        if stopped:
            return
        time.sleep(wait)


def read_feeds(spark: SparkSession, feeds: Iterable[str], fetch: Fetch, known: Known | None = None, limit: int | None = None, key: str = "code", wait: float = 0.0) -> DataFrame:
    """The pages of several feeds, as walk() gives them. Every action on the result asks for the pages again: write it once."""
    names = list(feeds)

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(name) for name in names]

        def read(self, partition):
            yield from walk(partition.value, fetch, known, limit, key, wait)

    class Feeds(DataSource):
        @classmethod
        def name(cls):
            return "paged_feeds"

        def schema(self):
            return PAGE

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Feeds)
    return spark.read.format("paged_feeds").load()


def page_items(pages: DataFrame) -> DataFrame:
    """feed, page, position (from 0), raw_json of each item."""
    return pages.select("feed", "page", F.posexplode("items").alias("position", "raw_json"))


def walks(pages: DataFrame) -> DataFrame:
    """feed, pages, items, stopped, complete of each walk; only a complete one says that what it hasn't seen is gone."""
    out = pages.groupBy("feed").agg(F.count("*").alias("pages"), F.sum(F.size("items")).cast("long").alias("items"), F.max("stopped").alias("stopped"))
    return out.withColumn("complete", F.coalesce(F.col("stopped") == "end", F.lit(False)))


def named_collections(pages: DataFrame, old: DataFrame, stamp: str) -> DataFrame:
    """collection_id, name, item_count, synced_at: old with what the pages of a collection list say, the last mention of an id counting.

    Collections whose id isn't a number are made by the service, not by a user, and are left out. One without a name is called by its id.
    """
    item = F.from_json("raw_json", "collection_id string, collection_name string, collection_media_count long")
    rows = page_items(pages).withColumn("c", item).where(F.col("c.collection_id").rlike("^[0-9]+$"))
    name = F.trim(F.coalesce(F.nullif("c.collection_name", F.lit("")), F.col("c.collection_id")))
    rows = rows.select("c.collection_id", name.alias("name"), F.col("c.collection_media_count").alias("item_count"), F.lit(stamp).alias("synced_at"), F.struct("page", "feed", "position").alias("at"))
    last = rows.groupBy("collection_id").agg(F.max_by(F.struct("name", "item_count", "synced_at"), "at").alias("c")).select("collection_id", "c.*")
    return old.join(last.select("collection_id"), "collection_id", "left_anti").unionByName(last)
