"""Work queues: what is still to do, from the state of stages, the versions present and the hashes of inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ordered import ROW, reached, running


def retry_queue(items: DataFrame, state: DataFrame, stage: str, most: int = 3, limit: int | None = None) -> DataFrame:
    """Saved items without a state in stage, or failed fewer than most times, newest first."""
    mine = state.where(F.col("stage") == stage).select("shortcode", "status", "attempts")
    out = items.where(F.col("unsaved_at").isNull()).join(mine, "shortcode", "left")
    out = out.where(F.col("status").isNull() | ((F.col("status") == "failed") & (F.col("attempts") < most)))
    out = out.orderBy(F.col("taken_at").desc_nulls_last(), "shortcode").select(*items.columns)
    return out if limit is None else out.limit(limit)


def version_queue(items: DataFrame, made: DataFrame, version: str, state: DataFrame | None = None, blocked: Sequence[str] = ("unavailable",), key: str = "shortcode") -> DataFrame:
    """Items without a row of this tool version, unless their state blocks them."""
    out = items.join(made.where(F.col("tool_version") == version).select(key), key, "left_anti")
    if state is not None:
        out = out.join(state.where(F.col("status").isin(*blocked)).select(key), key, "left_anti")
    return out


def stale_queue(items: DataFrame, inputs: Sequence[DataFrame], done: DataFrame, current: dict[str, str], only: Sequence[str] | None = None, force: bool = False, limit: int | None = None, key: str = "shortcode", order: str = "ingest_seq") -> DataFrame:
    """Items with all inputs whose result is missing or was made with other fingerprints than current (column: value)."""
    if only is not None:
        items = items.where(F.col(key).isin(*set(only))) if only else items.where(F.lit(False))
    for side in inputs:
        items = items.join(side.select(key).distinct(), key, "left_semi")
    if not force:
        fresh = F.lit(True)
        for column, value in current.items():
            fresh = fresh & F.col(column).eqNullSafe(F.lit(value))
        items = items.join(done.where(fresh).select(key), key, "left_anti")
    items = items.orderBy(order)
    return items if limit is None else items.limit(limit)


def until(items: DataFrame, limits: dict[str, int], *order: str) -> DataFrame:
    """Items in order until one of the limits (boolean column: how many) is reached, the item that reaches it included.

    order: columns that together are unique. The end is found first (see `reached`); the items are then a filter, which reaches the scan.
    """
    if any(most <= 0 for most in limits.values()):
        return items.limit(0)
    end = reached(items, order, limits) if limits else None
    return items if end is None else items.where(end)


def quota(items: DataFrame, success: str, most: int, *order: str) -> DataFrame:
    """Items in order until most successes are reached, the last success included."""
    return until(items, {success: most}, *order)


def download_queue(items: DataFrame, state: DataFrame, lost: DataFrame | None = None, only: Sequence[str] | None = None, most: int = 3) -> DataFrame:
    """Saved reels and videos that have no download state, failed fewer than most times, or are done but their file is lost (shortcode of lost).

    Skipped ones never come back. only: the shortcodes asked for; nothing asked for is everything.
    """
    mine = state.where(F.col("stage") == "download").select("shortcode", "status", "attempts")
    out = items.where(F.col("unsaved_at").isNull() & F.col("kind").isin("reel", "video")).join(mine, "shortcode", "left")
    if only:
        out = out.where(F.col("shortcode").isin(*set(only)))
    gone = F.lit(False)
    if lost is not None:
        out = out.join(lost.select("shortcode", F.lit(True).alias("__lost")).distinct(), "shortcode", "left")
        gone = F.coalesce("__lost", F.lit(False))
    due = F.col("status").isNull() | ((F.col("status") == "failed") & (F.col("attempts") < most)) | ((F.col("status") == "done") & gone)
    return out.where(due).select(*items.columns)


def drawn(queue: DataFrame, seed: int, key: str = "shortcode") -> DataFrame:
    """queue with draw, a random order that a seed fixes; the same on any cluster and for any partitioning."""
    return queue.withColumn("draw", F.xxhash64(F.lit(seed), F.col(key)))


def attempted(queue: DataFrame, outcomes: DataFrame, sample: int | None = None, abort_after: int = 5, order: Sequence[str] = ("ingest_seq",), key: str = "shortcode") -> DataFrame:
    """What a run over queue gets to, given the outcome (200, 404, 401, 0) of each item: it ends at sample successes or abort_after blocks."""
    df = queue.join(outcomes.select(key, "outcome"), key).withColumns({"__ok": F.col("outcome") == 200, "__blocked": F.col("outcome") == 401})
    limits = ({"__ok": sample} if sample else {}) | {"__blocked": abort_after}
    return until(df, limits, *order).drop("__ok", "__blocked")


def next_page(page: DataFrame, known: DataFrame, key: str = "shortcode") -> bool:
    """Whether a feed walk should go on: the page has a key that isn't known yet."""
    return page.join(known.select(key), key, "left_anti").limit(1).count() > 0


def walked(pages: DataFrame, known: DataFrame, full: bool = False, limit: int | None = None, key: str = "shortcode") -> tuple[DataFrame, bool]:
    """(rows of pages (page, key, last boolean) that a feed walk reads, whether it saw the feed to its end).

    After each page the walk ends at limit rows; else, unless full, where all the page's keys are known (a first run and a page
    without keys never end so); else at the page marked last. Only that last reason means that the walk is complete.
    """
    old = known.select(key).distinct()
    rows = pages.join(old.withColumn("__known", F.lit(True)), key, "left").withColumn("__has", F.coalesce(F.col(key), F.lit("")) != "")
    per = rows.groupBy("page").agg(F.count_if("__has").alias("n"), F.count_if(F.col("__has") & F.col("__known").isNull()).alias("fresh"), F.bool_or(F.coalesce("last", F.lit(False))).alias("end"))
    upto = running(per, ["page"], {"seen": F.col("n")}).select(f"{ROW}.*", "seen")
    full_up = F.lit(False) if limit is None else F.col("seen") >= limit
    stale = F.lit(False) if full or not old.limit(1).count() else (F.col("n") > 0) & (F.col("fresh") == 0)
    stop = upto.where(full_up | stale | F.col("end")).orderBy("page").select("page", (F.col("end") & ~full_up & ~stale).alias("complete")).first()
    return (pages, False) if stop is None else (pages.where(F.col("page") <= stop.page), bool(stop.complete))
