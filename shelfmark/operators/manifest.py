"""Run manifests: which scan saw which item, how runs ended, and what model calls cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.state import first_per_key, insert_missing, latest_per_key


def observe(seen: DataFrame, run_id: str, page: DataFrame, stamp: Column) -> DataFrame:
    """seen (run_id, shortcode, position, seen_at) with a page's items (shortcode, position) of a run; an item counts once a run."""
    new = first_per_key(page.where(F.coalesce("shortcode", F.lit("")) != ""), ["shortcode"], "position")
    rows = new.select(F.lit(run_id).alias("run_id"), "shortcode", "position", stamp.alias("seen_at"))
    return insert_missing(seen, rows, ["run_id", "shortcode"], "position")


def finished(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """runs (run_id, status, at, ...) by their latest row, with the number of different items seen."""
    counts = seen.groupBy("run_id").agg(F.count_distinct("shortcode").alias("items"))
    return latest_per_key(runs, ["run_id"], "at", "status").join(counts, "run_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def usage(attempts: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens and milliseconds of model calls, in all or by columns."""
    sums = [F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "duration_ms")]]
    return attempts.groupBy(*by).agg(*sums) if by else attempts.agg(*sums)


def stage_counts(log: DataFrame) -> DataFrame:
    """stage, status, n."""
    return log.groupBy("stage", "status").agg(F.count("*").alias("n"))
