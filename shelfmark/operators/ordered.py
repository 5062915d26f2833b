"""Running totals and numbers over a whole table in order, and where a total is reached, without ever sorting it in one task.

Where only the beginning is wanted (`reached`), nothing is dealt out: totals of the ranges between a few sampled keys tell in which range
the total is reached, that range is divided again, and so on. Each turn reads the keys of the range left and nothing is written.

Else the table is dealt out by ranges of the order once and written, so that the totals of the ranges and the rows inside them
belong together for certain: a second evaluation could draw other ranges. Totals of the ranges, one row each, are
summed up; rows are ordered inside their range only.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import cut

ROW = "row"


def running(df: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """row (df's columns in one struct) and, for each total (name: Column of numbers), the sum over all rows up to this one in the order of by.

    by: columns that together are unique (rows equal in them follow each other in any order).
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)]
    rows = df.select(own, *keys, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in totals.items()])
    names = [f"k{i}" for i in range(len(by))]
    placed = cut(rows.repartitionByRange(*[F.col(k) for k in names]).withColumn("range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("range").agg(*[F.sum(n).alias(n) for n in totals])
    # One row a range: spark_partition_id numbers the ranges in order.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in totals])
    inside = Window.partitionBy("range").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(sums), "range")
    return out.select(ROW, *[F.col(n).alias(f"{n}_own") for n in totals], *[(F.col(f"{n}_before") + F.sum(n).over(inside)).alias(n) for n in totals])


SPLITS, LEAF = 63, 4096


def _literal(value, kind) -> Column:
    """A collected key field as a literal of its type."""
    if isinstance(value, datetime.datetime):
        value = value.isoformat(sep=" ")  # by its text, which reads the same in the session's zone
    return F.lit(value).cast(kind)


def _sampled(rows: DataFrame, n: int) -> list:
    """n keys of rows at most, picked by hash, distinct and in order."""
    picked = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(n)
    return [r.key for r in picked.distinct().orderBy("key").collect()]


def reached(df: DataFrame, by: Sequence[str], limits: dict[str, int]) -> Column | None:
    """Whether a row comes no later, in the order of by (unique), than the first at which the sum of one of limits' boolean columns is met.

    limits: column -> how many, from 1. None if no sum gets there. Each turn reads by and the columns of limits of what is still open, twice.
    """
    kinds = [df.schema[c].dataType for c in by]
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)])
    literal = lambda row: F.struct(*[_literal(v, kind).alias(f"k{i}") for i, (v, kind) in enumerate(zip(row, kinds, strict=True))])
    flags = [f"n{i}" for i in range(len(limits))]
    rows = df.select(key.alias("key"), *[F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0)).alias(f) for c, f in zip(limits, flags, strict=True)])
    most, before, part = list(limits.values()), [0] * len(limits), rows
    while True:
        cuts = _sampled(part, SPLITS)

        def place(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(F.col("key") <= literal(cuts[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))  # noqa: B023

        sums = part.groupBy(place(0, len(cuts)).alias("at")).agg(F.count("*").alias("rows"), *[F.sum(f).alias(f) for f in flags])
        for r in sorted(sums.collect()):
            upto = [b + r[f] for b, f in zip(before, flags, strict=True)]
            if any(u >= m for u, m in zip(upto, most, strict=True)):
                break
            before = upto
        else:
            return None
        first, last = r["at"] > 0, r["at"] < len(cuts)
        if first:
            part = part.where(F.col("key") > literal(cuts[r["at"] - 1]))
        if last:
            part = part.where(F.col("key") <= literal(cuts[r["at"]]))
        if r["rows"] <= LEAF or (len(cuts) <= 1 and not first):
            break
    # The rows left are few (or of one key), so they are ordered as they are.
    inside = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    done = F.lit(False)
    for b, f, m in zip(before, flags, most, strict=True):
        done = done | (F.sum(f).over(inside) + b >= m)
    end = part.withColumn("done", done).where("done").orderBy("key").first()
    return key <= literal(end.key)


def numbered(df: DataFrame, by: Sequence[str], name: str, first: int = 1) -> DataFrame:
    """df with its rows numbered from first in the order of by, in a column called name."""
    out = running(df, by, {"nth": F.lit(1)})
    return out.select(f"{ROW}.*", (F.col("nth") + (first - 1)).alias(name))
