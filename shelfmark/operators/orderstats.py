"""Exact order statistics by refinement: no sort, no range shuffle, nothing written but the narrowed bounds.

The values of a column are counted in a few thousand bins between their least and greatest one; the bin that holds the wanted index is the next
turn's range, from the least to the greatest value seen in it, and so on until these are the same. Each turn is one pass that combines
before the shuffle. All columns, indexes and groups are narrowed in the same passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shelfmark.scratch import cut

BINS = 2048
#: Bounds of so many (group, column, index) at most go out with the pass; more are a table that is joined.
LOCAL = 20_000


def _settle(bounds: DataFrame) -> tuple[DataFrame, bool, bool]:
    """bounds, worked out once; whether they are few enough to be sent to every task; whether any is still open."""
    rows = bounds.limit(LOCAL + 1).collect()
    if len(rows) <= LOCAL:
        # NaN is equal to itself here, as in Spark.
        wide = any(r["lo"] != r["hi"] and not (r["lo"] != r["lo"] and r["hi"] != r["hi"]) for r in rows)
        return bounds.sparkSession.createDataFrame(rows, bounds.schema), True, wide
    kept = cut(bounds, "bounds")
    return kept, False, kept.where("lo <> hi").limit(1).count() > 0


def _bin(v: Column, lo: Column, hi: Column, whole: bool, bins: int) -> Column:
    """Which part of [lo, hi] v is in; it never falls as v grows, and lo and hi are always apart."""
    d = lambda x: x.cast("double")
    inside = (d(v) - d(lo)) / F.nullif(d(hi) - d(lo), F.lit(0.0))
    if whole:  # of one sign, the difference is exact however large they are
        inside = F.when((lo >= 0) | (hi < 0), d(F.try_subtract(v, lo)) / d(F.try_subtract(hi, lo))).otherwise(inside)
    middle = F.floor(F.when(inside.isNull() | F.isnan(inside), 1.0 / bins).otherwise(F.least(inside, F.lit(1.0))) * bins)
    return F.when(v == lo, 0).when(v == hi, bins).otherwise(F.greatest(F.least(middle, F.lit(bins - 1)), F.lit(0))).cast("int")


def order_statistics(df: DataFrame, fields: Sequence[str], at: dict[str, Column], by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """by, field, n and, for each name in at, the value at a zero-based index (a Column of n, the number of values) of the sorted field.

    One row for each group and field (without by: each field, also if it has no values: n is 0 then, the values null). Nulls aren't values; NaN
    is the greatest. Values are longs if all fields are whole numbers, else doubles.
    """
    whole = all(isinstance(df.schema[f].dataType, IntegralType) for f in fields)
    kind = "long" if whole else "double"
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast(kind).alias("v")) for f in fields]
    rows = df.select(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(by)], F.explode(F.array(*pairs)).alias("p")) if len(fields) > 1 else df.select(*[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(by)], pairs[0].alias("p"))
    groups = [f"g{i}" for i in range(len(by))]
    rows = rows.select(*groups, "p.field", "p.v").where(F.col("v").isNotNull())
    keys = [*groups, "field"]
    wanted = F.explode_outer(F.filter(F.array(*[F.struct(F.lit(name).alias("name"), index.cast("long").alias("index")) for name, index in at.items()]), lambda w: (w["index"] >= 0) & (w["index"] < F.col("n"))))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    every, few, wide = _settle(ends.select("*", wanted.alias("w")).select(*keys, "n", "w.name", "w.index", "lo", "hi", F.lit(0).cast("long").alias("below")))
    state = every.where("name is not null")
    done = state.where("lo = hi")
    while wide:
        bounds = state.where("lo <> hi").select(*[F.col(k).alias(f"{k}_") for k in keys], "name", "index", "lo", "hi", "below", "n")
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
        # Only values inside a range that is still open leave the scan's task.
        inside = rows.join(F.broadcast(bounds) if few else bounds, [*same, F.col("v").between(F.col("lo"), F.col("hi"))])
        parts = inside.groupBy(*keys, "name", "index", "below", "n", _bin(F.col("v"), F.col("lo"), F.col("hi"), whole, bins).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys, "name").orderBy("bin"))
        new = parts.withColumn("upto", upto).where((F.col("upto") > F.col("index")) & (F.col("upto") - F.col("c") <= F.col("index")))
        state, few, wide = _settle(new.select(*keys, "n", "name", "index", "lo", "hi", (F.col("upto") - F.col("c")).alias("below")))
        done = done.unionByName(state.where("lo = hi"))
    values = [F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in at]
    found = done.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(*values)
    every = every.select(*keys, "n").distinct()
    if not by:
        every = df.sparkSession.createDataFrame([(f,) for f in fields], "field string").join(every, "field", "left").select("field", F.coalesce("n", F.lit(0)).alias("n"))
    out = every.join(found, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], "left")
    return out.select(*[F.col(g).alias(name) for g, name in zip(groups, by, strict=True)], "field", "n", *at)
