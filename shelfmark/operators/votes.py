"""Group decisions: majorities and what they reject, elected names, ordered unions, ratios and rank statistics.

Votes are two-level aggregates (count of each value, then the best): both levels combine before the shuffle, so a hot
group costs its number of different values, not its number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import name_key
from shelfmark.operators.ordered import ROW, running


def majority(df: DataFrame, keys: Sequence[str], field: str, order: str) -> DataFrame:
    """keys, field (the most frequent trimmed, non-empty value; ties: the shortest, then the one first met), rejected (the others, sorted)."""
    value = F.trim(F.col(field).cast("string"))
    counts = df.select(*keys, value.alias("__v"), F.col(order).alias("__o")).where("__v <> ''").groupBy(*keys, "__v").agg(F.count("*").alias("__n"), F.min("__o").alias("__o"))
    out = counts.groupBy(*keys).agg(F.min_by("__v", F.struct(-F.col("__n"), F.length("__v"), "__o", "__v")).alias(field), F.sort_array(F.collect_set("__v")).alias("__all"))
    return out.select(*keys, field, F.array_except("__all", F.array(field)).alias("rejected"))


def elected_name(df: DataFrame, keys: Sequence[str], names: Sequence[str], order: str) -> DataFrame:
    """keys, canonical_name: the first non-blank of the name columns, voted on: no handle before frequency before brevity."""
    name = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in names])
    counts = df.select(*keys, name.alias("__v"), F.col(order).alias("__o")).where("__v is not null").groupBy(*keys, "__v").agg(F.count("*").alias("__n"), F.min("__o").alias("__o"))
    return counts.groupBy(*keys).agg(F.min_by("__v", F.struct(F.col("__v").startswith("@"), -F.col("__n"), F.length("__v"), "__o", "__v")).alias("canonical_name"))


def ordered_union(df: DataFrame, keys: Sequence[str], field: str, order: str) -> DataFrame:
    """keys, field: the different non-blank members of an array column, in the order first met."""
    flat = df.select(*keys, F.col(order).alias("__o"), F.posexplode(field).alias("__p", "__v")).where("trim(__v) <> ''")
    first = flat.groupBy(*keys, "__v").agg(F.min(F.struct("__o", "__p")).alias("__at"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__v"))), lambda x: x["__v"]).alias(field))


def first_spellings(df: DataFrame, keys: Sequence[str], field: str, order: str, separator: str = " | ") -> DataFrame:
    """keys, field: members of an array column with different name keys, each in its first spelling, joined."""
    flat = df.select(*keys, F.col(order).alias("__o"), F.posexplode(field).alias("__p", "__v")).withColumn("__k", name_key("__v")).where("__k <> ''")
    first = flat.groupBy(*keys, "__k").agg(F.min(F.struct("__o", "__p", "__v")).alias("__at"))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("__at")), lambda x: x["__v"]), separator).alias(field))


def joined_set(field: str, separator: str = " | ") -> Column:
    return F.array_join(F.sort_array(F.collect_set(F.when(F.trim(field) != "", F.col(field)))), separator)


def conflicts(**rejected: Column) -> Column:
    """A map of the fields that have rejected values, null if none has."""
    pairs = [x for k, v in rejected.items() for x in (F.lit(k), F.coalesce(v, F.array().cast("array<string>")))]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)
    return F.when(F.size(kept) > 0, kept)


def promoted(df: DataFrame, key: str, kind: str, ranks: dict[str, int]) -> DataFrame:
    """key, kind: the kind of the highest rank met."""
    rank = F.coalesce(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)], F.lit(0))
    return df.groupBy(key).agg(F.max_by(kind, F.struct(rank, kind)).alias(kind))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 1 where there is nothing to count."""
    return F.when(den == 0, F.lit(1.0)).otherwise(num / den)


def labelled_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """label, n: the number of rows of each part, in one plan."""
    out = None
    for label, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out


def group_counts(df: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """keys, n, most frequent first."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *keys)
    return out if limit is None else out.limit(limit)

