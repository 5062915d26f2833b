"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every order of all rows is as likely as any other, and shards differ by a row at most:

1. Rows are numbered within the partitions they come in and written once, so that nothing below can see them otherwise on a retry.
2. How many rows partition i sends to shard s is drawn without looking at a row: the row of the matrix is multivariate hypergeometric
   given what the shards have left. First groups of 4096 partitions draw theirs on the driver (a row a group), then each group deals what it drew
   to its partitions in a task of its own. Row sums are the partitions' sizes, column sums the shards', exactly.
3. A partition permutes its rows and deals the first so many to shard 0, the next to shard 1, and so on.
4. In its shard a row takes a place by a second random number: places are counted by ranges of that number, the ranges (about
   ``spread`` rows each) are ordered one by one, and their sizes are summed up, so no shard is sorted in one task.

No step looks at a row's content, so a hot source or thousands of equal texts change nothing; equal texts aren't kept together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text, ready, unused

SHARDS, SPREAD, GROUP = 16, 100_000, 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws rows, taken from good + bad without order or return, are good; for numbers of any size.

    The probabilities around the mode follow from their ratios; 14 standard deviations to either side hold all but under 1e-20 of them.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    wide = 14 * np.sqrt(draws * (good / total) * (bad / total) * max(total - draws, 1) / max(total - 1, 1)) + 40
    a, b = max(low, mode - int(wide)), min(high, mode + int(wide))
    k = np.arange(a, b, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1)))])
    p = np.cumsum(np.exp(log - log.max()))
    return min(a + int(np.searchsorted(p, rng.random() * p[-1], side="right")), b)


def communication_matrix(sizes: list[int], room: list[int], rng: np.random.Generator) -> list[list[int]]:
    """A row for each size: how many of its rows go to each shard, room being what the shards take in all (the sum of sizes)."""
    room, out = list(room), []
    for size in sizes:
        row, left, rest = [], size, sum(room)
        for has in room:
            got = hypergeometric(rng, has, rest - has, left)
            row.append(got)
            left, rest = left - got, rest - has
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def _rng(seed: str, *of: int) -> np.random.Generator:
    return np.random.default_rng([zlib.crc32(seed.encode()), *of])


def _matrix(counts: DataFrame, shards: int, seed: str, group: int) -> DataFrame:
    """part, ends: up to which place in its permutation a partition's rows go to each shard. counts: part, n."""
    spark = counts.sparkSession
    grouped = counts.select("part", "n", F.floor(F.col("part") / group).cast("long").alias("g"))
    sums = sorted(map(tuple, grouped.groupBy("g").agg(F.sum("n")).collect()))
    total = sum(n for _, n in sums)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    drawn = communication_matrix([n for _, n in sums], room, _rng(seed, 0))
    rooms = spark.createDataFrame([(g, row) for (g, _), row in zip(sums, drawn, strict=True)], "g long, room array<long>")

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("part")
        rows = communication_matrix(part["n"].tolist(), [int(x) for x in part["room"].iloc[0]], _rng(seed, 1, int(part["g"].iloc[0])))
        return pd.DataFrame({"part": part["part"].to_numpy(), "ends": [np.cumsum(r).tolist() for r in rows]})

    ready(spark)
    return grouped.join(F.broadcast(rooms), "g").groupBy("g").applyInPandas(deal, "part long, ends array<long>")


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: str = "shuffle", spread: int = SPREAD, group: int = GROUP, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """rows, all columns, with the row's shard (int, from 0) and its slot there (long, gapless from 0).

    The first (rows % shards) shards hold a row more than the others. Same seed and same partitions of the input give the same
    shuffle. Nulls, empty texts and repeated rows are rows like any other; an empty table gives no rows. Columns of rows that have the new columns' names make an error.
    """
    if taken := {c.lower() for c in rows.columns} & {shard.lower(), slot.lower()}:
        raise ValueError(f"columns of these names are there: {sorted(taken)}")
    row = unused(rows, "row")
    at = F.monotonically_increasing_id()
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(row)
    placed = cut(rows.select(own).select(row, at.alias("at")).select(row, F.shiftright("at", 33).alias("part"), "at"), "numbered")
    counts = cut(placed.groupBy("part").agg(F.count("*").alias("n")), "parts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ends = cut(_matrix(counts, shards, seed, group), "matrix")
    random = lambda n: F.xxhash64(F.lit(f"{seed}:{n}"), "part", "at")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(random(1), "at"))
    dealt = placed.join(ends, "part").withColumn("nth", nth)
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("nth"))).cast("int"))
    ranges = max(1, -(-total // (shards * spread)))
    dealt = dealt.select(row, "part", "at", "shard", random(2).alias("turn")).withColumn("range", F.pmod(F.col("turn"), F.lit(ranges)))
    dealt = cut(dealt, "dealt")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "range").orderBy("turn", "part", "at"))
    out = dealt.join(sums, ["shard", "range"]).withColumn("slot", (F.col("before") + inside - 1).cast("long"))
    return out.select(F.col(f"{row}.*"), F.col("shard").alias(shard), F.col("slot").alias(slot))


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("long") + 1


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = "shuffle", spread: int = SPREAD, group: int = GROUP) -> DataFrame:
    """doc_id, size (bytes of the text and 1), text_crc32, law ('rows': counts at most one apart), shard, slot, grown_shard (null: this law has none).

    Null texts have no bytes. Texts stay where they are: only these columns are dealt out.
    """
    rows = id_text(docs).select("doc_id", utf8_size(F.col("text")).alias("size"), F.crc32("text").cast("long").alias("text_crc32"))
    out = shuffle_into_shards(rows, shards, seed, spread, group)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = "shuffle", max_rows: int = 1_000_000) -> None:
    """docs in shuffled order as Parquet: a folder shard=s for each shard, files of at most max_rows rows, in order of slot within and (by name) across files."""
    out = shuffle_into_shards(docs, shards, seed)
    piece = F.floor(F.col("slot") / max_rows)
    out.withColumn("piece", piece).repartitionByRange("shard", "piece").sortWithinPartitions("shard", "piece", "slot").write.partitionBy("shard", "piece").option("maxRecordsPerFile", max_rows).parquet(path)
