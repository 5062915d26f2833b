"""Helpers shared by the training-data operators: keys, scratch tables, bounded broadcasts, Arrow batches.

Conventions of every operator in this package:

* It reads only the columns it names, so further columns, whatever they are called, change nothing.
* A null text counts as the empty text; a null doc_id is kept and stays null.
* Rows are never identified by doc_id alone: the pair (doc_id, hash of the text) is the key, so repeated
  doc_ids are separate documents and fully identical rows share one (equal) result.
* Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every executor can read, and never to
  an executor's own disk, so a lost executor costs a retry and not the job.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.scratch import cut, drop, drop_scratch, release, scratch, shared_dir

__all__ = ["cut", "drop", "drop_scratch", "release", "scratch", "shared_dir"]

ROOT = str(Path(__file__).resolve().parents[2])
WS_JAVA = r"[\x20\x09-\x0D]"
NON_WS_JAVA = r"[^\x20\x09-\x0D]"


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed on them."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if a count shows at most max_rows; beyond that the caller's join shuffles instead."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def apart_keys(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """keys and aggs of df grouped by keys, in an order of partitions of its own.

    Grouped by the keys' complements (keys are longs), so that a join on the keys shuffles both of its sides anew. Spark can then
    split a hot key's rows on the other side, which it can't while this side's aggregate stands in the join's own stage.
    """
    turned = df.groupBy(*[F.bitwise_not(F.col(k)).alias(k) for k in keys]).agg(*aggs)
    return turned.withColumns({k: F.bitwise_not(F.col(k)) for k in keys})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df is called so, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named further columns, and nothing else; null texts become empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more)


def row_key(id_col: str = "doc_id", text: Column | str = "text") -> list[Column]:
    """k1, k2: what identifies a row (see the module's text)."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(text).alias("k2")]


def slices(batch: pa.RecordBatch, column: int = 1, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about max_bytes together (one longer text stands alone), to bound memory."""
    if not batch.num_rows:
        return
    _, off = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the n + 1 offsets into them; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    if not len(arr) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    ready(df.sparkSession)
    return df.mapInArrow(fn, schema)


def filter_rows(docs: DataFrame, keep) -> DataFrame:
    """Rows of docs, all columns, whose text keep() marks; keep gets a batch's texts (nulls as '') and returns booleans. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last, 1 << 20):
                kept = part.filter(pa.array(np.asarray(keep(part.column(last)), bool)))
                yield kept.select(list(range(last)))

    return map_arrow(docs.select("*", text_or_empty().alias(unused(docs, "text"))), run, docs.schema)
