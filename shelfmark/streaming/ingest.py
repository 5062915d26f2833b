"""Landed feed pages as a stream: each micro-batch is one upsert of the state, which touches only the buckets that its keys are in.

    v000000007/bucket=B/   the rows of the buckets that batch 7 touched, as they are after it
    current/7              which version each bucket is at, after batch 7: what makes the batch count

Keys are dealt over a fixed number of buckets by hash. A batch reads and writes its own keys' buckets; the folders of the others stay as they are, and
the new list of versions goes on naming them. The list is written last, so a batch that fails before it has changed nothing, and one that is
replayed finds its list and does nothing, or gives the same rows again. The batch path over whole tables is state.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfmark.operators.state import upsert_seen
from shelfmark.operators.versions import numbers, put, read_text

BUCKETS = 256


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _folder(base: str, n: int) -> str:
    return f"{base}/v{n:09d}"


def bucket_versions(spark: SparkSession, base: str, number: int | None = None) -> dict[int, int]:
    """bucket -> version after batch number (default: the last); empty before the first."""
    n = max(numbers(spark, f"{base}/current"), default=0) if number is None else number
    text = read_text(spark, f"{base}/current/{n}") if n else ""
    return dict(tuple(map(int, x.split(":"))) for x in text.split(",") if x)


def state_table(spark: SparkSession, base: str, schema: StructType, only: list[int] | None = None, number: int | None = None) -> DataFrame:
    """The state after the last batch (or batch number); only: of these buckets."""
    at = bucket_versions(spark, base, number)
    paths = [f"{_folder(base, v)}/bucket={b}" for b, v in sorted(at.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def apply_batch(spark: SparkSession, batch: DataFrame, number: int, base: str, schema: StructType, key: str = "shortcode") -> dict[str, int]:
    """Write version number + 1: the buckets of batch's keys with batch applied. Done already, it does nothing.

    Returns inserted, updated and kept (rows of the touched buckets that the batch leaves alone), counted by the write itself; nothing where nothing was written.
    """
    n = number + 1
    if n in numbers(spark, f"{base}/current") and read_text(spark, f"{base}/current/{n}"):
        return {}
    counts: dict[str, int] = {}
    before = bucket_versions(spark, base, number) if number else {}
    named = batch.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    touched = sorted(r[0] for r in named.select(bucket_of(F.col(key))).distinct().collect())  # BUCKETS rows at most
    if touched:
        old = state_table(spark, base, schema, touched, number) if number else spark.createDataFrame([], schema)
        watch = Observation()
        rows = upsert_seen(old, named, key, watch=watch).withColumn("bucket", bucket_of(F.col(key)))
        rows.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(_folder(base, n))
        counts = watch.get
    after = before | dict.fromkeys(touched, n)
    put(spark, f"{base}/current/{n}", ",".join(f"{b}:{v}" for b, v in sorted(after.items())) or ",")
    return counts


def ingest(spark: SparkSession, landing: str, landed: StructType, base: str, schema: StructType, checkpoint: str) -> StreamingQuery:
    """Follow a folder of landed JSON pages; stops by itself once all that is there is applied."""
    pages = spark.readStream.schema(landed).json(landing)
    rows = pages.withColumn("seq", F.monotonically_increasing_id()) if "seq" not in landed.fieldNames() else pages
    return rows.writeStream.foreachBatch(lambda df, n: apply_batch(spark, df, n, base, schema)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
