"""Which of many names stand literally in which of many texts.

The names are a stated query set: they go to the executors in blocks of bounded size, one pass over the texts for each block. An
executor makes one automaton of a block's names (Aho and Corasick's) and reads each text once, so names of any
length are found at any place, inside words and across line breaks too. Texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.scratch import cut


def _automaton(words: dict[str, list]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, word)
    found.make_automaton()
    return found


def attested_pairs(texts: DataFrame, key: str, text: str, items: DataFrame, item: str, name: str, block_items: int = 50_000, block_bytes: int = 16 << 20) -> DataFrame:
    """key, item: every pair whose lower-cased trimmed name stands in the lower-cased text, once; blank names stand nowhere."""
    spark = texts.sparkSession
    rows = items.select(F.col(item), F.lower(F.trim(name)).alias("needle")).where("needle <> ''")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block_items), math.ceil(size / block_bytes))
    hay = texts.select(F.col(key), F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("hay"))
    kinds = [texts.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()]
    out = None
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block) if blocks > 1 else rows
        words: dict[str, list] = {}
        for r in own.toLocalIterator():
            words.setdefault(r["needle"], []).append(r[item])
        sent = spark.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words = sent.value
            find = _automaton(words) if words else None
            for batch in batches:
                keys, met = [], []
                for row, hay in enumerate(batch.column(1)):
                    for word in {w for _, w in find.iter(hay.as_py())} if find else ():
                        keys += [row] * len(words[word])
                        met += words[word]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(met, _arrow(kinds[1]))], names=["key", "item"])

        part = hay.mapInArrow(run, f"key {kinds[0]}, item {kinds[1]}")
        if blocks > 1:
            part = cut(part, "attested")
            sent.unpersist()
        out = part if out is None else out.union(part)
    return out.select(F.col("key").alias(key), F.col("item").alias(item))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
