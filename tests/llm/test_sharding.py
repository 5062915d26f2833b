import itertools
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest

from shelfmark.llm import sharding
from shelfmark.llm.sharding import communication_matrix, hypergeometric, shard_documents, shuffle_into_shards, write_shards


def test_hypergeometric_frequencies():
    rng = np.random.default_rng(4)
    for good, bad, draws in ((5, 7, 4), (3, 20, 10), (40, 2, 30)):
        seen = Counter(hypergeometric(rng, good, bad, draws) for _ in range(20_000))
        want = {k: comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
        assert set(seen) <= set(want)
        chi = sum((seen[k] - 20_000 * p) ** 2 / (20_000 * p) for k, p in want.items() if 20_000 * p > 5)
        assert chi < 3 * len(want) + 12
    assert [hypergeometric(rng, 0, 9, 4), hypergeometric(rng, 9, 0, 4), hypergeometric(rng, 5, 5, 10)] == [0, 4, 5]
    big = [hypergeometric(rng, 10**11, 15 * 10**11, 10**6) for _ in range(400)]
    assert abs(np.mean(big) - 62_500) < 60 and 200 < np.std(big) < 290  # sd 242


def test_matrix_sums_are_exact():
    rng = np.random.default_rng(1)
    sizes = [0, 17, 1, 400, 93, 0, 2]
    room = [33, 32, 32] + [32] * 13
    m = np.array(communication_matrix(sizes, room, rng))
    assert m.sum(1).tolist() == sizes and m.sum(0).tolist() == room and (m >= 0).all()


def test_every_order_is_as_likely(spark):
    """Four rows in two partitions, two shards: all 24 orders, by the driver's draws of many seeds."""
    df = spark.createDataFrame([(i,) for i in range(4)], "i long").repartitionByRange(2, "i").cache()
    parts = df.select("i", sharding.F.spark_partition_id().alias("p")).toPandas()
    assert parts.p.nunique() == 2
    seen = Counter()
    for seed in range(60):
        out = shuffle_into_shards(df, 2, seed=f"s{seed}").collect()
        seen[tuple(r.i for r in sorted(out, key=lambda r: (r.shard, r.slot)))] += 1
    assert set(seen) <= set(itertools.permutations(range(4))) and len(seen) >= 18
    first = Counter(k[0] for k in seen.elements())
    assert max(first.values()) < 28


@pytest.mark.parametrize(("shards", "spread", "group"), [(16, 100_000, 4096), (3, 20, 2), (40, 1, 1)])
def test_shards_are_exact_and_slots_gapless(spark, shards, spread, group):
    df = spark.range(0, 1003, 1, 7).selectExpr("id doc_id", "concat('text ', id % 5) text")
    out = shard_documents(df, shards, spread=spread, group=group).toPandas()
    assert sorted(out.doc_id) == list(range(1003))
    sizes = out.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(sizes) == shards and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all() and (sizes["nunique"] == sizes["count"]).all()
    again = shard_documents(df, shards, spread=spread, group=group).toPandas()
    key = lambda d: sorted(map(tuple, d[["doc_id", "shard", "slot"]].to_numpy().tolist()))
    assert key(out) == key(again)
    other = shard_documents(df, shards, seed="another", spread=spread, group=group).toPandas()
    assert key(out) != key(other)
    # Rows that stood together are far apart: neighbours share a shard about once in so many shards.
    at = dict(zip(out.doc_id, out.shard))
    together = np.mean([at[i] == at[i + 1] for i in range(1002)])
    assert abs(together - 1 / shards) < 0.06


def test_columns_and_odd_rows(spark, messy, texts, nothing):
    out = shard_documents(messy).toPandas()
    assert sorted(map(str, out.doc_id.astype("Int64"))) == sorted("<NA>" if i is None else str(i) for i, _, _ in texts)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in texts)
    assert sorted(zip(out["size"], out.text_crc32)) == want
    assert set(out.law) == {"rows"} and out.grown_shard.isna().all()
    assert shard_documents(nothing).count() == 0
    whole = shuffle_into_shards(messy, 3, shard="of", slot="nth")
    assert whole.columns == [*messy.columns, "of", "nth"] and whole.count() == len(texts)
    with pytest.raises(ValueError):
        shuffle_into_shards(messy, 3, shard="Text")


def test_written_shards_are_in_order(spark, tmp_path):
    df = spark.range(0, 500, 1, 4).selectExpr("id doc_id", "repeat('w ', int(id % 9)) text")
    write_shards(df, str(tmp_path / "out"), 4, max_rows=50)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and sorted(r.doc_id for r in back.collect()) == list(range(500))
    files = sorted((tmp_path / "out" / "shard=2" / "piece=1").glob("*.parquet"))
    slots = [s for f in files for s in spark.read.parquet(str(f)).toPandas().slot]
    assert slots == list(range(50, 100))
