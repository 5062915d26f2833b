"""The index in a folder: answers of a scan, refreshes that only add, what a search reads, versions under two writers."""

import os
import re
import threading

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import search, versions, written_index

QUERIES = ["tea NOT green", "\"green tea\" OR te*", "^green", "source:shop t*", "(tea OR coffee) NOT source:shop", "NEAR(green cup, 1)", "NEAR(\"green tea\" cup, 3)", "tea + with", "absent OR \"!!\"", "café"]
TEXTS = [(1, "Green tea in a cup", "shop"), (2, "tea, green; cup", "home"), (3, None, "shop"), (4, "", None), (5, "Café coffee with tea with green tea", "tea"), (6, "temple green green tea a b c d e cup", "x"), (7, "CUP of Green", "shop")]
SCHEMA = "doc_id long, text string, source string"


def together(parts):
    """q -> ids of a DataFrame of ids for each query, in one job."""
    out = None
    for q, part in parts.items():
        part = part.select(F.lit(q).alias("q"), part.columns[0])
        out = part if out is None else out.union(part)
    got = {q: [] for q in parts}
    for q, i in out.collect():
        got[q].append(i)
    return {q: sorted(ids) for q, ids in got.items()}


def answers(index):
    return together({q: written_index.search(index, q) for q in QUERIES})


def scanned(docs):
    return together({q: docs.where(search.matches(q, {f: search.folded(f) for f in ("text", "source")})).select("doc_id") for q in QUERIES})


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_answers_are_those_of_a_scan_before_and_after_refreshes(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    path = str(tmp_path / "index")
    index = written_index.create_index(docs, path, "doc_id", "text", "source")
    assert answers(index) == scanned(docs)
    assert any(answers(index).values())
    first = files(path)
    changed = spark.createDataFrame([(2, "coffee only", "home"), (3, "green tea at last", "shop"), (6, None, None), (9, "a new cup of tea", "shop")], SCHEMA)
    assert written_index.refresh(index, changed, "doc_id") == 1
    now = docs.join(changed, "doc_id", "left_anti").union(changed)
    assert answers(index) == scanned(now)
    # Nothing that stood is touched, and the new files are in the folders of the changed documents' tokens alone.
    assert first <= files(path)
    buckets = {re.search(r"bucket=(\d+)", f)[1] for f in files(path) - first if "postings" in f}
    tokens = written_index.postings(changed, "doc_id", ("text", "source")).select("bucket").distinct().collect()
    assert buckets == {str(r.bucket) for r in tokens}
    back = spark.createDataFrame([(6, "temple tea", "x")], SCHEMA)
    assert written_index.refresh(index, back, "doc_id") == 2
    now = now.where("doc_id <> 6").union(back)
    assert answers(index) == scanned(now)
    small = written_index.compacted(index, str(tmp_path / "small"))
    assert answers(small) == scanned(now)
    assert {r.id for r in written_index.holding(small).select("id").collect()} == {r.doc_id for r in now.where("coalesce(text, source, '') <> ''").collect()}


def test_a_refresh_that_fails_changes_no_answer(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    index = written_index.create_index(docs, str(tmp_path / "index"), "doc_id", "text", "source")
    before = answers(index)
    changed = spark.createDataFrame([(1, "nothing any more", "x")], SCHEMA)
    written_index._write(written_index.postings(changed, "doc_id", index.fields), index.path, versions.claim(spark, f"{index.path}/claims"))
    assert answers(index) == before
    assert written_index.refresh(index, changed, "doc_id") == 2
    assert answers(index) == scanned(docs.where("doc_id <> 1").union(changed))


def test_an_emptied_index_and_an_empty_one(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    index = written_index.create_index(docs.limit(0), str(tmp_path / "none"), "doc_id", "text", "source")
    assert not any(answers(index).values())
    index = written_index.create_index(docs.where("doc_id = 1"), str(tmp_path / "one"), "doc_id", "text", "source")
    written_index.refresh(index, spark.createDataFrame([(1, None, None)], SCHEMA), "doc_id")
    assert not any(answers(index).values())
    with pytest.raises(search.QuerySyntaxError):
        written_index.search(index, "author:me")


def test_a_search_reads_its_words_folders_and_shuffles_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 97} other{i % 13}", "s") for i in range(2000)], SCHEMA)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(before, ("false", "64"), strict=True):
            spark.conf.set(c, v)
        index = written_index.create_index(docs, str(tmp_path / "index"), "doc_id", "text", "source")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    out = written_index.search(index, 'word5 "other3"')
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan parquet") == 1
    pruned = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert "bucket" in pruned[1] and "EqualTo(token,word5)" in pruned[2]
    assert sorted(r.id for r in out.collect()) == [i for i in range(2000) if i % 97 == 5 and i % 13 == 3]
    # A frequent token's postings are in many files, none of which has all of them.
    held = written_index.holding(index).where("token = 'common'").selectExpr("input_file_name() f").groupBy("f").count().collect()
    assert len(held) > 8 and max(r["count"] for r in held) < 500


def test_two_writers_lose_no_update(spark, tmp_path):
    base = str(tmp_path / "table")
    versions.publish(spark.range(1), base)
    ready = threading.Barrier(2)
    made = []

    def writer(k):
        def make(old):
            rows = old.union(spark.range(k, k + 1))
            made.append(k)
            if len(made) <= 2:
                ready.wait(60)  # both have read the same version
            return rows

        versions.update(spark, base, make)

    threads = [threading.Thread(target=writer, args=(k,)) for k in (10, 20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r.id for r in versions.current(spark, base).collect()) == [0, 10, 20]
    assert len(made) == 3  # one was outrun and made its version anew


def test_a_writer_that_died_between_its_steps_stops_nobody(spark, tmp_path):
    base = str(tmp_path / "table")
    versions.publish(spark.range(1), base)
    fs, at = versions._fs(spark, f"{base}/current/2")
    fs.create(at, False).close()
    assert versions.current(spark, base).count() == 1
    assert versions.update(spark, base, lambda old: old.union(spark.range(5, 6)), wait=0.01) == 3
    assert sorted(r.id for r in versions.current(spark, base).collect()) == [0, 5]
    assert versions.publish(spark.range(3), base) == 4
