"""The columns and types that each query returns, one row for each row of its table where that is promised."""

import pytest

import __spark_entry__ as entry
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: dict(page_id="bigint", host="string", path="string", rule="string", verdict="string"),
    2: dict(doc_id="bigint", n_assign="bigint", n_access="bigint", n_hex="bigint", base_sha256="string", spans="string"),
    3: dict(doc_id="bigint", n_email="bigint", n_ip="bigint", n_card="bigint", n_phone="bigint", base_sha256="string", spans="string"),
    4: dict(doc_id="bigint", n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint", base_failed="boolean", kept="boolean"),
    5: dict(doc_id="bigint", size="bigint", source_size="bigint", target="double", taken="bigint"),
    6: dict(doc_id="bigint", n_words="bigint", n_removed="bigint", kept_sha256="string"),
    7: dict(doc_id="bigint", n_bytes="bigint", n_tokens="bigint", over_limit="boolean"),
    8: dict(doc_id="bigint", fingerprint="string", component_id="bigint"),
    9: dict(doc_id="bigint", held_out="boolean", score="double", predicted="int"),
    10: dict(doc_id="bigint", item_id="bigint", n_shingles="bigint", n_found="bigint", containment="double"),
    11: dict(vec_id="bigint", component="int", n="bigint", deviation="bigint", whitened="double", explained="double", identity_error="double"),
    12: dict(vec_id="bigint", cluster="int", distance="bigint", cluster_inertia="bigint", inertia="bigint", centroid_sha256="string"),
    13: dict(doc_id="bigint", size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int"),
}
TABLES = {1: "pages", 12: "embeddings"}
NATIVE = (1, 2, 3, 5)


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_columns(spark, n):
    (name,) = [q for q in QUERIES if q.startswith(f"op{n}_")]
    df = entry.queries()[name](spark, SF)
    got = dict(df.dtypes)
    assert {k: got.get(k) for k in COLUMNS[n]} == COLUMNS[n]
    if n == 11:
        assert df.count() == 32 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
    elif n != 10:
        assert df.count() == spark.read.parquet(f"{SF}/{TABLES.get(n, 'documents')}.parquet").count()
    if n in NATIVE:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_pipeline_is_registered(spark):
    import corpus_pipeline as p

    assert 4 <= len(p.STAGES) <= 5 and entry.queries()["pipeline"] is p.run
