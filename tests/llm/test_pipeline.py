import corpus_pipeline as P
from shelfmark.llm import decontam, secret_scan, toxicity
from shelfmark.llm.common import drop_scratch, table

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    model = toxicity.fit_toxicity(docs, table(spark, SF, "labels"))
    bad = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("predicted = 1").collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(P.STAGES) - 1:
            assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert len(ids) == docs.count() <= before
        if name == "toxicity":
            assert not ids & bad and len(ids) == before - len(bad)
        if name == "decontamination":
            assert decontam.find_contaminated(docs, table(spark, SF, "benchmark")).count() == 0
        if name == "secrets":
            left = secret_scan.find_secrets(docs).agg({"n_assign": "sum", "n_access": "sum", "n_hex": "sum"}).first()
            assert sum(left) == 0 and docs.count() == before
        before = docs.count()
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(docs.columns)
    whole = P.run(spark, SF)
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, docs.select(*key).collect()))
    assert drop_scratch(spark) > 0


def test_messy_documents_pass(spark, messy, texts):
    docs = messy
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == messy.columns
    assert 0 < P.STAGES[-1][1](spark, docs, SF).count() <= len(texts)
    assert P.STAGES[1][1](spark, messy.limit(0), SF).count() == 0


def test_empty_and_wordless_tables_run_through(spark, tmp_path):
    schema = table(spark, SF, "documents").schema
    for name, rows in (("none", []), ("blank", [(1, None, "en", "a", 0), (2, "", "en", None, 0), (2, " \n", "en", "a", 2)])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        for other in ("labels", "benchmark"):
            table(spark, SF, other).write.parquet(str(tmp_path / name / f"{other}.parquet"))
        out = P.run(spark, str(tmp_path / name)).collect()
        assert len(out) == min(len(rows), 1) and all(r.size == r.taken == 0 for r in out)
    nothing = spark.createDataFrame([], schema)
    for _, stage in P.STAGES:
        assert stage(spark, nothing, SF).count() == 0
