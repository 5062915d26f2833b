import re

import pytest
from oracle import same

from shelfmark.llm import decontam, queries


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)


def brute(docs, items, share=0.8):
    out = []
    for item_id, text in items:
        n = min(5, shingles(text, 1)[1])
        own = shingles(text, n)[0] if n else set()
        for doc_id, doc in docs:
            found = len(own & shingles(doc, n)[0]) if own else 0
            if own and found >= share * len(own) - 1e-9:
                out.append((doc_id, item_id, len(own), found))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 2, 20_000])
def test_pairs(spark, messy, texts, nothing, block):
    prose = texts[3][1].split()
    items = [(1, " ".join(prose[5:25])), (2, "again again again again again again again"), (3, "word"), (4, ""), (5, None), (6, " ".join(prose[3:16]) + " then something new entirely here"), (7, "OTHER words"), (1, " ".join(prose[5:25])), (None, " ".join(prose[:9])), (8, " ".join(prose[10:22]) + " zzz")]
    df = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontam.find_contaminated(messy, df, block_items=block).collect()), key=str)
    assert got == brute([(i, t) for i, t, _ in texts], items)
    assert decontam.find_contaminated(nothing, df).count() == 0 and decontam.find_contaminated(messy, df.limit(0)).count() == 0
    kept = decontam.drop_contaminated(messy, df, block_items=block)
    assert kept.columns == messy.columns and kept.count() == len(texts) - sum(any(p[0] == i for p in brute([(i, t)], items)) for i, t, _ in texts)


def test_real_tables_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in queries.op10_decontamination(spark, d).collect()), key=str)
    assert got == brute(docs, items)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    same(queries.op10_decontamination(spark, d), decontam.ORACLE, d)
