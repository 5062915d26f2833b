"""Results that the smallest tables don't show to be whole."""

import random

import pytest
from oracle import same
from pyspark.sql import functions as F

from shelfmark import api
from shelfmark.operators import queues
from shelfmark.plans import queries
from shelfmark.sources import media


def test_attested_in_sources_finds_every_needle(spark, tmp_path):
    docs = ["one line\nbreak within the first words of it", "xinside a long word stands thisy", "tiny", "Ends in tin", "nothing"]
    needles = ["line\nbreak within the", "nside a long word stands", "tin", "in", "", "ot there at all, this one"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(needles)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, queries.QUERIES["attested_in_sources"](spark, str(tmp_path)).collect()))
    assert got == sorted((d, i) for d, t in enumerate(docs) for i, n in enumerate(needles) if n.strip() and n.strip().lower() in t.lower())


def test_attested_in_sources_on_more_documents(spark):
    same(queries.QUERIES["attested_in_sources"](spark, "/root/testdata/sf0.1"), queries.ORACLE_SQL["attested_in_sources"], "/root/testdata/sf0.1")


def test_attested_pairs_in_blocks(spark):
    from shelfmark.operators.attest import attested_pairs

    docs = spark.createDataFrame([(1, "Smart of the town"), (2, None), (3, "cats, CATS\nand dogs"), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "art of the town"), (11, " cats "), (12, "CATS"), (13, "cats\nand"), (14, "s, c"), (15, " "), (16, None), (17, "at")], "item_id int, text string")
    want = {(1, 10), (3, 11), (3, 12), (3, 13), (3, 14), (3, 17)}
    for most in (50_000, 2):
        got = attested_pairs(docs, "doc_id", "text", items, "item_id", "text", block_items=most)
        assert got.count() == len(want) and set(map(tuple, got.collect())) == want
    assert attested_pairs(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert attested_pairs(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


@pytest.mark.parametrize(("adaptive", "parts"), [("true", 16), ("true", 200), ("false", 16)])
def test_quota_keeps_every_row_that_is_due(spark, adaptive, parts):
    rng = random.Random(parts)
    order = list(range(60_000))
    rng.shuffle(order)
    rows = [(k, rng.random() < 0.15, rng.random() < 0.01, "x" * 40) for k in order]
    df = spark.createDataFrame(rows, "k long, ok boolean, blocked boolean, pad string").repartition(7).cache()
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for limits in ({"ok": 3000}, {"ok": 1}, {"ok": 10**9}, {"ok": 8000, "blocked": 100}):
            want, seen = 0, dict.fromkeys(limits, 0)
            for r in sorted(rows):
                if any(seen[x] >= n for x, n in limits.items()):
                    break
                want += 1
                for x in limits:
                    seen[x] += r[1] if x == "ok" else r[2]
            got = sorted(r.k for r in queues.until(df, limits, "k").select("k").collect())
            assert got == list(range(want))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def brute_object(text):
    start = text.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        ch = text[i]
        if skip:
            skip = False
        elif ch == "\\":
            skip = True
        elif ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{}":
            depth += 1 if ch == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def test_first_json_object_by_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('{}"\\a\n ') for _ in range(rng.randrange(30))) for _ in range(3000)]
    deep = '{"a":' * 100_000
    texts += ["", '{"a":"\\ud800"} tail', deep, deep + "1" + "}" * 100_000, '{"never closed', "{bad} {}", "}{", '"{" {x}']
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    found = media.first_json_object(df, "t")
    assert "Python" not in found._jdf.queryExecution().toString()
    assert {r.i: r.object for r in found.collect()} == {i: brute_object(t) for i, t in enumerate(texts)} | {-1: None}


def test_numbers_and_ranks_by_ranges(spark):
    from shelfmark.operators import ordered

    rng = random.Random(2)
    values = [rng.choice([None, *range(50)]) for _ in range(4000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(5)
    numbers = {r.i: r.n for r in ordered.numbered(df.where("v is not null"), ["v", "i"], "n").collect()}
    order = sorted((v, i) for i, v in enumerate(values) if v is not None)
    assert numbers == {i: k + 1 for k, (_, i) in enumerate(order)}


@pytest.mark.parametrize(("bins", "local"), [(512, 20_000), (2, 0)])
def test_order_statistics_by_refinement(spark, monkeypatch, bins, local):
    """Against sorted lists: several fields and groups, few and many bins, bounds sent along and joined; null groups, no values."""
    from shelfmark.operators import orderstats

    monkeypatch.setattr(orderstats, "LOCAL", local)
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(50)]), 10 ** rng.randrange(17) + rng.randrange(3), None) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, `v.w` int, x long, none long").repartition(3).cache()
    at = {"lo": F.lit(0), "mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1, "past": F.col("n")}
    want = {}
    for f, i in (("v.w", 1), ("x", 2)):
        for g in (None, "a", "b"):
            v = sorted(r[i] for r in rows if r[0] == g and r[i] is not None)
            want[g, f] = (len(v), v[0], v[len(v) // 2], v[-1], None)
    out = orderstats.order_statistics(df, ["v.w", "x", "none"], at, ["g"], bins).collect()
    assert {(r.g, r.field): (r.n, r.lo, r.mid, r.top, r.past) for r in out} == want
    if bins > 2:
        assert tuple(orderstats.order_statistics(df, ["none"], {"lo": F.lit(0)}).first()) == ("none", 0, None)
        reals = [float("inf"), float("-inf"), 1e308, -1e308, 0.0, 5e-324, 1.0, 1.0, float("nan")]
        real = spark.createDataFrame([(x,) for x in reals], "r double")
        got = orderstats.order_statistics(real, ["r"], {f"i{i}": F.lit(i) for i in range(9)}).first()
        assert str(list(got[2:])) == str(sorted(reals[:-1]) + [reals[-1]])
        big = [2**62 + i * i for i in range(300)] + [-(2**62)]
        longs = spark.createDataFrame([(x,) for x in big], "l long")
        assert orderstats.order_statistics(longs, ["l"], {"m": F.lit(150), "z": F.lit(300)}).first()[2:] == (2**62 + 149**2, 2**62 + 299**2)


def test_a_quota_writes_nothing_and_narrows(spark, monkeypatch):
    """The end is found in ranges however few rows make one; string, stamp and null keys; the plan is a filter."""
    import datetime

    from shelfmark.operators import ordered

    monkeypatch.setattr(ordered, "LEAF", 20)
    monkeypatch.setattr(ordered, "cut", None)
    rows = [(None if i == 3 else f"k{i * 7919 % 5000:05d}", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i * 31 % 977), i % 5 == 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, at timestamp, ok boolean").repartition(6).cache()
    for order in (["k"], ["at", "k"]):
        place = lambda r: [(x is not None, x) for x in (r[0],)] if order == ["k"] else [(True, r[1]), (r[0] is not None, r[0] or "")]  # noqa: E731, B023
        want, met = [], 0
        for r in sorted(rows, key=place):
            if met == 321:
                break
            want.append(r[0])
            met += r[2]
        out = queues.quota(df, "ok", 321, *order)
        assert sorted(map(str, (r.k for r in out.collect()))) == sorted(map(str, want))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    same = spark.createDataFrame([(1, True)] * 6000, "k long, ok boolean")
    assert queues.quota(same, "ok", 3, "k").count() == 6000  # one key: no row is before another
    assert queues.quota(same, "ok", 0, "k").count() == 0 and queues.quota(same.limit(0), "ok", 3, "k").count() == 0


def test_a_failed_version_leaves_the_last_one(spark, tmp_path):
    from shelfmark.operators import versions

    base, log = str(tmp_path / "table"), []
    record = lambda ok, error: log.append((ok, error and error[:9]))
    assert versions.current(spark, base) is None

    def broken(_):
        raise ValueError("too early to say")

    assert not versions.attempt(spark, base, broken, record)
    assert versions.attempt(spark, base, lambda old: spark.range(3), record)
    assert versions.attempt(spark, base, lambda old: old.union(spark.range(10, 12)), record)
    late = lambda old: old.select(F.raise_error(F.lit("boom")).cast("long").alias("id"))
    assert not versions.attempt(spark, base, late, record)
    assert sorted(r.id for r in versions.current(spark, base).collect()) == [0, 1, 2, 10, 11]
    assert [ok for ok, _ in log] == [False, True, True, False] and log[0][1] == "too early"


def test_feed_walk(spark):
    pages = spark.createDataFrame([(1, "a", False), (1, "b", False), (2, "k1", False), (2, "k2", False), (3, "k1", True), (3, "z", True)], "page int, shortcode string, last boolean")
    known = spark.createDataFrame([("k1",), ("k2",)], "shortcode string")
    read = lambda *a, **k: (lambda p, done: (sorted({r.page for r in p.collect()}), done))(*queues.walked(*a, **k))
    assert read(pages, known) == ([1, 2], False)
    assert read(pages, known, full=True) == ([1, 2, 3], True)
    assert read(pages, known.limit(0)) == ([1, 2, 3], True)
    assert read(pages, known, full=True, limit=3) == ([1, 2], False)
    assert read(pages, known, full=True, limit=6) == ([1, 2, 3], False)
    assert read(pages.where("page < 3"), known, full=True) == ([1, 2], False)


def test_written_index_answers_like_the_scan(spark, tmp_path):
    from shelfmark.operators import search

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    search.write_index(search.token_table(docs, "doc_id", "text", "source"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for q in ("the with", "the NOT with", '"of the"', "licens* OR ^the", "source:src1 AND the", "NEAR(the in, 3)", "a*", "nothere", "(der OR una) NOT source:src2"):
        want = [r.doc_id for r in search.search(docs, q, ["text", "source"], "doc_id").collect()]
        assert sorted(r.doc_id for r in search.search_index(index, q, "doc_id", ["text", "source"]).collect()) == want, q


def test_conversations(spark):
    s = "id long, title string, created_at string, updated_at string"
    m = "id long, session_id long, role string, content string, created_at string"
    sessions, messages, n = api.asked(spark.createDataFrame([], s), spark.createDataFrame([], m), "  What is\nnew? " + "x" * 80, "t1")
    assert n == 1 and sessions.first().title == ("What is new? " + "x" * 80)[:72] + "…"
    sessions, messages, n = api.asked(sessions, messages, "and then", "t2", 1)
    assert [r.content for r in api.conversation(messages, 1).collect()][1] == "and then" and sessions.count() == 1
    for bad in ("", " ", "x" * 801):
        with pytest.raises(ValueError):
            api.asked(sessions, messages, bad, "t", 1)
    with pytest.raises(ValueError):
        api.asked(sessions, messages, "x", "t", 5)
    assert [d.count() for d in api.without_session(sessions, messages, 1)] == [0, 0]
