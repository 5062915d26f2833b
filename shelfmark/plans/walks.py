"""Queries over page sources, scorecard fixtures, the harness, recorded attempts and published versions, each beside its SQL."""

from __future__ import annotations

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import functions as F

from shelfmark import api
from shelfmark.operators import versions
from shelfmark.plans import harness
from shelfmark.plans.registry import query
from shelfmark.scratch import cut, place
from shelfmark.sources import media, paged
from shelfmark.vocabulary import VERDICTS

c, lit = F.col, F.lit
PAGE_IDS = 200


def _folder(path: str) -> ds.Dataset:
    store, at = fs.FileSystem.from_uri(path)
    return ds.dataset(at, filesystem=store, format="parquet")


# Documents are a feed a language, newest number first, a page for PAGE_IDS numbers; English and German have been walked before, German with gaps.
FEEDS = f"""
WITH m AS (SELECT max(doc_id) AS m FROM documents), d AS (SELECT lang, doc_id, (m - doc_id) // {PAGE_IDS} + 1 AS page, lang = 'en' AND doc_id < m * 0.7 OR lang = 'de' AND doc_id % 5 <> 0 AS known FROM documents, m),
p AS (SELECT lang, page, count(*) AS n, bool_and(known) AS stale FROM d GROUP BY 1, 2), s AS (SELECT lang, min(CASE WHEN stale THEN page END) AS stop, max(page) AS last FROM p GROUP BY 1),
w AS (SELECT lang, coalesce(stop, last) AS pages, stop IS NULL AS complete FROM s)
"""


def _walked(t):
    d = t("documents")
    spark = d.sparkSession
    most = d.agg(F.max("doc_id")).first()[0]
    known = ((c("lang") == "en") & (c("doc_id") < most * 0.7)) | ((c("lang") == "de") & (c("doc_id") % 5 != 0))
    rows = d.select("lang", c("doc_id").cast("string").alias("code"), F.floor((most - c("doc_id")) / PAGE_IDS + 1).cast("long").alias("page"), known.alias("known"))
    shown, seen = place(spark, "feed"), place(spark, "known")
    rows.groupBy("lang", "page").agg(F.collect_list("code").alias("codes")).repartitionByRange("lang", "page").sortWithinPartitions("lang", "page").write.parquet(shown)
    rows.where("known").select("lang", "code").repartitionByRange("code").write.parquet(seen)
    last = {r.lang: r.n for r in rows.groupBy("lang").agg(F.max("page").alias("n")).collect()}

    def fetch(feed: str, cursor: str | None) -> dict:
        n = int(cursor or 1)
        codes = _folder(shown).to_table(["codes"], filter=(ds.field("lang") == feed) & (ds.field("page") == n))["codes"].to_pylist()
        return {"items": [{"media": {"code": x}} for x in (codes[0] if codes else [])], "next_max_id": str(n + 1), "more_available": n < last[feed]}

    def look_up(feed: str, keys: list[str]) -> list[str]:
        return _folder(seen).to_table(["code"], filter=(ds.field("lang") == feed) & ds.field("code").isin(keys))["code"].to_pylist()

    return cut(paged.read_feeds(spark, sorted(last), fetch, look_up), "pages")


@query(FEEDS + """
SELECT lang AS feed, pages, (SELECT sum(n)::BIGINT FROM p WHERE p.lang = w.lang AND page <= pages) AS items, CASE WHEN complete THEN 'end' ELSE 'known' END AS stopped, complete FROM w
""")
def walked_feeds(t):
    """How far a walk of each feed goes: through known pages it stops, through the others it sees the end."""
    return paged.walks(_walked(t))


@query(FEEDS + "SELECT lang AS feed, page, doc_id FROM d JOIN w USING (lang) WHERE page <= pages")
def feed_items(t):
    rows = paged.page_items(_walked(t))
    return rows.select("feed", "page", F.get_json_object("raw_json", "$.code").cast("long").alias("doc_id"))


@query("""
WITH r AS (SELECT p_partkey AS k, p_size::VARCHAR AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT id, max(k) AS k FROM r GROUP BY 1), o AS (SELECT DISTINCT (p_size + 25)::VARCHAR AS id FROM part)
SELECT r.id AS collection_id, trim(coalesce(nullif(name, ''), id)) AS name, k AS item_count, 'now' AS synced_at FROM r JOIN n USING (id, k)
UNION ALL SELECT id, 'old', 0, 'then' FROM o WHERE id NOT IN (SELECT id FROM n)
""")
def named_collections(t):
    """A collection list in pages that name an id more than once, with ids of the service's own, blank and missing names."""
    part, k = t("part"), c("p_partkey")
    number = F.when(k % 3 == 0, F.concat(lit("ALL_MEDIA_"), c("p_size").cast("string"))).otherwise(c("p_size").cast("string"))
    name = F.when(k % 5 == 0, None).when(k % 7 == 0, "").otherwise(F.concat(lit(" "), "p_name", lit(" ")))
    item = F.to_json(F.struct(number.alias("collection_id"), name.alias("collection_name"), k.alias("collection_media_count")))
    rows = part.groupBy(lit("list").alias("feed"), F.floor(k / 100).alias("page")).agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), item.alias("i")))).alias("x"))
    old = part.select((c("p_size") + 25).cast("string").alias("collection_id"), lit("old").alias("name"), lit(0).cast("long").alias("item_count"), lit("then").alias("synced_at")).distinct()
    return paged.named_collections(rows.select("feed", "page", F.transform("x", lambda x: x["i"]).alias("items")), old, "now")


# Scorecard cases: one for each labelled document; every fault has its rows in the first query, the second takes sound ones.


def _fixture(t, sound: bool):
    d = t("labels").join(t("documents").select("doc_id", "lang", "source"), "doc_id")
    k = c("doc_id")
    fault = lambda n, bad, good: good if sound else F.when(k % n == 1, bad).otherwise(good)
    entity = F.struct(fault(13, lit(" "), F.concat(lit("Item "), "source")).alias("name"), lit("place").alias("type"), F.array(F.concat(lit("alias "), k.cast("string"))).alias("aliases"))
    rows = d.select(
        fault(7, lit(None).cast("string"), k.cast("string")).alias("shortcode"), F.when(k % 9 != 0, c("lang")).alias("category"), fault(11, lit("all"), F.when(c("toxic") == 1, "complete")).alias("entity_scope"),
        fault(5, lit("mode"), F.when(c("quality") == 1, "repertoire")).alias("expected_mode"), fault(3, lit("song"), lit("recipe")).alias("expected_content_kind"),
        F.when(k % 4 != 0, F.array(entity)).alias("expected_entities"), F.when(k % 4 == 0, F.array("source", lit("nothing"))).alias("expected_names"),
    )
    path = place(d.sparkSession, "cases")
    (rows if sound else rows.unionAll(rows.where("category = 'en'"))).write.json(path)
    return d.sparkSession, path


@query("""
WITH l AS (SELECT doc_id AS k, lang FROM labels JOIN documents USING (doc_id)), r AS (SELECT k, lang, CASE WHEN k % 7 <> 1 THEN k::VARCHAR END AS s, 1 AS again FROM l UNION ALL SELECT k, lang, CASE WHEN k % 7 <> 1 THEN k::VARCHAR END, 2 FROM l WHERE lang = 'en' AND k % 9 <> 0),
f AS (SELECT s, unnest([CASE WHEN k % 7 = 1 THEN 'no shortcode' END, CASE WHEN k % 11 = 1 THEN 'unknown scope' END, CASE WHEN k % 5 = 1 THEN 'unknown mode' END, CASE WHEN k % 3 = 1 THEN 'unknown content kind' END, CASE WHEN k % 13 = 1 AND k % 4 <> 0 THEN 'entity without a name' END]) AS fault FROM r)
SELECT s AS shortcode, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT s, 'repeated shortcode', 1 FROM r GROUP BY 1 HAVING count(*) > 1
""")
def case_faults(t):
    return media.case_faults(media.case_rows(*_fixture(t, False), lines=True)).groupBy("shortcode", "fault").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT doc_id AS k, CASE WHEN doc_id % 9 <> 0 THEN lang ELSE 'non catégorisé' END AS category, quality = 1 AS q, toxic = 1 AS x, source FROM labels JOIN documents USING (doc_id))
SELECT category, count(*) AS cases, sum(CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END)::BIGINT AS entities_expected, count(*) FILTER (WHERE k % 5 <> 0) AS entities_found,
  count(*) FILTER (WHERE k % 5 <> 0 AND k % 4 <> 0 AND k % 3 = 0) AS type_errors, (count(*) FILTER (WHERE x AND k % 5 = 0) + count(*) FILTER (WHERE x))::BIGINT AS false_positives,
  count(*) FILTER (WHERE q) AS mode_expected, count(*) FILTER (WHERE q AND k % 6 <> 0) AS mode_correct FROM l GROUP BY 1
""")
def harness_report(t):
    """The whole harness over all labelled documents: fixture read and checked, sources sliced, extraction, score by category, report written and read back."""
    spark, path = _fixture(t, True)

    def extract(kept):
        d = kept["reel"]
        k = c("shortcode").cast("long")
        good = F.when(k % 5 == 0, lit("Else")).when(k % 4 == 0, c("source")).otherwise(F.concat(lit("ITEM  "), "source"))
        name = F.explode(F.array(F.struct(lit(0).alias("j"), good.alias("name"), lit("llm").alias("source")), F.struct(lit(1).alias("j"), lit("Surplus").alias("name"), lit("llm").alias("source")), F.struct(lit(2).alias("j"), lit("By hand").alias("name"), lit("human").alias("source")))).alias("c")
        kind = F.when(k % 3 == 0, "shop").otherwise("place")
        made = d.select("shortcode", kind.alias("type"), name).select((c("shortcode").cast("long") * 3 + c("c.j")).alias("id"), "shortcode", "c.name", lit(None).cast("string").alias("name_latin"), "type", lit(True).alias("verified"), "c.source")
        said = d.select("shortcode", (k % 6 != 0).alias("ok"), lit("repertoire").alias("mode"), lit("recipe").alias("content_kind"), lit(None).cast("boolean").alias("actionable"))
        return {"candidate": made, "extraction": said}

    reels = t("documents").select(c("doc_id").cast("string").alias("shortcode"), "source")
    out = harness.run({"reel": reels}, media.read_cases(spark, path, lines=True), extract, by="category")
    told = place(spark, "report")
    harness.write_report(out["scorecard"], told)
    schema = out["scorecard"].schema
    return spark.read.schema(schema).json(told).select("category", "cases", "entities_expected", "entities_found", "type_errors", "false_positives", "mode_expected", "mode_correct")


# Attempts and versions


@query(f"""
WITH o AS (SELECT o_orderkey AS k, list_extract({[*VERDICTS, "meh"]!r}, (o_orderkey % 6 + 1)::INT) AS v, CASE WHEN o_orderkey % 8 <> 7 THEN o_orderkey % 8 END AS r, o_custkey % 9 = 0 AS bad FROM orders),
f AS (SELECT k, CASE WHEN v = 'meh' THEN 'verdict' WHEN r NOT BETWEEN 1 AND 5 THEN 'rating' WHEN bad THEN 'cooked_at' END AS fault FROM o), n AS (SELECT max(c_custkey) AS n FROM customer)
SELECT k AS recipe_id, n + row_number() OVER (ORDER BY k) AS attempt_id, 'none' AS fault FROM f, n WHERE fault IS NULL UNION ALL SELECT k, 0, fault FROM f WHERE fault IS NOT NULL UNION ALL SELECT c_nationkey, c_custkey, 'none' FROM customer
""")
def recorded_attempts(t):
    k = c("o_orderkey")
    verdict = F.element_at(F.array(*map(lit, [*VERDICTS, "meh"])), (k % 6 + 1).cast("int"))
    cooked = F.when(c("o_custkey") % 9 == 0, lit("2024-02-30")).when(k % 10 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    new = t("orders").select(k.cast("long").alias("recipe_id"), verdict.alias("verdict"), F.when(k % 8 != 7, k % 8).cast("int").alias("rating"), cooked.alias("cooked_at"), lit("n").alias("note"))
    old = t("customer").select(c("c_nationkey").cast("long").alias("recipe_id"), lit("liked").alias("verdict"), lit(None).cast("int").alias("rating"), lit(None).cast("string").alias("cooked_at"), lit("").alias("note"), c("c_custkey").cast("long").alias("attempt_id"))
    attempts, refused = api.recorded_attempts(old, new, "recipe_id")
    return attempts.select("recipe_id", "attempt_id", lit("none").alias("fault")).unionByName(refused.select("recipe_id", lit(0).cast("long").alias("attempt_id"), "fault"))


@query("""
SELECT o_orderstatus AS status, count(*) AS n, max(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 1 END) AS newest, 'true false true' AS runs FROM orders GROUP BY 1
""")
def published_versions(t):
    """Three runs publish a table; the second dies on one of its rows, after others were written, and changes nothing but the record."""
    o = t("orders").select("o_orderkey", c("o_orderstatus").alias("status"))
    spark, base, runs = o.sparkSession, place(o.sparkSession, "versions"), []
    record = lambda ok, _: runs.append(str(ok).lower())
    last = o.agg(F.max("o_orderkey")).first()[0]
    even = c("o_orderkey") % 2 == 0
    versions.attempt(spark, base, lambda _: o.withColumn("run", lit(1)), record)
    versions.attempt(spark, base, lambda old: old.withColumn("run", F.when(c("o_orderkey") == last, F.raise_error(lit("no such page"))).otherwise(2)), record)
    versions.attempt(spark, base, lambda old: old.withColumn("run", F.when(even, 3).otherwise(c("run"))), record)
    return versions.current(spark, base).groupBy("status").agg(F.count("*").alias("n"), F.max("run").alias("newest"), lit(" ".join(runs)).alias("runs"))
