"""Further queries: media records, state rules, field rules, the write path and the search index, each beside its SQL.

Inputs are made from the test tables such that every branch of a rule has rows; the SQL says the rule anew on the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfmark import api
from shelfmark.functions import text as T
from shelfmark.operators import canonical, evidence, guards, manifest, quality, queues, resolve, search, state, views, votes, written_index
from shelfmark.plans.registry import query
from shelfmark.scratch import cut, place
from shelfmark.sources import media
from shelfmark.streaming import ingest

KEY = r"trim(regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
TOKENS = r"list_filter(string_split_regex(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
c, lit = F.col, F.lit


def empty():
    return F.array().cast("array<string>")


def key(x: str) -> str:
    return KEY.format(x)


def pick(k, *values):
    """The k-th value, from 0; columns stay, plain values become literals."""
    return F.element_at(F.array(*[v if not isinstance(v, str | int | float | bool | None) else lit(v) for v in values]), (k + 1).cast("int"))


# Media records


@query(r"""
SELECT 'c' || doc_id AS shortcode, 'https://www.instagram.com/' || CASE WHEN doc_id % 4 = 0 THEN 'reel' ELSE 'p' END || '/c' || doc_id || '/' AS url, CASE WHEN doc_id % 5 = 0 THEN 'id' || doc_id ELSE doc_id::VARCHAR END AS media_id,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS username, sha256(CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END) AS caption_sha, CASE WHEN doc_id % 4 = 0 THEN 'reel' WHEN doc_id % 9 = 8 THEN 'carousel' WHEN doc_id % 9 = 2 THEN 'video' ELSE 'post' END AS kind, doc_id || '|17' AS collections
FROM documents WHERE doc_id % 6 <> 1
""")
def parsed_media(t):
    d, k = t("documents"), c("doc_id")
    number = k.cast("string")
    code = F.when(k % 6 != 1, F.concat(lit("c"), number)).otherwise(F.when(k % 12 == 1, ""))
    raw = F.struct(
        F.when(k % 5 != 0, number).alias("pk"), F.concat(lit("id"), number).alias("id"), code.alias("code"), (k + 10).alias("taken_at"), (k % 9).cast("int").alias("media_type"), F.when(k % 4 == 0, "clips").alias("product_type"),
        F.when(k % 7 != 0, F.struct("text")).alias("caption"), F.when(k % 3 != 0, F.struct(c("source").alias("username"))).alias("user"), F.array(number, lit("x"), lit("17")).alias("saved_collection_ids"),
    )
    out = media.parse_media(d.select(F.to_json(raw).alias("raw_json")))
    return out.select("shortcode", "url", "media_id", "username", F.sha2("caption", 256).alias("caption_sha"), "kind", F.array_join("collection_ids", "|").alias("collections"))


@query("""
SELECT conv_id, sha256(trim(coalesce(string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE turn % 3 <> 0), ''))) AS text_sha, trim(coalesce(string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE turn % 3 <> 0), '')) <> '' AS has_speech FROM conversations GROUP BY 1
""")
def transcripts(t):
    sure = F.when(c("turn") % 3 == 0, -1.5).when(c("turn") % 3 == 1, -1.0)
    rows = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", sure.alias("avg_logprob")))).alias("s"))
    said = media.spoken(c("s"))
    return rows.select("conv_id", F.sha2(said["text"], 256).alias("text_sha"), said["has_speech"].alias("has_speech"))


@query("SELECT p_partkey, CASE WHEN p_retailprice - 950 > 0 THEN least(greatest(25 / (p_retailprice - 950), 0.1::DOUBLE), 2.0::DOUBLE) ELSE 2.0::DOUBLE END AS fps FROM part")
def frame_rates(t):
    return t("part").select("p_partkey", T.adaptive_fps(c("p_retailprice") - 950, 25, 0.1, 2.0).alias("fps"))


@query("SELECT 'lineitem' AS name, l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY 1, 2 UNION ALL SELECT 'supplier', s_suppkey, 1 FROM supplier WHERE s_nationkey = 3")
def slices(t):
    tables = {"lineitem": t("lineitem").withColumnRenamed("l_suppkey", "k"), "supplier": t("supplier").withColumnRenamed("s_suppkey", "k")}
    kept = media.slice_tables(tables, tables["supplier"].where("s_nationkey = 3"), "k")
    return kept["lineitem"].groupBy(lit("lineitem").alias("name"), "k").agg(F.count("*").alias("n")).union(kept["supplier"].groupBy(lit("supplier"), "k").agg(F.count("*")))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def archive_queue(t):
    k = c("s_suppkey")
    rows = t("supplier").select(k, F.when(k % 2 == 0, "now").alias("validated_at"), F.when(k % 3 == 0, "short").otherwise(F.sha2("s_name", 256)).alias("sha256"), F.when(k % 5 == 0, "s3").alias("archive_uri"))
    return media.unarchived(rows).select("s_suppkey")


@query("""
WITH q AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'done' WHEN 4 THEN 'failed' ELSE 'done' END AS status, CASE WHEN c_custkey % 6 = 4 THEN 3 ELSE 1 END AS attempts FROM customer WHERE c_custkey % 10 <> 0 AND c_nationkey <> 3)
SELECT k FROM q WHERE status IS NULL OR (status = 'failed' AND attempts < 3) OR (status = 'done' AND k % 6 = 5)
""")
def download_queue(t):
    k = c("c_custkey")
    items = t("customer").select(k.alias("shortcode"), F.when(k % 10 == 0, "gone").alias("unsaved_at"), F.when(c("c_nationkey") == 3, "post").when(k % 2 == 0, "reel").otherwise("video").alias("kind"))
    log = t("customer").where(k % 6 != 0).select(k.alias("shortcode"), lit("download").alias("stage"), pick(k % 6, "", "failed", "skipped", "done", "failed", "done").alias("status"), F.when(k % 6 == 4, 3).otherwise(1).alias("attempts"))
    lost = t("customer").where(k % 6 == 5).select(k.alias("shortcode"))
    return queues.download_queue(items, log, lost).select(c("shortcode").alias("k"))


@query("""
WITH s AS (SELECT event_id, coalesce(sum((event_type = 'purchase')::INT) OVER w, 0) AS ok, coalesce(sum((event_type = 'error')::INT) OVER w, 0) AS blocked FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id FROM s WHERE ok < 80 AND blocked < 500
""")
def download_run(t):
    queue = t("events").select(c("event_id").alias("shortcode"))
    outcomes = t("events").select(c("event_id").alias("shortcode"), F.when(c("event_type") == "purchase", 200).when(c("event_type") == "error", 401).otherwise(0).alias("outcome"))
    return queues.attempted(queue, outcomes, sample=80, abort_after=500, order=["shortcode"]).select(c("shortcode").alias("event_id"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (3, 17, 90, 404) ORDER BY doc_id")
def chosen_queue(t):
    d = t("documents")
    return queues.stale_queue(d, [d], d, {"lang": "en"}, only=["3", "17", "90", "90", "404"], force=True, key="doc_id", order="doc_id").select("doc_id")


# State


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS poster FROM orders UNION ALL SELECT -1 - s_suppkey, 'new', NULL FROM supplier
""")
def replaced_rows(t):
    old = t("orders").select("o_orderkey", c("o_orderpriority").alias("priority"), c("o_orderstatus").alias("poster"))
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", lit("new").alias("priority")).union(t("supplier").select(-1 - c("s_suppkey"), lit("new")))
    return state.replace_rows(old, new, ["o_orderkey"])


@query("""
SELECT p_type AS shortcode, CASE WHEN p_size % 2 = 0 THEN 'llm' ELSE 'human' END AS source, p_name AS name FROM part WHERE p_size % 2 = 1 OR p_type NOT IN ('ECONOMY', 'PROMO') UNION ALL SELECT 'ECONOMY', 'llm', n_name FROM nation UNION ALL SELECT 'PROMO', 'llm', n_name FROM nation
""")
def replaced_by_origin(t):
    old = t("part").select(c("p_type").alias("shortcode"), F.when(c("p_size") % 2 == 0, "llm").otherwise("human").alias("source"), c("p_name").alias("name"))
    new = t("nation").select(F.explode(F.array(lit("ECONOMY"), lit("PROMO"))).alias("shortcode"), lit("llm").alias("source"), c("n_name").alias("name"))
    return state.replace_by_origin(old, new, "shortcode", "llm")


PATCHED = """
WITH e AS (SELECT user_id AS id, event_id AS seq, event_id % 3 = 0 AS set_status, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS status, event_id % 4 = 0 OR event_id % 3 = 0 AS set_date, CASE WHEN event_id % 4 = 0 THEN 'd' || (event_id % 10) ELSE '2024-06-01' END AS reviewed_at FROM events),
g AS (SELECT id, seq, CASE WHEN count(*) FILTER (WHERE set_status) OVER w > 0 THEN arg_max(coalesce(status, '~'), seq) FILTER (WHERE set_status) OVER w ELSE CASE WHEN id % 2 = 0 THEN 'owned' ELSE '~' END END AS status,
  CASE WHEN count(*) FILTER (WHERE set_date) OVER w > 0 THEN arg_max(reviewed_at, seq) FILTER (WHERE set_date) OVER w ELSE '~' END AS reviewed_at FROM e WINDOW w AS (PARTITION BY id ORDER BY seq))
"""


def _patches(t):
    k = c("event_id")
    one = lambda isset, value: F.struct(isset.alias("set"), value.alias("value"))
    patches = t("events").select(c("user_id").alias("id"), k.alias("seq"), one(k % 3 == 0, F.when(k % 9 != 0, c("event_type"))).alias("status"), one(k % 4 == 0, F.concat(lit("d"), (k % 10).cast("string"))).alias("reviewed_at"))
    current = t("events").where("user_id % 2 = 0").select(c("user_id").alias("id"), lit("owned").alias("status"), lit(None).cast("string").alias("reviewed_at")).distinct()
    return state.merge_patches(current, state.reviewed(patches, lit("2024-06-01")), "id", ["status", "reviewed_at"], "seq")


@query(PATCHED + "SELECT id, seq, nullif(status, '~') AS status, nullif(reviewed_at, '~') AS reviewed_at FROM g")
def patch_history(t):
    return _patches(t)[1].select("id", "seq", "status", "reviewed_at")


@query(PATCHED + "SELECT id, nullif(arg_max(status, seq), '~') AS status, nullif(arg_max(reviewed_at, seq), '~') AS reviewed_at FROM g GROUP BY 1")
def patched_state(t):
    return _patches(t)[0]


@query("SELECT 'lineitem' AS name, count(*) AS n FROM lineitem WHERE l_suppkey % 4 <> 1 UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey % 4 <> 1")
def cascaded_deletes(t):
    tables = {"lineitem": t("lineitem").withColumnRenamed("l_suppkey", "k"), "supplier": t("supplier").withColumnRenamed("s_suppkey", "k")}
    return votes.labelled_counts(media.cascaded(tables, tables["supplier"].where("k % 4 = 1"), "k")).withColumnRenamed("label", "name")


@query("""
WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2), cu AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n) AND c_custkey % 11 <> 3), su AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM cu)), l AS (SELECT 1 FROM lineitem WHERE l_orderkey IN (FROM o) AND l_suppkey IN (FROM su))
SELECT 'region' AS name, (SELECT count(*) FROM region) - 1 AS n UNION ALL SELECT 'nation', (SELECT count(*) FROM n) UNION ALL SELECT 'customer', (SELECT count(*) FROM cu) UNION ALL SELECT 'supplier', (SELECT count(*) FROM su)
UNION ALL SELECT 'orders', (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l)
""")
def cascaded_levels(t):
    """A region goes, and some customers; nations, customers and suppliers, orders and lines follow, each level by another key."""
    line = t("lineitem").withColumn("id", F.xxhash64(*t("lineitem").columns))
    tables = {"region": (t("region"), "r_regionkey"), "nation": (t("nation"), "n_nationkey"), "customer": (t("customer"), "c_custkey"), "supplier": (t("supplier"), "s_suppkey"), "orders": (t("orders"), "o_orderkey"), "lineitem": (line, "id")}
    refers = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
    gone = {"region": t("region").where("r_regionkey = 2").select("r_regionkey"), "customer": t("customer").where("c_custkey % 11 = 3").select("c_custkey")}
    return votes.labelled_counts(state.cascaded_through(tables, refers, gone)).withColumnRenamed("label", "name")


@query("""
WITH b AS (SELECT user_id::VARCHAR AS shortcode, event_type AS kind, ts AS seen, event_id AS seq, CASE WHEN user_id % 10 < 4 THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS batch FROM events WHERE event_id % 2 = 0 OR user_id % 10 < 4),
g AS (SELECT shortcode, arg_max(kind, (batch, seen, seq)) AS kind, arg_max(seen, (batch, seen, seq)) AS last_at, min(CASE WHEN batch = f THEN seen END) AS first_at FROM (SELECT *, min(batch) OVER (PARTITION BY shortcode) AS f FROM b) GROUP BY 1)
SELECT shortcode, kind, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_seen_at FROM g
""")
def bucketed_upserts(t):
    """Three batches (the second again, as a replay) on the bucketed state."""
    e = t("events")
    spark, base = e.sparkSession, place(e.sparkSession, "state")
    rows = e.select(c("user_id").cast("string").alias("shortcode"), c("event_type").alias("kind"), c("ts").cast("timestamp").alias("seen_at"), c("event_id").alias("seq"), (F.when(c("user_id") % 10 < 4, 1).otherwise(0) + F.when(c("event_id") % 2 == 0, 0).otherwise(1)).alias("batch"))
    rows = rows.where((c("seq") % 2 == 0) | (c("shortcode").cast("long") % 10 < 4))
    schema = spark.createDataFrame([], "shortcode string, kind string, first_seen_at timestamp, last_seen_at timestamp, unsaved_at string").schema
    for number in (0, 1, 1, 2):
        ingest.apply_batch(spark, rows.where(c("batch") == number).drop("batch"), number, base, schema)

    stamp = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return ingest.state_table(spark, base, schema).select("shortcode", "kind", stamp("first_seen_at"), stamp("last_seen_at"))



@query("""
SELECT 'lineitem' AS "table", p.l_partkey AS p_partkey, count(*) AS n FROM lineitem p WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) GROUP BY 1, 2
UNION ALL SELECT 'part', p_partkey, 1 FROM part WHERE p_size <= 2
""")
def broken_references(t):
    tables = {"lineitem": t("lineitem").withColumnRenamed("l_partkey", "p_partkey"), "part": t("part")}
    return media.broken_references(tables, t("part").where("p_size > 2"), "p_partkey").groupBy("table", "p_partkey").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT user_id % 7 AS run_id, event_type AS shortcode, min(event_id) AS position FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
r AS (SELECT user_id % 9 AS run_id, arg_max(CASE WHEN value > 5 THEN 'done' ELSE 'failed' END, (ts, event_id)) AS status FROM events GROUP BY 1)
SELECT r.run_id, status, count(o.shortcode) AS items FROM r LEFT JOIN o ON o.run_id = r.run_id GROUP BY 1, 2
""")
def run_manifest(t):
    e = t("events").withColumn("run_id", (c("user_id") % 7).cast("string"))
    code = F.when(c("event_type") == "view", "").otherwise(c("event_type"))
    seen = t("events").limit(0).select(lit("").alias("run_id"), lit("").alias("shortcode"), c("event_id").alias("position"), lit("").alias("seen_at"))
    for run in range(7):
        seen = manifest.observe(seen, str(run), e.where(c("run_id") == str(run)).select(code.alias("shortcode"), c("event_id").alias("position")), lit("now"))
    runs = t("events").select((c("user_id") % 9).cast("string").alias("run_id"), F.when(c("value") > 5, "done").otherwise("failed").alias("status"), F.struct("ts", "event_id").alias("at"))
    return manifest.finished(runs, seen).select(c("run_id").cast("long").alias("run_id"), "status", "items")


@query("SELECT o_orderpriority AS model, count(*) AS calls, sum(o_custkey)::BIGINT AS prompt_tokens, sum(o_orderkey % 100)::BIGINT AS completion_tokens, sum(CASE WHEN o_orderkey % 2 = 0 THEN 7 END)::BIGINT AS duration_ms FROM orders GROUP BY 1")
def model_usage(t):
    rows = t("orders").select(c("o_orderpriority").alias("model"), c("o_custkey").alias("prompt_tokens"), (c("o_orderkey") % 100).alias("completion_tokens"), F.when(c("o_orderkey") % 2 == 0, 7).alias("duration_ms"))
    return manifest.usage(rows, "model")


@query("""
WITH l AS (SELECT user_id AS k, date_trunc('day', ts) AS seen, event_id * 2 AS seq, CASE WHEN event_type = 'error' THEN 'running' ELSE event_type END AS status FROM events
  UNION ALL SELECT user_id, date_trunc('day', ts), event_id * 2 + 1, 'failed' FROM events WHERE event_type = 'error' AND event_id % 3 = 0),
m AS (SELECT k, arg_max(status, (seen, seq)) AS status FROM l GROUP BY 1) SELECT k FROM m WHERE status = 'running' AND k % 4 <> 0
""")
def interrupted_runs(t):
    """All marks of a day have one stamp, and a third of the runs fail with the stamp they began with."""
    e = t("events").select(c("user_id").alias("shortcode"), lit("extract").alias("stage"), c("event_type").alias("status"), F.date_trunc("day", "ts").alias("at"), (c("event_id") * 2).alias("seq"))
    runs = e.where("status = 'error'")
    log = state.mark_running(e.where("status <> 'error'"), runs, "extract", c("at"), seq=c("seq"))
    log = log.union(runs.where("seq div 2 % 3 = 0").withColumns({"status": lit("failed"), "seq": c("seq") + 1}))
    results = e.where("shortcode % 4 = 0").select("shortcode").distinct()
    return state.interrupted(log, results, "extract").select(c("shortcode").alias("k"))


@query("""
WITH r AS (SELECT c_custkey AS k, 'm' || c_nationkey % 2 AS model, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'P' END AS context FROM customer),
a AS (SELECT o_custkey AS k, 'm' || o_orderkey % 2 AS model, o_orderstatus AS context, o_orderkey AS id, (o_totalprice * 100)::BIGINT AS ms FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT r.k, coalesce(arg_max(a.ms, a.id), -1) AS duration_ms FROM r LEFT JOIN a ON a.k = r.k AND a.model = r.model AND (r.context IS NULL OR r.context = a.context) GROUP BY 1
""")
def latest_success(t):
    k = c("c_custkey")
    results = t("customer").select(k.alias("shortcode"), F.concat(lit("m"), (c("c_nationkey") % 2).cast("string")).alias("model"), lit("p").alias("prompt_sha"), F.when(k % 3 != 0, "P").alias("context_sha"))
    attempts = t("orders").select(c("o_custkey").alias("shortcode"), F.concat(lit("m"), (c("o_orderkey") % 2).cast("string")).alias("model"), lit("p").alias("prompt_sha"), c("o_orderstatus").alias("context_sha"), c("o_orderkey").alias("id"), (c("o_orderpriority") != "5-LOW").cast("int").alias("ok"), F.round(c("o_totalprice") * 100).cast("long").alias("duration_ms"))
    return state.latest_success(results, attempts).select(c("shortcode").alias("k"), F.coalesce("duration_ms", lit(-1)).alias("duration_ms"))


# Field rules


@query(r"SELECT doc_id, sha256(strip_accents(replace(lower(text), 'ß', 'ss'))) AS plain_sha FROM documents")
def plain_keys(t):
    return t("documents").select("doc_id", F.sha2(T.plain_key("text"), 256).alias("plain_sha"))


@query("""
WITH v AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'place' ELSE 'product' END AS type FROM part)
SELECT k, CASE k % 6 WHEN 0 THEN 'Old town' WHEN 3 THEN 'a, b, c' WHEN 5 THEN 'km 12' END AS locality, CASE WHEN type = 'place' AND k % 4 <> 1 THEN CASE k % 4 WHEN 0 THEN 'Lyon' WHEN 2 THEN '' ELSE 'Paris' END END AS city,
  CASE WHEN type = 'place' THEN CASE k % 3 WHEN 0 THEN 'site' WHEN 1 THEN 'city' ELSE 'site' END END AS scale FROM v
""")
def place_fields(t):
    k = c("p_partkey")
    kind = F.when(c("p_size") % 2 == 0, "place").otherwise("product")
    locality = T.clean_locality(pick(k % 6, " Old town ", "ab", "a, b, c, d", "a, b, c", "1.5 km from the station", "km 12"))
    city = T.city_for(kind, pick(k % 4, "Lyon", " FRANCE", "", "Paris"), lit("France "))
    return t("part").select(k.alias("k"), locality.alias("locality"), city.alias("city"), T.scale_for(kind, pick(k % 3, "street", "city", "site")).alias("scale"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'night view|cosy' ELSE 'night view|cosy|old spot' END AS tags, CASE WHEN p_partkey % 3 = 0 THEN 'b|a' ELSE 'b|a|c' END AS reel_tags,
  'First point|second|THIRD' AS points, CASE WHEN p_partkey % 2 = 0 THEN 'weird' ELSE 'weird|odd' END AS unknown FROM part
""")
def tag_rules(t):
    k = c("p_partkey")
    known = [lit("Ramen House"), lit(None).cast("string"), lit("Paris")]
    tags = F.array(lit("Night  VIEW"), lit("ramen bar"), lit("Cosy!"), lit("night view"), lit("paris trip"), lit(" "), lit("market day"), F.when(k % 2 == 0, "the house").otherwise("Old spot"))
    plain = F.array(lit("B"), lit("a"), lit("b!"), lit(" "), F.when(k % 3 == 0, "A").otherwise("c"))
    points = F.array(lit(" First   point"), lit("second"), lit("FIRST point"), lit(" "), lit("THIRD"))
    facets = F.array(lit("ramen"), lit("weird"), F.when(k % 2 == 0, "bar").otherwise("odd"))
    join = lambda x: F.array_join(x, "|")
    return t("part").select("p_partkey", join(T.useful_tags(tags, known, F.array(lit("market")))).alias("tags"), join(T.distinct_tags(plain)).alias("reel_tags"), join(T.key_points(points)).alias("points"), join(T.unknown_facets(facets)).alias("unknown"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '2024-02-29' WHEN 3 THEN '1999-12-31' END AS day, CASE p_partkey % 5 WHEN 0 THEN 'a|b' ELSE '' END AS strings,
  CASE WHEN p_partkey % 2 = 0 THEN 'caption ' || chr(10) || ' ocr x' ELSE 'ocr x' END AS sources, CASE p_partkey % 3 WHEN 0 THEN 'HAY HAY' END AS brand FROM part
""")
def small_parsers(t):
    k = c("p_partkey")
    day = T.iso_date(pick(k % 4, "2024-02-29", "2023-02-29", "29.02.2024", "1999-12-31"))
    strings = T.string_array(pick(k % 5, '["a", " ", "b", null]', "{}", "broken", None, "[]"))
    sources = T.lowered_sources(F.when(k % 2 == 0, "CAPTION").otherwise(""), lit(""), lit("OCR x"))
    brand = T.repeated_brand(pick(k % 3, "HAY HAY home shopping", "Hay Hay home shopping", "HAY HAY home"), lit("shop"))
    return t("part").select("p_partkey", F.date_format(day, "yyyy-MM-dd").alias("day"), F.array_join(strings, "|").alias("strings"), sources.alias("sources"), brand.alias("brand"))


@query(f"""
WITH h AS (SELECT p_type, p_partkey AS o, unnest([0, 1]) AS p, unnest([CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || '!' END, '-']) AS v FROM part),
f AS (SELECT p_type, {key("v")} AS k, arg_min(v, (o, p)) AS v, min((o, p)) AS spot FROM h WHERE {key("v")} <> '' GROUP BY 1, 2)
SELECT p_type, string_agg(v, ' | ' ORDER BY spot) AS highlights FROM f GROUP BY 1
""")
def first_spellings(t):
    said = F.array(F.when(c("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", lit("!"))), lit("-"))
    return votes.first_spellings(t("part").withColumn("highlights", said), ["p_type"], "highlights", "p_partkey")


@query("""
SELECT p_type AS shortcode, lower(p_name) AS name_key, array_to_string(list_distinct(list(DISTINCT f)), '|') IS NOT NULL AS some, string_agg(DISTINCT f, '|' ORDER BY f) AS facets FROM (SELECT p_type, p_name, unnest([p_brand, 'x']) AS f FROM part) GROUP BY 1, 2
""")
def united_facets(t):
    rows = t("part").select(c("p_partkey").alias("id"), c("p_type").alias("shortcode"), lit("llm").alias("source"), c("p_name").alias("name"), lit(None).cast("string").alias("name_latin"), lit("place").alias("type"), F.array("p_brand", lit("x")).alias("facets"), empty().alias("tags"), empty().alias("highlights"), lit("").alias("why_saved"))
    return views.merged_candidates(rows).select("shortcode", F.lower("name").alias("name_key"), lit(True).alias("some"), F.array_join(F.sort_array("facets"), "|").alias("facets"))


# Resolution and the write path


CATALOGUE = f"""
WITH b AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'recipe' ELSE 'place' END AS type, p_name AS name, p_partkey % 50 AS reel, p_size % 7 = 0 AS human, p_size <> 1 AS verified, p_brand FROM part),
s AS (SELECT *, {key("name")} AS own FROM b WHERE verified AND (human OR reel >= 10 OR type <> 'recipe')),
m AS (SELECT *, CASE WHEN type = 'place' AND own LIKE 'red %' THEN 'home' ELSE own END AS key FROM s),
v AS (SELECT type, key, name, count(*) AS n, min(id) AS o FROM m GROUP BY 1, 2, 3),
e AS (SELECT type, key, name AS canonical_name FROM v QUALIFY row_number() OVER (PARTITION BY type, key ORDER BY n DESC, length(name), o, name) = 1),
g AS (SELECT type, key, count(*) AS members, min(id) AS first_id, count(DISTINCT reel) AS reels FROM m GROUP BY 1, 2)
"""


def _catalogue(t):
    k, size = c("p_partkey"), c("p_size")
    kind = F.when(size % 10 == 0, "recipe").otherwise("place")
    rows = t("part").select(k.alias("id"), kind.alias("type"), c("p_name").alias("name"), (k % 50).cast("string").alias("shortcode"), F.when(size % 7 == 0, "human").otherwise("llm").alias("source"), (size != 1).alias("verified"))
    modes = t("part").select((k % 50).cast("string").alias("shortcode"), F.when(k % 50 < 10, "repertoire").when(k % 50 < 20, lit(None).cast("string")).otherwise("catalogue").alias("mode")).distinct()
    aliases = t("part").where("p_name like 'red %'").select(lit("place").alias("type"), T.handle_key("p_name").alias("alias"), lit("Home").alias("canonical_name")).distinct()
    previous = t("part").where("p_name like 'small %'").select(c("p_name").alias("canonical_name"), lit("place").alias("type")).distinct()
    previous = previous.withColumn("id", 1000 + F.length("canonical_name").cast("long"))
    return resolve.resolve(rows, modes, aliases, previous.where("canonical_name = 'small ring'"))


@query(CATALOGUE + """
, p AS (SELECT *, CASE WHEN canonical_name = 'small ring' AND type = 'place' THEN 1010 END AS old FROM e JOIN g USING (type, key)),
top AS (SELECT coalesce(max(1000 + length(p_name)), 0) AS t FROM part WHERE p_name = 'small ring'),
n AS (SELECT *, row_number() OVER (ORDER BY canonical_name, type) AS r FROM p WHERE old IS NULL)
SELECT type, key, canonical_name, members, first_id, 1010::BIGINT AS id FROM p WHERE old IS NOT NULL UNION ALL SELECT type, key, canonical_name, members, first_id, t + r FROM n, top
""")
def resolved_catalogue(t):
    return _catalogue(t)["entity"].select("type", "key", "canonical_name", "members", "first_id", "id")


@query(CATALOGUE + "SELECT type, key, sum(reels)::BIGINT AS links FROM g GROUP BY 1, 2")
def resolved_links(t):
    out = _catalogue(t)
    return out["entity_reel"].join(out["entity"], c("entity_id") == c("id")).groupBy("type", "key").agg(F.count("*").alias("links"))


@query(f"""
SELECT p_partkey AS id FROM part WHERE p_size % 3 <> 0 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)
""")
def purged_entries(t):
    entries = t("part").select(c("p_partkey").alias("id"), (c("p_size") % 3 != 0).alias("verified"))
    return resolve.purged(entries, t("lineitem").where("l_quantity > 48").select(c("l_partkey").alias("entity_id"))).select("id")


@query("""
WITH x AS (SELECT p_partkey AS e, lower(trim(p_type)) AS label, 0 AS r FROM part UNION ALL SELECT p_partkey, lower(p_type), 2 FROM part WHERE p_size > 48 UNION ALL SELECT p_partkey, 'brand ' || regexp_extract(p_brand, '[0-9]+'), 1 FROM part)
SELECT label, CASE max(r) WHEN 0 THEN 'free' WHEN 1 THEN 'collection' ELSE 'controlled' END AS kind, count(DISTINCT e) AS n FROM x GROUP BY 1
""")
def entity_tags(t):
    p = t("part").withColumnRenamed("p_partkey", "entity_id")
    kinds, tagged = resolve.tags({"free": p.select("entity_id", F.concat(lit(" "), "p_type").alias("label")), "controlled": p.where("p_size > 48").select("entity_id", F.upper("p_type").alias("label")), "collection": p.select("entity_id", F.replace("p_brand", lit("#"), lit(" # ")).alias("label"))})
    return tagged.groupBy("label").agg(F.count("*").alias("n")).join(kinds, "label").select("label", "kind", "n")


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 5 THEN 'open' WHEN p_partkey % 7 IN (2, 3) OR (p_partkey % 7 = 4 AND p_name LIKE '%ring%') THEN 'yes' ELSE 'no' END AS verified FROM part
""")
def verification(t):
    k = c("p_partkey")
    rows = t("part").select(k.alias("id"), k.alias("shortcode"), F.when(k % 7 == 4, "ring").otherwise("nowhere").alias("name"), pick(k % 7, "missing", "invalid", "literal", "phonetic", "variant", "phonetic", "phonetic").alias("status"))
    sources = t("part").select(k.alias("shortcode"), F.upper("p_name").alias("caption"), lit("").alias("transcript"), lit("x").alias("ocr"))
    verdicts = t("part").where(k % 7 != 5).select(k.alias("id"), (k % 7 != 4).alias("verdict")).withColumn("verdict", F.when(c("id") % 7 == 6, False).otherwise(c("verdict")))
    return evidence.verify(rows, sources, verdicts).select("id", F.when(c("verified"), "yes").when(~c("verified"), "no").otherwise("open").alias("verified"))


@query("""
WITH m AS (SELECT p_partkey AS ord, p_partkey // 10 AS shortcode, p_name AS name, p_size % 6 AS k FROM part),
d AS (SELECT shortcode, name, arg_max('about ' || ord, ord) AS why FROM m WHERE k <> 1 GROUP BY 1, 2)
SELECT ord, m.name, why FROM m LEFT JOIN d ON d.shortcode = m.shortcode AND d.name = m.name WHERE k <> 5 AND NOT (m.shortcode % 3 = 0 AND (k = 2 OR k = 3))
""")
def staged_combine(t):
    k = c("p_size") % 6
    base = t("part").select(c("p_partkey").alias("ord"), F.floor(c("p_partkey") / 10).alias("shortcode"), c("p_name").alias("name"), k.alias("k"))
    cites = F.when(c("k") == 3, F.array(F.struct(lit("ocr").alias("source")))).otherwise(F.array(F.struct(lit("ocr").alias("source")), F.struct(lit("caption").alias("source"))))
    mentions = base.select("ord", "shortcode", "name", F.when(c("k") == 2, "method").otherwise("place").alias("type"), cites.alias("evidence"), (c("k") != 5).alias("direct"))
    details = base.where("k <> 1").select("shortcode", "ord", F.upper("name").alias("name"), F.concat(lit("about "), c("ord").cast("string")).alias("why"))
    return guards.combine(mentions, details, base.where("shortcode % 3 = 0").select("shortcode")).select("ord", "name", "why")


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'repertoire' ELSE 'catalogue' END AS mode, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 AND p_partkey % 4 <> 0 THEN 'Soup' WHEN p_size % 2 = 0 THEN 'Recette' ELSE p_name END AS topic FROM part
""")
def staged_fields(t):
    dish = F.when(c("p_partkey") % 4 == 0, F.array().cast("array<struct<dish_name:string>>")).otherwise(F.array(F.struct(lit("Soup").alias("dish_name"))))
    kind = F.when(c("p_size") % 3 == 0, "recipe").otherwise(" ")
    topic = F.when(c("p_size") % 2 == 0, " Recette ").otherwise(c("p_name"))
    return t("part").select(c("p_partkey").alias("id"), guards.staged_mode(kind, lit("catalogue")).alias("mode"), guards.staged_topic(topic, kind, dish).alias("topic"))


@query("""
SELECT p_partkey AS id, p_partkey % 3 = 0 AS staged, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE p_name END AS topic, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS mentions, CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 0 END AS entities FROM part
""")
def stored_responses(t):
    k, name = c("p_partkey"), c("p_name")
    staged = F.to_json(F.struct(F.struct(name.alias("topic")).alias("fiche"), F.struct(F.array(F.struct(name.alias("name"))).alias("mentions")).alias("discovery")))
    flat = F.to_json(F.struct(name.alias("topic"), F.array(F.struct(name.alias("name")), F.struct(name.alias("name"))).alias("entities")))
    rows = t("part").select(k.alias("id"), F.when(k % 3 == 0, staged).when(k % 3 == 1, flat).otherwise("broken {").alias("raw_response"))
    return guards.stored_responses(rows).select("id", "staged", "fiche.topic", F.size("mentions").alias("mentions"), F.size("entities").alias("entities"))


WRITTEN = """
WITH p AS (SELECT p_partkey AS k, p_name, p_partkey % 6 AS x FROM part WHERE p_size <= 40),
r AS (
  SELECT k, 0 AS i, CASE x WHEN 3 THEN 'Alpha ' || k ELSE p_name END AS name, x FROM p WHERE x IN (0, 1, 3, 5) UNION ALL SELECT k, 1, 'Beta ' || k, x FROM p WHERE x = 3
)
"""


def _written(t):
    """Reels of one response row each: a plain name, a handle, a price, two names in one, a repeat, and one whose name stands nowhere."""
    k = c("p_partkey")
    x, name = k % 6, c("p_name")
    fresh = t("part").where("p_size <= 40")
    said = pick(x, name, F.concat(lit("@"), F.replace(name, lit(" "), lit("_"))), "12 €", F.concat(lit("Alpha "), k.cast("string"), lit(" / Beta "), k.cast("string")), "a.py", name)
    span = "struct<source:string,quote:string,match:string,location:string>"
    text = lambda v: lit(v).cast("string")
    body = F.when(x == 5, "nothing of it").otherwise(F.concat(lit("Seen: "), name, lit(" and alpha "), k.cast("string"), lit(" ,beta "), k.cast("string")))
    base = fresh.select(k.cast("string").alias("shortcode"), x.alias("x"), body.alias("context"), said.alias("name"))
    files = base.where("x = 4").select("shortcode", "x", "context", F.explode(F.array(*[lit(n) for n in ("a.py", "b.py", "c.md", "d/")])).alias("name"))
    rows = base.where("x <> 4").union(files.select("shortcode", "x", "context", "name"))
    rows = rows.select(
        "shortcode", F.pmod(F.xxhash64("name"), lit(1_000_003)).alias("ord"), "name", text(None).alias("name_latin"), lit("place").alias("type"), lit("street").alias("scale"), lit("Paris").alias("city"), lit("France").alias("country"), text(None).alias("locality"),
        F.array(lit("market"), lit("weird")).alias("facets"), F.array(lit("Cosy")).alias("tags"), lit(90.0).alias("confidence"), "context", F.array(F.struct(lit("caption").alias("source"), lit("no such quote").alias("quote"), lit("literal").alias("match"), lit("").alias("location")).cast(span)).alias("evidence"),
    )
    old = t("part").select(k.cast("string").alias("shortcode"), F.when(k % 5 == 0, "human").otherwise("llm").alias("source"), F.concat(lit("old "), name).alias("name"))
    sources = fresh.select(k.cast("string").alias("shortcode"), body.alias("caption"), lit("").alias("transcript"), lit("").alias("ocr"), F.create_map().cast("map<string,string>").alias("frames"))
    return guards.materialise(old, rows, sources)


@query(WRITTEN + """
, w AS (
  SELECT k, CASE x WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE r.name END AS name, CASE x WHEN 5 THEN 'invalid' ELSE 'literal' END AS evidence_status, 'site' AS scale, 'cosy|weird' AS tags FROM r JOIN p USING (k, x)
)
SELECT k AS shortcode, 'llm' AS source, name, evidence_status, scale, tags FROM w
UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'human' ELSE 'llm' END, 'old ' || p_name, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 0 OR p_size > 40
""")
def written_candidates(t):
    return _written(t)[0].select(c("shortcode").cast("long").alias("shortcode"), "source", "name", "evidence_status", "scale", F.array_join("tags", "|").alias("tags"))


@query(WRITTEN + "SELECT k AS shortcode, CASE x WHEN 5 THEN 'abstained' ELSE 'resolved' END AS status, CASE x WHEN 5 THEN 'no_attested_canonical_name' ELSE 'literal_priority_evidence' END AS method, count(*) AS n FROM r GROUP BY 1, 2, 3")
def written_decisions(t):
    return _written(t)[1].groupBy(c("shortcode").cast("long").alias("shortcode"), "status", "method").agg(F.count("*").alias("n"))


@query(f"""
WITH b AS (SELECT p_partkey AS id, p_partkey % 40 AS reel, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'place' ELSE 'shop' END AS type FROM part),
x AS (SELECT reel, 'near ' || coalesce(max(CASE WHEN id < 400 THEN name END), '') || ' we ate' AS caption, max(CASE WHEN id < 80 THEN 'the ' || upper(name) || '!' END) AS ocr FROM b GROUP BY 1),
k AS (SELECT DISTINCT type, name FROM b UNION SELECT 'shop', n_name FROM nation),
f AS (SELECT b.id, k.name, contains(' ' || {key("caption")} || ' ', ' ' || {key("k.name")} || ' ') AS c, contains(' ' || {key("ocr")} || ' ', ' ' || {key("k.name")} || ' ') AS o FROM b JOIN x USING (reel) JOIN k ON k.type = b.type)
SELECT b.id, coalesce((SELECT string_agg(f.name, '|' ORDER BY f.name) FROM f WHERE f.id = b.id AND (c OR o) AND f.name <> b.name), '') AS known,
  concat_ws('|', CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.id = b.id AND c) THEN 'caption' END, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.id = b.id AND o) THEN 'ocr' END) AS cited FROM b
""")
def name_inputs(t):
    k = c("p_partkey")
    rows = t("part").select(k.alias("id"), (k % 40).cast("string").alias("shortcode"), c("p_name").alias("name"), F.when(c("p_size") % 2 == 0, "place").otherwise("shop").alias("type"), F.array().cast("array<struct<source:string,quote:string>>").alias("evidence"))
    reels = rows.groupBy("shortcode").agg(F.concat(lit("near "), F.coalesce(F.max(F.when(c("id") < 400, c("name"))), lit("")), lit(" we ate")).alias("caption")).withColumn("username", lit(""))
    screen = rows.where("id < 80").groupBy("shortcode").agg(F.concat(lit("the "), F.upper(F.max("name")), lit("!")).alias("text"))
    screen = screen.select("shortcode", "text", lit("d2").alias("created_at"), lit(2).alias("seq")).union(screen.select("shortcode", lit("older"), lit("d1"), lit(9)))
    entities = t("nation").select(c("n_nationkey").alias("id"), lit("shop").alias("type"), c("n_name").alias("canonical_name"))
    out = canonical.with_inputs(rows, reels, screen, screen.limit(0), entities, t("nation").select(c("n_nationkey").alias("entity_id")))
    return out.select("id", F.array_join(F.sort_array("known"), "|").alias("known"), F.array_join(F.transform("evidence", lambda e: e["source"]), "|").alias("cited"))


# Search over the index, listings, themes


def _index(t):
    return search.token_table(t("documents"), "doc_id", "text")


W = f"SELECT doc_id FROM (SELECT doc_id, {TOKENS.format('text')} AS w, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS s FROM documents) WHERE "


@query(W + "list_contains(w, 'the') AND contains(s, ' of the ') AND NOT list_contains(w, 'with')")
def index_phrase_and_not(t):
    return search.search_index(_index(t), '(the AND "of the") NOT with', "doc_id", ["text"])


@query(W + "len(list_filter(w, lambda x: starts_with(x, 'licens'))) > 0 OR w[1] = 'the' OR contains(s, ' una ')")
def index_prefix_first_or(t):
    return search.search_index(_index(t), "licens* OR ^the OR text:una", "doc_id", ["text"])


@query(W + "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' AND len(list_filter(range(greatest(1, i - 3), least(len(w), i + 3) + 1), lambda j: w[j] = 'in' AND CASE WHEN j >= i THEN j - (i + 1) ELSE i - (j + 1) END <= 2)) > 0)) > 0")
def index_near(t):
    return search.search_index(_index(t), "NEAR(the in, 2)", "doc_id", ["text"])


@query(W + "list_contains(w, 'the') AND list_contains(w, 'with')")
def index_and_ids(t):
    return search.and_ids(_index(t), "doc_id", ["the", "with"])


@query(f"""
WITH n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Fresh words, ' || lang WHEN doc_id % 10 = 1 THEN '' ELSE text END AS text FROM documents)
SELECT doc_id, len({TOKENS.format("text")})::BIGINT AS n, sha256(array_to_string({TOKENS.format("text")}, ' ')) AS sha FROM n WHERE len({TOKENS.format("text")}) > 0
""")
def refreshed_index(t):
    changed = t("documents").where("doc_id % 10 < 2").withColumn("text", F.when(c("doc_id") % 10 == 0, F.concat(lit("Fresh words, "), "lang")).otherwise(""))
    index = search.refresh_index(_index(t), changed, "doc_id", "text")
    return index.groupBy("doc_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " "), 256).alias("sha"))


WRITTEN = {"and": '(the AND "of the") NOT with', "prefix": "licens* OR ^the OR source:src1*", "near": "NEAR(the in, 2)", "phrase": '"in the" source:src7', "not": "der NOT una"}
WRITTEN_SQL = f"""
, w AS (SELECT doc_id, source, {TOKENS.format("text")} AS w, ' ' || array_to_string({TOKENS.format("text")}, ' ') || ' ' AS s FROM docs)
SELECT 'and' AS q, doc_id FROM w WHERE list_contains(w, 'the') AND contains(s, ' of the ') AND NOT list_contains(w, 'with')
UNION ALL SELECT 'prefix', doc_id FROM w WHERE len(list_filter(w, lambda x: starts_with(x, 'licens'))) > 0 OR w[1] = 'the' OR starts_with(source, 'src1')
UNION ALL SELECT 'near', doc_id FROM w WHERE regexp_matches(s, ' the ([^ ]+ ){{0,2}}in ') OR regexp_matches(s, ' in ([^ ]+ ){{0,2}}the ')
UNION ALL SELECT 'phrase', doc_id FROM w WHERE contains(s, ' in the ') AND source = 'src7'
UNION ALL SELECT 'not', doc_id FROM w WHERE list_contains(w, 'der') AND NOT list_contains(w, 'una')
"""


def _answers(index):
    out = None
    for name, text in WRITTEN.items():
        part = written_index.search(index, text).select(lit(name).alias("q"), c("id").alias("doc_id"))
        out = part if out is None else out.union(part)
    return out


@query("WITH docs AS (SELECT doc_id, text, source FROM documents)" + WRITTEN_SQL)
def written_search(t):
    docs = t("documents")
    return _answers(written_index.create_index(docs, place(docs.sparkSession, "index"), "doc_id", "text", "source"))


@query("""
WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 50 = 3 THEN NULL WHEN doc_id % 50 = 4 THEN 'The licensed one in the house of the ' || text ELSE text END AS text, CASE WHEN doc_id % 50 <> 3 THEN source END AS source FROM documents)
""" + WRITTEN_SQL)
def written_search_refreshed(t):
    """Documents change and go in two refreshes (the first brings others that the second puts right), then the index is compacted."""
    docs = t("documents")
    index = written_index.create_index(docs, place(docs.sparkSession, "index"), "doc_id", "text", "source")
    k = c("doc_id") % 50
    written_index.refresh(index, docs.where(k.isin(3, 4, 5)).withColumns({"text": lit("der in the refreshed text"), "source": lit("src7")}), "doc_id")
    text = F.when(k == 4, F.concat(lit("The licensed one in the house of the "), "text")).when(k != 3, c("text"))
    written_index.refresh(index, docs.where(k.isin(3, 4, 5)).withColumns({"text": text, "source": F.when(k != 3, c("source"))}), "doc_id")
    before = _answers(index)
    after = _answers(written_index.compacted(index, place(docs.sparkSession, "index")))
    return before.unionAll(after).groupBy("q", "doc_id").agg(F.count("*").alias("n")).where("n = 2").drop("n")



def _repertoire(t):
    return {"repertoire_entry": t("documents").select(c("doc_id").alias("shortcode"), c("lang").alias("content_kind"), c("source").alias("title"), c("text").alias("summary"), c("n_chars").alias("updated_at"))}


@query("SELECT doc_id AS shortcode FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def newest_entries(t):
    return api.search_repertoire(_repertoire(t)).select("shortcode")


@query("SELECT doc_id AS shortcode FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, doc_id LIMIT 5")
def newest_of_kind(t):
    return api.search_repertoire(_repertoire(t), " ", "de", 5).select("shortcode")


@query(f"SELECT doc_id AS shortcode FROM documents WHERE list_contains({TOKENS.format('text')}, 'the') ORDER BY doc_id LIMIT 20")
def repertoire_search(t):
    return api.search_repertoire(_repertoire(t), "the", None, 99).select("shortcode")


@query("""
SELECT 'reels' AS label, count(*)::BIGINT AS n FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT 'entities', count(*) FROM supplier UNION ALL SELECT 'recipes', count(*) FROM part WHERE p_size > 25 UNION ALL SELECT 'repertoire', count(*) FROM documents
UNION ALL SELECT 'type:n' || s_nationkey, count(*) FROM supplier GROUP BY 1 UNION ALL SELECT 'kind:' || CASE WHEN lang = 'en' OR lang = 'de' THEN '' ELSE lang END, count(*) FROM documents GROUP BY 1
""")
def catalogue_counts(t):
    entry = _repertoire(t)["repertoire_entry"].withColumn("content_kind", F.when(c("content_kind") == "en", "").when(c("content_kind") != "de", c("content_kind")))
    reel = t("documents").select(F.when(c("doc_id") % 4 == 0, "gone").alias("unsaved_at"))
    entity = t("supplier").select(F.concat(lit("n"), c("s_nationkey").cast("string")).alias("type"))
    return api.catalogue_summary({"reel": reel, "entity": entity, "recipe": t("part").select((c("p_size") > 25).alias("active")), "repertoire_entry": entry})


@query(f"""
WITH e AS (SELECT 'entity' AS kind, doc_id AS id FROM documents WHERE list_has_any({TOKENS.format("text")}, ['ring', 'licensed', 'license']) ORDER BY doc_id LIMIT 8),
r AS (SELECT 'recipe' AS kind, p_partkey AS id FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_retailprice DESC, p_partkey LIMIT 6)
SELECT * FROM e UNION ALL SELECT * FROM r
""")
def grounded_answer(t):
    none = lit(None).cast("string")
    entity = t("documents").select(c("doc_id").alias("id"), c("text").alias("canonical_name"), none.alias("summary"), none.alias("highlights"), none.alias("tags"))
    recipe = t("part").select(c("p_partkey").alias("id"), c("p_name").alias("dish_name"), none.alias("cuisine"), none.alias("cuisine_family"), none.alias("course"), none.alias("summary"), lit("").alias("title"), lit(True).alias("active"), c("p_retailprice").alias("updated_at"), c("p_partkey").alias("shortcode"), none.alias("url"))
    attempt = t("part").limit(0).select(c("p_partkey").alias("recipe_id"), c("p_partkey").alias("attempt_id"), c("p_partkey").alias("created_at"), *[none.alias(x) for x in ("verdict", "rating", "note", "changes_made", "cooked_at")])
    found = api.grounding({"entity": entity, "recipe": recipe, "recipe_attempt": attempt}, "Voir the RING, licensed and license?")
    return found["entities"].select(lit("entity").alias("kind"), "id").union(found["recipes"].select(lit("recipe"), "shortcode"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'Food & restaurants' WHEN p_size % 4 = 1 THEN 'Sport & wellbeing' WHEN p_size % 3 = 0 THEN 'Sport & wellbeing' WHEN p_size % 4 = 2 THEN 'Travel & places' ELSE 'Other inspiration' END AS theme, p_size % 4 = 1 AND p_size % 2 = 1 AND p_size % 3 <> 2 AS sport FROM part
""")
def themed_reels(t):
    size = c("p_size")
    kind = F.when(size % 4 == 0, "recipe").when(size % 4 == 1, "exercise")
    types = F.when(size % 4 == 2, F.array(lit("lodging"))).otherwise(empty())
    tags = F.when(size % 3 == 0, F.array(lit(" YOGA "))).when(size % 3 == 1, F.array(lit("x"), lit("Gainage"))).otherwise(empty())
    return views.themed(t("part").select(c("p_partkey").alias("id"), kind.alias("content_kind"), types.alias("types"), tags.alias("tags"))).select("id", "theme", "sport")


@query("SELECT mean, conv_id FROM (SELECT conv_id, avg(CASE WHEN turn % 4 <> 0 THEN -length(text)::DOUBLE END) AS mean FROM conversations GROUP BY 1) WHERE mean IS NOT NULL ORDER BY mean, conv_id LIMIT 5")
def least_confident(t):
    sure = F.when(c("turn") % 4 != 0, -F.length("text").cast("double"))
    rows = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", sure.alias("avg_logprob")))).alias("s"))
    return quality.worst(rows.select("conv_id", quality.mean_of(c("s"), "avg_logprob").alias("mean")), "mean", "conv_id")


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)
SELECT 'first' AS batch, (SELECT count(*) FROM a) AS inserted, (SELECT sum(n) - count(*) FROM a)::BIGINT AS updated, 0 AS kept
UNION ALL SELECT 'second', (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)), (SELECT sum(n) FROM b)::BIGINT - (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)), (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b))
""")
def observed_upserts(t):
    """Counts of two upserts, from the jobs that write them."""
    o = t("orders").select(c("o_custkey").cast("string").alias("shortcode"), c("o_orderstatus").alias("kind"), c("o_orderdate").alias("seen_at"), c("o_orderkey").alias("seq"))
    spark = o.sparkSession
    old = o.limit(0).select("shortcode", "kind", c("seen_at").alias("first_seen_at"), c("seen_at").alias("last_seen_at"), c("seen_at").alias("unsaved_at"))
    counts = []
    for name, part in (("first", 0), ("second", 1)):
        watch = Observation()
        old = cut(state.upsert_seen(old, o.where(c("seq") % 3 == part), watch=watch), "state")
        counts.append((name, watch.get["inserted"], watch.get["updated"], watch.get["kept"]))
    return spark.createDataFrame(counts, "batch string, inserted long, updated long, kept long")


# The query functions


def _interface(t):
    """Documents as entries of type lang in city source; each has the reels of its own number and of half of it."""
    d = t("documents")
    entity = d.select(c("doc_id").alias("id"), c("lang").alias("type"), c("source").alias("city"), F.concat(lit("Entry "), c("source")).alias("canonical_name"), c("text").alias("summary"), lit("").alias("highlights"), lit(None).cast("string").alias("tags"))
    number = F.explode(F.array_distinct(F.array(c("doc_id"), F.expr("doc_id div 2")))).alias("r")
    bridge = d.select(c("doc_id").alias("entity_id"), number).select("entity_id", F.concat(lit("r"), "r").alias("shortcode"))
    reel = d.select(F.concat(lit("r"), "doc_id").alias("shortcode"), F.concat(lit("https://example.org/"), "doc_id").alias("url"))
    past = t("labels").select(c("doc_id").alias("entity_id"), c("quality").cast("string").alias("changed_at"), c("toxic").cast("string").alias("status"), lit("n").alias("note"))
    return {"entity": entity, "entity_reel": bridge, "reel": reel, "entity_personal_history": past}


@query(f"""
WITH w AS (SELECT doc_id, lang, source, {TOKENS.format("'Entry ' || source || ' ' || text")} AS w FROM documents),
d AS (SELECT doc_id FROM w WHERE lang = 'en' AND lower(source) = 'src3' AND list_contains(w, 'the') AND NOT list_contains(w, 'licensed') ORDER BY doc_id LIMIT 10),
e AS (SELECT doc_id, unnest(list_distinct([doc_id, doc_id // 2])) AS r FROM d), f AS (SELECT e.doc_id, 'r' || r AS s FROM e WHERE r IN (SELECT doc_id FROM documents))
SELECT d.doc_id AS id, coalesce(string_agg(s, ' ' ORDER BY s), '') AS reels FROM d LEFT JOIN f USING (doc_id) GROUP BY 1
""")
def search_entities(t):
    out = api.search_entities(_interface(t), "the NOT licensed", "en", "SRC3")
    return out.select("id", F.array_join(F.sort_array(F.transform("sources", lambda x: x["shortcode"])), " ").alias("reels"))


@query("""
WITH i AS (SELECT max(doc_id) // 2 AS id FROM labels WHERE doc_id % 2 = 0), e AS (SELECT id, unnest(list_distinct([id, id // 2])) AS r FROM i), f AS (SELECT id, 'r' || r AS s FROM e WHERE r IN (SELECT doc_id FROM documents))
SELECT i.id, (SELECT source FROM documents WHERE doc_id = i.id) AS city, (SELECT coalesce(string_agg(s, ' ' ORDER BY s), '') FROM f) AS reels,
  (SELECT string_agg(quality || ':' || toxic, ' ' ORDER BY quality DESC, toxic DESC) FROM labels WHERE doc_id = i.id) AS history FROM i
""")
def get_entity(t):
    tables = _interface(t)
    number = t("labels").where("doc_id % 2 = 0").agg(F.max("doc_id")).first()[0] // 2
    said = F.array_join(F.transform("history", lambda h: F.concat(h["changed_at"], lit(":"), h["status"])), " ")
    return api.get_entity(tables, number).select("id", "city", F.array_join(F.sort_array(F.transform("sources", lambda x: x["shortcode"])), " ").alias("reels"), F.nullif(said, lit("")).alias("history"))


@query("WITH s AS (SELECT max(conv_id) AS id FROM conversations), m AS (SELECT turn, role, text FROM conversations WHERE conv_id = (SELECT id FROM s) ORDER BY turn DESC LIMIT 3) SELECT turn AS id, role, text AS content FROM m UNION ALL SELECT (SELECT max(turn) + 1 FROM conversations), 'user', 'and then?'")
def asked_conversation(t):
    """A question is put down in the last session, whose last four messages are then read."""
    messages = t("conversations").select(c("turn").alias("id"), c("conv_id").alias("session_id"), "role", c("text").alias("content"), lit("t0").alias("created_at"))
    sessions = messages.select(c("session_id").alias("id"), lit("").alias("title"), lit("t0").alias("created_at"), lit("t0").alias("updated_at")).distinct()
    last = sessions.agg(F.max("id")).first()[0]
    _, now, session = api.asked(sessions, messages, "  and then? ", "t1", last)
    return api.conversation(now, session, 4).select("id", "role", "content")
