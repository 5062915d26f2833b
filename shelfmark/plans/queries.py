"""Every operator over the test tables, beside SQL that says the same.

Stand-ins: documents are reels (text: caption, source: account), labels verification, events the log of stages,
conversations messages, orders attempts, part candidates, supplier and lineitem entries and their bridge.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import attest, canonical, evidence, guards, quality, queues, resolve, search, state, views, votes
from shelfmark.plans.registry import ORACLE_SQL, QUERIES, query
from shelfmark.sources import media

__all__ = ["ORACLE_SQL", "QUERIES"]

KEY = r"trim(regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
TOKENS = r"list_filter(string_split_regex(strip_accents(lower(coalesce({}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
DAY, STAMP = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def key(c: str) -> str:
    return KEY.format(c)


def tokens(c: str) -> str:
    return TOKENS.format(c)


# Latest attempts, listings, pages


@query(r"""
WITH latest AS (SELECT o_custkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
SELECT c_custkey, c_name, o_orderpriority AS verdict, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END::INT AS verdict_rank
FROM customer LEFT JOIN latest ON o_custkey = c_custkey AND n = 1
""")
def latest_attempt_ranked(t):
    log = t("orders").where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp"))
    rows = views.with_latest(t("customer"), log, "c_custkey", "o_custkey", ["o_orderpriority"], "o_orderdate", "o_orderkey")
    rank = views.rank_of(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "4-NOT SPECIFIED": 4})
    return rows.select("c_custkey", "c_name", F.col("o_orderpriority").alias("verdict"), rank.alias("verdict_rank"))


RECIPES_SQL = """
WITH a AS (SELECT o_custkey AS recipe_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'favorite' WHEN '2-HIGH' THEN 'liked' WHEN '3-MEDIUM' THEN 'want_to_try' WHEN '4-NOT SPECIFIED' THEN 'disappointing' ELSE 'meh' END AS verdict
    FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
r AS (SELECT p_partkey AS id, p_name AS dish_name, verdict, p_retailprice AS updated_at, CASE verdict WHEN 'favorite' THEN 0 WHEN 'liked' THEN 1 WHEN 'want_to_try' THEN 2 WHEN 'disappointing' THEN 4 ELSE 5 END AS r
    FROM part LEFT JOIN a ON recipe_id = p_partkey WHERE p_size < 40)
"""


def _recipes(t):
    verdict = F.create_map(*[F.lit(x) for x in ("1-URGENT", "favorite", "2-HIGH", "liked", "3-MEDIUM", "want_to_try", "4-NOT SPECIFIED", "disappointing")])[F.col("o_orderpriority")]
    empty = F.lit(None).cast("string")
    attempts = t("orders").select(F.col("o_custkey").alias("recipe_id"), F.coalesce(verdict, F.lit("meh")).alias("verdict"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("attempt_id"), *[empty.alias(c) for c in ("rating", "note", "changes_made", "cooked_at")])
    recipes = t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("dish_name"), F.col("p_type").alias("cuisine"), F.col("p_brand").alias("cuisine_family"), F.lit("main").alias("course"), empty.alias("summary"), F.lit("").alias("title"), (F.col("p_size") < 40).alias("active"), F.col("p_retailprice").alias("updated_at"))
    return recipes, attempts


@query(RECIPES_SQL + "SELECT id, dish_name, verdict FROM r ORDER BY r, updated_at DESC, id LIMIT 20")
def ranked_listing(t):
    return views.ranked_recipes(*_recipes(t)).select("id", "dish_name", "verdict")


@query(RECIPES_SQL + "SELECT id, dish_name FROM r WHERE verdict IS NULL AND dish_name ILIKE '%ring%' ORDER BY r, updated_at DESC, id LIMIT 50")
def untried_recipes(t):
    return views.ranked_recipes(*_recipes(t), verdict="untried", text="ring", limit=50).select("id", "dish_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def pagination(t):
    return views.page(t("orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE (p_name ILIKE '%re%' OR p_type ILIKE '%re%') AND (lower(p_brand) = 'brand#11' OR lower(p_type) = 'brand#11') AND p_size <= 25")
def optional_filters(t):
    out = views.filtered(t("part"), {"p_brand|p_type": "Brand#11", "p_name": None}, "re", ("p_name", "p_type"), {"p_size": 25, "p_retailprice": None})
    return out.select("p_partkey", "p_name", "p_brand")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 12")
def last_messages(t):
    return views.last_messages(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12")
def top_n_per_group(t):
    return state.top_per_key(t("events"), ["user_id"], 12, F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id")


# Queues


@query("""
WITH i AS (SELECT o_orderkey AS k, o_orderdate, o_orderkey % 5 = 0 AS gone, o_orderkey % 8 AS h, o_custkey % 5 AS attempts FROM orders)
SELECT k, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS taken_at FROM i WHERE NOT gone AND (h < 2 OR h IN (2, 3) OR (h IN (4, 5) AND attempts < 3))
""")
def retry_queue(t):
    """Orders as items: a fifth not saved any more; in stage asr an eighth each done, running, and two eighths failed 0 to 4 times, without a state, or with one of another stage."""
    k, h = F.col("o_orderkey"), F.col("o_orderkey") % 8
    items = t("orders").select(k.alias("shortcode"), F.col("o_orderdate").alias("taken_at"), F.when(k % 5 == 0, "gone").alias("unsaved_at"))
    status = F.when(h.isin(4, 5), "failed").when(h == 6, "done").when(h == 7, "running").otherwise("failed")
    log = t("orders").where(h >= 2).select(k.alias("shortcode"), F.when(h.isin(2, 3), "ocr").otherwise("asr").alias("stage"), status.alias("status"), F.when(h.isin(2, 3), 9).otherwise(F.col("o_custkey") % 5).alias("attempts"))
    return queues.retry_queue(items, log, "asr").select(F.col("shortcode").alias("k"), F.date_format("taken_at", STAMP).alias("taken_at"))


@query("""
WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'error') AS attempts, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1, 2)
SELECT user_id, day, attempts, CASE status WHEN 'error' THEN 'failed' ELSE status END AS status FROM d
""")
def folded_attempts(t):
    log = t("events").select("user_id", F.date_format("ts", DAY).alias("day"), "ts", "event_id", F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("status"), F.col("props").alias("error"))
    return state.fold_attempts(log, ["user_id", "day"], "ts", "event_id").select("user_id", "day", "attempts", "status")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def version_queue(t):
    made = t("labels").select("doc_id", F.lit("v1").alias("tool_version"))
    return queues.version_queue(t("documents"), made, "v1", key="doc_id").select("doc_id", "lang")


@query("""
SELECT d.doc_id FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
  AND NOT EXISTS (SELECT 1 FROM documents e JOIN labels m ON m.doc_id = e.doc_id WHERE e.doc_id = d.doc_id AND m.quality = 1 AND substr(sha256(e.lang), 1, 12) = substr(sha256('en'), 1, 12))
""")
def staleness_queue(t):
    done = t("documents").join(t("labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", T.fingerprint(F.col("lang")).alias("context_sha"))
    current = {"context_sha": _sha12("en")}
    return queues.stale_queue(t("documents"), [t("labels")], done, current, key="doc_id", order="doc_id").select("doc_id")


def _sha12(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:12]


@query("""
WITH s AS (SELECT event_id, coalesce(sum((event_type = 'purchase')::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
SELECT event_id FROM s WHERE before < 100
""")
def success_quota(t):
    return queues.quota(t("events").withColumn("ok", F.col("event_type") == "purchase"), "ok", 100, "event_id").select("event_id")


# Counts and pivots


@query("""
SELECT user_id, count(DISTINCT event_type)::BIGINT AS stages,
  max(CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END) AS click, max(CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END) AS error,
  max(CASE WHEN event_type = 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END) AS purchase, max(CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END) AS signup,
  max(CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END) AS "view"
FROM events GROUP BY 1
""")
def stage_status_pivot(t):
    stages = ["click", "error", "purchase", "signup", "view"]
    pivot = views.status_pivot(t("events"), "user_id", "event_type", F.date_format("ts", STAMP), stages)
    met = [F.col(s).isNotNull().cast("long") for s in stages]
    return pivot.select("user_id", sum(met[1:], met[0]).alias("stages"), *stages)


@query("""
SELECT 'documents' AS label, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents
UNION ALL SELECT 'good', count(*) FROM labels WHERE quality = 1 UNION ALL SELECT 'messages', count(*) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages
""")
def counts_bundle(t):
    docs, labels = t("documents"), t("labels")
    return votes.labelled_counts({"documents": docs, "labels": labels, "sources": docs.select("source").where("source is not null").distinct(), "good": labels.where("quality = 1"), "messages": t("conversations"), "pages": t("pages")})


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def group_count_ordered(t):
    return votes.group_counts(t("part"), "p_type", limit=10)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def stage_status_counts(t):
    return votes.group_counts(t("lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey")
def distinct_over_join(t):
    df = t("lineitem").select("l_suppkey", "l_partkey").join(t("part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return df.join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select("s_nationkey", "p_brand").distinct()


@query("SELECT DISTINCT v AS option FROM (SELECT p_brand AS v FROM part UNION ALL SELECT p_type FROM part) WHERE v <> ''")
def filter_options(t):
    return views.options(t("part"), "p_brand", "p_type")


# State


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '2024-06-01' END AS unsaved_at FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def soft_delete_mark_absent(t):
    rows = t("documents").select("doc_id", F.lit(None).cast("string").alias("unsaved_at"))
    return state.mark_absent(rows, t("labels"), F.lit("2024-06-01"), key="doc_id")


@query("""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen_at,
  coalesce(arg_max(event_type, (ts, event_id)) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), arg_max(event_type, (ts, event_id))) AS kind
FROM events GROUP BY 1
""")
def upsert_first_last_seen(t):
    rows = t("events").select(F.col("user_id").cast("string").alias("shortcode"), F.col("event_type").alias("kind"), F.col("ts").alias("seen_at"), F.col("event_id").alias("seq"))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    none = rows.limit(0).select("shortcode", "kind", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), F.col("seen_at").alias("unsaved_at"))
    out = state.upsert_seen(state.upsert_seen(none, rows.where(F.col("seen_at") < cut)), rows.where(F.col("seen_at") >= cut))
    return out.select(F.col("shortcode").cast("long").alias("user_id"), F.date_format("first_seen_at", STAMP).alias("first_seen_at"), F.date_format("last_seen_at", STAMP).alias("last_seen_at"), "kind")


@query("""
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate >= TIMESTAMP '1997-01-01', l_orderkey, l_linenumber, l_quantity) = 1
""")
def first_wins_bridge(t):
    rows, keys, order = t("lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"), ["l_suppkey", "l_partkey"], ("l_orderkey", "l_linenumber", "l_quantity")
    early = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    old = state.first_per_key(rows.where(early), keys, *order)
    return state.insert_missing(old, rows.where(~early), keys, *order).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


@query("""
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1997-06-01')
""")
def orphan_purge(t):
    alive = t("lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1997-06-01").cast("timestamp")))
    return state.orphans(t("part"), alive, "p_partkey", "l_partkey").select("p_partkey")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT o_custkey, o_orderstatus AS status, o_totalprice AS score, c AS changes FROM r WHERE n = 1
""")
def feedback_current_history(t):
    log = t("orders")
    history = log.groupBy("o_custkey").agg(F.count("*").alias("changes"))
    now = state.latest_per_key(log, ["o_custkey"], "o_orderdate", "o_orderkey")
    return now.join(history, "o_custkey").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"), "changes")


@query("""
SELECT n_nationkey, n_name, CASE WHEN s.k IS NULL THEN FALSE ELSE TRUE END AS active FROM nation LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000) s ON s.k = n_nationkey
""")
def active_flags(t):
    old = t("nation").select("n_nationkey", "n_name", F.lit(True).alias("active"), F.lit(1).alias("scope"))
    present = t("supplier").where("s_acctbal > 9000").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name", F.lit(1).alias("scope")).distinct()
    return state.sync_active(old, present, ["n_nationkey"], "scope", old.select("scope")).select("n_nationkey", "n_name", "active")


# Votes and resolution


@query("""
WITH c AS (SELECT user_id, trim(event_type) AS v, count(*) AS n, min(event_id) AS o FROM events WHERE trim(event_type) <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(v), o, v) AS k FROM c)
SELECT user_id, max(CASE WHEN k = 1 THEN v END) AS event_type, coalesce(string_agg(CASE WHEN k > 1 THEN v END, '|' ORDER BY v), '') AS rejected FROM r GROUP BY 1
""")
def majority_vote_conflicts(t):
    return votes.majority(t("events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", F.array_join("rejected", "|").alias("rejected"))


@query("""
WITH c AS (SELECT p_type, p_size, trim(p_name) AS v, count(*) AS n, min(p_partkey) AS o FROM part GROUP BY 1, 2, 3)
SELECT p_type, p_size, v AS canonical_name FROM c QUALIFY row_number() OVER (PARTITION BY p_type, p_size ORDER BY starts_with(v, '@'), n DESC, length(v), o, v) = 1
""")
def canonical_pick(t):
    return votes.elected_name(t("part"), ["p_type", "p_size"], ["p_name"], "p_partkey")


@query(f"""
WITH base AS (SELECT p_type AS type, {key("p_name")} AS key, p_partkey AS id, trim(p_name) AS name, trim(p_brand) AS brand, p_size FROM part),
n AS (SELECT type, key, name, row_number() OVER (PARTITION BY type, key ORDER BY starts_with(name, '@'), count(*) DESC, length(name), min(id), name) AS k FROM base GROUP BY type, key, name),
b AS (SELECT type, key, brand, row_number() OVER (PARTITION BY type, key ORDER BY count(*) DESC, length(brand), min(id), brand) AS k FROM base WHERE brand <> '' GROUP BY type, key, brand),
bb AS (SELECT type, key, max(CASE WHEN k = 1 THEN brand END) AS brand, coalesce(string_agg(CASE WHEN k > 1 THEN brand END, '|' ORDER BY brand), '') AS brand_conflicts FROM b GROUP BY 1, 2),
g AS (SELECT type, key, count(*) AS members, min(id) AS first_id, string_agg(DISTINCT lpad(p_size::VARCHAR, 3, '0'), '|' ORDER BY lpad(p_size::VARCHAR, 3, '0')) AS sizes FROM base GROUP BY 1, 2)
SELECT type, key, name AS canonical_name, brand, brand_conflicts, members, first_id, sizes FROM n JOIN bb USING (type, key) JOIN g USING (type, key) WHERE n.k = 1
""")
def resolve_entities(t):
    part = t("part")
    candidates = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), "p_size", F.lit(True).alias("verified"), F.lit("llm").alias("source"), F.lit(None).cast("string").alias("shortcode"))
    rows = resolve.blocked(resolve.selected(candidates))
    entries = resolve.grouped(rows, ("brand",))
    sizes = rows.withColumn("__s", F.lpad(F.col("p_size").cast("string"), 3, "0")).groupBy("type", "key").agg(votes.joined_set("__s", "|").alias("sizes"))
    conflicts = F.coalesce(F.array_join(F.col("conflicts")["brand"], "|"), F.lit(""))
    return entries.join(sizes, ["type", "key"]).select("type", "key", "canonical_name", "brand", conflicts.alias("brand_conflicts"), "members", "first_id", "sizes")


@query("""
WITH u AS (SELECT lower(trim(p_type)) AS label, 0 AS r FROM part UNION ALL SELECT lower(trim(p_type)), 1 FROM part WHERE p_size > 48 UNION ALL SELECT lower(trim(p_brand)), 2 FROM part WHERE p_size > 45 UNION ALL SELECT lower(trim(p_brand)), 0 FROM part)
SELECT label, CASE max(r) WHEN 0 THEN 'free' WHEN 1 THEN 'collection' ELSE 'controlled' END AS kind FROM u GROUP BY 1
""")
def tag_kind_promotion(t):
    part = t("part")
    sources = [("free", part, "p_type"), ("collection", part.where("p_size > 48"), "p_type"), ("controlled", part.where("p_size > 45"), "p_brand"), ("free", part, "p_brand")]
    rows = None
    for kind, df, c in sources:
        one = df.select(F.lower(F.trim(c)).alias("label"), F.lit(kind).alias("kind"))
        rows = one if rows is None else rows.union(one)
    return votes.promoted(rows, "label", "kind", {"free": 0, "collection": 1, "controlled": 2})


@query(f"SELECT p_type, p_brand, {key('p_name')} AS name_key, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2, 3")
def dedupe_first_occurrence(t):
    rows = t("part").select(F.col("p_type").alias("shortcode"), F.col("p_brand").alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("«"), F.col("p_name"), F.lit("»"))).alias("name"), F.col("p_partkey").alias("ord"))
    return guards.without_repeats(rows).select(F.col("shortcode").alias("p_type"), F.col("type").alias("p_brand"), T.name_key("name").alias("name_key"), F.col("ord").alias("p_partkey"))


@query(f"SELECT arg_min(doc_id, doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY {key('text')}")
def texts_by_key(t):
    # Grouped by a digest of the key: texts needn't be shuffled.
    keyed = t("documents").select("doc_id", F.sha2(T.name_key("text"), 256).alias("k"))
    return keyed.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("""
WITH w AS (SELECT s_nationkey, l_suppkey::VARCHAR AS v, min((l_orderkey * 10 + l_linenumber, l_partkey)) AS o FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT s_nationkey, string_agg(v, '|' ORDER BY o, v) AS merged FROM w GROUP BY 1
""")
def ordered_union(t):
    rows = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.select("s_nationkey", F.array(F.col("l_suppkey").cast("string"), F.lit(" ")).alias("merged"), F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_partkey").alias("o"))
    return votes.ordered_union(rows, ["s_nationkey"], "merged", "o").select("s_nationkey", F.array_join("merged", "|").alias("merged"))


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE trim(event_type) <> '' AND trim(event_type) <> coalesce(trim(b), '')
""")
def consecutive_dedupe(t):
    rows = t("events").withColumn("o", F.struct("ts", "event_id"))
    return media.consecutive_distinct(rows, "user_id", "o", "event_type").select("event_id", "user_id", "event_type")


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, count(*) OVER (PARTITION BY l_suppkey, l_partkey) AS c FROM lineitem) WHERE c < 4")
def group_size_guard(t):
    rows = t("lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return guards.small_groups(rows, ["l_suppkey", "l_partkey"], 3)


@query("""
WITH n AS (SELECT p_partkey, p_partkey // 7 AS g, p_size % 2 = 0 AS f FROM part)
SELECT p_partkey FROM (SELECT *, count(*) FILTER (WHERE f) OVER (PARTITION BY g) AS c FROM n) WHERE NOT f OR c < 4
""")
def file_listings(t):
    end = F.when(F.col("p_size") % 4 == 0, ".py").when(F.col("p_size") % 2 == 0, "/").otherwise("")
    rows = t("part").select(F.floor(F.col("p_partkey") / 7).alias("shortcode"), F.concat("p_name", end).alias("name"), "p_partkey")
    return guards.without_listings(rows).select("p_partkey")


# Text


@query(f"SELECT doc_id, sha256({key('text')}) AS key_sha FROM documents")
def normalised_key(t):
    return t("documents").select("doc_id", F.sha2(T.name_key("text"), 256).alias("key_sha"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(strip_accents(lower(trim(text, E' \n\t\r'))), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))) AS tag_sha FROM documents")
def norm_tag(t):
    return t("documents").select("doc_id", F.sha2(T.tag_key("text"), 256).alias("tag_sha"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '#([\p{L}\p{N}\p{M}_]+)'))::INT AS hashtags, len(regexp_extract_all(text, '@([\p{L}\p{N}\p{M}_.]+)'))::INT AS mentions, len(regexp_extract_all(text, 'https?://\S+'))::INT AS links,
  regexp_matches(text, '(?i)(all the (locations|places|spots)|\b\d+\s*(spots|places|lieux|adresses|restos)\b|compilation|liste|thread|save this|enregistre)') AS has_list_marker FROM documents
""")
def extract_tokens(t):
    c = media.caption_context(F.col("text"))
    return t("documents").select("doc_id", *[F.size(c[k]).alias(k) for k in ("hashtags", "mentions", "links")], c["has_list_marker"].alias("has_list_marker"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'reel' WHEN o_orderkey % 10 = 8 THEN 'carousel' WHEN o_orderkey % 10 = 2 THEN 'video' ELSE 'post' END AS kind, CASE WHEN o_orderkey % 150 > 1 AND o_orderkey % 150 <= 100 THEN (o_orderkey % 150)::DOUBLE / 100 ELSE (o_orderkey % 150)::DOUBLE END AS confidence FROM orders")
def media_kind_case(t):
    kind = media.media_kind(F.when(F.col("o_orderstatus") == "F", "clips"), (F.col("o_orderkey") % 10).cast("int"))
    return t("orders").select("o_orderkey", kind.alias("kind"), T.ratio_of_percent((F.col("o_orderkey") % 150).cast("double")).alias("confidence"))


@query(r"""
WITH v AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || p_name || ' ' WHEN 2 THEN 'n/a' WHEN 3 THEN 'unknown ' WHEN 4 THEN NULL WHEN 5 THEN ' INCONNU' ELSE p_name END AS v FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 7 IN (1, 6) THEN trim(v) END AS kept FROM v
""")
def blank_to_null(t):
    k = F.col("p_partkey") % 7
    said = F.when(k == 0, "  ").when(k == 1, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 2, "n/a").when(k == 3, "unknown ").when(k == 4, F.lit(None).cast("string")).when(k == 5, " INCONNU").otherwise(F.col("p_name"))
    return t("part").select("p_partkey", T.blank_to_null(said).alias("kept"))


@query(r"SELECT doc_id, sha256(CASE WHEN len(p) > 0 THEN array_to_string(p, '§') ELSE trim(text) END) AS pieces, greatest(len(p), 1)::INT AS n FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\s*[|/;]\s*|\s+·\s+'), lambda p: trim(p)), lambda p: length(p) > 1) AS p FROM documents)")
def split_names(t):
    return t("documents").select("doc_id", T.let(T.split_names(F.col("text")), lambda p: F.struct(F.sha2(F.array_join(p, "§"), 256).alias("pieces"), F.size(p).alias("n"))).alias("s")).select("doc_id", "s.*")


@query("SELECT s_suppkey, 'https://www.google.com/maps/search/?api=1&query=' || replace(url_encode(trim(s_name) || ' ' || n_name || ' ' || r_name), '%20', '+') AS url FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def maps_url(t):
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t("supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", T.maps_url(F.trim("s_name"), F.col("n_name"), F.col("r_name")).alias("url"))


@query(r"SELECT doc_id, CASE WHEN length(t) > 72 THEN substr(t, 1, 72) || '…' ELSE t END AS title, replace(substr(text, 1, 80), chr(10), ' ') AS preview, (length(text) // 3)::BIGINT AS est_tokens FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def title_preview(t):
    return t("documents").select("doc_id", T.title(F.col("text")).alias("title"), T.preview(F.col("text")).alias("preview"), T.token_estimate(F.col("text")).alias("est_tokens"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+'), lambda w: length(w) >= 3 AND w NOT IN ('avec','dans','pour','quel','quelle','quels','quelles','des','les','une','est','sur','the','and','que','mon','mes','moi','voir','trouver','veux'))[1:6], ' ') AS terms FROM conversations WHERE role = 'user'")
def question_terms(t):
    return t("conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(T.question_terms(F.col("text")), " ").alias("terms"))


@query("SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n, sum(value)::BIGINT AS total FROM (SELECT props, round(value * 100)::BIGINT AS value FROM events) GROUP BY 1")
def json_unnest(t):
    k = F.from_json("props", "k bigint")["k"]
    return t("events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))


@query("""
WITH p AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '["' || event_type || '","x y"]' WHEN 1 THEN '[1,"' || event_id || '",null,{"k":2},[3],true]' WHEN 2 THEN '{"tags":["a"]}' WHEN 3 THEN '["cut off' WHEN 4 THEN '[]' WHEN 5 THEN NULL ELSE '"' || event_type || '"' END AS tags FROM events),
a AS (SELECT event_id, tags, json_array_length(tags)::INT AS n FROM p WHERE tags IS NOT NULL AND json_valid(tags) AND json_type(tags) = 'ARRAY'),
e AS (SELECT event_id, tags, unnest(range(n))::INT AS pos FROM a)
SELECT event_id, pos, CASE json_type(tags, '$[' || pos || ']') WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'bigint' WHEN 'NULL' THEN 'void' ELSE lower(json_type(tags, '$[' || pos || ']')) END AS kind, json_extract(tags, '$[' || pos || ']')::VARCHAR AS value FROM e
""")
def json_elements(t):
    k, kind = F.col("event_id") % 7, F.col("event_type")
    quoted = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    mixed = quoted('[1,"', F.col("event_id").cast("string"), '",null,{"k":2},[3],true]')
    tags = F.when(k == 0, quoted('["', kind, '","x y"]')).when(k == 1, mixed).when(k == 2, '{"tags":["a"]}').when(k == 3, '["cut off').when(k == 4, "[]").when(k == 6, quoted('"', kind, '"'))
    return media.json_elements(t("events").withColumn("tags", tags), "tags", "event_id")



@query("""
WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'CAPTION:' || chr(10) || text END AS a, CASE WHEN turn % 2 = 0 AND trim(text) <> '' THEN 'SCREEN TEXT:' || chr(10) || text END AS b, 'ROLE:' || chr(10) || role AS c FROM conversations),
p AS (SELECT conv_id, turn, concat_ws(chr(10) || chr(10), a, b, c) AS part FROM m)
SELECT conv_id, sha256(string_agg(part, chr(10) || '--- frame ---' || chr(10) ORDER BY turn)) AS dossier_sha FROM p GROUP BY 1
""")
def dossier_text(t):
    c = F.col
    part = views.dossier([("CAPTION", F.when(c("turn") % 3 == 0, c("text"))), ("TRANSCRIPT", F.lit("  ")), ("SCREEN TEXT", F.when(c("turn") % 2 == 0, c("text"))), ("ROLE", c("role"))])
    rows = t("conversations").select("conv_id", "turn", part.alias("part"))
    return rows.groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n--- frame ---\n"), 256).alias("dossier_sha"))


@query("""
WITH w AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'never {closed ' ELSE '' END AS k, role FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN '{bad}' WHEN 3 THEN '{"a":"}{ ' || role || '","at":{"turn":' || turn || '}}' END AS object FROM w
""")
def first_json_object(t):
    k, c = F.col("turn") % 4, F.col
    nested = F.concat(F.lit('said {"a":"}{ '), c("role"), F.lit('","at":{"turn":'), c("turn").cast("string"), F.lit("}} and {more}"), c("text"))
    body = F.when(k == 0, "none").when(k == 1, F.concat(F.lit("never {closed "), F.replace(F.replace(c("text"), F.lit("}"), F.lit("")), F.lit("{"), F.lit("")))).when(k == 2, F.concat(F.lit("Answer: {bad} "), "text")).otherwise(nested)
    return media.first_json_object(t("conversations").select("conv_id", "turn", body.alias("body")), "body").select("conv_id", "turn", "object")


# Search


def _searched(t, text_query: str):
    return search.search(t("documents"), text_query, ["text"], "doc_id").select("doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {tokens('text')} AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'with') ORDER BY doc_id")
def fts_and(t):
    return _searched(t, "the with")


@query(f"SELECT doc_id FROM (SELECT doc_id, {tokens('text')} AS w FROM documents) WHERE list_contains(w, 'der') OR list_contains(w, 'una') ORDER BY doc_id")
def fts_or(t):
    return _searched(t, "der OR una")


@query(f"SELECT doc_id FROM (SELECT doc_id, {tokens('text')} AS w FROM documents) WHERE list_contains(w, 'the') AND NOT list_contains(w, 'with') ORDER BY doc_id")
def fts_not(t):
    return _searched(t, "the NOT with")


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({tokens('text')}, ' ') || ' ' AS w FROM documents) WHERE contains(w, ' of the ') ORDER BY doc_id")
def fts_phrase(t):
    return _searched(t, '"of the"')


@query(f"SELECT doc_id FROM (SELECT doc_id, {tokens('text')} AS w FROM documents) WHERE len(list_filter(w, lambda x: starts_with(x, 'licens'))) > 0 ORDER BY doc_id")
def fts_prefix(t):
    return _searched(t, "licens*")


@query(f"SELECT doc_id FROM (SELECT doc_id, {tokens('text')} AS w FROM documents) WHERE w[1] = 'the' ORDER BY doc_id")
def fts_first(t):
    return _searched(t, "^the")


@query(f"SELECT doc_id FROM (SELECT doc_id, {tokens('text')} AS w FROM documents) WHERE list_contains(w, 'license') OR list_contains(w, 'licensed') ORDER BY doc_id LIMIT 8")
def grounded_context(t):
    return search.search_any(t("documents"), ["license", "licensed"], ["text"], "doc_id", 8).select("doc_id")


@query(f"SELECT token, count(DISTINCT doc_id)::BIGINT AS docs, count(*) AS n FROM (SELECT doc_id, unnest({tokens('text')}) AS token FROM documents) GROUP BY 1")
def inverted_index(t):
    return search.token_counts(t("documents"), "text")


# Evidence and names


@query("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(trim(b.text))) AND trim(b.text) <> ''")
def attested_in_sources(t):
    return attest.attested_pairs(t("documents"), "doc_id", "text", t("benchmark"), "item_id", "text")


@query(f"SELECT doc_id, contains(' ' || {key('text')} || ' ', ' of the ') AS found FROM documents")
def whole_word_contains(t):
    return t("documents").select("doc_id", T.contains_words(F.col("text"), F.lit("Of the!")).alias("found"))


@query(r"""
SELECT doc_id, CASE WHEN len(list_filter(f, lambda x: contains(lower(text), x))) >= greatest(1, len(f) // 2) THEN 'License version thonin' END AS kept
FROM (SELECT doc_id, text, list_filter(string_split('license version thonin', ' '), lambda x: length(x) > 3) AS f FROM documents)
""")
def fragment_attestation(t):
    return t("documents").select("doc_id", T.attested_value(F.lit("License version thonin"), F.col("text")).alias("kept"))


@query(r"""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN CASE WHEN contains(lower(text), 'zzqx') THEN 'literal' ELSE 'invalid' END WHEN 2 THEN 'phonetic' WHEN 4 THEN 'variant' WHEN 6 THEN CASE WHEN contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'golden fox') THEN 'literal' ELSE 'invalid' END ELSE 'literal' END AS status,
  CASE doc_id % 7 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS kept FROM documents
""")
def evidence_status(t):
    k, text = F.col("doc_id") % 7, F.col("text")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    cite = F.struct(pick("", "caption", "transcript", "caption", "caption", "ocr", "caption").alias("source"), pick("", "nowhere to be found", "we saw zzq", "a  golden FOX", "nothing of it", "MUKU sign", "zzq").alias("quote"), pick("", "literal", "phonetic", "literal", "literal", "literal", "literal").alias("match"), pick("", "", "", "", "", "f9", "").alias("location"))
    none = F.array().cast("array<struct<source:string,quote:string,match:string,location:string>>")
    rows = t("documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("shortcode"), pick("any", "zzqx", "zzqy", "Golden Fox", "Pertes de Valserine", "Muku", "Golden Fox").alias("name"), F.when(k == 0, none).otherwise(F.array(cite)).alias("evidence"))
    caption = F.when(k == 3, F.concat(text, F.lit(" a Golden\nFox "))).when(k == 4, F.concat(text, F.lit(" les Pertes de la Valserine"))).otherwise(text)
    frames = F.when(k == 5, F.create_map(F.lit("f1"), F.lit("MUKU sign"), F.lit("f2"), F.lit("menu"))).otherwise(F.create_map().cast("map<string,string>"))
    sources = t("documents").select(F.col("doc_id").alias("shortcode"), caption.alias("caption"), F.when(k == 2, "then we saw zzq there").otherwise("").alias("transcript"), F.when(k == 5, "MUKU sign\nmenu").otherwise("").alias("ocr"), frames.alias("frames"))
    return evidence.assess(rows, sources).select(F.col("id").alias("doc_id"), "status", F.size("kept").alias("kept"))


@query("""
WITH c AS (SELECT p_partkey, p_name, p_partkey % 10 AS k FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 1, 4, 6, 8) THEN 'resolved' ELSE 'abstained' END AS status,
  CASE k WHEN 0 THEN 'literal_priority_evidence' WHEN 1 THEN 'literal_priority_evidence' WHEN 2 THEN 'asr_only' WHEN 3 THEN 'no_attested_canonical_name' WHEN 4 THEN 'known_name_in_priority_evidence' WHEN 5 THEN 'ambiguous_local_names' WHEN 6 THEN 'authority:maps' WHEN 7 THEN 'low_confidence_authority:maps' WHEN 8 THEN 'repeated_brand' ELSE 'no_attested_canonical_name' END AS method,
  CASE WHEN k IN (0, 1) THEN p_name WHEN k = 4 THEN 'Known House' WHEN k = 6 THEN 'The ' || p_name WHEN k = 8 THEN 'HAY HAY' END AS canonical_name,
  CASE k WHEN 0 THEN 0.99 WHEN 1 THEN 0.95 WHEN 2 THEN 0.6 WHEN 4 THEN 0.99 WHEN 6 THEN 0.97 WHEN 7 THEN 0.5 WHEN 8 THEN 0.96 ELSE 0.0 END::DOUBLE AS confidence FROM c
""")
def name_decision(t):
    k, name = F.col("p_partkey") % 10, F.col("p_name")
    source = F.when(k == 1, "ocr").when(k == 2, "transcript").otherwise("caption")
    quote = F.when(k.isin(3, 6, 7, 9), "something else").when(k == 4, "at the KNOWN house.").when(k == 5, "Known House and Other-House").when(k == 8, "hay hay home shopping").otherwise(F.concat(F.lit("We saw "), F.upper(name), F.lit("!")))
    known = F.when(k.isin(4, 5), F.array(F.lit("Known House"), F.lit("Other House"), F.lit("Third"))).otherwise(F.array().cast("array<string>"))
    sure = F.when(k.isin(6, 7, 9), F.struct(F.lit("maps").alias("name"), F.concat(F.lit("The "), name).alias("canonical_name"), F.when(k == 7, 0.5).otherwise(0.97).alias("confidence")))
    rows = t("part").select(F.col("p_partkey").alias("id"), F.when(k == 8, "HAY HAY home shopping").otherwise(name).alias("name"), F.when(k == 8, "shop").when(k == 9, "media").otherwise("place").alias("type"), F.array(F.struct(source.alias("source"), quote.alias("quote"))).alias("evidence"), known.alias("known"), sure.alias("authority"))
    return canonical.decide(rows).select(F.col("id").alias("p_partkey"), "decision.status", "decision.method", "decision.canonical_name", "decision.confidence")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '' AND x NOT IN ('le', 'la', 'les', 'un', 'une', 'des', 'du', 'de', 'd')) AS t FROM documents)
SELECT doc_id, contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') AS variant FROM w
""")
def near_literal_names(t):
    return t("documents").select("doc_id", T.near_literal(F.col("text"), F.lit("Of la the")).alias("variant"))


@query(r"""
WITH n AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || ' €' WHEN 1 THEN p_retailprice::VARCHAR WHEN 2 THEN '@' || replace(p_name, ' ', '.') WHEN 3 THEN lower(p_name) ELSE p_name END AS name, p_type FROM part)
SELECT p_partkey, regexp_matches(trim(name), '(?i)^[\p{Nd}.,\s]+(?:€|\$|¥|yens?|euros?|dollars?|ml|cl|l|kg|g|%)?$') AS is_price,
  CASE WHEN starts_with(name, '@') THEN array_to_string(list_transform(list_filter(string_split_regex(ltrim(name, '@'), '[._]+'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ') ELSE trim(name) END AS clean,
  regexp_matches(name, '[\p{Ll}\p{Lu}\p{Lt}]') AND trim(name) = lower(trim(name)) AS is_common FROM n
""")
def name_guards(t):
    c = F.col
    k = c("p_partkey") % 5
    name = F.when(k == 0, F.concat(c("p_size").cast("string"), F.lit(" €"))).when(k == 1, c("p_retailprice").cast("string")).when(k == 2, F.concat(F.lit("@"), F.replace(c("p_name"), F.lit(" "), F.lit(".")))).when(k == 3, F.lower("p_name")).otherwise(c("p_name"))
    return t("part").select("p_partkey", T.is_price_or_quantity(name).alias("is_price"), T.clean_name(name).alias("clean"), T.is_common_noun(name).alias("is_common"))


@query("""
WITH f AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'media' ELSE 'exercise' END AS kind, ['ramen', 'ramen', CASE WHEN p_size > 25 THEN 'anime' ELSE 'back' END, 'bar', 'design', 'cafe', 'unheard'] AS facets FROM part)
SELECT p_partkey, kind, CASE kind WHEN 'restaurant' THEN 'ramen|bar|design' WHEN 'media' THEN CASE WHEN list_contains(facets, 'anime') THEN 'anime' ELSE '' END ELSE CASE WHEN list_contains(facets, 'back') THEN 'back' ELSE '' END END AS kept FROM f
""")
def facets_by_type(t):
    kind = F.when(F.col("p_size") % 3 == 0, "restaurant").when(F.col("p_size") % 3 == 1, "media").otherwise("exercise")
    facets = F.array(F.lit("ramen"), F.lit("ramen"), F.when(F.col("p_size") > 25, "anime").otherwise("back"), F.lit("bar"), F.lit("design"), F.lit("cafe"), F.lit("unheard"))
    return t("part").select("p_partkey", kind.alias("kind"), F.array_join(T.facets_for(kind, facets), "|").alias("kept"))


@query("""
WITH p AS (SELECT o_custkey AS entity_id, max(o_orderdate) AS updated_at FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
v AS (SELECT s_suppkey AS id, s_name, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority <> '1-URGENT') AS brand, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'F') AS intention, count(o_orderkey) AS members
    FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) l ON l_suppkey = s_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey WHERE s_suppkey % 3 <> 0 GROUP BY 1, 2)
SELECT id, s_name, brand, intention, members FROM v LEFT JOIN p ON entity_id = id ORDER BY coalesce(updated_at, TIMESTAMP '1997-01-01') DESC, s_name LIMIT 40
""")
def product_view(t):
    member = t("lineitem").select(F.col("l_suppkey").alias("entity_id"), "l_orderkey").distinct().join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    blank = lambda c, v: F.when(F.col(c) == v, " ").otherwise(F.col(c))
    member = member.select("entity_id", F.col("o_orderdate").alias("taken_at"), F.col("o_orderkey").alias("id"), blank("o_orderpriority", "1-URGENT").alias("brand"), blank("o_orderstatus", "F").alias("intention"))
    entities = t("supplier").select(F.col("s_suppkey").alias("id"), "s_name", F.col("s_name").alias("canonical_name"), F.when(F.col("s_suppkey") % 3 == 0, "brand").otherwise("product").alias("type"), F.lit("1997-01-01").cast("timestamp_ntz").alias("updated_at"))
    personal = t("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.max("o_orderdate").alias("updated_at"))
    sizes = member.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("members"))
    listed = views.products(entities, member, personal, limit=40)
    return listed.join(sizes, "id", "left").select("id", "s_name", "brand", "intention", F.coalesce("members", F.lit(0)).alias("members"))


SCORE_SQL = """
WITH p AS (SELECT l.doc_id AS d, lang, quality AS q, (length(text) > 200)::INT AS said, l.doc_id % 2 = 0 AS own, l.doc_id % 4 = 1 AS canon, l.doc_id % 5 <> 0 AS second FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
c AS (SELECT *, own::INT + second::INT AS found, (own OR canon)::INT + second::INT AS canon_found, (own AND d % 3 = 0)::INT AS type_error, CASE WHEN q = 1 THEN (NOT own)::INT + (d % 7 = 0)::INT ELSE 0 END AS fp, CASE WHEN q = 1 THEN (NOT own AND NOT canon)::INT + (d % 7 = 0)::INT ELSE 0 END AS canon_fp FROM p)
"""


def _score_inputs(t):
    """Cases, what is expected of them and what was found, such that every rule of the scorecard has its share of both outcomes."""
    c = F.col
    base = t("labels").join(t("documents"), "doc_id").select(c("doc_id").alias("case"), "lang", "source", "quality", "text")
    cases = base.select("case", "lang", F.when(c("quality") == 1, "complete").otherwise("minimum").alias("scope"), c("quality").cast("string").alias("mode"), F.when(c("case") % 2 == 0, "recipe").alias("content_kind"), F.when(c("case") % 3 == 0, F.lit(True)).alias("actionable"))
    said = base.where("case % 11 <> 0").select("case", (c("case") % 13 != 0).alias("ok"), (F.length("text") > 200).cast("int").cast("string").alias("mode"), F.when(c("case") % 4 == 0, "recipe").alias("content_kind"), (c("case") % 9 == 0).alias("actionable"))
    number, none = c("case").cast("string"), F.array().cast("array<string>")
    first = base.select("case", F.lit(0).alias("ord"), c("source").alias("name"), none.alias("aliases"), F.array(F.lit("place")).alias("types"))
    second = base.select("case", F.lit(1).alias("ord"), F.concat(F.lit("item "), number).alias("name"), F.array(F.concat(F.lit("Doc "), number)).alias("aliases"), none.alias("types"))
    row = lambda j, name, kind, where: base.where(where).select((c("case") * 10 + j).alias("id"), "case", name.alias("name"), F.lit(None).cast("string").alias("name_latin"), kind.alias("type"))
    actual = row(0, F.when(c("case") % 2 == 0, F.upper("source")).otherwise("other thing"), F.when(c("case") % 3 == 0, "shop").otherwise("place"), "true")
    actual = actual.union(row(1, F.concat(F.lit("«doc-"), number, F.lit("»")), F.lit("x"), "case % 5 <> 0")).union(row(2, F.lit("extra"), F.lit("x"), "case % 7 = 0"))
    decisions = base.select((c("case") * 10).alias("id"), F.when(c("case") % 4 == 1, "resolved").otherwise("abstained").alias("status"), c("source").alias("canonical_name"))
    dishes = base.where("case % 4 = 0").select("case", F.lit(0).alias("ord"), F.lit("Soup").alias("name"), F.array(F.lit("Stew")).alias("aliases")), base.where("case % 8 = 0").select("case", F.lit("STEW!").alias("name"))
    terms = base.where("case % 3 = 0").select("case", F.lit("Zebra, crossing").alias("term")), base.select("case", F.when(c("case") % 6 == 0, F.array(F.lit("a zebra"), F.lit("crossing the road"))).otherwise(none).alias("points"))
    return cases, first.union(second), actual, said, {"decisions": decisions, "recipes": dishes, "terms": terms}


@query(SCORE_SQL + """
SELECT d AS "case", 0 AS ord, own AS found, NOT own OR d % 3 <> 0 AS type_ok FROM c UNION ALL SELECT d, 1, second, TRUE FROM c
""")
def expected_matches(t):
    _, expected, actual, _, _ = _score_inputs(t)
    return quality.match_expected(expected, actual).select("case", "ord", "found", (~F.col("found") | F.col("type_ok")).alias("type_ok"))


@query("""
WITH m AS (SELECT p_type AS shortcode, lower(p_name) AS k, min((CASE WHEN p_size > 45 THEN 0 ELSE 1 END, p_partkey)) AS f, count(*) AS n FROM part GROUP BY 1, 2)
SELECT p.p_type AS shortcode, p.p_partkey AS id, p.p_name AS name, n AS merged FROM m JOIN part p ON p.p_partkey = m.f[2]
""")
def merged_fiches(t):
    none = F.array().cast("array<string>")
    rows = t("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("shortcode"), F.when(F.col("p_size") > 45, "human").otherwise("llm").alias("source"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("name_latin"), F.lit("place").alias("type"), F.array(F.col("p_partkey").cast("string")).alias("facets"), none.alias("tags"), none.alias("highlights"), F.lit("").alias("why_saved"))
    return views.merged_candidates(rows).select("shortcode", "id", "name", F.size("facets").cast("long").alias("merged"))


@query("SELECT l_suppkey AS shortcode, max(l_quantity)::BIGINT AS frames_used FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1 HAVING max(l_quantity) > 25")
def frames_at_risk(t):
    carriers = t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("shortcode"))
    frames = t("lineitem").groupBy(F.col("l_suppkey").alias("shortcode")).agg(F.max("l_quantity").cast("long").alias("frames_used"))
    return quality.at_risk(carriers, frames, 25)


@query("SELECT lang, CASE WHEN n_chars > 3000 THEN 404 WHEN contains(lower(text), 'license') THEN 401 WHEN doc_id % 2 = 0 THEN 200 ELSE 0 END AS outcome, count(*) AS n FROM documents GROUP BY 1, 2")
def download_outcomes(t):
    message = F.when(F.col("n_chars") > 3000, "ERROR: Video unavailable").when(F.lower("text").contains("license"), "HTTP Error 429: slow down").otherwise("odd")
    code = F.when((F.col("n_chars") <= 3000) & ~F.lower("text").contains("license") & (F.col("doc_id") % 2 == 0), 0).otherwise(1)
    return t("documents").groupBy("lang", media.download_outcome(code, message).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 'sha256/' || substr(sha256(s_name), 1, 2) || '/' || sha256(s_name) || '.mp4' AS object_key FROM supplier")
def content_keys(t):
    return t("supplier").select("s_suppkey", T.content_key(F.sha2("s_name", 256), ".mp4").alias("object_key"))


# Views and quality


@query("""
SELECT s_suppkey, s_name, sha256(coalesce(o.orders, '')) AS orders, coalesce(o.n, 0) AS n FROM supplier LEFT JOIN
  (SELECT l_suppkey, count(*) AS n, string_agg(l_orderkey::VARCHAR, '|' ORDER BY l_orderkey) AS orders FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY 1) o ON o.l_suppkey = s_suppkey
""")
def entity_with_sources(t):
    bridge = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey").distinct()
    rows = views.with_sources(t("supplier"), bridge, "s_suppkey", ["l_orderkey"])
    orders = F.coalesce(F.array_join(F.transform("sources", lambda x: x["l_orderkey"].cast("string")), "|"), F.lit(""))
    return rows.select("s_suppkey", "s_name", F.sha2(orders, 256).alias("orders"), F.when(F.col("sources").isNull(), 0).otherwise(F.size("sources")).cast("long").alias("n"))


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def correlated_counts(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t("customer").join(n, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query(f"""
WITH w AS (SELECT doc_id, {tokens('text')} AS t FROM documents)
SELECT CASE WHEN doc_id % 5 = 1 OR doc_id % 7 = 1 THEN 'Food & restaurants' WHEN list_has_any(t, ['food', 'restaurant', 'cuisine', 'recette', 'izakaya', 'gastronomie']) THEN 'Food & restaurants' WHEN list_has_any(t, ['langue', 'language', 'japonais', 'vocabulaire', 'phrase']) THEN 'Learning & languages'
  WHEN list_has_any(t, ['sport', 'fitness', 'workout', 'yoga', 'bien etre', 'wellness']) THEN 'Sport & wellbeing' WHEN list_has_any(t, ['voyage', 'travel', 'roadtrip', 'citytrip', 'visit', 'tourisme', 'excursion']) THEN 'Travel & places'
  WHEN list_has_any(t, ['shopping', 'souvenir', 'cadeau', 'achat', 'occasion']) THEN 'Shopping & products' WHEN list_has_any(t, ['anime', 'art', 'culture', 'streaming', 'fantasy', 'histoire']) THEN 'Culture & media'
  WHEN list_has_any(t, ['maison', 'mobilier', 'decoration', 'canape', 'diy', 'rangement', 'nettoyage']) THEN 'Home & DIY' WHEN list_has_any(t, ['nature', 'randonnee', 'montagne', 'panorama', 'outdoor', 'plage']) THEN 'Nature & outdoors'
  WHEN list_has_any(t, ['mode', 'beaute', 'beauty', 'skincare', 'vintage']) THEN 'Style & beauty' WHEN list_has_any(t, ['ia', 'photographie', 'photo', 'tech', 'camera', 'design']) THEN 'Tech & creation' ELSE 'Other inspiration' END AS theme, count(*) AS n
FROM w GROUP BY 1
""")
def theme_rollup(t):
    k = F.col("doc_id")
    kind, types = F.when(k % 5 == 1, "recipe"), F.when(k % 7 == 1, F.array(F.lit("media"), F.lit("restaurant"))).otherwise(F.array().cast("array<string>"))
    return views.theme_counts(t("documents").select(kind.alias("content_kind"), types.alias("types"), T.search_tokens("text").alias("tags")))


@query("""
SELECT doc_id, 'evidence' AS reason, 0 AS severity FROM labels WHERE quality = 0 AND toxic = 1 UNION ALL SELECT doc_id, 'rejected', 1 FROM labels WHERE quality = 0 AND toxic = 0
UNION ALL SELECT l.doc_id, 'silent', 2 FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 1 AND length(d.text) > 60 UNION ALL SELECT doc_id, 'uncertain', 3 FROM labels WHERE quality = 1 AND doc_id % 10 < 7
""")
def review_queue(t):
    c = t("labels").select(
        F.col("doc_id").alias("shortcode"), F.lit("n").alias("name"), F.lit("t").alias("type"), (F.col("quality") == 1).alias("verified"), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "invalid").alias("evidence_status"),
        F.lit("v").alias("verification_note"), F.lit("e").alias("evidence_note"), F.lit("llm").alias("source"), (F.col("doc_id") % 10 / 10).alias("confidence"),
    )
    classes = t("labels").select(F.col("doc_id").alias("shortcode"), (F.col("toxic") == 0).alias("is_actionable"), F.lit("topic").alias("predicted_topic"))
    reels = t("documents").select(F.col("doc_id").alias("shortcode"), F.col("text").alias("caption"))
    out = views.review_queue(c, classes, reels)
    return out.select(F.col("shortcode").alias("doc_id"), "reason", views.rank_of(F.col("reason"), {"evidence": 0, "rejected": 1, "silent": 2, "uncertain": 3}).alias("severity"))


@query(SCORE_SQL + """
SELECT lang, count(*) AS cases, 2 * count(*) AS entities_expected, sum(found)::BIGINT AS entities_found, sum(type_error)::BIGINT AS type_errors, sum(fp)::BIGINT AS false_positives, count(*) FILTER (WHERE q = 1) AS fp_cases,
  sum(canon_found)::BIGINT AS canonicalized_found, sum(canon_fp)::BIGINT AS canonicalized_false_positives, count(*) FILTER (WHERE canon) AS resolved, count(*) FILTER (WHERE NOT canon) AS abstained,
  count(*) FILTER (WHERE d % 4 = 0) AS recipes_expected, count(*) FILTER (WHERE d % 8 = 0) AS recipes_found, count(*) FILTER (WHERE d % 3 = 0) AS terms_expected, count(*) FILTER (WHERE d % 6 = 0) AS terms_found,
  count(*) AS mode_expected, count(*) FILTER (WHERE said = q AND d % 11 <> 0 AND d % 13 <> 0) AS mode_correct, count(*) FILTER (WHERE d % 2 = 0) AS content_kind_expected, count(*) FILTER (WHERE d % 4 = 0 AND d % 11 <> 0 AND d % 13 <> 0) AS content_kind_correct,
  count(*) FILTER (WHERE d % 3 = 0) AS actionable_expected, count(*) FILTER (WHERE d % 9 = 0 AND d % 11 <> 0 AND d % 13 <> 0) AS actionable_correct, sum(found)::DOUBLE / (2 * count(*)) AS recall FROM c GROUP BY 1
""")
def scorecard(t):
    cases, expected, actual, said, more = _score_inputs(t)
    return quality.scorecard(cases, expected, actual, said, by="lang", **more).drop("canonicalized_recall", "recipe_recall", "term_recall", "mode_accuracy", "content_kind_accuracy", "actionable_accuracy")


@query(SCORE_SQL + """
SELECT d AS "case", CASE WHEN d % 11 = 0 THEN 'absent' WHEN d % 13 = 0 THEN 'failed' ELSE 'ok' END AS status, concat_ws('|', CASE WHEN NOT own THEN source END, CASE WHEN NOT second THEN 'item ' || d END) AS missing
FROM c JOIN documents ON doc_id = d
""")
def case_results(t):
    cases, expected, actual, said, more = _score_inputs(t)
    return quality.case_results(cases, expected, actual, said, **more).select("case", "status", F.array_join("missing", "|").alias("missing"))


@query(SCORE_SQL + "SELECT d * 10 + j AS id FROM (SELECT d, unnest(CASE WHEN q = 1 THEN list_concat(CASE WHEN own THEN [] ELSE [0] END, CASE WHEN d % 7 = 0 THEN [2] ELSE [] END) ELSE [] END) AS j FROM c)")
def false_positive_items(t):
    cases, expected, actual, _, _ = _score_inputs(t)
    return quality.false_positives(expected, actual, cases.where("scope = 'complete'")).select("id")


@query("SELECT count(*) AS n, median(n_chars)::DOUBLE AS median, list_sort(list(n_chars))[(count(*) * 9 // 10) + 1] AS p90, max(n_chars) AS max FROM documents")
def corpus_stats(t):
    return quality.length_stats(t("documents"), "n_chars")


@query("SELECT count(*) AS n, list_sort(list(s_acctbal))[1] AS least, list_sort(list(s_acctbal))[(count(*) // 10) + 1] AS p10, list_sort(list(s_acctbal))[(count(*) // 2) + 1] AS median, max(s_acctbal) AS most FROM supplier")
def rank_stats(t):
    return quality.rank_stats(t("supplier"), "s_acctbal")


@query("SELECT count(*) AS n, sum(p_size)::BIGINT AS total, count(*) FILTER (WHERE p_size >= 25) AS at_cap, (sum(p_size) - sum(least(p_size, 25)))::BIGINT AS saved, median(p_size)::DOUBLE AS median, max(p_size) AS max FROM part")
def frame_stats(t):
    return quality.frame_stats(t("part"), "p_size", 25)


@query("""
WITH v AS (SELECT l_returnflag AS flag, 'l_quantity' AS field, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY flag, field ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY flag, field) AS n FROM v)
SELECT flag, field, n, max(CASE WHEN i = 0 THEN v END) AS least, max(CASE WHEN i = n // 10 THEN v END) AS p10, max(CASE WHEN i = n // 2 THEN v END) AS median, max(CASE WHEN i = n - 1 THEN v END) AS most FROM r GROUP BY 1, 2, 3
""")
def grouped_rank_stats(t):
    return quality.rank_stats(t("lineitem").withColumnRenamed("l_returnflag", "flag"), "l_quantity", "l_extendedprice", by=["flag"])


@query("""
WITH s AS (SELECT *, coalesce(sum((l_returnflag = 'R')::INT) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM s WHERE before < 200
""")
def first_by_progress(t):
    rows = t("lineitem").withColumn("ok", F.col("l_returnflag") == "R")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return queues.quota(rows, "ok", 200, *order).select("l_orderkey", "l_linenumber", "l_partkey")


@query(r"""
WITH n AS (SELECT doc_id, trim(strip_accents(regexp_replace(lower(source), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS name, strip_accents(regexp_replace(lower(text || ' ' || CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END), '[^\p{L}\p{N}_]+', ' ', 'g')) AS free, strip_accents(regexp_replace(lower(CASE WHEN doc_id % 3 = 1 THEN source ELSE '' END), '[^\p{L}\p{N}_]+', ' ', 'g')) AS ocr FROM documents)
SELECT CASE WHEN name <> '' AND contains(free, name) THEN 'caption_asr' WHEN name <> '' AND contains(ocr, name) THEN 'ocr_only' ELSE 'reworded' END AS carrier, count(*) AS n FROM n GROUP BY 1
""")
def source_attribution(t):
    c = F.col
    carrier = quality.attribution(c("source"), F.concat("text", F.lit(" "), F.when(c("doc_id") % 3 == 0, c("source")).otherwise("")), F.when(c("doc_id") % 3 == 1, c("source")).otherwise(""))
    return t("documents").groupBy(carrier.alias("carrier")).agg(F.count("*").alias("n"))


from shelfmark.plans import rules, walks  # noqa: E402, F401  (put their queries down)
