"""The write path of extracted candidates: guards in a fixed order, each a function of rows, chained by transform().

rows: shortcode, ord, name, name_latin, type, scale, city, country, locality, facets, tags, confidence, and context (the dossier).
Order matters: split names, drop repeats, drop file listings, drop prices, then field rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.operators import canonical, evidence
from shelfmark.operators.state import first_per_key

FILE_LIKE = r"(?i)(/$|\.(md|sh|py|js|ts|tsx|json|ya?ml|txt|toml|cfg|ini|sql|html|css|env)$)"
FILE_LISTING = 4


def split_rows(rows: DataFrame) -> DataFrame:
    """A row for each name run together; latin forms go along only if there are as many."""
    names, latin = T.split_names(F.col("name")), T.split_names(F.coalesce("name_latin", F.lit("")))
    out = rows.withColumn("__l", latin).select("*", F.posexplode(names).alias("__i", "__n"))
    size = F.size(T.split_names(F.col("name")))
    form = F.when(size == 1, F.col("name_latin")).when(F.size("__l") == size, F.get("__l", F.col("__i")))
    return out.withColumns({"name_latin": form, "ord": F.col("ord") * 1000 + F.col("__i")}).withColumn("name", F.col("__n")).drop("__i", "__n", "__l")


def without_repeats(rows: DataFrame) -> DataFrame:
    keyed = rows.withColumn("__k", T.name_key("name"))
    return first_per_key(keyed, ["shortcode", "type", "__k"], "ord").drop("__k")


def without_listings(rows: DataFrame, least: int = FILE_LISTING) -> DataFrame:
    """Drop file-like names where a reel has least or more: a picture of a directory, not entities. An aggregate and an anti join: a hot reel's rows never meet in one task."""
    flag = F.trim("name").rlike(FILE_LIKE)
    listed = rows.where(flag).groupBy("shortcode").count().where(F.col("count") >= least).select("shortcode", F.lit(True).alias("__file"))
    return rows.withColumn("__file", flag).join(listed, ["shortcode", "__file"], "left_anti").select(*rows.columns)


def small_groups(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows of the groups of at most most rows; sizes are an aggregate and an anti join."""
    large = rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys)
    return rows.join(large, keys, "left_anti")


def without_prices(rows: DataFrame) -> DataFrame:
    return rows.where(~T.is_price_or_quantity(F.col("name")))


def field_rules(rows: DataFrame) -> DataFrame:
    c = F.col
    rows = rows.withColumns({k: T.blank_to_null(c(k)) for k in ("name_latin", "city", "country", "locality", "scale")})
    rows = rows.withColumns({"name": T.clean_name(c("name")), "confidence": T.ratio_of_percent(c("confidence")), "tags": F.array_union("tags", T.unknown_facets(c("facets")))})
    rows = rows.withColumns(
        {
            "scale": T.scale_for(c("type"), c("scale")),
            "city": T.city_for(c("type"), c("city"), c("country")),
            "locality": T.place_only(c("type"), T.attested_value(T.clean_locality(c("locality")), c("context"))),
            "name_latin": T.attested_value(c("name_latin"), c("context")),
            "facets": T.facets_for(c("type"), c("facets")),
        }
    )
    return rows.withColumn("tags", T.useful_tags(c("tags"), [c("type"), c("city"), c("country"), c("name"), c("name_latin")], c("facets")))


def guarded(rows: DataFrame) -> DataFrame:
    return rows.transform(split_rows).transform(without_repeats).transform(without_listings).transform(without_prices).transform(field_rules)


def combine(mentions: DataFrame, details: DataFrame, recipe: DataFrame | None = None) -> DataFrame:
    """mentions (shortcode, ord, name, type, source, ...) with the details of the same name key; the last detail of a key wins.

    Mentions without details keep their own fields and have null ones. In reels listed in recipe (shortcode), mentions of
    type recipe, method or exercise and those seen by OCR alone (source, or all of an evidence column) go; mentions that aren't direct
    (where there is such a column) go everywhere.
    """
    if "direct" in mentions.columns:
        mentions = mentions.where(F.coalesce("direct", F.lit(True)))
    keyed = details.withColumn("__k", T.name_key("name"))
    last = keyed.groupBy("shortcode", "__k").agg(F.max_by(F.struct(*[c for c in details.columns if c not in ("shortcode", "name", "ord", "type")]), "ord").alias("__d"))
    out = mentions.withColumn("__k", T.name_key("name")).join(last, ["shortcode", "__k"], "left").select(*mentions.columns, "__d.*")
    if recipe is None:
        return out
    listed = recipe.select("shortcode", F.lit(True).alias("__r")).distinct()
    out = out.join(listed, "shortcode", "left")
    seen_only = F.forall(F.coalesce("evidence", F.array().cast(out.schema["evidence"].dataType)), lambda x: x["source"] == "ocr") if "evidence" in out.columns else F.col("source") == "ocr"
    gone = F.coalesce("__r", F.lit(False)) & (F.col("type").isin("recipe", "method", "exercise") | seen_only)
    return out.where(~gone).drop("__r")


def staged_mode(content_kind: Column, mode: Column) -> Column:
    """Anything with a content kind is repertoire."""
    return F.when(F.trim(F.coalesce(content_kind, F.lit(""))) != "", "repertoire").otherwise(mode)


def staged_topic(topic: Column, content_kind: Column, recipes: Column) -> Column:
    """The trimmed topic; a recipe's that only says so gives way to its first dish."""
    bare = F.trim(topic)
    generic = (content_kind == "recipe") & F.lower(bare).isin("repertoire", "recette", "recipe") & (F.size(recipes) > 0)
    return F.when(F.coalesce(generic, F.lit(False)), F.get(recipes, 0)["dish_name"]).otherwise(bare)


def materialise(old: DataFrame, responses: DataFrame, sources: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, name decisions) after new responses: the guards, then evidence, then the canonical name, replacing model rows only.

    old: candidates (shortcode, source, name, ...); responses: rows as guarded() takes them, with evidence, one reel's rows
    together; sources as evidence.assess() takes them; known: (type, name) of names attested elsewhere. Rows of other origins stay, and so do
    reels without responses. Applying stored responses again gives the same rows: replay and extraction are one path.
    """
    kept = guarded(responses).withColumn("id", F.xxhash64("shortcode", "ord", "name"))
    judged = evidence.assess(kept, sources).withColumnsRenamed({"status": "evidence_status", "note": "evidence_note"}).withColumn("source", F.lit("llm"))
    judged = judged.withColumn("evidence", F.col("kept")).drop("kept", "context")
    replaced = responses.select("shortcode").distinct()
    rest = old.where(F.col("source") != "llm").unionByName(old.where(F.col("source") == "llm").join(replaced, "shortcode", "left_anti"))
    quotes = judged.select("id", "shortcode", "name", "type", F.transform("evidence", lambda x: F.struct(x["source"].alias("source"), x["quote"].alias("quote"))).alias("evidence"))
    named = quotes.withColumn("known", F.array().cast("array<string>")) if known is None else canonical.with_known(quotes, known)
    decisions = canonical.decide(named).select("id", "shortcode", "name", "decision.*")
    return rest.unionByName(judged, allowMissingColumns=True), decisions


STORED = "struct<fiche:{f},discovery:struct<mentions:array<{m}>>,enrichment:struct<entities:array<{e}>>,content_index:struct<recipes:array<struct<dish_name:string,cuisine:string,summary:string>>>>"
FICHE = "struct<is_actionable:boolean,topic:string,why_saved:string,confidence:double,mode:string,tags:array<string>,key_points:array<string>,content_kind:string>"
ENTITY = "struct<name:string,name_latin:string,type:string,facets:array<string>,scale:string,city:string,country:string,locality:string,tags:array<string>,confidence:double>"


def stored_responses(rows: DataFrame, column: str = "raw_response") -> DataFrame:
    """rows with staged (boolean), fiche, mentions, entities and recipes of stored JSON, staged or flat; what is missing is null or empty."""
    staged = F.from_json(column, STORED.format(f=FICHE, m=ENTITY, e=ENTITY))
    old = F.from_json(column, FICHE[:-1] + f",entities:array<{ENTITY}>,recipes:array<struct<dish_name:string,cuisine:string,summary:string>>>")
    df = rows.withColumns({"__s": staged, "__o": old})
    is_staged = F.col("__s.fiche").isNotNull()
    fields = [x.split(":")[0] for x in ("is_actionable:", "topic:", "why_saved:", "confidence:", "mode:", "tags:", "key_points:", "content_kind:")]
    flat = F.struct(*[F.col(f"__o.{f}").alias(f) for f in fields])
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    recipes = "array<struct<dish_name:string,cuisine:string,summary:string>>"
    return df.select(
        *rows.columns,
        is_staged.alias("staged"),
        F.when(is_staged, F.col("__s.fiche")).otherwise(flat).alias("fiche"),
        empty(F.when(is_staged, F.col("__s.discovery.mentions")), f"array<{ENTITY}>").alias("mentions"),
        empty(F.when(is_staged, F.col("__s.enrichment.entities")).otherwise(F.col("__o.entities")), f"array<{ENTITY}>").alias("entities"),
        empty(F.when(is_staged, F.col("__s.content_index.recipes")).otherwise(F.col("__o.recipes")), recipes).alias("recipes"),
    )
