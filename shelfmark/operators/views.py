"""Read models: ranked listings, status pivots, review queue, merged fiches, products, dashboards, dossiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import let, name_key, preview, tag_key
from shelfmark.operators.state import latest_per_key, top_per_key
from shelfmark.vocabulary import REVIEW_ORDER, SPORT_TAGS, THEMES

VERDICT_RANK = {"favorite": 0, "liked": 1, "want_to_try": 2, "disappointing": 4}


def rank_of(value: Column, ranks: dict[str, int], other: int = 5) -> Column:
    """A verdict's rank; null and unlisted values have the last one."""
    out = F.lit(other)
    for k, v in ranks.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def with_latest(rows: DataFrame, log: DataFrame, key: str, log_key: str, fields: Sequence[str], *by: str) -> DataFrame:
    """rows with the fields of the latest log row of their key, null without one."""
    last = latest_per_key(log, [log_key], *by).select(F.col(log_key).alias("__k"), *fields)
    return rows.join(last, F.col(key) == F.col("__k"), "left").drop("__k")


def filtered(df: DataFrame, equal: dict[str, object] | None = None, text: str = "", fields: Sequence[str] = (), most: dict[str, object] | None = None) -> DataFrame:
    """df by optional parameters: a null or blank one asks for nothing. equal: a column, or several joined by |, any of which equals the value whatever the case."""
    for names, value in (equal or {}).items():
        if value not in (None, ""):
            hit = F.lit(False)
            for c in names.split("|"):
                hit = hit | (F.lower(c) == str(value).lower())
            df = df.where(hit)
    for c, value in (most or {}).items():
        if value is not None:
            df = df.where(F.col(c) <= value)
    if text.strip() and fields:
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.coalesce(c, F.lit("")).ilike(f"%{text.strip()}%")
        df = df.where(hit)
    return df


def options(df: DataFrame, *columns: str) -> DataFrame:
    """option: the different non-blank values of columns, for a filter's menu."""
    return df.select(F.explode(F.array(*columns)).alias("option")).where(F.trim("option") != "").distinct()


def ranked_recipes(recipes: DataFrame, attempts: DataFrame, cuisine: str | None = None, verdict: str | None = None, course: str | None = None, text: str = "", limit: int = 20) -> DataFrame:
    """Active recipes with their latest attempt, favourites first, then by recency; 'untried' asks for those without one."""
    df = with_latest(recipes.where(F.col("active")), attempts, "id", "recipe_id", ["verdict", "rating", "note", "changes_made", "cooked_at"], "created_at", "attempt_id")
    df = filtered(df, {"cuisine|cuisine_family": cuisine}, text, ("dish_name", "summary", "title"))
    if course:
        df = df.where(F.col("course") == course)
    if verdict:
        df = df.where(F.col("verdict").isNull() if verdict == "untried" else F.col("verdict") == verdict)
    return df.orderBy(rank_of(F.col("verdict"), VERDICT_RANK), F.col("updated_at").desc(), "id").limit(limit)


def status_pivot(log: DataFrame, key: str, stage: str, value: Column, stages: Sequence[str]) -> DataFrame:
    """key and, for each stage, the greatest value: one conditional aggregate, no join."""
    return log.groupBy(key).agg(*[F.max(F.when(F.col(stage) == s, value)).alias(s) for s in stages])


def review_queue(candidates: DataFrame, classification: DataFrame, reels: DataFrame, threshold: float = 0.7, reason: str | None = None, limit: int | None = None) -> DataFrame:
    """shortcode, reason, detail: what needs a human eye, most severe first."""
    bad = F.coalesce(F.col("evidence_status"), F.lit("")).isin("missing", "invalid")
    named = F.concat(F.lit("'"), "name", F.lit("' ("), "type", F.lit(") — "))
    parts = {
        "rejected": candidates.where((F.col("verified").cast("int") == 0) & ~bad).select("shortcode", F.concat(named, F.coalesce("verification_note", F.lit("None"))).alias("detail")),
        "evidence": candidates.where(bad).select("shortcode", F.concat(named, F.coalesce("evidence_note", F.lit("None"))).alias("detail")),
        "silent": classification.where("not is_actionable").join(reels.where(F.length("caption") > 60), "shortcode").select("shortcode", F.concat(F.lit("["), "predicted_topic", F.lit("] caption: "), preview(F.col("caption")), F.lit("...")).alias("detail")),
        "uncertain": candidates.where((F.col("verified").cast("int") == 1) & (F.col("source") == "llm") & (F.col("confidence") < threshold)).select("shortcode", F.concat(named, F.lit("confidence "), F.format_number("confidence", 2)).alias("detail")),
    }
    out = None
    for k, df in parts.items():
        if reason in (None, k):
            one = df.select("shortcode", F.lit(k).alias("reason"), "detail")
            out = one if out is None else out.unionByName(one)
    out = out.orderBy(rank_of(F.col("reason"), {k: i for i, k in enumerate(REVIEW_ORDER)}), "shortcode", "detail")
    return out if limit is None else out.limit(limit)


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """One row for each reel, type and key of the latin or own name: human rows first, arrays united, why_saved filled in."""
    key = name_key(F.coalesce(F.when(F.trim("name_latin") != "", F.col("name_latin")), F.col("name")))
    rank = F.struct((F.col("source") != "human").alias("h"), F.col("id").alias("id"))
    unite = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(rank, F.coalesce(c, F.array().cast("array<string>")).alias("v")))), lambda x: x["v"]))).alias(c)
    return candidates.withColumn("__k", key).groupBy("shortcode", "type", "__k").agg(
        F.min_by("name", rank).alias("name"), F.min_by("id", rank).alias("id"), F.min_by("why_saved", F.when(F.trim("why_saved") != "", rank)).alias("why_saved"), unite("facets"), unite("tags"), unite("highlights")
    ).drop("__k")


def products(entities: DataFrame, members: DataFrame, personal: DataFrame, limit: int | None = None) -> DataFrame:
    """Product entries with the newest non-blank brand and intention of members (entity_id, taken_at, id, brand, intention) and their personal state."""
    newest = F.struct("taken_at", "id")
    said = members.groupBy("entity_id").agg(*[F.max_by(c, F.when(F.trim(c) != "", newest)).alias(c) for c in ("brand", "intention")])
    df = entities.where(F.col("type") == "product").join(said.withColumnRenamed("entity_id", "id"), "id", "left").join(personal.withColumnRenamed("entity_id", "id").withColumnRenamed("updated_at", "p_updated_at"), "id", "left")
    df = df.orderBy(F.coalesce("p_updated_at", "updated_at").desc_nulls_last(), "canonical_name")
    return df if limit is None else df.limit(limit)


def theme(kind: Column, types: Column, tags: Column) -> Column:
    """The first dashboard theme whose types or tag words the reel has."""
    words = F.transform(tags, lambda t: F.lower(F.trim(t)))
    return let(F.struct(kind.alias("kind"), types.alias("types"), words.alias("words")), lambda s: _theme(s["kind"], s["types"], s["words"]))


def _theme(kind: Column, types: Column, words: Column) -> Column:
    out = F.lit("Other inspiration")
    for label, own, markers in reversed(THEMES):
        hit = F.arrays_overlap(words, F.array(*map(F.lit, markers)))
        if own:
            hit = hit | F.coalesce(kind.isin(*own), F.lit(False)) | F.arrays_overlap(types, F.array(*map(F.lit, own)))
        out = F.when(F.coalesce(hit, F.lit(False)), label).otherwise(out)
    return out


def theme_counts(reels: DataFrame) -> DataFrame:
    """theme, n of reels (content_kind, types, tags), most frequent first."""
    return reels.groupBy(theme(F.col("content_kind"), F.col("types"), F.col("tags")).alias("theme")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "theme")


def is_sport(tags: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(tags, lambda t: F.lower(F.trim(t))), F.array(*map(F.lit, SPORT_TAGS))), F.lit(False))


def themed(reels: DataFrame) -> DataFrame:
    """reels (content_kind, types, tags) with their theme and whether they are sport: exercises with a sport tag."""
    own = theme(F.col("content_kind"), F.col("types"), F.col("tags"))
    return reels.withColumns({"theme": own, "sport": F.coalesce(F.col("content_kind") == "exercise", F.lit(False)) & is_sport(F.col("tags"))})


def dossier(parts: Sequence[tuple[str, Column]]) -> Column:
    """Labelled parts, blank ones left out, with blank lines between."""
    return F.concat_ws("\n\n", *[F.when(F.trim(value) != "", F.concat(F.lit(f"{label}:\n"), value)) for label, value in parts])


def with_sources(entities: DataFrame, bridge: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """entities with sources: their bridge rows as a sorted array; one join instead of a query an entity."""
    return entities.join(bridge.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sources")), key, "left")


def last_messages(messages: DataFrame, key: str, order: str, n: int = 12) -> DataFrame:
    return top_per_key(messages, [key], n, F.col(order).desc()).orderBy(key, order)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 25) -> DataFrame:
    """A page of a total order; order must end with a unique column."""
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)


def tag_labels(labels: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(labels, lambda t: tag_key(t)), lambda t: t != ""))


def clamp(value: int, most: int = 20) -> int:
    return max(1, min(value, most))
