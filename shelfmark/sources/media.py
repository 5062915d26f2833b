"""Captured media records: raw JSON to rows, and the rules on derived text. No network, no media: those are injected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import let
from shelfmark.operators.state import orphans
from shelfmark.vocabulary import CONTENT_KINDS

MEDIA = (
    "struct<pk:string,id:string,code:string,taken_at:bigint,media_type:int,product_type:string,caption:struct<text:string>,user:struct<username:string>,saved_collection_ids:array<string>,"
    "location:string,usertags:string,coauthor_producers:string,clips_metadata:struct<music_info:string>,accessibility_caption:string>"
)
# Patterns of captions and of a download tool's messages.
HASHTAG, MENTION, LINK = r"#([\p{L}\p{N}\p{M}_]+)", r"@([\p{L}\p{N}\p{M}_.]+)", r"https?://\S+"
LIST_MARKER = r"(?i)(all the (locations|places|spots)|below\s*[⬇️👇]|\b\d+\s*(spots|places|lieux|adresses|restos)\b|compilation|liste|thread|save this|enregistre)"
GONE = r"(?i)(no longer available|video unavailable|content isn'?t available|post (?:has been )?(?:deleted|removed)|page not found|HTTP Error 404)"
REFUSED = r"(?i)(login required|rate.?limit|checkpoint|challenge_required|empty media response|HTTP Error 401|HTTP Error 403|HTTP Error 429)"


def media_kind(product_type: Column, media_type: Column) -> Column:
    return F.when(product_type == "clips", "reel").when(media_type == 8, "carousel").when(media_type == 2, "video").otherwise("post")


def parse_media(raw: DataFrame, column: str = "raw_json") -> DataFrame:
    """One row for each raw record with a code: reel fields with defaults, the caption's context, collection ids."""
    df = raw.withColumn("m", F.from_json(column, MEDIA)).where(F.coalesce(F.col("m.code"), F.lit("")) != "")
    kind, caption = media_kind(F.col("m.product_type"), F.col("m.media_type")), F.coalesce("m.caption.text", F.lit(""))
    url = F.concat(F.lit("https://www.instagram.com/"), F.when(kind == "reel", "reel").otherwise("p"), F.lit("/"), "m.code", F.lit("/"))
    return df.select(
        F.col("m.code").alias("shortcode"), F.coalesce("m.pk", "m.id", F.lit("")).alias("media_id"), url.alias("url"), F.coalesce("m.user.username", F.lit("")).alias("username"), caption.alias("caption"),
        "m.taken_at", "m.media_type", "m.product_type", kind.alias("kind"), F.col(column).alias("raw_json"),
        *[c.alias(n) for n, c in caption_context(caption).items()],
        F.col("m.location").alias("location_json"), F.col("m.usertags").alias("usertags_json"), F.col("m.clips_metadata.music_info").alias("music_json"), F.col("m.coauthor_producers").alias("coauthors_json"), "m.accessibility_caption",
        F.filter(F.coalesce("m.saved_collection_ids", F.array().cast("array<string>")), lambda i: i.rlike("^[0-9]+$")).alias("collection_ids"),
    )


def caption_context(caption: Column) -> dict[str, Column]:
    """hashtags, mentions, links and the list marker of a caption."""
    return {
        "hashtags": F.regexp_extract_all(caption, F.lit(HASHTAG), F.lit(1)),
        "mentions": F.regexp_extract_all(caption, F.lit(MENTION), F.lit(1)),
        "links": F.regexp_extract_all(caption, F.lit(LINK), F.lit(0)),
        "has_list_marker": caption.rlike(LIST_MARKER),
    }


def download_outcome(code: Column, message: Column) -> Column:
    """200 done, 404 gone, 401 refused, 0 other, of a tool's exit code and output."""
    return F.when(code == 0, 200).when(message.rlike(GONE), 404).when(message.rlike(REFUSED), 401).otherwise(0)


def spoken(segments: Column, least: float = -1.0) -> dict[str, Column]:
    """text and has_speech of transcript segments whose mean log-probability is at least least."""
    kept = F.filter(segments, lambda s: s["avg_logprob"].isNull() | (s["avg_logprob"] >= least))
    text = F.trim(F.array_join(F.transform(kept, lambda s: F.trim(s["text"])), " "))
    return {"text": text, "has_speech": text != ""}


def consecutive_distinct(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before; blank ones go, and a value after a blank counts as new."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    bare = F.trim(F.coalesce(F.col(value), F.lit("")))
    return df.withColumn("__b", F.trim(F.coalesce(before, F.lit("")))).where((bare != "") & (bare != F.col("__b"))).drop("__b")


def first_object(text: Column) -> Column:
    """The first balanced JSON object of a text: from the first brace to the one that closes it, strings and escapes respected.

    Null without a brace or where it is never closed. What stands inside isn't parsed. Escaped characters are blanked out first; then the text
    is a row of pieces that end in a quote or brace, over which depth and quoting are counted, to any depth.
    """
    tail = F.substr(text, F.instr(text, "{"))
    pieces = F.regexp_extract_all(F.regexp_replace(tail, r"(?s)\\.", "  "), F.lit('[^"{}]*+["{}]'), F.lit(0))

    def step(s: Column, piece: Column) -> Column:
        mark, at = F.right(piece, F.lit(1)), s["at"] + F.length(piece)
        depth = s["depth"] + F.when(s["quoted"], 0).when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        now = F.struct(at.alias("at"), depth.alias("depth"), (s["quoted"] != (mark == '"')).alias("quoted"), F.when((depth == 0) & (s["depth"] == 1), at).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(now)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("end"))
    end = F.aggregate(pieces, start, step, lambda s: s["end"])
    return F.when(text.contains("{"), let(end, lambda n: F.when(n > 0, F.substr(tail, F.lit(1), n))))


def first_json_object(df: DataFrame, column: str, out: str = "object") -> DataFrame:
    """df with the first balanced JSON object of a text column, null without one."""
    return df.withColumn(out, first_object(F.col(column)))


def slice_tables(tables: dict[str, DataFrame], keys: DataFrame, key: str = "shortcode") -> dict[str, DataFrame]:
    """The rows of chosen keys of each source table; results of extraction aren't copied by design of the caller's table list."""
    chosen = keys.select(key).distinct()
    return {name: df.join(chosen, key, "left_semi") for name, df in tables.items()}


CASE = {
    "shortcode": "string", "category": "string", "expected_mode": "string", "expected_content_kind": "string", "expected_actionable": "boolean", "entity_scope": "string", "expected_names": "array<string>",
    "expected_entities": "array<struct<name:string,type:string,types:array<string>,aliases:array<string>>>", "expected_recipes": "array<struct<name:string,aliases:array<string>>>", "expected_terms": "array<string>",
}
# Fixed values.
MODES = ("repertoire", "recommandation")


def case_faults(cases: DataFrame) -> DataFrame:
    """shortcode, fault: what is wrong with scorecard cases, a row for each fault; a repeated shortcode is one fault however often it stands."""

    def nameless(field: str) -> Column:
        return F.coalesce(F.exists(field, lambda e: F.trim(F.coalesce(e["name"], F.lit(""))) == ""), F.lit(False))

    wrong = {
        "no shortcode": F.trim(F.coalesce("shortcode", F.lit(""))) == "",
        "unknown scope": ~F.col("entity_scope").isin("minimum", "complete"),
        "unknown mode": F.coalesce(~F.col("expected_mode").isin(*MODES), F.lit(False)),
        "unknown content kind": F.coalesce(~F.col("expected_content_kind").isin("", *CONTENT_KINDS), F.lit(False)),
        "entity without a name": nameless("expected_entities"),
        "recipe without a name": nameless("expected_recipes"),
    }
    found = cases.select("shortcode", F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in wrong.items()]))).alias("fault"))
    twice = cases.groupBy("shortcode").count().where("count > 1").select("shortcode", F.lit("repeated shortcode").alias("fault"))
    return found.unionByName(twice)


def case_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scorecard cases as they stand in JSON files, with defaults: an object with a list of cases, a bare list, or (lines) a case a line."""
    fields = [f"{name} {kind}" for name, kind in CASE.items()]
    listed = ",".join(f.replace(" ", ":", 1) for f in fields)
    df = spark.read.schema(", ".join([*fields, f"cases array<struct<{listed}>>"])).json(path, multiLine=not lines)
    df = df.select(F.explode(F.coalesce("cases", F.array(F.struct(*CASE)))).alias("c")).select("c.*")
    return df.withColumns({"category": F.coalesce("category", F.lit("non catégorisé")), "entity_scope": F.coalesce("entity_scope", F.lit("minimum"))})


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scorecard cases of JSON files; refused as a whole where case_faults finds anything."""
    df = case_rows(spark, path, lines)
    faults = case_faults(df).limit(5).collect()
    if faults:
        raise ValueError(f"invalid cases in {path}: " + "; ".join(f"{r.shortcode}: {r.fault}" for r in faults))
    return df


def unarchived(media: DataFrame) -> DataFrame:
    """Media that are validated, have a checksum and no archive yet: what an object store should receive."""
    return media.where(F.col("validated_at").isNotNull() & F.col("sha256").rlike("^[0-9a-f]{64}$") & F.col("archive_uri").isNull())


def cascaded(tables: dict[str, DataFrame], gone: DataFrame, key: str = "shortcode") -> dict[str, DataFrame]:
    """tables without the rows whose parent (key) is deleted: what ON DELETE CASCADE leaves."""
    keys = gone.select(key).distinct()
    return {name: df.join(keys, key, "left_anti") for name, df in tables.items()}


def broken_references(tables: dict[str, DataFrame], parent: DataFrame, key: str = "shortcode") -> DataFrame:
    """table, key of rows whose parent is missing."""
    out = None
    for name, df in tables.items():
        part = orphans(df, parent, key, key).select(F.lit(name).alias("table"), key)
        out = part if out is None else out.union(part)
    return out


def json_elements(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """keep, pos, kind, value of each element of the JSON arrays in column; kind is the element's own (string, bigint, object, ...), value its JSON text.

    Texts that aren't JSON, and JSON that is no array, give no rows; nothing is cast, so arrays of mixed kinds are kept as they are.
    """
    rows = df.select(*keep, F.try_parse_json(F.col(column)).alias("__v")).where(F.schema_of_variant("__v").startswith("ARRAY"))
    out = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer()))
    kind = F.lower(F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0))
    return out.select(*keep, "pos", kind.alias("kind"), F.to_json("value").alias("value"))
