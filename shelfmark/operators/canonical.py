"""The canonical name of a candidate: an attested spelling, or an abstention; never a guess.

rows: id, name, type, evidence array<struct<source, quote>>, known array<string> (other spellings of the type).
Rules in order: a doubled brand before its category label; the name itself in a strong source; exactly one known name in
a strong source; several, abstain; an authority sure enough; the transcript alone, abstain; nothing, abstain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import contains_words, name_key, repeated_brand
from shelfmark.operators.state import latest_per_key
from shelfmark.vocabulary import SOURCE_CONFIDENCE, SOURCE_PRIORITY

DECISION = "struct<status:string,method:string,canonical_name:string,confidence:double>"
AUTHORITY_TYPES = ("place", "restaurant", "lodging", "shop")
SURE = 0.95


def _of(table: dict, source: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[source], F.lit(default))


def _outcome(status: str, method: Column | str, name: Column | None = None, confidence: Column | float = 0.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(status).alias("status"), lit(method).alias("method"), (F.lit(None).cast("string") if name is None else name).alias("canonical_name"), lit(confidence).cast("double").alias("confidence"))


def _confidence(x: Column, default: float = 0.9) -> Column:
    return _of(SOURCE_CONFIDENCE, x["source"], default)


def decide(rows: DataFrame) -> DataFrame:
    """rows with decision; an optional authority struct<name, canonical_name, confidence> column is asked where rules before it fail."""
    by_rank = F.transform(F.sort_array(F.transform("evidence", lambda x, i: F.struct((-_of(SOURCE_PRIORITY, x["source"], 0)).alias("r"), i.alias("i"), x["source"].alias("source"), F.coalesce(x["quote"], F.lit("")).alias("quote")))), lambda x: F.struct(x["r"].alias("r"), x["source"].alias("source"), x["quote"].alias("quote")))
    df = rows.withColumn("__ranked", by_rank)
    df = df.withColumn("__exact", F.try_element_at(F.filter("__ranked", lambda x: contains_words(x["quote"], F.col("name"))), F.lit(1)))
    df = df.withColumn("__strong", F.filter("__ranked", lambda x: x["r"] <= -2))
    attested = F.filter(F.array_distinct(F.transform("known", lambda n: F.trim(n))), lambda n: (n != "") & F.exists("__strong", lambda x: contains_words(x["quote"], n)))
    df = df.withColumn("__known", F.sort_array(F.transform(attested, lambda n: F.struct(F.length(n).alias("l"), F.lower(n).alias("c"), n.alias("n")))))
    df = df.withColumn("__keys", F.array_distinct(F.transform("__known", lambda x: name_key(x["n"]))))
    exact, strong_exact = F.col("__exact").isNotNull(), F.coalesce(F.col("__exact.r") <= -2, F.lit(False))
    brand, one = repeated_brand(F.col("name"), F.col("type")), F.try_element_at("__known", F.lit(1))["n"]
    winner = F.try_element_at(F.filter("__strong", lambda x: contains_words(x["quote"], one)), F.lit(1))
    out = F.when(brand.isNotNull() & strong_exact, _outcome("resolved", "repeated_brand", brand, 0.96))
    out = out.when(strong_exact, _outcome("resolved", "literal_priority_evidence", F.col("name"), _confidence(F.col("__exact"))))
    out = out.when(F.size("__keys") == 1, _outcome("resolved", "known_name_in_priority_evidence", one, _confidence(winner)))
    out = out.when(F.size("__keys") > 1, _outcome("abstained", "ambiguous_local_names"))
    if "authority" in rows.columns:
        a = F.col("authority")
        asked = a.isNotNull() & F.col("type").isin(*AUTHORITY_TYPES)
        sure = a["confidence"].between(SURE, 1.0)
        out = out.when(asked & sure, _outcome("resolved", F.concat(F.lit("authority:"), a["name"]), a["canonical_name"], a["confidence"]))
        out = out.when(asked, _outcome("abstained", F.concat(F.lit("low_confidence_authority:"), a["name"]), None, F.when(a["confidence"].between(0, 1), a["confidence"]).otherwise(0.0)))
    out = out.when(exact, _outcome("abstained", "asr_only", None, _confidence(F.col("__exact"), 0.6)))
    out = out.otherwise(_outcome("abstained", "no_attested_canonical_name"))
    return df.select(*rows.columns, out.alias("decision"))


def spread(names: DataFrame) -> DataFrame:
    """type, name, token: each name under the token of its key that the fewest names of its type have, which a text that holds the name has, too."""
    rows = names.where(name_key("name") != "").select("type", F.trim("name").alias("name")).distinct()
    tokens = rows.select("type", "name", F.explode(F.array_distinct(F.split(name_key("name"), " "))).alias("token"))
    common = tokens.groupBy("type", "token").agg(F.count("*").alias("n"))
    return tokens.join(common, ["type", "token"]).groupBy("type", "name").agg(F.min_by("token", F.struct("n", "token")).alias("token"))


def found_names(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, name: the names of names (type, name) that stand as whole words in the texts (key, type, body) of their type.

    Joined on one token a name, so a text meets the names whose rarest token it has and no others.
    """
    keyed = texts.select(key, "type", name_key("body").alias("body")).where("body <> ''")
    words = keyed.select(key, "type", F.explode(F.array_distinct(F.split("body", " "))).alias("token"))
    met = words.join(spread(names), ["type", "token"]).select(key, "type", "name").distinct()
    there = F.concat(F.lit(" "), "body", F.lit(" ")).contains(F.concat(F.lit(" "), name_key("name"), F.lit(" ")))
    return met.join(keyed, [key, "type"]).where(there).select(key, "name").distinct()


def with_known(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (id, name, type, evidence) with known: the other names of their type that stand in their evidence. decide() asks for no others."""
    texts = rows.select("id", "type", F.explode("evidence").alias("e")).select("id", "type", F.col("e.quote").alias("body"))
    known = found_names(texts, names, "id").groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("__known"))
    out = rows.drop("known").join(known, "id", "left")
    return out.withColumn("known", F.array_except(F.coalesce("__known", F.array().cast("array<string>")), F.array("name"))).drop("__known")


def local_names(candidates: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """type, name: other candidates' names, entries' names, and the names of entries with an alias, each once."""
    names = candidates.select("type", "name").union(entities.select("type", "canonical_name"))
    return names.union(aliases.join(entities.select(F.col("id").alias("entity_id"), "type", "canonical_name"), "entity_id").select("type", "canonical_name")).where("name is not null").distinct()


def with_inputs(candidates: DataFrame, reels: DataFrame, screen_text: DataFrame, transcripts: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """candidates with known spellings and with the evidence that the account's name and the sources themselves give.

    known are the local names of the type that stand in the evidence or a source; no type's names are ever gathered in one row.
    """
    own = latest_per_key(screen_text, ["shortcode"], "created_at", "seq").select("shortcode", F.col("text").alias("__ocr"))
    asr = latest_per_key(transcripts, ["shortcode"], "created_at", "seq").select("shortcode", F.col("text").alias("__asr"))
    df = candidates.join(reels.select("shortcode", F.col("username").alias("__user"), F.col("caption").alias("__cap")), "shortcode", "left").join(own, "shortcode", "left").join(asr, "shortcode", "left")
    user = F.regexp_replace(F.trim(F.coalesce("__user", F.lit(""))), "^@+", "")
    cite = lambda source, quote: F.struct(F.lit(source).alias("source"), quote.alias("quote"))
    mine = F.transform("evidence", lambda x: F.struct(x["source"].alias("source"), x["quote"].alias("quote")))
    account = F.when((user != "") & (name_key(user) == name_key("name")), cite("account", user))
    bodies = {"caption": "__cap", "ocr": "__ocr", "transcript": "__asr"}
    df = df.select(*candidates.columns, *bodies.values(), mine.alias("__mine"), account.alias("__account"))
    every = F.concat(F.transform("__mine", lambda x: x["quote"]), F.array("__account.quote", *bodies.values()))
    texts = df.select("id", "type", F.explode(F.filter(every, lambda t: t.isNotNull())).alias("body"))
    known = found_names(texts, local_names(candidates, entities, aliases), "id").groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("__known"))
    df = df.join(known, "id", "left").withColumn("__known", F.coalesce("__known", F.array().cast("array<string>")))
    extra = [F.col("__account")]
    for source, c in bodies.items():
        body = F.trim(F.coalesce(c, F.lit("")))
        new = ~F.exists("__mine", _is(source, body))
        extra.append(F.when((body != "") & new & F.exists(F.array_union("__known", F.array("name")), _inside(body)), cite(source, body)))
    return df.select(*[c for c in candidates.columns if c != "evidence"], F.concat("__mine", F.filter(F.array(*extra), lambda x: x.isNotNull())).alias("evidence"), F.array_except("__known", F.array("name")).alias("known"))


def _is(source: str, quote: Column):
    return lambda x: (x["source"] == source) & (x["quote"] == quote)


def _inside(body: Column):
    return lambda n: contains_words(body, n)
