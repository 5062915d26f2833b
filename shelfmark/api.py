"""The query interface: six functions over a catalogue's tables, JSON-shaped rows out, arguments checked before a plan is built."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import iso_date
from shelfmark.operators import search as S
from shelfmark.operators import views
from shelfmark.operators.ordered import numbered
from shelfmark.operators.votes import labelled_counts
from shelfmark.vocabulary import STATUSES, STOP_WORDS, VERDICTS

Tables = dict[str, DataFrame]


def search_entities(t: Tables, query: str, kind: str | None = None, city: str | None = None, limit: int = 10) -> DataFrame:
    """Entries that match, with their reels."""
    rows = t["entity"]
    if kind:
        rows = rows.where(F.col("type") == kind)
    if city:
        rows = rows.where(F.lower("city") == city.lower())
    found = S.search(rows, query, ["canonical_name", "summary", "highlights", "tags"], "id", limit=views.clamp(limit))
    bridge = t["entity_reel"].join(t["reel"].select("shortcode", "url"), "shortcode").withColumnRenamed("entity_id", "id")
    return views.with_sources(found, bridge, "id", ["shortcode", "url"]).orderBy("id")


def search_recipes(t: Tables, text: str = "", cuisine: str | None = None, verdict: str | None = None, course: str | None = None, family: str | None = None, limit: int = 20) -> DataFrame:
    """Ranked recipes; the family filters what the limit has left, so fewer rows than exist may come back."""
    out = views.ranked_recipes(t["recipe"], t["recipe_attempt"], cuisine, verdict, course, text, views.clamp(limit))
    return out.where(F.col("cuisine_family") == family) if family else out


def search_repertoire(t: Tables, query: str = "", kind: str | None = None, limit: int = 20) -> DataFrame:
    rows = t["repertoire_entry"] if kind is None else t["repertoire_entry"].where(F.col("content_kind") == kind)
    return S.search(rows, query, ["title", "summary"], "shortcode", newest="updated_at", limit=views.clamp(limit))


def get_entity(t: Tables, entity_id: int) -> DataFrame:
    """An entry with its reels and its personal history, newest first."""
    row = t["entity"].where(F.col("id") == entity_id)
    bridge = t["entity_reel"].where(F.col("entity_id") == entity_id).join(t["reel"].select("shortcode", "url"), "shortcode").withColumnRenamed("entity_id", "id")
    past = t["entity_personal_history"].where(F.col("entity_id") == entity_id).groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("changed_at", "status", "note")), asc=False).alias("history"))
    return views.with_sources(row, bridge, "id", ["shortcode", "url"]).join(past, "id", "left")


def get_reel(t: Tables, shortcode: str) -> DataFrame:
    """A reel with its candidates merged by type and name."""
    row = t["reel"].where(F.col("shortcode") == shortcode)
    merged = views.merged_candidates(t["candidate"].where(F.col("shortcode") == shortcode))
    found = merged.groupBy("shortcode").agg(F.sort_array(F.collect_list(F.struct("id", "type", "name", "facets", "tags", "highlights", "why_saved"))).alias("candidates"))
    return row.join(found, "shortcode", "left")


def catalogue_summary(t: Tables) -> DataFrame:
    """label, n: sizes of the tables, entries by type and repertoire by kind."""
    sizes = labelled_counts({"reels": t["reel"].where(F.col("unsaved_at").isNull()), "entities": t["entity"], "recipes": t["recipe"].where("active"), "repertoire": t["repertoire_entry"]})
    kinds = t["repertoire_entry"].groupBy(F.concat(F.lit("kind:"), F.coalesce("content_kind", F.lit(""))).alias("label")).agg(F.count("*").alias("n"))
    types = t["entity"].groupBy(F.concat(F.lit("type:"), "type").alias("label")).agg(F.count("*").alias("n"))
    return sizes.union(types).union(kinds)


MOST_CHARACTERS = 800


def checked_question(question: str) -> str:
    bare = question.strip()
    if not bare:
        raise ValueError("ask a question")
    if len(bare) > MOST_CHARACTERS:
        raise ValueError(f"a question has at most {MOST_CHARACTERS} characters")
    return bare


def question_words(question: str) -> list[str]:
    """The words a question is searched by, as functions.text.question_terms has them."""
    words = [w for w in re.findall(r"[\w-]+", checked_question(question).casefold()) if len(w) >= 3 and w not in STOP_WORDS]
    return words[:6]


def grounding(t: Tables, question: str) -> dict[str, DataFrame]:
    """What an answer may draw on: 8 entities with any of the question's terms, 6 recipes by its first."""
    terms = question_words(question)
    recipes = views.ranked_recipes(t["recipe"], t["recipe_attempt"], text=terms[0] if terms else "", limit=6)
    return {
        "entities": S.search_any(t["entity"], terms, ["canonical_name", "summary", "highlights", "tags"], "id", 8),
        "recipes": recipes.select("dish_name", "cuisine", "cuisine_family", "summary", "shortcode", "url"),
    }


def conversation(messages: DataFrame, session: int, n: int = 12) -> DataFrame:
    """The last n messages of a session, oldest first."""
    return views.last_messages(messages.where(F.col("session_id") == session), "session_id", "id", n).orderBy("id")


def asked(sessions: DataFrame, messages: DataFrame, question: str, stamp: str, session: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(sessions, messages, session) with a question put down; without a session a new one is titled after it, an unknown one is refused."""
    bare = checked_question(question)
    spark = sessions.sparkSession
    if session is None:
        session = sessions.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        compact = " ".join(bare.split())
        new = spark.range(1).select(F.lit(session).alias("id"), F.lit(compact[:72] + ("…" if len(compact) > 72 else "")).alias("title"), F.lit(stamp).alias("created_at"), F.lit(stamp).alias("updated_at"))
        sessions = sessions.unionByName(new)
    elif not sessions.where(F.col("id") == session).limit(1).count():
        raise ValueError(f"no such conversation: {session}")
    number = messages.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    row = spark.range(1).select(F.lit(number).alias("id"), F.lit(session).alias("session_id"), F.lit("user").alias("role"), F.lit(bare).alias("content"), F.lit(stamp).alias("created_at"))
    return sessions, messages.unionByName(row), session


def without_session(sessions: DataFrame, messages: DataFrame, session: int) -> tuple[DataFrame, DataFrame]:
    """A deleted session takes its messages along."""
    return sessions.where(F.col("id") != session), messages.where(F.col("session_id") != session)


def checked_attempt(verdict: str, rating: int | None = None, cooked_at: str | None = None) -> dict:
    if verdict not in VERDICTS:
        raise ValueError(f"unknown verdict: {verdict}")
    if rating is not None and not 1 <= rating <= 5:
        raise ValueError("rating must be from 1 to 5")
    if cooked_at is not None:
        datetime.date.fromisoformat(cooked_at)
    return {"verdict": verdict, "rating": rating, "cooked_at": cooked_at}


def attempt_fault(verdict: Column, rating: Column, cooked_at: Column) -> Column:
    """What checked_attempt refuses, over columns: the first fault of a row, null where there is none."""
    bad_date = cooked_at.isNotNull() & iso_date(cooked_at).isNull()
    return F.when(verdict.isNull() | ~verdict.isin(*VERDICTS), "verdict").when(~rating.between(1, 5), "rating").when(bad_date, "cooked_at")


def recorded_attempts(old: DataFrame, new: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(attempts, refused): old with the rows of new (recipe_id, verdict, rating, cooked_at, note) that are right, and the others with their fault.

    Attempts are only added. They are numbered on from the largest attempt_id, in order; order must be unique.
    """
    judged = new.withColumn("fault", attempt_fault(F.col("verdict"), F.col("rating"), F.col("cooked_at")))
    last = old.agg(F.coalesce(F.max("attempt_id"), F.lit(0))).first()[0]
    fresh = numbered(judged.where("fault is null").drop("fault"), list(order), "__n").withColumn("attempt_id", F.col("__n") + F.lit(last).cast("long")).drop("__n")
    return old.unionByName(fresh.select(*old.columns)), judged.where("fault is not null")


def checked_status(status: str | None, score: int | None = None) -> dict:
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    if score is not None and not 1 <= score <= 5:
        raise ValueError("score must be from 1 to 5")
    return {"status": status, "score": score}
