"""Entity resolution: candidates to catalogue entries.

Candidates are blocked by type and name key, with known aliases leading to the entry they belong to; each group votes
on its name and fields and records what it rejects. Ids are kept by (name, type); new entries get numbers after the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import handle_key, maps_url, tag_key
from shelfmark.operators import votes
from shelfmark.operators.ordered import numbered
from shelfmark.operators.state import first_per_key
from shelfmark.vocabulary import PLACE_TYPES, TAG_RANK

GROUP = ("type", "key")


class UnverifiedCandidates(ValueError):
    """Resolution was asked for while candidates wait for verification."""


def selected(candidates: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Accepted candidates; of reels in repertoire mode only human ones and types other than recipe, exercise, method."""
    out = candidates.where(F.col("verified").cast("int") == 1)
    if modes is None:
        return out
    listed = F.col("type").isin("recipe", "exercise", "method")
    return out.join(modes.select("shortcode", "mode"), "shortcode", "left").where((F.col("source") == "human") | F.col("mode").isNull() | (F.col("mode") != "repertoire") | ~listed)


def blocked(candidates: DataFrame, aliases: DataFrame | None = None, use_resolved: bool = True) -> DataFrame:
    """candidates with key: the handle key of the resolved or observed name, or of the entry an alias (type, alias, canonical_name) names."""
    name = F.coalesce(F.when(F.trim("resolved_name") != "", F.trim("resolved_name")), F.col("name")) if use_resolved and "resolved_name" in candidates.columns else F.col("name")
    out = candidates.withColumn("key", handle_key(name))
    if aliases is None:
        return out
    known = first_per_key(aliases.select("type", F.col("alias").alias("key"), handle_key("canonical_name").alias("__to")), ["type", "key"], "__to")
    return out.join(known, ["type", "key"], "left").withColumn("key", F.coalesce("__to", "key")).drop("__to")


def grouped(rows: DataFrame, fields: tuple[str, ...] = ("city", "country", "locality", "scale", "brand"), order: str = "id") -> DataFrame:
    """One entry a group: name, voted fields, facets, highlights, why_saved, members, conflicts."""
    fields = tuple(f for f in fields if f in rows.columns)
    names = [c for c in ("resolved_name", "name_latin", "name") if c in rows.columns]
    out = votes.elected_name(rows, GROUP, names, order)
    for f in fields:
        out = out.join(votes.majority(rows, GROUP, f, order).withColumnRenamed("rejected", f"__{f}"), list(GROUP), "left")
    for f, merge in (("facets", votes.ordered_union), ("tags", votes.ordered_union), ("highlights", votes.first_spellings)):
        if f in rows.columns:
            out = out.join(merge(rows, GROUP, f, order), list(GROUP), "left")
    sums = [F.count("*").alias("members"), F.min(order).alias("first_id")]
    if "why_saved" in rows.columns:
        sums.append(votes.joined_set("why_saved").alias("why_saved"))
    out = out.join(rows.groupBy(*GROUP).agg(*sums), list(GROUP))
    out = out.withColumn("conflicts", votes.conflicts(**{f: F.col(f"__{f}") for f in fields})) if fields else out
    if {"locality", "city", "country"} <= set(fields):
        out = out.withColumn("maps_url", F.when(F.col("type").isin(*PLACE_TYPES), maps_url(F.col("canonical_name"), F.col("locality"), F.col("city"), F.col("country"))))
    return out.drop(*[f"__{f}" for f in fields])


def with_ids(entries: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """entries with id: the previous entry's of the same name and type, else numbers after the largest, by name and type."""
    if previous is None:
        return numbered(entries, ["canonical_name", "type"], "id")
    kept = entries.join(previous.select("canonical_name", "type", "id"), ["canonical_name", "type"])
    fresh = entries.join(previous.select("canonical_name", "type"), ["canonical_name", "type"], "left_anti")
    top = previous.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return kept.unionByName(numbered(fresh, ["canonical_name", "type"], "id", top + 1))


def links(rows: DataFrame, entries: DataFrame, order: str = "id") -> DataFrame:
    """entity_id, shortcode, candidate_id: the first candidate of each entry in each reel."""
    met = rows.join(entries.select(*GROUP, F.col("id").alias("entity_id")), list(GROUP)).select("entity_id", "shortcode", F.col(order).alias("candidate_id"))
    return first_per_key(met, ["entity_id", "shortcode"], "candidate_id")


def tags(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(label, kind) and (entity_id, label) of (entity_id, label) rows by kind; a label has the highest kind it is met with."""
    every = None
    for kind, df in sources.items():
        part = df.select("entity_id", tag_key("label").alias("label"), F.lit(kind).alias("kind")).where("label <> ''")
        every = part if every is None else every.union(part)
    return votes.promoted(every, "label", "kind", TAG_RANK), every.select("entity_id", "label").distinct()


def alias_rows(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """entity_id, alias: every key that the members' names and latin names have."""
    met = rows.join(entries.select(*GROUP, F.col("id").alias("entity_id")), list(GROUP))
    names = [c for c in ("name", "name_latin", "resolved_name") if c in rows.columns]
    return met.select("entity_id", F.explode(F.array(*[handle_key(c) for c in names])).alias("alias")).where("alias <> ''").distinct()


def purged(entries: DataFrame, bridge: DataFrame) -> DataFrame:
    """Entries with a link, and those verified by hand."""
    alive = entries.join(bridge.select(F.col("entity_id").alias("id")).distinct(), "id", "left_semi")
    return alive.unionByName(entries.where(F.col("verified").cast("int") == 1).join(alive.select("id"), "id", "left_anti"))


def resolve(candidates: DataFrame, modes: DataFrame | None = None, aliases: DataFrame | None = None, previous: DataFrame | None = None, force: bool = False, use_resolved: bool = True) -> dict[str, DataFrame]:
    """entity, entity_reel and entity_alias from candidates; refuses while some are unverified, unless forced."""
    if not force and candidates.where(F.col("verified").isNull()).limit(1).count():
        raise UnverifiedCandidates("candidates wait for verification")
    rows = blocked(selected(candidates, modes), aliases, use_resolved)
    entries = with_ids(grouped(rows), previous)
    return {"entity": entries, "entity_reel": links(rows, entries), "entity_alias": alias_rows(rows, entries)}
