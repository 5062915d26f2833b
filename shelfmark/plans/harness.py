"""The benchmark harness: slice, extract, resolve, score, report. The extraction is a callable that is passed in."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import quality, resolve
from shelfmark.sources.media import slice_tables

Tables = dict[str, DataFrame]


def case_tables(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, expected entities) as the scorecard takes them, from validated scorecard cases."""
    entity = "struct<name:string,type:string,types:array<string>,aliases:array<string>>"
    named = F.transform(F.coalesce("expected_names", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("array<string>").alias("types"), F.lit(None).cast("array<string>").alias("aliases")).cast(entity))
    wanted = F.when(F.size(F.coalesce("expected_entities", F.array().cast(f"array<{entity}>"))) > 0, F.col("expected_entities")).otherwise(named)
    head = cases.select(F.col("shortcode").alias("case"), "category", F.col("entity_scope").alias("scope"), F.col("expected_mode").alias("mode"), F.col("expected_content_kind").alias("content_kind"), F.col("expected_actionable").alias("actionable"))
    rows = cases.select(F.col("shortcode").alias("case"), F.posexplode(wanted).alias("ord", "e"))
    types = F.coalesce("e.types", F.when(F.col("e.type").isNotNull(), F.array("e.type")), F.array().cast("array<string>"))
    return head, rows.select("case", "ord", F.col("e.name").alias("name"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"), types.alias("types"))


def run(sources: Tables, cases: DataFrame, extract: Callable[[Tables], Tables], by: str | None = None) -> Tables:
    """scorecard, false_positives and the resolved tables. extract gets the sliced sources and returns candidate (with id, verified, source) and extraction."""
    kept = slice_tables(sources, cases)
    made = extract(kept)
    head, expected = case_tables(cases)
    candidates = made["candidate"].where(F.col("source") == "llm")
    actual = candidates.withColumnRenamed("shortcode", "case")
    extraction = made["extraction"].withColumnRenamed("shortcode", "case")
    catalogue = resolve.resolve(made["candidate"], force=True)
    complete = head.where(F.col("scope") == "complete")
    more = {k: made[k] for k in ("decisions",) if k in made}
    if "recipe" in made:
        wanted = cases.select(F.col("shortcode").alias("case"), F.posexplode("expected_recipes").alias("ord", "r")).select("case", "ord", "r.name", "r.aliases")
        more["recipes"] = (wanted, made["recipe"].select(F.col("shortcode").alias("case"), F.col("dish_name").alias("name")))
    if "key_points" in made["extraction"].columns:
        terms = cases.select(F.col("shortcode").alias("case"), F.explode("expected_terms").alias("term"))
        more["terms"] = (terms, extraction.select("case", F.col("key_points").alias("points")))
    return {"scorecard": quality.scorecard(head, expected, actual, extraction, by, **more), "cases": quality.case_results(head, expected, actual, extraction, **more), "false_positives": quality.false_positives(expected, actual, complete), "matches": quality.match_expected(expected, actual), **catalogue}


def report(card: DataFrame) -> str:
    """The scorecard as JSON, every category of it, row by row."""
    return json.dumps([r.asDict() for r in card.toLocalIterator()], ensure_ascii=False, sort_keys=True, indent=2)


def write_report(card: DataFrame, path: str) -> None:
    """The scorecard as JSON lines in a folder."""
    card.write.json(path)


def inside(base: str, path: str) -> bool:
    """Whether a path, taken from base if it is relative, stays in base; nothing on disk is looked at."""
    root, full = os.path.normpath(base), os.path.normpath(os.path.join(base, path))
    return full == root or full.startswith(root.rstrip("/") + "/")
