"""Quality: the scorecard of expected against actual results, and statistics of the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import loose_key, name_key, without_accents
from shelfmark.operators.orderstats import order_statistics
from shelfmark.operators.votes import ratio


def match_expected(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected (case, ord, name, aliases, types) with found and type_ok against actual (case, name, name_latin, type, id).

    An expected entity is found if any of its aliases has the key of an actual name or latin form.
    """
    keys = expected.select("case", "ord", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).select("case", "ord", name_key("a").alias("k")).distinct()
    have = actual.select("case", "id", "type", F.explode(F.array("name", "name_latin")).alias("n")).where("n <> ''").select("case", "id", "type", name_key("n").alias("k"))
    have = have.groupBy("case", "k").agg(F.min_by("type", "id").alias("t"), F.min("id").alias("id"))
    met = keys.join(have, ["case", "k"]).groupBy("case", "ord").agg(F.min_by("t", "id").alias("t"))
    out = expected.join(met, ["case", "ord"], "left")
    return out.withColumn("found", F.col("t").isNotNull()).withColumn("type_ok", (F.size("types") <= 0) | F.col("types").isNull() | F.array_contains("types", F.col("t"))).withColumnRenamed("t", "actual_type")


def false_positives(expected: DataFrame, actual: DataFrame, complete: DataFrame) -> DataFrame:
    """Actual rows of complete cases (case) that no expected alias accounts for."""
    accepted = expected.select("case", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).select("case", name_key("a").alias("k")).distinct()
    rows = actual.join(complete.select("case").distinct(), "case", "left_semi")
    hit = rows.select("case", "id", F.explode(F.array("name", "name_latin")).alias("n")).where("n is not null").select("case", "id", name_key("n").alias("k")).join(accepted, ["case", "k"]).select("case", "id").distinct()
    return rows.join(hit, ["case", "id"], "left_anti")


def projected(actual: DataFrame, decisions: DataFrame) -> DataFrame:
    """actual with the name that the decision on it (id, status, canonical_name) resolves, its own where it abstains."""
    said = decisions.select("id", F.when(F.col("status") == "resolved", F.col("canonical_name")).alias("__name"))
    return actual.join(said, "id", "left").withColumn("name", F.coalesce("__name", "name")).drop("__name")


def named_found(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """case, wanted, met of expected (case, ord, name, aliases) whose name or an alias has the key of an actual (case, name)."""
    keys = expected.select("case", "ord", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).select("case", "ord", name_key("a").alias("k")).distinct()
    hit = keys.join(actual.select("case", name_key("name").alias("k")).distinct(), ["case", "k"], "left_semi").select("case", "ord").distinct().withColumn("hit", F.lit(1))
    return expected.join(hit, ["case", "ord"], "left").groupBy("case").agg(F.count("*").alias("wanted"), F.count("hit").alias("met"))


def terms_found(terms: DataFrame, points: DataFrame) -> DataFrame:
    """case, wanted, met of terms (case, term) whose key stands in the key of the case's key points (case, points array), joined by spaces."""
    said = points.select("case", name_key(F.array_join("points", " ")).alias("said"))
    rows = terms.join(said, "case", "left")
    return rows.groupBy("case").agg(F.count("*").alias("wanted"), F.count_if(F.coalesce("said", F.lit("")).contains(name_key("term"))).alias("met"))


def case_results(cases: DataFrame, expected: DataFrame, actual: DataFrame, extraction: DataFrame, decisions: DataFrame | None = None, recipes: tuple[DataFrame, DataFrame] | None = None, terms: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row a case: its status, what was expected of it and what of that was met, and what is missing.

    recipes: (expected (case, ord, name, aliases), actual (case, name)); terms: (expected (case, term), (case, points)).
    """
    met = match_expected(expected, actual)
    found = met.groupBy("case").agg(
        F.count("*").alias("entities_expected"), F.count_if("found").alias("entities_found"), F.count_if(F.col("found") & ~F.col("type_ok")).alias("type_errors"),
        F.transform(F.sort_array(F.collect_list(F.when(~F.col("found"), F.struct("ord", "name")))), lambda x: x["name"]).alias("missing"),
    )
    complete = cases.where(F.col("scope") == "complete")
    count = lambda df, name: df.groupBy("case").agg(F.count("*").alias(name))
    shown = actual if decisions is None else projected(actual, decisions)
    df = cases.join(found, "case", "left").join(count(false_positives(expected, actual, complete), "false_positives"), "case", "left")
    canon = match_expected(expected, shown).groupBy("case").agg(F.count_if("found").alias("canonicalized_found"))
    df = df.join(canon, "case", "left").join(count(false_positives(expected, shown, complete), "canonicalized_false_positives"), "case", "left")
    if decisions is None:
        df = df.withColumns({"resolved": F.lit(0), "abstained": F.lit(0)})
    else:
        said = actual.select("case", "id").join(decisions.select("id", "status"), "id").groupBy("case").agg(F.count_if(F.col("status") == "resolved").alias("resolved"), F.count_if(F.col("status") == "abstained").alias("abstained"))
        df = df.join(said, "case", "left")
    for name, part in (("recipes", recipes and named_found(*recipes)), ("terms", terms and terms_found(*terms))):
        df = df.join(part.select("case", F.col("wanted").alias(f"{name}_expected"), F.col("met").alias(f"{name}_found")), "case", "left") if part else df.withColumns({f"{name}_expected": F.lit(0), f"{name}_found": F.lit(0)})
    e = extraction.select("case", "ok", *[F.col(c).alias(f"__{c}") for c in ("mode", "content_kind", "actionable")])
    df = df.join(e, "case", "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    status = F.when(F.col("ok").isNull(), "absent").when(~ok, "failed").otherwise("ok")
    right = {}
    for c in ("mode", "content_kind", "actionable"):
        said = F.coalesce(F.col("__content_kind"), F.lit("")) if c == "content_kind" else F.col(f"__{c}")
        right[f"{c}_correct"] = F.when(F.col(c).isNotNull(), ok & F.coalesce(said == F.col(c), F.lit(False)))
    df = df.withColumns({"status": status, **right}).withColumn("fp_cases", (F.col("scope") == "complete").cast("int"))
    return df.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in COUNTS} | {"missing": F.coalesce("missing", F.array().cast("array<string>"))}).drop("__mode", "__content_kind", "__actionable")


COUNTS = (
    "entities_expected", "entities_found", "type_errors", "false_positives", "fp_cases", "canonicalized_found", "canonicalized_false_positives", "resolved", "abstained",
    "recipes_expected", "recipes_found", "terms_expected", "terms_found",
)


def scorecard(cases: DataFrame, expected: DataFrame, actual: DataFrame, extraction: DataFrame, by: str | None = None, **more) -> DataFrame:
    """Counts and ratios over cases (case, category, scope, mode, content_kind, actionable; null: not expected), in all or by a column.

    actual: model rows only; human ones are to be left out by the caller. extraction: case, ok, mode, content_kind, actionable. more: see case_results.
    """
    df = case_results(cases, expected, actual, extraction, **more)
    sums = [F.count("*").alias("cases"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]]
    for c in ("mode", "content_kind", "actionable"):
        sums += [F.count(c).alias(f"{c}_expected"), F.count_if(f"{c}_correct").alias(f"{c}_correct")]
    df = df.groupBy(by).agg(*sums) if by else df.agg(*sums)
    ratios = {"recall": ratio(F.col("entities_found"), F.col("entities_expected")), "canonicalized_recall": ratio(F.col("canonicalized_found"), F.col("entities_expected"))}
    ratios |= {"recipe_recall": ratio(F.col("recipes_found"), F.col("recipes_expected")), "term_recall": ratio(F.col("terms_found"), F.col("terms_expected"))}
    ratios |= {f"{c}_accuracy": ratio(F.col(f"{c}_correct"), F.col(f"{c}_expected")) for c in ("mode", "content_kind", "actionable")}
    return df.withColumns(ratios)


def passed(card: DataFrame) -> bool:
    """Whether every expectation is met: the gate of a release."""
    return card.where("recall < 1 or mode_accuracy < 1 or content_kind_accuracy < 1 or actionable_accuracy < 1 or type_errors > 0 or false_positives > 0").limit(1).count() == 0


def _middle() -> dict[str, Column]:
    return {"lo": F.floor((F.col("n") - 1) / 2), "hi": F.floor(F.col("n") / 2)}


def length_stats(df: DataFrame, *fields: str, by: Sequence[str] = ()) -> DataFrame:
    """n, median, p90 (the value at int(0.9 n) of the sorted values) and max; with by for each group, with more than one field (then named) for each."""
    s = order_statistics(df, fields, _middle() | {"p90": F.floor(F.col("n") * 9 / 10), "max": F.col("n") - 1}, by)
    return s.select(*by, *(["field"] if len(fields) > 1 else []), "n", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "p90", "max")


def frame_stats(df: DataFrame, field: str, cap: int) -> DataFrame:
    """total, at_cap, saved, median and max: how many frames there are, how many rows reach the cap, what the cap saves."""
    v = F.col(field)
    median = order_statistics(df, [field], _middle()).select((F.col("lo") + F.col("hi")) / 2).first()[0]
    sums = df.agg(F.count(v).alias("n"), F.coalesce(F.sum(v), F.lit(0)).cast("long").alias("total"), F.count_if(v >= cap).alias("at_cap"), F.coalesce(F.sum(v) - F.sum(F.least(v, F.lit(cap))), F.lit(0)).cast("long").alias("saved"), F.max(v).alias("max"))
    return sums.select("n", "total", "at_cap", "saved", F.lit(median).cast("double").alias("median"), "max")


def worst(df: DataFrame, field: str, key: str, n: int = 5) -> DataFrame:
    """The n rows with the least values, ties by key."""
    return df.where(F.col(field).isNotNull()).orderBy(field, key).limit(n).select(field, key)


def mean_of(segments: Column, field: str) -> Column:
    """Mean of a field over an array of structs, null without values."""
    values = F.filter(F.transform(segments, lambda s: s[field]), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def rank_stats(df: DataFrame, *fields: str, by: Sequence[str] = ()) -> DataFrame:
    """n, least, p10 (index n // 10), median (index n // 2) and most, without interpolation; by and several fields as in length_stats."""
    s = order_statistics(df, fields, {"least": F.lit(0), "p10": F.floor(F.col("n") / 10), "median": F.floor(F.col("n") / 2), "most": F.col("n") - 1}, by)
    return s.drop("field") if len(fields) == 1 else s


def attribution(name: Column, free_text: Column, ocr: Column) -> Column:
    """Which source carries a name: caption_asr, ocr_only or reworded."""
    norm = lambda c: without_accents(loose_key(c))
    bare = F.trim(norm(name))
    return F.when((bare != "") & norm(free_text).contains(bare), "caption_asr").when((bare != "") & norm(ocr).contains(bare), "ocr_only").otherwise("reworded")


def at_risk(carriers: DataFrame, frames: DataFrame, cap: int, key: str = "shortcode") -> DataFrame:
    """Carrier reels whose latest frame count is over the cap, and would lose frames."""
    return carriers.select(key).distinct().join(frames.where(F.col("frames_used") > cap).select(key, "frames_used"), key)
