"""Evidence: whether a candidate's citations stand in the sources they declare, and the verification that follows.

candidates: id, shortcode, name, evidence array<struct<source, quote, match, location>>.
sources: shortcode, caption, transcript, ocr, frames map<string, string> (empty if OCR kept no frames).
One equi join by shortcode; everything else is expressions on the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import attested, near_literal, squeeze

PARTITIONS = ("caption", "transcript", "ocr")
ISSUES = {
    "phonetic": "a phonetic match is only valid for a transcript",
    "frame": "unknown OCR frame",
    "location": "only OCR evidence may carry a frame location",
    "no_frame": "OCR evidence needs its frame location",
    "quote": "quote not found in the declared source",
    "name": "a literal quote does not contain the entity name",
}


def _norm(c: Column) -> Column:
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def _judge(x: Column, name: Column, frames: Column, text: dict[str, Column]) -> Column:
    """issue (null if the citation is good) and location of a citation; text: the normalised sources."""
    source, place = x["source"], F.coalesce(x["location"], F.lit(""))
    has_frames = F.size(frames) > 0
    at_frame = (source == "ocr") & (place != "")
    known = F.array_contains(F.map_keys(frames), place)
    body = F.when(at_frame & known, _norm(frames[place])).when(source == "caption", text["caption"]).when(source == "transcript", text["transcript"]).when(source == "ocr", text["ocr"])
    quote = _norm(x["quote"])
    issue = (
        F.when((x["match"] == "phonetic") & (source != "transcript"), ISSUES["phonetic"])
        .when(at_frame & ~known & has_frames, ISSUES["frame"])
        .when((source != "ocr") & (place != ""), ISSUES["location"])
        .when((source == "ocr") & (place == "") & has_frames, ISSUES["no_frame"])
        .when((quote == "") | ~F.coalesce(body.contains(quote), F.lit(False)), ISSUES["quote"])
        .when((x["match"] == "literal") & ~quote.contains(name), ISSUES["name"])
    )
    return F.struct(source.alias("source"), x["quote"].alias("quote"), x["match"].alias("match"), F.when(at_frame & ~known, "").otherwise(place).alias("location"), issue.alias("issue"))


def assess(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """candidates with status (literal, phonetic, variant, invalid, missing), note and kept (the citations that stand)."""
    side = sources.select("shortcode", *[F.coalesce(p, F.lit("")).alias(f"__{p}") for p in PARTITIONS], F.coalesce("frames", F.create_map().cast("map<string,string>")).alias("__frames"))
    df = candidates.join(side, "shortcode", "left").withColumn("__name", _norm(F.col("name")))
    df = df.withColumns({f"__{p}": F.coalesce(f"__{p}", F.lit("")) for p in PARTITIONS} | {"__frames": F.coalesce("__frames", F.create_map().cast("map<string,string>"))})
    df = df.withColumns({f"__n_{p}": _norm(F.col(f"__{p}")) for p in PARTITIONS})  # once a row
    text, plain = {p: F.col(f"__n_{p}") for p in PARTITIONS}, {p: F.col(f"__{p}") for p in PARTITIONS}
    df = df.withColumn("__judged", F.transform("evidence", lambda x: _judge(x, F.col("__name"), F.col("__frames"), text)))
    df = df.withColumn("__good", F.filter("__judged", lambda x: x["issue"].isNull()))
    where = F.when(text["caption"].contains(F.col("__name")), "caption").when(text["transcript"].contains(F.col("__name")), "transcript").when(text["ocr"].contains(F.col("__name")), "ocr")
    frame = F.when(where == "ocr", F.coalesce(F.try_element_at(F.sort_array(F.map_keys(F.map_filter("__frames", lambda _, t: _norm(t).contains(F.col("__name"))))), F.lit(1)), F.lit(""))).otherwise("")
    cite = lambda source, quote, match, location: F.struct(source.alias("source"), quote.alias("quote"), match.alias("match"), location.alias("location"))
    df = df.withColumn("__repair", F.when((F.col("__name") != "") & where.isNotNull(), cite(where, F.col("name"), F.lit("literal"), frame)))
    good = F.transform("__good", lambda x: cite(x["source"], x["quote"], x["match"], x["location"]))
    none, literal = F.size("__good") == 0, F.exists("__good", lambda x: x["match"] == "literal")
    repaired = F.col("__repair").isNotNull()
    near = F.coalesce(*[F.when(near_literal(plain[p], F.col("name")), F.lit(p)) for p in PARTITIONS])
    empty = F.coalesce(F.size("evidence"), F.lit(0)) <= 0
    first_issue = F.try_element_at(F.filter(F.transform("__judged", lambda x: x["issue"]), lambda i: i.isNotNull()), F.lit(1))
    dropped = F.size("__judged") - F.size("__good")
    status = F.when(empty, "missing").when(repaired & (none | ~literal), "literal").when(none & near.isNotNull(), "variant").when(none, "invalid").when(literal, "literal").otherwise("phonetic")
    note = (
        F.when(empty, "no evidence was supplied").when(repaired & (none | ~literal), "repaired a malformed citation")
        .when(none & near.isNotNull(), F.concat(F.lit("near-literal name variant in "), near)).when(none, F.coalesce(first_issue, F.lit("no valid evidence")))
        .when(dropped > 0, F.concat(F.lit("discarded "), dropped.cast("string"), F.lit(" unsupported citation(s)"))).when(~literal, "transcript spelling needs review")
    )
    kept = F.when(empty | (none & ~repaired), F.array().cast("array<struct<source:string,quote:string,match:string,location:string>>")).when(none, F.array("__repair")).when(repaired & ~literal, F.concat(good, F.array("__repair"))).otherwise(good)
    return df.select(*candidates.columns, status.alias("status"), note.alias("note"), kept.alias("kept"))


def verify(assessed: DataFrame, sources: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """assessed with verified: 0 for missing or invalid evidence, 1 for literal, else an outside verdict (id, verdict), which a literal attestation overrides; null without one."""
    side = sources.select("shortcode", F.concat_ws(" \n ", *[F.when(F.col(p) != "", F.lower(p)) for p in PARTITIONS]).alias("__all"))
    df = assessed.join(side, "shortcode", "left")
    if verdicts is None:
        df = df.withColumn("__v", F.lit(None).cast("boolean"))
    else:
        df = df.join(verdicts.select("id", F.col("verdict").alias("__v")), "id", "left")
    open_ = F.when(F.col("__v").isNotNull(), F.col("__v") | attested(F.coalesce("__all", F.lit("")), F.col("name")))
    verified = F.when(F.col("status").isin("missing", "invalid"), False).when(F.col("status") == "literal", True).otherwise(open_)
    return df.select(*assessed.columns, verified.alias("verified"))


def needs_verdict(assessed: DataFrame) -> DataFrame:
    """The rows that a costly outside verdict is worth asking for."""
    return assessed.where(F.col("status").isin("phonetic", "variant"))
