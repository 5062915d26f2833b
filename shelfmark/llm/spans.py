"""Spans of pattern matches as DataFrame expressions, in time linear in the text and its matches.

Spark's regexp functions give matches but not their places. The text split by a pattern, piece by piece with the matches
between, gives both: places are running sums of lengths in code points. Running sums and maxima are made in
blocks, as an array that grows by one element at a time would be copied each time. Parts of a text are cut out
of a list of its chunks, as Spark's substring walks the text from its beginning. Texts without a match stop after one pass.

Patterns here are possessive where a group or class repeats, so no text, however long, makes Java's matcher recurse or
try a run again from each of its characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, CHUNK = 256, 4096
SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"
BARE = "array<struct<start:bigint,end:bigint>>"
#: Stands for a character of a blanked span; no candidate pattern matches it.
BLANK = "\uffff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find(text: Column, pattern: str, may: Column | None = None) -> Column:
    """Array of (start, end, hit): the leftmost non-overlapping matches; code points, end exclusive. may: a cheap test that every text with a match passes."""
    none = F.array().cast(SPAN)

    def places(hits: Column) -> Column:
        # The gap after the last match has no match: its sum is cut off again.
        sizes = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("long"))
        ends = F.slice(running(sizes, lambda a, x: a + x), F.lit(1), F.size(hits))
        return F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, places(hits)).otherwise(none))
    return out if may is None else F.when(may, out).otherwise(none)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima (step) of an array of longs that aren't negative, each with its own value."""
    start = F.lit(0).cast("long")

    def inner(block: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        grown = F.aggregate(block, state, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(step(s["at"], x))).alias("out")))
        return grown["out"]

    def all_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, start, step))
        before = F.concat(F.array(start), inner(totals, start))
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda b, k: inner(b, F.get(at, k)))))

    def cut_up(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut_up(v), all_blocks)).otherwise(F.array().cast("array<bigint>")))


def bare(spans: Column) -> Column:
    """(start, end) of spans."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def ranked(kinds: list[tuple[str, Column]]) -> Column:
    """All spans as one array of (start, rank, kind, end), by start, then kind as listed; kinds: (kind, spans)."""
    return F.array_sort(F.concat(*[F.transform(c, _placed(i, kind)) for i, (kind, c) in enumerate(kinds)]))


def _placed(rank: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def chunks(text: Column) -> Column:
    """A text in pieces of CHUNK code points, to cut parts from."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}+"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end of a text's chunks; costs the chunks it touches."""
    start, end = start.cast("long"), end.cast("long")

    def piece(j: Column) -> Column:
        lo, hi = F.greatest(start - j * CHUNK, F.lit(0)), F.least(end - j * CHUNK, F.lit(CHUNK))
        return F.substring(F.get(pieces, j.cast("int")), (lo + 1).cast("int"), (hi - lo).cast("int"))

    return F.when(end > start, F.array_join(F.transform(F.sequence(F.floor(start / CHUNK), F.floor((end - 1) / CHUNK)), piece), "")).otherwise("")


def united(spans: Column) -> Column:
    """Spans sorted by start, as separate (start, end): those that overlap become one."""

    def unite(reach: Column, s: Column) -> Column:
        n = F.size(s)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(b, k + 1), n) - 1).alias("end"))))

    far = lambda s: running(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    return let(bare(spans), lambda s: F.when(F.size(s) > 0, let(far(s), lambda reach: unite(reach, s))).otherwise(F.array().cast(BARE)))


def masked(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """text with mask(span) in place of each of the united spans; spans are sorted by start."""

    def replace(u: Column, pieces: Column) -> Column:
        before = lambda k: F.coalesce(F.get(u, k - 1)["end"], F.lit(0))
        parts = F.transform(u, lambda x, k: F.concat(part(pieces, before(k), x["start"]), mask(x)))
        return F.concat(F.array_join(parts, ""), part(pieces, F.get(u, F.size(u) - 1)["end"], F.length(text)))

    return F.when(F.size(spans) > 0, let(united(spans), lambda u: let(chunks(text), lambda c: replace(u, c)))).otherwise(text)


def blanked(text: Column, spans: Column) -> Column:
    """text with BLANK for every character of spans (in any order), so that places stay."""
    return masked(text, F.array_sort(bare(spans)), lambda x: F.repeat(F.lit(BLANK), (x["end"] - x["start"]).cast("int")))


def apart(candidates: Column, text: Column, taken: Column) -> Column:
    """The candidates that overlap none of the taken spans (both of text); with none of either, nothing is compared."""
    clear = lambda pieces: F.filter(candidates, lambda x: ~part(pieces, x["start"], x["end"]).contains(BLANK))
    return F.when((F.size(candidates) > 0) & (F.size(taken) > 0), let(chunks(blanked(text, taken)), clear)).otherwise(candidates)
