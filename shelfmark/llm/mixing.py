"""Mixing sources to target weights by Pareto order sampling.

Targets: the words of all documents are shared among the sources by weight; a source stops at ``max_copies`` times
its own words and the excess goes to the others by weight. The common level of all sources below their stop
follows from running sums over the sources, in order of how much weight lifts them to their stop.

A document's expected copies are f = target / source size: floor(f) certain whole copies and, for the rest, a place in
a fixed-size sample with unequal probabilities. Its inclusion probability p goes with its preference, which is floor(sqrt(size)) + 1: longer
documents, which hold more connected text, are likelier to get the further copy; a column can stand in for it. Documents whose
share would be 1 or more are certain copies, too: they are taken first, and the probabilities of the others are scaled to what
is then left, so that the sum of p * size is the rest of the source's target, exactly. The others are ranked by
Q = (u / (1 - u)) / (p / (1 - p)), u their own random number, and the least are taken until the words due are met.

The sample is fixed in words, not in rows: the documents in order of Q as far as all of them fit. The gap that is left is under one
document; it is filled with the fewest documents (the largest that fits, then the largest that still fits, and so on down to the
least; of one length, those first in order of Q), and then by the one that comes nearest, if taking it is nearer than taking none.

No source is ever sorted in one place. Ranks are numbers of 60 bits; the words of each 1024th of a source's range are summed
before the shuffle, the 1024th in which the words due run out is divided again, and so on until it holds at most
``edge`` documents. Only those are ordered row by row, however large the source. The gap is filled from counts of lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.ordered import ROW, numbered, running

from .common import NON_WS_JAVA, bounded_broadcast, cut, release, text_or_empty

WEIGHTS = (5, 2, 1)
BITS, STEP, EDGE = 60, 10, 4096
GRAIN = 1 << BITS
MAX_SOURCES = 50_000
#: Where probabilities end, so that their odds are finite.
LEAST, MOST = 1e-9, 1 - 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_WS_JAVA + "+")).cast("long")


def _source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("v"), F.col(source).cast("string")), F.lit("~"))  # "~" stands after every "v..."


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 3) -> DataFrame:
    """skey, source_size, target for each source of sizes (skey, source_size); sources in code point order, null last, have the weights in turn.

    In order of how much weight lifts a source to its stop, the sources that stop are a beginning; their stops are summed up along that order.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    per = numbered(sizes, ["skey"], "nth", first=0).withColumn("w", weight).withColumn("cap", F.col("source_size") * max_copies).withColumn("ratio", F.col("cap") / F.col("w"))
    upto = cut(running(per, ["ratio", "skey"], {"caps": F.col("cap"), "ws": F.col("w")}).select(f"{ROW}.*", (F.col("caps") - F.col("cap")).alias("caps"), (F.col("ws") - F.col("w")).alias("ws")), "sources")
    total, weighs = upto.agg(F.sum("source_size"), F.sum("w")).first()
    share = (F.lit(float(total or 0)) - F.col("caps").cast("double")) / F.greatest(F.lit(weighs).cast("double") - F.col("ws"), "w")
    level = upto.select("ratio", share.alias("share")).where("share < ratio").agg(F.max("share")).first()[0]
    target = F.col("cap").cast("double") if level is None else F.when(F.col("ratio") <= level, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("w"))
    return upto.select("skey", "source_size", target.alias("target"))


def inclusion_levels(likes: DataFrame, rests: DataFrame) -> DataFrame:
    """skey, sure (words of the documents that are certain), bar (their least preference; null: none), scale (p = scale * liking below the bar).

    likes: skey, liking, words (a row for each preference that a source has); rests: skey, rest (the words due). From the largest preference
    down, one is certain if what is left for it and the lesser ones gives it a probability of 1 or more.
    """
    down = Window.partitionBy("skey").orderBy(F.desc("liking")).rowsBetween(Window.unboundedPreceding, -1)
    rows = likes.join(rests, "skey").withColumn("liked", F.col("liking") * F.col("words"))
    rows = rows.withColumns({"above": F.coalesce(F.sum("words").over(down), F.lit(0)), "part": F.sum("liked").over(Window.partitionBy("skey")) - F.coalesce(F.sum("liked").over(down), F.lit(0))})
    certain = (F.col("part") > 0) & (F.col("liking") * (F.col("rest") - F.col("above")) >= F.col("part"))
    rows = rows.withColumn("certain", certain)
    sums = rows.groupBy("skey", "rest").agg(F.coalesce(F.sum(F.when(F.col("certain"), F.col("words"))), F.lit(0)).alias("sure"), F.min(F.when(F.col("certain"), F.col("liking"))).alias("bar"), F.coalesce(F.sum(F.when(~F.col("certain"), F.col("liked"))), F.lit(0)).alias("open"))
    return sums.select("skey", "sure", "bar", ((F.col("rest") - F.col("sure")) / F.greatest("open", F.lit(1))).alias("scale"))


def pareto_rank(u: Column, p: Column) -> Column:
    """Random odds divided by inclusion odds: the least are taken first."""
    return (u / (1 - u)) / (p / (1 - p))


def prefix_end(rows: DataFrame, rooms: DataFrame, edge: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """skey, lo, end (the key of the last row taken; null if none is at lo or beyond), gap (words of room left) for each source of rooms (skey, room) whose rows don't all fit.

    rows: skey, key (struct of grain, ...), grain, size. Taken are rows in order of key as far as their words together stay within room; equal rows
    count as one. small: the hint for tables of one row a source.
    """
    state = rooms.select("skey", "room", F.lit(0).cast("long").alias("lo"), F.lit(GRAIN).cast("long").alias("hi"), F.lit(0).cast("long").alias("below"))
    for shift in range(BITS - STEP, -1, -STEP):
        inside = rows.join(small(state), "skey").where((F.col("grain") >= F.col("lo")) & (F.col("grain") < F.col("hi")))
        parts = inside.groupBy("skey", "room", "lo", "hi", "below", F.shiftright("grain", shift).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.col("below") + F.sum("words").over(Window.partitionBy("skey").orderBy("bin"))
        over = parts.withColumn("upto", upto).where(F.col("upto") > F.col("room")).groupBy("skey", "room").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("below"), "n")).alias("at"))
        new = over.select("skey", "room", F.shiftleft("at.bin", shift).alias("lo"), F.shiftleft(F.col("at.bin") + 1, shift).alias("hi"), F.col("at.below").alias("below"), F.col("at.n").alias("n"))
        new = cut(new, "edges")
        state = new.drop("n")
        if not new.where(F.col("n") > edge).limit(1).count():
            break
    inside = rows.join(small(state), "skey").where((F.col("grain") >= F.col("lo")) & (F.col("grain") < F.col("hi")))
    inside = inside.groupBy("skey", "key", "room", "below").agg(F.sum("size").alias("words"))
    upto = F.col("below") + F.sum("words").over(Window.partitionBy("skey").orderBy("key"))
    last = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("room")).groupBy("skey").agg(F.max("upto").alias("met"), F.max("key").alias("end"))
    return state.join(last, "skey", "left").select("skey", "lo", "end", (F.col("room") - F.coalesce("met", "below")).alias("gap"))


def _taken() -> Column:
    """Whether a row is in its source's prefix, from prefix_end's columns (null where all rows fit)."""
    return F.col("lo").isNull() | (F.col("grain") < F.col("lo")) | F.coalesce(F.col("key") <= F.col("end"), F.lit(False))


def gap_lengths(lengths: DataFrame) -> DataFrame:
    """skey, size, take: how many documents of which length fill each source's gap. lengths: skey, gap, size, n (untaken documents of that length, under 2 * gap)."""
    per = lengths.groupBy("skey", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    start = F.struct(F.col("gap").alias("left"), F.array().cast("array<struct<size:bigint,take:bigint>>").alias("takes"))

    def fill(acc: Column, x: Column) -> Column:
        take = F.least(x["n"], F.floor(acc["left"] / x["size"])).cast("long")
        more = F.struct((acc["left"] - take * x["size"]).alias("left"), F.concat(acc["takes"], F.array(F.struct(x["size"].alias("size"), take.alias("take")))).alias("takes"))
        return F.when(x["size"] <= acc["left"], more).otherwise(acc)  # lengths that don't fit leave no trace, so the list stays short

    filled = per.select("skey", "sizes", F.aggregate("sizes", start, fill).alias("f")).select("skey", "sizes", F.col("f.left").alias("left"), F.col("f.takes").alias("takes"))
    off = lambda x: F.abs(x["size"] - F.col("left"))
    over = F.filter("sizes", lambda x: (off(x) < F.col("left")) & ~F.exists("takes", lambda t: (t["size"] == x["size"]) & (t["take"] >= x["n"])))
    near = F.array_min(F.transform(over, lambda x: F.struct(off(x).alias("off"), x["size"].alias("size"))))["size"]
    rows = filled.select("skey", F.explode(F.concat("takes", F.array(F.struct(near.alias("size"), F.lit(1).cast("long").alias("take"))))).alias("t"))
    return rows.where("t.size is not null").groupBy("skey", "t.size").agg(F.sum("t.take").alias("take"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = 3, seed: str = "mix", prefer: str | None = None, edge: int = EDGE) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, inclusion; one row for each row of docs.

    taken is copies * size; inclusion is p (1: certain). Null and empty texts have size 0 and take 0 words; a source without words has
    target 0. Null sources are one source, the last. Random numbers come from the seed, doc_id and text, so reruns agree;
    identical rows are taken together or not at all. prefer: a column of positive whole preferences (null: 1) in the place
    of floor(sqrt(size)) + 1. No document exceeds max_copies copies: a fraction is left only where floor(f) < max_copies.
    """
    text = text_or_empty()
    grain = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))), 1, 15), 16, 10).cast("long")
    given = F.coalesce(F.col(f"`{prefer}`").cast("long"), F.lit(1)) if prefer else F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _source_key().alias("skey"), word_count(text).alias("size"), grain.alias("draw"), given.alias("given"))
    rows = cut(rows.withColumn("liking", F.coalesce("given", F.floor(F.sqrt("size")).cast("long") + 1)).drop("given"), "sizes")
    likes = cut(rows.groupBy("skey", "liking").agg(F.sum("size").alias("words")), "likes")
    plan = source_targets(likes.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, max_copies)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cut(plan.join(inclusion_levels(likes, plan.select("skey", "rest")), "skey"), "targets")
    release(docs.sparkSession)
    few = plan.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    small = F.broadcast if few else lambda df: df  # counted once: all tables below have a row a source
    sure = F.coalesce(F.col("liking") >= F.col("bar"), F.lit(False))
    p = F.least(F.greatest(F.col("scale") * F.col("liking"), F.lit(LEAST)), F.lit(MOST))
    # Q of the source's share alone has the odds of u; Q' / (1 + Q') brings the rank into [0, 1) around it.
    even = F.least(F.greatest(F.col("rest") / F.greatest("source_size", F.lit(1)), F.lit(LEAST)), F.lit(MOST))
    u = (F.col("draw") + 0.5) / float(GRAIN)
    ranked = rows.join(small(plan), "skey").withColumns({"sure": sure, "p": F.when(sure, 1.0).otherwise(p), "q": pareto_rank(u, p) * (even / (1 - even))})
    ranked = ranked.withColumn("grain", F.least(F.floor(F.col("q") / (1 + F.col("q")) * float(GRAIN)), F.lit(GRAIN - 1)))
    ranked = ranked.select("doc_id", "source", "skey", "size", "source_size", "target", "whole", "sure", "p", "grain", F.struct("grain", F.col("doc_id").isNull().alias("none"), "doc_id", "size").alias("key"))
    others = ranked.where("not sure").select("skey", "key", "grain", "size")
    rooms = plan.select("skey", F.greatest(F.floor(F.col("rest") - plan["sure"]), F.lit(0)).cast("long").alias("room"))
    ends = cut(prefix_end(others, rooms, edge, small), "ends")
    release(docs.sparkSession)
    left = others.join(small(ends), "skey").where(~_taken())
    lengths = left.where((F.col("size") > 0) & (F.col("size") < 2 * F.col("gap"))).groupBy("skey", "gap", "size").agg(F.count("*").alias("n"))
    takes = cut(gap_lengths(lengths), "takes")
    # Of each length that fills, the first in order of key; equal rows are one unit and go together.
    units = left.join(bounded_broadcast(takes, 100_000), ["skey", "size"]).groupBy("skey", "size", "take", "key").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("skey", "size").orderBy("key"))
    filled = units.withColumn("upto", upto).where("upto <= take").select("skey", "key", F.lit(True).alias("fills"))
    out = ranked.join(small(ends), "skey", "left").join(bounded_broadcast(cut(filled, "filled"), 100_000), ["skey", "key"], "left")
    further = F.col("sure") | _taken() | F.coalesce("fills", F.lit(False))
    copies = F.least(F.col("whole") + further.cast("long"), F.lit(max_copies)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source", F.col("p").alias("inclusion"))


ORACLE = """
WITH RECURSIVE base AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '~' ELSE 'v' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS draw
  FROM documents
), liked AS (SELECT *, floor(sqrt(size::DOUBLE))::BIGINT + 1 AS liking FROM base),
per AS (SELECT skey, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM liked GROUP BY skey),
cap AS (SELECT *, (source_size * 3)::BIGINT AS cap, (source_size * 3)::DOUBLE / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS total FROM per),
share AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(w) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM cap),
level AS (SELECT max(CASE WHEN share < ratio THEN share END) AS level FROM share),
goal AS (SELECT skey, source_size, CASE WHEN level IS NULL OR ratio <= level THEN cap::DOUBLE ELSE level * w END AS target FROM share, level),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goal),
rest AS (SELECT *, target - whole * source_size AS rest FROM plan),
likes AS (SELECT skey, liking, sum(size)::BIGINT AS words FROM liked GROUP BY 1, 2),
part AS (SELECT skey, liking, words, rest, coalesce(sum(words) OVER down, 0)::BIGINT AS above, ((sum(liking * words) OVER (PARTITION BY skey)) - coalesce(sum(liking * words) OVER down, 0))::BIGINT AS part
  FROM likes JOIN rest USING (skey) WINDOW down AS (PARTITION BY skey ORDER BY liking DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
certain AS (SELECT *, part > 0 AND liking * (rest - above) >= part AS certain FROM part),
levels AS (SELECT skey, coalesce(sum(CASE WHEN certain THEN words END), 0)::BIGINT AS sure_words, min(CASE WHEN certain THEN liking END) AS bar,
  (any_value(rest) - coalesce(sum(CASE WHEN certain THEN words END), 0)::BIGINT) / greatest(coalesce(sum(CASE WHEN NOT certain THEN liking * words END), 0), 1)::DOUBLE AS scale FROM certain GROUP BY skey),
odds AS (SELECT l.*, r.source_size, r.target, r.whole, greatest(floor(r.rest - v.sure_words), 0)::BIGINT AS room, (draw + 0.5::DOUBLE) / 1152921504606846976::DOUBLE AS u, coalesce(l.liking >= v.bar, false) AS sure,
  least(greatest(v.scale * l.liking, 1e-9::DOUBLE), (1 - 1e-9::DOUBLE)) AS p, least(greatest(r.rest / greatest(r.source_size, 1), 1e-9::DOUBLE), (1 - 1e-9::DOUBLE)) AS even FROM liked l JOIN rest r USING (skey) JOIN levels v USING (skey)),
pareto AS (SELECT *, ((u / (1 - u)) / (p / (1 - p))) * (even / (1 - even)) AS q FROM odds),
unit AS (SELECT skey, sure, least(floor(q / (1 + q) * 1152921504606846976::DOUBLE)::BIGINT, 1152921504606846975) AS grain, doc_id, size, any_value(source_size) AS source_size, any_value(target) AS target, any_value(whole) AS whole, any_value(room) AS room, sum(size)::BIGINT AS words, count(*) AS n FROM pareto GROUP BY ALL),
one AS (SELECT *, NOT sure AND sum(CASE WHEN sure THEN 0 ELSE words END) OVER (PARTITION BY skey ORDER BY grain, doc_id NULLS LAST, size) <= room AS fits FROM unit),
gaps AS (SELECT *, room - coalesce(sum(CASE WHEN fits THEN words END) OVER (PARTITION BY skey), 0)::BIGINT AS gap FROM one),
lengths AS (SELECT skey, gap, size, sum(n)::BIGINT AS n FROM gaps WHERE NOT sure AND NOT fits AND size > 0 AND size < 2 * gap GROUP BY ALL),
fill AS (
  SELECT skey, gap AS open, gap + 1 AS size, 0::BIGINT AS take FROM lengths GROUP BY skey, gap
  UNION ALL
  SELECT f.skey, f.open - least(l.n, f.open // l.size) * l.size, l.size, least(l.n, f.open // l.size) FROM fill f JOIN lengths l ON l.skey = f.skey AND l.size <= f.open AND l.size < f.size
  QUALIFY row_number() OVER (PARTITION BY f.skey ORDER BY l.size DESC) = 1
),
opens AS (SELECT skey, min(open) AS open FROM fill GROUP BY skey),
taking AS (SELECT l.skey, l.size, coalesce(f.take, 0) AS take, l.n - coalesce(f.take, 0) AS over, o.open FROM lengths l JOIN opens o USING (skey) LEFT JOIN fill f ON f.skey = l.skey AND f.size = l.size AND f.take > 0),
near AS (SELECT skey, arg_min(size, (abs(size - open), size)) AS near FROM taking WHERE over > 0 AND abs(size - open) < open GROUP BY skey),
takes AS (SELECT t.skey, t.size, t.take + CASE WHEN t.size = near THEN 1 ELSE 0 END AS take FROM taking t LEFT JOIN near USING (skey)),
last AS (SELECT g.*, NOT g.sure AND NOT g.fits AND coalesce(sum(CASE WHEN NOT g.sure AND NOT g.fits THEN g.n ELSE 0 END) OVER (PARTITION BY g.skey, g.size ORDER BY grain, doc_id NULLS LAST) <= t.take, false) AS fills FROM gaps g LEFT JOIN takes t ON t.skey = g.skey AND t.size = g.size)
SELECT doc_id, size, source_size, target, (least(whole + (sure OR fits OR fills)::INT, 3) * size)::BIGINT AS taken FROM (SELECT *, unnest(range(n)) FROM last)
"""
