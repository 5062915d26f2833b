"""Keyed state: latest and first rows, upserts that keep history, soft deletes, append-only logs.

Every function is pure: it takes the old state and the new rows and returns the new state, which the caller writes
beside the old one and swaps in. A failed run therefore leaves the old rows as they were, and replaying a batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfmark.scratch import cut


def _nth(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark prunes to n a partition before the shuffle (WindowGroupLimit)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def latest_per_key(df: DataFrame, keys: Sequence[str], *by: str) -> DataFrame:
    """One row a key, the greatest by the columns given (end with a unique one: stamps have ties)."""
    return _nth(df, keys, [F.col(c).desc_nulls_last() for c in by], 1)


def first_per_key(df: DataFrame, keys: Sequence[str], *by: str) -> DataFrame:
    """One row a key, the least: first wins."""
    return _nth(df, keys, [F.col(c).asc_nulls_last() for c in by], 1)


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    return _nth(df, keys, list(order), n)


def upsert_seen(old: DataFrame, batch: DataFrame, key: str = "shortcode", stamp: str = "seen_at", seq: str = "seq", watch: Observation | None = None) -> DataFrame:
    """old (key, fields, first_seen_at, last_seen_at, unsaved_at) with a batch (key, fields, stamp, seq) applied.

    first_seen_at never moves, last_seen_at does, a row that is seen again isn't deleted any more; blank keys are
    skipped; within a batch the last row wins, and a new key was first seen at its first row. Fields that only old has are kept.
    watch: gets the counts of upsert_counts, and kept (keys that the batch hasn't), from the job that writes the result, with no job of their own.
    """
    named = batch.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    rest = [c for c in batch.columns if c != key]
    new = named.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(stamp, seq)).alias("__l"), F.min(stamp).alias("__first"), F.count("*").alias("__n")).select(key, "__l.*", "__first", "__n")
    fields = [c for c in old.columns if c in rest]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    here = F.col(f"n.{key}").isNotNull()
    if watch is not None:
        inserted = F.coalesce(F.count_if(here & F.col(f"o.{key}").isNull()), F.lit(0))
        joined = joined.observe(watch, inserted.alias("inserted"), (F.coalesce(F.sum("__n"), F.lit(0)) - inserted).alias("updated"), F.count_if(~here).alias("kept"))
    out = {key: F.coalesce(f"n.{key}", f"o.{key}")}
    for c in old.columns:
        if c in fields:
            out[c] = F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        elif c not in (key, "first_seen_at", "last_seen_at", "unsaved_at"):
            out[c] = F.col(f"o.{c}")
    out["first_seen_at"] = F.coalesce("o.first_seen_at", "n.__first")
    out["last_seen_at"] = F.coalesce(f"n.{stamp}", "o.last_seen_at")
    out["unsaved_at"] = F.when(~here, F.col("o.unsaved_at"))
    return joined.select(*[out[c].alias(c) for c in old.columns])


def upsert_counts(old: DataFrame, batch: DataFrame, key: str = "shortcode") -> DataFrame:
    """inserted, updated: rows of the batch, repeats counted each time but a new key's first, which is the insert."""
    rows = batch.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").groupBy(key).count()
    known = rows.join(old.select(key).distinct().withColumn("known", F.lit(1)), key, "left")
    inserted = F.coalesce(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)), F.lit(0))
    return known.agg(inserted.alias("inserted"), (F.coalesce(F.sum("count"), F.lit(0)) - inserted).alias("updated"))


def mark_absent(state: DataFrame, seen: DataFrame, stamp: Column, complete: bool = True, key: str = "shortcode") -> DataFrame:
    """Stamp unsaved_at on rows that a complete walk didn't see; an incomplete or empty walk marks nothing."""
    if not complete or not seen.limit(1).count():
        return state
    marked = state.join(seen.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    return marked.withColumn("unsaved_at", F.when(F.col("__k").isNull() & F.col("unsaved_at").isNull(), stamp).otherwise(F.col("unsaved_at"))).select(*state.columns)


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whole-row replacement: a key's new row stands, nothing of the old one."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """First wins: rows of new whose key neither old nor an earlier row of new has are added."""
    return old.unionByName(first_per_key(new, keys, *order).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def replace_by_origin(old: DataFrame, new: DataFrame, key: str, origin: str, column: str = "source") -> DataFrame:
    """Replace one origin's rows under the keys of new; rows of other origins stay."""
    mine = old.where(F.col(column) == origin).join(new.select(key).distinct(), key, "left_anti")
    return old.where(~F.col(column).eqNullSafe(F.lit(origin))).unionByName(mine).unionByName(new)


def sync_active(old: DataFrame, present: DataFrame, keys: Sequence[str], scope: str, scopes: DataFrame | None = None) -> DataFrame:
    """Rows of the scopes worked on are active if their key is present, else switched off; new keys come in active.

    scopes lists what was worked on, which may have nothing present any more; without it, it is what present has.
    """
    here = present.select(*keys).distinct().withColumn("__here", F.lit(True))
    done = (present if scopes is None else scopes).select(scope).distinct().withColumn("__scope", F.lit(True))
    kept = old.join(here, list(keys), "left").join(done, scope, "left")
    kept = kept.withColumn("active", F.when(F.col("__scope"), F.col("__here").isNotNull()).otherwise(F.col("active"))).select(*old.columns)
    fresh = present.join(old.select(*keys), list(keys), "left_anti").withColumn("active", F.lit(True))
    return kept.unionByName(fresh, allowMissingColumns=True)


def fold_attempts(log: DataFrame, keys: Sequence[str], *by: str) -> DataFrame:
    """attempts, status, last_error of each key from its log of (status, error) rows; attempts counts failures."""
    last = F.struct(*by, "status", "error")
    return log.groupBy(*keys).agg(F.count_if(F.col("status") == "failed").alias("attempts"), F.max(last).alias("__l")).select(*keys, "attempts", F.col("__l.status").alias("status"), F.when(F.col("__l.status") != "done", F.col("__l.error")).alias("last_error"))


def merge_patches(current: DataFrame, patches: DataFrame, key: str, fields: Sequence[str], *by: str) -> tuple[DataFrame, DataFrame]:
    """(new current rows, the full snapshots to append) of patches whose fields are (set boolean, value) structs.

    A field that isn't set keeps its value, one set to null becomes null. Patches of a key apply in the order given.
    """
    base = current.select(key, *fields)
    rows = patches.join(base.select(key, *[F.col(f).alias(f"__{f}") for f in fields]), key, "left")
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in by]).rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.coalesce(F.last(F.when(F.col(f)["set"], F.struct(F.col(f)["value"].alias("v"))), ignorenulls=True).over(w), F.struct(F.col(f"__{f}").alias("v")))["v"].alias(f) for f in fields]
    history = rows.select(key, *by, *cols)
    newest = latest_per_key(history, [key], *by).select(key, *fields)
    return replace_rows(base, newest, [key]), history


def reviewed(patches: DataFrame, today: Column) -> DataFrame:
    """patches in which a status that is set, without a review date that is, gets today's."""
    dated = F.col("status")["set"] & ~F.col("reviewed_at")["set"]
    return patches.withColumn("reviewed_at", F.when(dated, F.struct(F.lit(True).alias("set"), today.cast("string").alias("value"))).otherwise(F.col("reviewed_at")))


def mark_running(log: DataFrame, items: DataFrame, stage: str, stamp: Column, key: str = "shortcode", seq: Column | None = None) -> DataFrame:
    """log (key, stage, status, at, and seq if given) with a running mark for each item, to be written before the work: a mark alone makes nothing authoritative.

    seq: a number that grows along the marks of a key; stamps alone have ties.
    """
    marks = [F.lit(stage).alias("stage"), F.lit("running").alias("status"), stamp.alias("at"), *([seq.alias("seq")] if seq is not None else [])]
    return log.unionByName(items.select(key, *marks), allowMissingColumns=True)


def interrupted(log: DataFrame, results: DataFrame, stage: str, key: str = "shortcode") -> DataFrame:
    """Keys whose last mark of the stage is running and that have no result: what a crash left, and a new run takes up from the start.

    The last mark is the one with the greatest (at, seq). Where these tie, or log has no seq, a running mark is the start of what
    else was marked then, so it isn't the last.
    """
    seq = F.col("seq") if "seq" in log.columns else F.lit(None).cast("long")
    mine = log.where(F.col("stage") == stage).select(key, "status", "at", seq.alias("seq"), (F.col("status") != "running").alias("ended"))
    last = latest_per_key(mine, [key], "at", "seq", "ended", "status")
    return last.where(F.col("status") == "running").join(results.select(key), key, "left_anti").select(key)


def latest_success(results: DataFrame, attempts: DataFrame, key: str = "shortcode") -> DataFrame:
    """results (key, model, prompt_sha, context_sha) with the duration_ms of the last successful attempt of the same key, model and prompt, and of the same context where the result has one."""
    r, a = results.alias("r"), attempts.where(F.col("ok") == 1).alias("a")
    same = [F.col(f"r.{c}") == F.col(f"a.{c}") for c in (key, "model", "prompt_sha")]
    fits = F.col("r.context_sha").isNull() | (F.col("r.context_sha") == F.col("a.context_sha"))
    best = r.join(a, [*same, fits]).groupBy(f"r.{key}", "r.model", "r.prompt_sha", "r.context_sha").agg(F.max_by("a.duration_ms", "a.id").alias("duration_ms"))
    keys = [key, "model", "prompt_sha", "context_sha"]
    best = best.select(*[F.col(c).alias(f"__{c}") for c in keys], "duration_ms")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return results.join(best, on, "left").drop(*[f"__{c}" for c in keys])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key the parent lacks: what a foreign key would refuse."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def cascaded_through(tables: dict[str, tuple[DataFrame, str]], references: Sequence[tuple[str, str, str, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables (name -> (rows, id column)) without the rows of gone (name -> ids, one column) and all that refers to them, over any number of levels.

    references: (child, its column, parent, the column meant there), each with a key of its own; they may form cycles. Each level is one semi join a
    reference with the rows found on the level before, and ends where nothing new is found. A null refers to nothing,
    and a row whose id is null can't be meant.
    """
    dead = {name: ids.select(F.col(f"`{ids.columns[0]}`").alias("__gone")).where("__gone is not null").distinct() for name, ids in gone.items()}
    level = dead = {name: cut(ids, "gone") for name, ids in dead.items()}
    while level:
        found: dict[str, DataFrame] = {}
        for child, column, parent, meant in references:
            if parent in level:
                rows, own = tables[parent]
                keys = rows.join(level[parent], F.col(f"`{own}`") == F.col("__gone"), "left_semi").select(F.col(f"`{meant}`").alias("__k")).distinct()
                kids, own = tables[child]
                hit = kids.join(keys, F.col(f"`{column}`") == F.col("__k"), "left_semi").select(F.col(f"`{own}`").alias("__gone"))
                found[child] = found[child].union(hit) if child in found else hit
        level = {}
        for name, ids in found.items():
            ids = ids.where("__gone is not null")
            new = ids.distinct().join(dead[name], "__gone", "left_anti") if name in dead else ids.distinct()
            new = cut(new, "gone")
            if new.limit(1).count():
                level[name] = new
                dead = dead | {name: dead[name].union(new) if name in dead else new}
    return {name: rows.join(dead[name], F.col(f"`{own}`") == F.col("__gone"), "left_anti") if name in dead else rows for name, (rows, own) in tables.items()}
