"""Substring dedup by recompression.

Every text's words are parsed in rounds. The first names maximal runs of one word; each later round splits the symbols
into left and right ones by a bit of their name's hash and names each pair of a left symbol and the right one after it.
Names are hashes of what they stand for, so they are the same in every text and on every executor: equal
substrings get equal symbols but for some at their two ends.

For a window of ``window`` words the symbols that its own words fix, whatever stands around it, are known in every
round (the end symbols that a neighbour could still join are left out). Its anchor is, in the highest round with such a
symbol, the longest (of equal ones that with the least hash). Equal windows have equal anchors at equal places, down to single words,
where a window always has some. Neighbouring windows share anchors, so a text has an anchor for every dozen words.

1. Each anchor is one row: its symbol, and a hash of all words that its windows cover (its context).
2. Symbols are counted. An anchor whose context occurs twice has only repeated windows; one whose symbol occurs once
   has none; the rest, mostly at the ends of repeats, is open.
3. The windows of open anchors (and of one anchor for each repeated context of the same symbols) are compared by
   their own hashes.
4. The words that repeated windows cover are removed.

Equality is by 128 bits: in step 2 the hash of the context with the anchor's name beside it, in step 3 two hashes of a window that
are made of its words in different ways. Among 1e12 windows that leaves a chance of 1e-15 for any false pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, flat, id_text, map_arrow, row_key, slices
from .textnum import U, hash_ranges, mix, normalised, per_doc_sum, windows_inside, word_bounds

ROUNDS = 5
_KEY, _SECOND = U(0x27D4EB2F165667C5), U(0x9E3779B97F4A7C15)
UNIQUE, REPEATED, OPEN, SHOWN = 0, 1, 2, 3


def _times(k: int) -> np.uint64:
    return U(int(_KEY) * k % (1 << 64))


def span_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each width consecutive hashes, by doubling: two overlapping powers of two cover the width."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size, acc = 1, mix(h ^ _KEY)
    while size * 2 <= width:
        acc = mix(acc[: len(acc) - size] * U(3) ^ (acc[size:] + _KEY))
        size *= 2
    return mix(acc[:n] * U(5) ^ acc[width - size : width - size + n]) if size < width else acc[:n]


@dataclass
class Anchors:
    """Anchors of a batch: runs of neighbouring windows with the same one."""

    symbol: np.ndarray
    context: np.ndarray
    at: np.ndarray  # first window, as a word number in the batch
    n: np.ndarray  # windows


def anchors(h: np.ndarray, first: np.ndarray, window: int, spans: np.ndarray) -> Anchors:
    total = len(h)
    p = np.flatnonzero(windows_inside(first, window, total)) if total else np.zeros(0, np.int64)
    if not len(p):
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(np.uint64), none.astype(np.uint64), none, none)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    names, begin, owner = h, np.arange(total), doc
    lo, hi = p.copy(), p + window
    best = np.zeros(len(p), np.int8)
    best_lo, best_hi = lo, hi
    levels = [(names, begin)]
    for k in range(1, ROUNDS + 1):
        if k == 1:  # runs
            new = np.ones(len(names), bool)
            new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
            of = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(names)))
            named = np.where(size > 1, mix(names[at] * U(7) ^ size.astype(np.uint64)), names[at])
            lo, hi = of[np.minimum(lo, len(of) - 1)] + 1, of[hi - 1]
        else:  # pairs
            left = (mix(names ^ _times(2 * k + 1)) >> U(40)) & U(1) == 1
            joins = np.zeros(len(names), bool)
            joins[:-1] = left[:-1] & ~left[1:] & (owner[1:] == owner[:-1])
            new = np.ones(len(names), bool)
            new[1:] = ~joins[:-1]
            of = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            named = names[at].copy()
            paired = joins[at]
            src = at[paired]
            named[paired] = mix(names[src] * U(9) ^ mix(names[src + 1] + _KEY))
            a, b = np.minimum(lo, len(of) - 1), np.clip(hi - 1, 0, len(of) - 1)
            lo, hi = np.where(left[a], of[a], of[a] + 1), np.where(left[b], of[b], of[b] + 1)
        names, begin, owner = named, begin[at], owner[at]
        levels.append((names, begin))
        ok = (lo < hi) & (best == k - 1)
        best = np.where(ok, k, best).astype(np.int8)
        best_lo, best_hi = np.where(ok, lo, best_lo), np.where(ok, hi, best_hi)
    symbol, place = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64)
    for k, (names, begin) in enumerate(levels):
        own = np.flatnonzero(best == k)
        if len(own):
            words = np.minimum(np.diff(np.append(begin, total)), 255).astype(np.uint64)
            i = _least((mix(names ^ _KEY) >> U(8)) | (U(255) - words) << U(56), best_lo[own], best_hi[own])
            symbol[own], place[own] = mix(names[i] + _times(k)), begin[i]
    starts = np.ones(len(p), bool)
    starts[1:] = (p[1:] != p[:-1] + 1) | (symbol[1:] != symbol[:-1]) | (place[1:] != place[:-1]) | (best[1:] != best[:-1]) | (doc[p[1:]] != doc[p[:-1]])
    s = np.flatnonzero(starts)
    e = np.append(s[1:], len(p)) - 1
    n = e - s + 1
    context = mix(spans[p[s]] * U(11) ^ mix(spans[p[e]] + n.astype(np.uint64) * _KEY) ^ (place[s] - p[s]).astype(np.uint64))
    return Anchors(symbol[s], context, p[s], n)


def _least(value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least value in each [lo, hi), the first of equal ones, by a sparse table."""
    size = hi - lo
    tables = [np.arange(len(value))]
    while 2 ** len(tables) <= size.max():
        t, half = tables[-1], 2 ** (len(tables) - 1)
        a, b = t[:-half], t[half:]
        tables.append(np.where(value[a] <= value[b], a, b))
    out = np.zeros(len(lo), np.int64)
    level = np.frexp(size)[1] - 1
    for k, t in enumerate(tables):
        own = np.flatnonzero(level == k)
        a, b = t[lo[own]], t[hi[own] - 2**k]
        out[own] = np.where(value[a] <= value[b], a, b)
    return out


def _read(texts: pa.Array, window: int):
    buf, off = flat(texts)
    starts, ends, first = word_bounds(buf, off)
    h = hash_ranges(buf, starts, ends)
    return buf, starts, ends, first, span_hash(h, window), h


def find_anchors(docs: DataFrame, window: int) -> DataFrame:
    """symbol, context, k1, k2, place: the anchors of every text. place: 256 times the first window's number in the text, plus the windows less 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                _, _, _, first, spans, h = _read(part.column(2), window)
                a = anchors(h, first, window, spans)
                doc = np.searchsorted(first, a.at, "right") - 1
                k1, k2 = (part.column(i).to_numpy()[doc] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.symbol.view(np.int64), a.context.view(np.int64), k1, k2, (a.at - first[doc]) * 256 + a.n - 1)], names=["symbol", "context", "k1", "k2", "place"])

    return map_arrow(docs.select("k1", "k2", "text"), run, "symbol long, context long, k1 long, k2 long, place long")


def judge_anchors(found: DataFrame) -> DataFrame:
    """k1, k2, place, state of the anchors whose symbol occurs twice or more.

    REPEATED: the context occurs twice; SHOWN: so it does, it is one to stand for the others, and the symbol has other
    contexts, so its windows are to be compared with theirs; OPEN: the context occurs once.
    """
    # Every counted side is a table of its own before it is joined, so that Spark can split a hot symbol's or context's rows.
    counts = cut(found.groupBy("symbol").agg(F.count("*").alias("rows")).where("rows > 1"), "symbols")
    shared = cut(found.join(counts, "symbol"), "shared")
    drop(found)
    drop(counts)
    contexts = cut(shared.groupBy("symbol", "context").agg(F.count("*").alias("m"), F.min("k1").alias("rep")).where("m > 1"), "contexts")
    state = F.when(F.col("m").isNull(), OPEN).when((F.col("m") < F.col("rows")) & (F.col("k1") == F.col("rep")), SHOWN).otherwise(REPEATED)
    hits = cut(shared.join(contexts, ["symbol", "context"], "left").select("k1", "k2", "place", state.cast("byte").alias("state")), "hits")
    drop(shared)
    drop(contexts)
    return hits


def _open_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                _, _, _, first, spans, h = _read(part.column(2), window)
                other = span_hash(mix(h * _SECOND + _KEY), window)
                out = []
                for d, own in enumerate(part.column(3).to_pylist()):
                    out += [(d, (x["place"] >> 8), (x["place"] & 255) + 1, x["state"]) for x in own]
                d, a, m, s = (np.array(x, np.int64) for x in zip(*out, strict=True))
                row = np.repeat(np.arange(len(d)), m)
                p = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                doc = d[row]
                k1, k2 = (part.column(i).to_numpy()[doc] for i in (0, 1))
                at = np.where(s[row] == SHOWN, -1, p)  # shown windows are known to be repeated
                w = first[doc] + p
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (spans[w].view(np.int64), other[w].view(np.int64), k1, k2, at)], names=["window", "other", "k1", "k2", "at"])

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                buf, off = flat(part.column(1))
                starts, ends, first = word_bounds(buf, off)
                edge = np.zeros(len(starts) + 1, np.int64)
                for k, (spans, single) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    for at, n in [*((x >> 8, (x & 255) + 1) for x in spans or ()), *((x, 1) for x in single or ())]:
                        lo = first[k] + at
                        edge[lo] += 1
                        edge[lo + n + window - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                n = np.diff(first)
                removed = per_doc_sum(gone, first) if len(starts) else np.zeros(len(n), np.int64)
                keep = ~gone
                kept_first = np.concatenate([[0], np.cumsum(n - removed)])
                norm, s, e = normalised(buf, starts[keep], ends[keep], kept_first, lower=False)
                data = norm.tobytes()
                texts = [data[s[a] : e[b - 1]] if b > a else b"" for a, b in zip(kept_first[:-1], kept_first[1:], strict=True)]
                cols = [part.column(0), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode("utf-8", "replace") for t in texts])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words joined by one space); one row for each row of docs.

    A word goes if it lies in a window of ``window`` words whose sequence also starts anywhere else, in the same text
    too; windows are judged on the input. Null and empty texts, and texts shorter than a window, lose nothing.
    Fully identical rows are repeats of each other.
    """
    # Where doc_ids are unique they are the key; the texts' hashes come in only where they aren't.
    alone = docs.agg((F.count("*") == F.count("doc_id")) & (F.count("*") == F.count_distinct(F.col("doc_id").cast("long")))).first()[0]
    k1, k2 = row_key()
    keyed = id_text(docs).select("doc_id", "text", k1, F.lit(0).cast("long").alias("k2") if alone else k2)
    hits = judge_anchors(cut(find_anchors(keyed, window), "anchors"))
    lists = cut(
        hits.groupBy("k1", "k2").agg(
            F.collect_set(F.when(F.col("state") != OPEN, F.col("place"))).alias("spans"),
            F.collect_set(F.when(F.col("state") != REPEATED, F.struct("place", "state"))).alias("open"),
        ),
        "lists",
    )
    drop(hits)
    joined = keyed.join(lists.hint("shuffle_hash"), ["k1", "k2"], "left")
    look = joined.where(F.size("open") > 0).select("k1", "k2", "text", "open")
    windows = map_arrow(look, _open_windows(window), "`window` long, other long, k1 long, k2 long, at long")
    twice = cut(windows.groupBy("window", "other").agg(F.count("*").alias("c")).where("c > 1").select("window", "other"), "windows")
    single = windows.where("at >= 0").join(twice, ["window", "other"]).groupBy("k1", "k2").agg(F.collect_set("at").alias("single"))
    full = joined.join(single.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "spans", "single")
    return map_arrow(full, _remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


ORACLE = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 34), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM words)),
repeated AS (SELECT doc_id, list(p) AS ps FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS c FROM windows) WHERE c > 1 GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM (SELECT doc_id, unnest(ps) AS p FROM repeated)),
lost AS (SELECT doc_id, count(*) AS n, list(i) AS idx FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words) ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM words w LEFT JOIN lost ON lost.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
