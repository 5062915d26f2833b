"""Quality rules: gradient-boosted trees over document statistics, scored as flat numpy node arrays.

Statistics are computed for whole texts, a batch at a time. The trees are trained on the driver from the statistics
(not the texts) of a bounded sample of labelled rows, with monotonic constraints: more symbols, repeated words or
repeated lines can never raise a document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, id_text, map_arrow, row_key, slices
from .textnum import covered, hash_ranges, per_doc_sum, repeated_in_doc, window_hash, windows_inside, word_bounds

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "words_per_line", "next_same")
#: Sign of each feature's allowed effect on the score; 0: any.
MONOTONE = dict(zip(FEATURES, (0, 0, -1, -1, -1, 0, 0, 0, -1, 0, -1), strict=True))


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL, _UPPER, _DIGIT, _MARK = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(bytes(range(48, 58))), _table(b"!?#*$%&|<>=~^_{}[]")


def document_stats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The BASE counts (n x 5, long) and FEATURES (n x 11) of each text; a text without words has zeros."""
    buf, off = flat(texts)
    starts, ends, first = word_bounds(buf, off)
    n, total = np.diff(first), len(starts)
    doc = np.repeat(np.arange(len(texts)), n)

    def chars(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[buf], dtype=np.int64)])
        return c[off[1:]] - c[off[:-1]]

    in_word = np.ones(256, bool)
    in_word[[9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)]] = False
    word_chars, symbols = chars(in_word), chars(_SYMBOL)
    h = hash_ranges(buf, starts, ends)
    flags = np.zeros(total, bool)
    inside = np.flatnonzero(windows_inside(first, WINDOW, total)) if total else np.zeros(0, np.int64)
    if len(inside):
        keys = window_hash(h, WINDOW)[inside]
        flags[inside] = repeated_in_doc(keys, doc[inside])
    repeat = per_doc_sum(covered(flags, WINDOW, total), first) if total else np.zeros(len(n), np.int64)
    single = per_doc_sum(~repeated_in_doc(h, doc), first) if total else np.zeros(len(n), np.int64)
    same = np.zeros(total, bool)
    if total > 1:
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    same = per_doc_sum(same, first) if total else np.zeros(len(n), np.int64)
    dup, lines = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    data = buf.tobytes()
    for i in range(len(n)):
        seen: set[bytes] = set()
        rows = [x for x in data[off[i] : off[i + 1]].split(b"\n") if x.strip()]
        seen.update(rows)
        dup[i], lines[i] = len(rows) - len(seen), len(rows)
    base = np.stack([n, word_chars, symbols, dup, repeat], axis=1).astype(np.int64)
    w, c = np.maximum(n, 1), np.maximum(word_chars, 1)
    feats = np.stack([np.log1p(n), word_chars / w, symbols / c, dup / np.maximum(lines, 1), repeat / w, single / w, chars(_UPPER) / c, chars(_DIGIT) / c, chars(_MARK) / c, np.log1p(n / np.maximum(lines, 1)), same / w], axis=1)
    return base, feats


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])


@dataclass
class Trees:
    """All trees' nodes in one set of arrays; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float
    cutoff: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for each row of x."""
        rows, out = np.arange(len(x)), np.full(len(x), self.bias)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: int = 5) -> Trees:
    """Newton boosting of the logistic loss on binned features; splits against a sign, or values outside the bounds that splits above have set, aren't made."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p0 = np.clip(y.mean(), 0.01, 0.99)
    bias = float(np.log(p0 / (1 - p0)))
    f = np.full(n, bias)
    nodes: list[list[float]] = []
    roots = []

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + l2), lo, hi))

    def grow(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, me, me, rate * leaf(gs, hs, lo, hi)])
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j in range(m):
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                k = len(cuts[j]) + 1
                cg, ch, cn = (np.cumsum(np.bincount(b, w, minlength=k))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-cg / (ch + l2), lo, hi), np.clip(-(gs - cg) / (hs - ch + l2), lo, hi)
                loss = lambda v, a, c: a * v + 0.5 * (c + l2) * v * v
                parent = leaf(gs, hs, lo, hi)
                gain = loss(parent, gs, hs) - loss(vl, cg, ch) - loss(vr, gs - cg, hs - ch)
                gain[(cn < least) | (len(rows) - cn < least) | (signs[j] * (vr - vl) < 0)] = -1
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), (j, at, float(vl[at]), float(vr[at])))
        if best[1]:
            j, at, vl, vr = best[1]
            mid, go = (vl + vr) / 2, binned[rows, j] <= at
            bound = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[int(signs[j])]
            left = grow(rows[go], level + 1, *bound[0])
            right = grow(rows[~go], level + 1, *bound[1])
            nodes[me][:4] = [j, cuts[j][at], left, right]
        return me

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        before = len(nodes)
        roots.append(grow(np.arange(n), 0, -4.0, 4.0))
        a = np.array(nodes)
        part = Trees(np.array([before]), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], depth, 0.0)
        f = f + part.score(x)
    a = np.array(nodes).reshape(-1, 5)
    return Trees(np.array(roots, int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], depth, bias)


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, keep_good: float = 0.998) -> Trees:
    """Trees from the max_labelled labelled rows with the least (hash of the doc_id, label, hash of the text): a bounded sample that reruns repeat.

    The cutoff is the highest log-odds, at most 0, that keeps keep_good of the good rows of a quarter set aside.
    Without labels, or with one class only, every document is kept.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"), F.xxhash64(F.col("doc_id").cast("long")).alias("order"))
    chosen = F.broadcast(chosen.orderBy("order", "doc_id", "label").limit(max_labelled))
    rows = map_arrow(id_text(docs).join(chosen, "doc_id").select("label", "text", "order", row_key()[1]), _labelled_features, "label int, `order` long, k2 long, x array<double>")
    found = rows.orderBy("order", "label", "k2").limit(max_labelled).toArrow()
    y = found.column("label").to_numpy().astype(float)
    none = Trees(np.zeros(0, int), *(np.zeros(0, int),), np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0, 0.0, -np.inf)
    if len(y) < 40 or y.min() == y.max():
        return none
    x = np.array(found.column("x").to_pylist())
    aside = np.arange(len(y)) % 4 == 3
    signs = np.array([MONOTONE[f] for f in FEATURES])
    trial = fit_trees(x[~aside], y[~aside], signs)
    good = np.sort(trial.score(x[aside & (y == 1)]))
    cutoff = min(0.0, float(good[int((1 - keep_good) * len(good))])) if len(good) else 0.0
    trees = fit_trees(x, y, signs)
    trees.cutoff = cutoff
    return trees


def _labelled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            _, x = document_stats(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "order", "k2", "x"])


def judge_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score; one row for each row of docs.

    kept is false where base_failed, else the trees' verdict. Null and empty texts have zero counts and fail the
    base. Map-only: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                base, x = document_stats(part.column(1))
                failed, score = base_failed(base), trees.score(x)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(np.ascontiguousarray(base[:, j])) for j in range(5)), pa.array(failed), pa.array(~failed & (score >= trees.cutoff)), pa.array(1 / (1 + np.exp(-score)))],
                    names=["doc_id", *BASE, "base_failed", "kept", "score"],
                )

    return map_arrow(id_text(docs), run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
