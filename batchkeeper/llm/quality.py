"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The statistics of every whole text come out of one map over the documents. Trees are fitted to labelled rows
(at most ``MAX_LABELLED``, those with the lowest hash of their id; the bound of what the driver holds), with
splits on histograms. Scores cannot rise with a feature marked -1, whatever the labels say: more symbols, more
repeated lines or more capitals never make a text better. All trees are flattened into arrays of nodes, and a
batch of documents walks all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.text import IS_WORD, Words, by_batch, column, prepare, windows, words
from batchkeeper.session import materialize

# fixed values: the base rules
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3
SYMBOLS = b"#*$%&|<>"

MAX_LABELLED = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 3, 0.2, 32, 20, 1.0

#: Features, and whether the score may only fall (-1), or may go either way (0), as they grow.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "capital_share": -1,
    "mark_share": -1,
    "digit_share": 0,
    "distinct_share": 0,
    "words_a_line": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _set(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


IS_SYMBOL = _set(SYMBOLS)
IS_MARK = _set(b"!?@~^=_\\{}[]")
IS_CAPITAL = _set(bytes(range(ord("A"), ord("Z") + 1)))
IS_SMALL = _set(bytes(range(ord("a"), ord("z") + 1)))
IS_DIGIT = _set(b"0123456789")
# every byte but the second and later ones of a character
IS_FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside runs of three words that occur twice or more."""
    runs = windows(hashes, REPEAT_WINDOW)
    if not len(runs):
        return 0
    _, which, times = np.unique(runs, return_inverse=True, return_counts=True)
    twice = times[which] > 1
    covered = np.zeros(len(hashes), dtype=bool)
    for j in range(REPEAT_WINDOW):
        covered[j : j + len(runs)] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(" \t\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    return again


def _sums(found: Words, members: np.ndarray) -> np.ndarray:
    """How many bytes of each text are members."""
    return np.diff(np.concatenate(([0], np.cumsum(members[found.data])))[found.offsets])


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, null as an empty one, and its features as one array for each."""
    found = words(texts)
    hashes = found.hashes()
    slices = [hashes[found.first[i] : found.first[i + 1]] for i in range(len(texts))]
    plain = ["" if t is None else t for t in texts.to_pylist()]
    n = np.diff(found.first).astype(np.int64)
    out = {
        "n_words": n,
        "word_chars": _sums(found, IS_WORD & IS_FIRST).astype(np.int64),
        "n_symbols": _sums(found, IS_SYMBOL).astype(np.int64),
        "n_dup_lines": np.array([repeated_lines(t) for t in plain], dtype=np.int64),
        "n_repeat_words": np.array([repeated_words(h) for h in slices], dtype=np.int64),
    }
    some = np.maximum(n, 1)
    chars = np.maximum(out["word_chars"], 1)
    lines = np.maximum(np.array([t.count("\n") + 1 for t in plain]), 1)
    capitals, small = _sums(found, IS_CAPITAL), _sums(found, IS_SMALL)
    features = {
        "log_words": np.log1p(n),
        "word_length": out["word_chars"] / some,
        "symbol_share": out["n_symbols"] / chars,
        "dup_line_share": out["n_dup_lines"] / lines,
        "repeat_share": out["n_repeat_words"] / some,
        "capital_share": capitals / np.maximum(capitals + small, 1),
        "mark_share": _sums(found, IS_MARK) / chars,
        "digit_share": _sums(found, IS_DIGIT) / chars,
        "distinct_share": np.array([len(np.unique(h)) for h in slices]) / some,
        "words_a_line": n / lines,
    }
    return out | {"features": np.column_stack([features[f] for f in FEATURES])}


@dataclass
class Trees:
    """All trees' nodes in one row of arrays; a leaf leads to itself."""

    feature: np.ndarray
    below: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of the label 1 for each row."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.below[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray) -> Trees | None:
    """Trees for labels 0 and 1; None without rows of both."""
    if not len(y) or y.min() == y.max():
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    nodes: list[list[float]] = []
    roots = []
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + RIDGE), low, high))

    def gain(g: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        return -(g * v + 0.5 * (h + RIDGE) * v * v)

    def grow(rows: np.ndarray, depth: int, low: float, high: float, grad: np.ndarray, hess: np.ndarray) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        own = leaf(g, h, low, high)
        nodes.append([0, np.inf, at, at, own * RATE])
        best = (1e-6, -1, 0)
        if depth < DEPTH:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, f]
                gl = np.bincount(b, grad[rows], len(e) + 1).cumsum()[:-1]
                hl = np.bincount(b, hess[rows], len(e) + 1).cumsum()[:-1]
                nl = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
                vl = np.clip(-gl / (hl + RIDGE), low, high)
                vr = np.clip(-(g - gl) / (h - hl + RIDGE), low, high)
                won = gain(gl, hl, vl) + gain(g - gl, h - hl, vr) - gain(g, h, own)
                allowed = (nl >= LEAST_ROWS) & (len(rows) - nl >= LEAST_ROWS) & (signs[f] * (vr - vl) >= 0)
                won = np.where(allowed, won, -np.inf)
                k = int(won.argmax())
                if won[k] > best[0]:
                    best = (float(won[k]), f, k)
        if best[1] >= 0:
            _, f, k = best
            goes = binned[rows, f] <= k
            sides = [rows[goes], rows[~goes]]
            values = [leaf(grad[s].sum(), hess[s].sum(), low, high) for s in sides]
            middle = sum(values) / 2
            # what lies below must stay on its side of the middle, or a constrained feature could turn back
            caps = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}
            for place, side, (lo, hi) in zip((2, 3), sides, caps[int(signs[f])], strict=True):
                nodes[at][place] = grow(side, depth + 1, lo, hi, grad, hess)
            nodes[at][0], nodes[at][1] = f, edges[f][k]
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        begin = len(nodes)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
        own = np.array(nodes[begin:])
        at = np.zeros(len(y), dtype=np.int64)
        for _ in range(DEPTH):
            goes = x[np.arange(len(y)), own[at, 0].astype(np.int64)] <= own[at, 1]
            at = (np.where(goes, own[at, 2], own[at, 3]) - begin).astype(np.int64)
        raw += own[at, 4]
    flat = np.array(nodes)
    return Trees(
        flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), flat[:, 4],
        np.array(roots), base,
    )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees from the labelled rows of ``docs``; None without labels of both kinds.

    ``labels`` has the id and ``quality``, 1 or 0; rows with null in either, or of no document, teach nothing.
    Of rows of ``docs`` that share a labelled id the one with the smallest statistics teaches.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality in (0, 1)").distinct()
    texts = _texts(docs, id_col, text_col)
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    # a table of at most MAX_LABELLED rows
    sample = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_LABELLED), "labelled")

    def describe(batch: pa.RecordBatch) -> dict:
        features = statistics(column(batch, "text"))["features"]
        return {
            "doc_id": column(batch, "doc_id"), "quality": column(batch, "quality"),
            "features": pa.array(list(features), pa.list_(pa.float64())),
        }

    taught = by_batch(texts.join(sample, "doc_id"), "doc_id long, quality int, features array<double>", describe)
    # rows that share an id give one example a label, so no more than MAX_LABELLED reach the driver
    rows = taught.groupBy("doc_id", "quality").agg(F.min("features").alias("features")).orderBy("doc_id", "quality").toArrow()
    if not rows.num_rows:
        return None
    x = np.stack(rows.column("features").to_numpy())
    return fit(x, rows.column("quality").to_numpy().astype(np.float64), np.array(list(FEATURES.values())))


def _judge(trees: Trees | None, texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts, ``base_failed``, ``score`` (NaN without trees) and ``kept`` of each text."""
    stats = statistics(texts)
    features = stats.pop("features")
    n, repeated = stats["n_words"], stats["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    score = np.full(len(n), np.nan) if trees is None else trees.score(features)
    return stats | {"base_failed": failed, "score": score, "kept": ~failed & ~(score < 0.5)}


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``score`` and ``kept`` for each row of ``docs``.

    ``kept`` is false where a base rule fails, and where the trees give the label 1 less than one half. Without
    labels of both kinds the base rules decide, and ``score`` is null. Null and empty texts have no words, and
    fail. Rows that share an id are judged each by its own text. Other columns are ignored; an empty table
    gives none.
    """
    prepare(docs.sparkSession)
    trees = learn(docs, labels, id_col, text_col)

    def rows(batch: pa.RecordBatch) -> dict:
        found = _judge(trees, column(batch, "text"))
        score = pa.array(found.pop("score"), from_pandas=True)
        return {"doc_id": column(batch, "doc_id")} | found | {"score": score}

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return by_batch(_texts(docs, id_col, text_col), schema, rows)


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`quality_rules` keeps."""
    prepare(docs.sparkSession)
    trees = learn(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_judge(trees, column(batch, text_col))["kept"]))

    return docs.mapInArrow(run, docs.schema)
