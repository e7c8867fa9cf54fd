"""Quality rules: gradient-boosted trees over document statistics.

Statistics of every whole text are counted in one pass.  The trees are fitted on a
bounded sample of labelled documents (``SAMPLE`` rows, those with the least hash of their
id), flattened into node arrays, sent to the tasks, and applied to all documents in the
pass that counts them; no text is shuffled.  Features in ``FALLING`` may only lower a
document's score as they rise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, MIN_WEIGHT = 40, 3, 32, 0.2, 1.0, 1.0
MIN_WORDS = 50
CUT = 0.5

_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_word_share", "distinct_word_share",
    "upper_share", "digit_share", "exclamations_per_word", "stops_per_word", "words_per_line",
]
FALLING = ["symbols_per_word", "dup_line_share", "repeat_word_share", "upper_share", "exclamations_per_word"]

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_LEAD = _WHITE + bytes(range(0x80, 0xC0))  # continuation bytes add no code point
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


# --- statistics ---------------------------------------------------------------------


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, and distinct words."""
    n = len(words)
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if n < 4:
        return 0, len(ids)
    pair = code[:-1] * len(ids) + code[1:]
    if len(ids) > 2_000_000:  # three codes no longer fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, count = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return int(inside.sum()), len(ids)


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one whole text."""
    words = text.split()  # bytes: ASCII white space
    lines, dup_lines, seen = 0, 0, set()
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    n = len(words)
    chars = len(text.translate(None, _NOT_LEAD))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    repeats, distinct = _repeat_words(words)
    per_word, per_char = 1 / max(n, 1), 1 / max(chars, 1)
    upper, digits = (len(text) - len(text.translate(None, kind)) for kind in (_UPPER, _DIGITS))
    return [n, chars, symbols, dup_lines, repeats], [
        float(np.log1p(n)), chars * per_word, symbols * per_word, dup_lines / max(lines, 1), repeats * per_word,
        distinct * per_word, upper * per_char, digits * per_char, text.count(b"!") * per_word,
        text.count(b".") * per_word, n / max(lines, 1),
    ]


def _measure(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics((t.as_py() or "").encode()) for t in texts]
    base = np.array([f[0] for f in found], np.int64).reshape(-1, len(_BASE))
    return base, np.array([f[1] for f in found], np.float64).reshape(-1, len(FEATURES))


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])


# --- trees --------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees as arrays: a leaf has feature -1 and its own place as both children."""

    bias: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of every row of ``x``, all trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            low = (f < 0) | (x[rows, np.maximum(f, 0)] <= self.threshold[at])
            at = np.where(low, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.bias + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, falling: list[int]) -> Forest:
    """Boosted trees on logistic loss with second-order leaves.

    A split on a falling feature must give its left side the greater value, and bounds
    both subtrees by the middle, so no later split can turn the order round.  Without
    rows of both classes the forest is its bias: everything is good unless all is bad.
    """
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    good = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1 - 1e-3
    bias = float(np.log(good / (1 - good)))
    if len(y) and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), bias)

        def leaf_gain(g, h, v):
            return -(g * v + 0.5 * (h + RIDGE) * v * v)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
            place = len(nodes)
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-gs / (hs + RIDGE), low, high))
            nodes.append([-1, 0.0, place, place, RATE * value])
            margin[rows] += RATE * value  # taken back if the node splits
            best = (1e-6, None)
            for f in range(x.shape[1]) if depth else ():
                size = len(edges[f]) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                vl = np.clip(-gl / (hl + RIDGE), low, high)
                vr = np.clip(-(gs - gl) / (hs - hl + RIDGE), low, high)
                gain = leaf_gain(gl, hl, vl) + leaf_gain(gs - gl, hs - hl, vr) - leaf_gain(gs, hs, value)
                allowed = (hl > MIN_WEIGHT) & (hs - hl > MIN_WEIGHT)
                if f in falling:
                    allowed &= vl >= vr
                gain = np.where(allowed, gain, -np.inf)
                if len(gain) and gain.max() > best[0]:
                    b = int(gain.argmax())
                    best = (float(gain[b]), (f, b, float(vl[b]), float(vr[b])))
            if best[1] is not None:
                f, b, vl, vr = best[1]
                margin[rows] -= RATE * value
                middle = (vl + vr) / 2
                bounds = ((middle, high), (low, middle)) if f in falling else ((low, high), (low, high))
                lower = binned[rows, f] <= b
                left = grow(rows[lower], g, h, depth - 1, *bounds[0])
                right = grow(rows[~lower], g, h, depth - 1, *bounds[1])
                nodes[place] = [f, float(edges[f][b]), left, right, 0.0]
            return place

        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH, -np.inf, np.inf))
    table = np.array(nodes, np.float64).reshape(-1, 5)
    feature, left, right = (table[:, i].astype(np.int64) for i in (0, 2, 3))
    return Forest(bias, np.array(roots, np.int64), feature, table[:, 1], left, right, table[:, 4])


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled documents; repeated labels of an id are averaged, null ones ignored."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _measure(batch.column(2))[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "y", "x"]
            )

    picked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("_label_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("_label_id"), "_label_id")
        .limit(sample)
    )
    texts = documents.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    known = texts.join(F.broadcast(picked), F.col("_id") == F.col("_label_id"))  # at most `sample` ids
    rows = known.select(F.xxhash64("_id", "_text").alias("key"), "y", "_text").mapInArrow(
        measure, "key long, y double, x array<double>"
    ).orderBy("key").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(np.float64), [FEATURES.index(f) for f in FALLING])


# --- verdicts -----------------------------------------------------------------------


def verdicts(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, the forest's ``score`` and ``kept``.

    A null or empty text has no words and fails the base rule.  Repeated rows and equal
    or null ids each give a row.  Without labels of both kinds only the base rule decides.
    Other columns are not read.
    """
    forest = train(documents, labels, doc_id, text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = _measure(batch.column(1))
            failed, score = base_failed(base), forest.probability(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= CUT))],
                names=["doc_id", *_BASE, "base_failed", "score", "kept"],
            )

    id_type = documents.schema[doc_id].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _BASE)
    picked = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(judge, f"doc_id {id_type}, {counts}, base_failed boolean, score double, kept boolean")


def keep_good(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that ``verdicts`` keeps, all columns as they came, in one pass."""
    forest = train(documents, labels, doc_id, text)
    place = documents.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = _measure(batch.column(place).cast(pa.string()))
            yield batch.filter(pa.array(~base_failed(base) & (forest.probability(x) >= CUT)))

    return documents.mapInArrow(judge, documents.schema)
