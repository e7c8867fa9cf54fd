"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z only) and cut into words.  The *fingerprint* of a window of
``window`` consecutive words is the least hash of its k-grams of words.  Equal windows
have equal fingerprints, so every shared span of at least ``window`` words is met by a
shared fingerprint.  A benchmark text of fewer words is one window of its own length.

1. Benchmark windows give fingerprints, and a digest of their words.
2. The fingerprints' slots in a bitmap of fixed size (``SLOTS``, a proven bound whatever
   the benchmark's size) go to every task.  A document window whose fingerprint has no
   slot is no hit; the others are extended to the whole window, whose digest is taken.
3. Document digests are joined with benchmark digests (a shuffle that carries only
   such windows).  Joined windows are real hits; a full bitmap would cost time only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, blocks, byte_values, gram_hashes, mix, prefix_sums, runs, sliding_min, span_hashes, stage
from .keys import SLOT_BITS, bitmap, has, matching, split_by_slot

WINDOW = 13
GRAM = 5
TEXTS = 1000  # that a task holds at once

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_IS_WORD = np.array([bool(_WORD.match(bytes([b]).lower())) for b in range(256)])

_HIT = "array<struct<start:int,words:int,digest:binary>>"


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, and the position of every row's first word in them."""
    low = _LOWER[data]
    starts, ends = runs(_IS_WORD[data], bounds)
    return span_hashes(prefix_sums(byte_values(low)), starts, ends), np.searchsorted(starts, bounds)


def _slots(words: np.ndarray, window: int) -> np.ndarray:
    """The slot of the fingerprint of every window."""
    gram = min(GRAM, window)
    if len(words) < window:
        return np.zeros(0, np.int64)
    least = sliding_min(gram_hashes(words, gram), window - gram + 1)
    return (mix(least + np.uint64(window)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _digest(words: list[bytes], start: int, window: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + window]), digest_size=16).digest()


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, words, slot, digest) of all windows of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for first, end, data, bounds in blocks(texts):
                hashes, at = _word_hashes(data, bounds)
                for i in range(first, end):
                    own = hashes[at[i - first] : at[i - first + 1]]
                    if not len(own):
                        continue
                    width = min(window, len(own))
                    words = _words(texts[i].as_py())
                    n = len(own) - width + 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[i].as_py()] * n, pa.string()),
                        pa.array([width] * n, pa.int32()),
                        pa.array(_slots(own, width)),
                        pa.array([_digest(words, s, width) for s in range(n)], pa.binary()),
                    ], names=["item", "words", "slot", "digest"])

    picked = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(cut, "item string, words int, slot long, digest binary").distinct()


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    threshold: tuple[int, int] = (1, 20),
) -> DataFrame:
    """One row per document: the words that lie inside benchmark windows, and whose they are.

    Returns ``doc_id, text_hash, n_words, n_hit, items, contaminated``; ``items`` are the
    sorted ids (as text) of the items with a window in the document, and a document is
    contaminated when at least ``threshold`` of its words (as a fraction) are hit.

    A null or empty text has no words and is not contaminated.  Repeated rows and equal
    ids each give a row.  An item without words has no window; one without an id hits
    words and is not listed; equal items are all listed.  Empty tables give no rows, or
    documents without hits.  Other columns are not read.
    """
    windows = stage(benchmark_windows(benchmark, item_id, text, window), "bench-windows")
    widths = sorted(r.words for r in windows.select("words").distinct().collect())  # one to window
    # one bitmap for all lengths: slots are made from the length as well
    sent = documents.sparkSession.sparkContext.broadcast(bitmap(windows, "slot"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            texts = batch.column(2)
            n_words, hits = np.zeros(len(texts), np.int64), [None] * len(texts)
            for first, end, data, bounds in blocks(texts):
                hashes, at = _word_hashes(data, bounds)
                n_words[first:end] = np.diff(at)
                for width in widths:
                    starts = np.flatnonzero(has(bits, _slots(hashes, width)))
                    rows = np.searchsorted(at, starts, "right") - 1
                    whole = starts + width <= at[rows + 1]
                    starts, rows = starts[whole], rows[whole]
                    cuts = np.flatnonzero(np.diff(rows)) + 1
                    for mine in np.split(starts, cuts) if len(starts) else []:
                        row = int(np.searchsorted(at, mine[0], "right")) - 1
                        words = _words(texts[first + row].as_py())
                        hits[first + row] = (hits[first + row] or []) + [
                            {"start": s, "words": width, "digest": _digest(words, s, width)}
                            for s in (mine - at[row]).tolist()
                        ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(n_words), pa.array(hits, _ARROW_HITS)],
                names=["_row", "doc_id", "text_hash", "n_words", "hits"],
            )

    id_type = documents.schema[doc_id].dataType.simpleString()
    picked = documents.select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"),
        F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    )
    with batches_of(documents.sparkSession, TEXTS):
        scanned = stage(
            picked.mapInArrow(scan, f"_row long, doc_id {id_type}, text_hash long, n_words long, hits {_HIT}"), "doc-windows"
        )
    owners = windows.groupBy("digest").agg(F.collect_set("item").alias("items"))
    real = (
        scanned.select("_row", F.explode("hits").alias("hit"))
        .select("_row", "hit.start", "hit.words", "hit.digest")
        .join(owners, "digest")
        .groupBy("_row")
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "words"))).alias("spans"),
            F.collect_set("items").alias("item_sets"),
        )
        .select("_row", _covered("spans").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("item_sets"))).alias("items"))
    )
    numerator, denominator = threshold
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return scanned.drop("hits").join(real, "_row", "left").select(
        "doc_id", "text_hash", "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (denominator * n_hit >= numerator * F.col("n_words"))).alias("contaminated"),
    )


_ARROW_HITS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())]))


def _covered(spans: str) -> F.Column:
    """Words in the union of sorted (start, words) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("covered"))

    def add(acc, span):
        end = (span["start"] + span["words"]).cast("long")
        start = F.greatest(acc["end"], span["start"].cast("long"))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["covered"] + F.greatest(end - start, F.lit(0).cast("long"))).alias("covered"))

    return F.aggregate(spans, zero, add)["covered"]


def decontaminate(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they came; those that stay are not moved."""
    bad = contamination(documents, benchmark, doc_id, text, **options).filter("contaminated")
    bad = stage(bad.select("doc_id", "text_hash").distinct(), "contaminated")
    own = [F.col(doc_id), F.xxhash64(F.col(text).cast("string"))]
    sure, unsure = split_by_slot(documents, own, bad)
    return sure.union(matching(unsure, own, bad, "left_anti"))


def digest_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
