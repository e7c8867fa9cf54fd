"""Importance resampling towards a target distribution, on hashed word features.

An untrained Regex Split of the tokenizers library cuts the ASCII-lowered text into words
with offsets.  Windows of one and of two consecutive offset pairs are the features; a
feature's bucket is the CRC-32 of its words joined by a blank.  Histograms of all source
texts and of all target texts give every bucket a gain, a text's weight is the mean gain
of its features, and Gumbel noise from a hash of its id turns weights into a draw without
replacement.

Texts are cut once: their buckets are staged, two bytes a feature, and both the histogram
and the weights are read from them.  The draw sorts narrow rows by range; a rank is the
offset of the sorted task plus the place in it, so no task ranks all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = (25, 100)
SEED = "7"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 1 << 20  # characters that are cut at once; a text is cut between words, and a longer word is not cut
WORDS_KEPT = 1 << 17  # checksums of words that a task remembers
_LONGEST = 64  # words of more bytes are appended one by one
_IN_TASK = 33  # bits of Spark's row numbers that count within a task

_splitter = None


def words(text: str) -> list[tuple[str, tuple[int, int]]]:
    """The words of a lowered text and their offsets."""
    global _splitter
    if _splitter is None:
        from tokenizers import Regex, pre_tokenizers

        _splitter = pre_tokenizers.Split(Regex(SEPARATORS), "removed")
    return _splitter.pre_tokenize_str(text)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text cut at separators, in parts of about ``size``."""
    separator = re.compile(SEPARATORS)
    start = 0
    while len(text) - start > size:
        found = separator.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


# --- checksums of joined words --------------------------------------------------------


def _zero_bytes(checksum: int, n: int) -> int:
    """What ``n`` bytes after it make of a checksum, apart from their own: a linear map of its bits."""
    return zlib.crc32(bytes(n), checksum) ^ zlib.crc32(bytes(n))


_SHIFTS: dict[int, np.ndarray] = {}


def _shifted(checksums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``_zero_bytes`` of many, by a table of four times 256 entries for each length."""
    out = np.zeros(len(checksums), np.uint32)
    for length in np.unique(lengths).tolist():
        table = _SHIFTS.get(length)
        if table is None:
            table = _SHIFTS[length] = np.array(
                [[_zero_bytes(byte << 8 * place, length) for byte in range(256)] for place in range(4)], np.uint32
            )
        at = np.flatnonzero(lengths == length)
        part = checksums[at]
        for place in range(4):
            out[at] ^= table[place][(part >> np.uint32(8 * place)) & np.uint32(255)]
    return out


class Checksums:
    """CRC-32 of words and of word pairs; words are numbered as they come."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.own = np.zeros(1024, np.uint32)  # of the word
        self.open = np.zeros(1024, np.uint32)  # of the word and a blank
        self.sizes = np.zeros(1024, np.int64)  # bytes, at most _LONGEST + 1
        self.long: dict[int, bytes] = {}

    def number(self, word: str) -> int:
        data = word.encode()
        n = self.numbers[word] = len(self.numbers)
        if n == len(self.own):
            self.own, self.open, self.sizes = (np.concatenate((a, np.zeros_like(a))) for a in (self.own, self.open, self.sizes))
        checksum = zlib.crc32(data)
        self.own[n], self.open[n], self.sizes[n] = checksum, zlib.crc32(b" ", checksum), min(len(data), _LONGEST + 1)
        if len(data) > _LONGEST:
            self.long[n] = data
        return n

    def features(self, found: list[str], before: str | None) -> np.ndarray:
        """Checksums of all words, and of all pairs of neighbours, the one with ``before`` first."""
        if len(self.numbers) > WORDS_KEPT:
            self.__init__()
        own = found if before is None else [before, *found]
        known = self.numbers
        ids = np.array([known[w] if w in known else self.number(w) for w in own], np.int64)
        single, size = self.own[ids], self.sizes[ids]
        opened = self.open[ids]
        pairs = _shifted(opened[:-1], np.minimum(size[1:], _LONGEST)) ^ single[1:]
        for i in np.flatnonzero(size[1:] > _LONGEST).tolist():
            pairs[i] = zlib.crc32(self.long[int(ids[i + 1])], int(opened[i]))
        return np.concatenate((single[len(own) - len(found) :], pairs))


def buckets(text: str | None, sums: Checksums, n_buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its features."""
    lowered = (text or "").encode().lower().decode()  # bytes: A-Z only
    n, last, found = 0, None, []
    for piece in pieces(lowered):
        own = [word for word, _ in words(piece)]
        if own:
            found.append((sums.features(own, last) % np.uint32(n_buckets)).astype(np.uint16))
            n, last = n + len(own), own[-1]
    return n, np.concatenate(found) if found else np.zeros(0, np.uint16)


# --- histograms, gains, weights -------------------------------------------------------


def cut(documents: DataFrame, text: str, doc_id: str | None = None) -> DataFrame:
    """``doc_id, n_words, buckets`` of every row, the buckets as bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Checksums()
        for batch in batches:
            for i in range(len(batch)):  # a row of its own each: texts may be very long
                n, found = buckets(batch.column(1)[i].as_py(), sums)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([n], pa.int64()), pa.array([found.tobytes()], pa.binary())],
                    names=["doc_id", "n_words", "buckets"],
                )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in scan(batches):
            held.append(row)
            size += row.nbytes
            if size > PIECE or len(held) >= 4096:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    own = F.col(doc_id) if doc_id else F.lit(0)
    picked = documents.select(own.alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(gathered, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_words long, buckets binary")


def histogram(features: DataFrame) -> np.ndarray:
    """Features per bucket over all rows: added up in every task, then by Spark; ``BUCKETS`` numbers come back."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for data in batch.column(0):
                counts += np.bincount(np.frombuffer(data.as_buffer(), np.uint16), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    found = features.select("buckets").mapInArrow(scan, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of every bucket."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of a row's features, 0 for none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(len(batch), np.int64)
            means = np.zeros(len(batch), np.int64)
            for i, data in enumerate(batch.column(2)):
                found = np.frombuffer(data.as_buffer(), np.uint16)
                sizes[i] = len(found)
                if len(found):
                    means[i] = int(gain[found].sum()) // len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(means)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    id_type = features.schema["doc_id"].dataType.simpleString()
    return features.mapInArrow(scan, f"doc_id {id_type}, n_words long, n_features long, weight long")


# --- the draw -------------------------------------------------------------------------


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of the id; a null id is an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """All rows with their place, from 1, in a total order; one range shuffle and no task with all rows."""
    sorted_ = stage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    task, place = F.shiftright("_at", _IN_TASK), F.col("_at").bitwiseAND(F.lit((1 << _IN_TASK) - 1))
    sizes = sorted_.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task of the sort
    offsets = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # as many rows as the sort had tasks, which is spark.sql.shuffle.partitions at most
    joined = sorted_.withColumn("_task", task).join(F.broadcast(offsets), "_task")
    return joined.select(*rows.columns, (F.col("_before") + place + 1).alias(name))


def resample(
    documents: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row; ``rank`` is null for rows that are not drawn.

    A null or empty text has no words, no features, weight 0, and is not drawn.  Equal ids
    have the same noise; ties go to the smaller id, null last, and then to the heavier
    text.  Of rows that agree in all of that any may come first, as their results are the
    same.  Without target texts every gain follows from the source alone; an empty table
    gives no rows.  Other columns are not read.
    """
    features = stage(cut(documents, text, doc_id), "buckets")
    gain = gains(histogram(features), histogram(cut(target, target_text)))
    scored = stage(weights(features, gain).select(
        "*", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), F.monotonically_increasing_id().alias("_tie")
    ), "weights")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * share[0] // share[1]
    columns = ["doc_id", "n_features", "weight", "score"]
    # the last column keeps rows that agree in all others apart, so the sort can spread them
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.asc("_tie")]
    places = ranked(able.select(*columns, "_tie"), order, "rank")
    shown = places.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return shown.unionByName(rest)


def digest_rows(documents: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns."""
    return resample(documents, target)
