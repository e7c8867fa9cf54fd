"""SimHash near-duplicates, compared on vertical bit planes.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes (seed 42) of
its word shingles.  Fingerprints that differ in at most ``RADIUS`` bits are linked.

Candidates: the 64 bits are ``BLOCKS`` bytes; two fingerprints within two bits agree in
six of the eight, so they share one of 28 keys of 48 bits.  A key's bucket holds at most
2 ** 16 different fingerprints, whatever the input, and no fingerprint has more than 136
others within two bits in it, so neither buckets nor links need a cap.

Comparison: all pairs of a bucket at the same distance in sorted order form lanes.  The
lanes' bits stand vertically (a plane per bit), differences are counted for 64 lanes at
once by carry-save adders, and a block of lanes is abandoned once all of them exceed the
radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components
from .keys import matching, split_by_slot

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCKS = 8
PAIRS = list(combinations(range(BLOCKS), 2))  # of blocks that a table leaves out
HOT_SHARE = 1000
LANES = 1 << 16  # compared in one numpy step
ABANDON = 8  # words of 64 lanes that are abandoned together


# --- fingerprints -------------------------------------------------------------------


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of all words if there are fewer."""
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), LANES):
        part = hashes[i : i + LANES].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = [fingerprint(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in texts]
            fps = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["doc_id", "text_hash", "fp"])

    id_type = documents.schema[doc_id].dataType.simpleString()
    picked = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
    )
    return picked.mapInArrow(scan, f"doc_id {id_type}, text_hash long, fp long")


# --- comparison ---------------------------------------------------------------------


def _exceeding(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above ``radius``."""
    above, equal = over.copy(), np.full_like(over, ~np.uint64(0))
    for j in reversed(range(len(counters))):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            above |= equal & counters[j]
            equal &= ~counters[j]
    return above


def within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Indices of the lanes whose two fingerprints differ in at most ``radius`` bits."""
    n = len(left)
    size = 64 * ABANDON
    pad = -n % size

    def planes(values: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
        bits = np.concatenate((bits, np.zeros((pad, 64), np.uint8))) if pad else bits
        return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.uint64).reshape(64, -1, ABANDON)

    differ = planes(left) ^ planes(right)
    live = np.arange(differ.shape[1])
    over = np.zeros(differ.shape[1:], np.uint64)
    counters = [np.zeros_like(over) for _ in range(max(1, radius.bit_length()))]
    for at in range(0, 64, 2):
        x, y = differ[at][live], differ[at + 1][live]
        half = counters[0] ^ x
        carry = (counters[0] & x) | (half & y)
        counters[0] = half ^ y
        for j in range(1, len(counters)):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if at % 8 == 6:
            keep = (_exceeding(counters, over, radius) != ~np.uint64(0)).any(axis=1)
            if not keep.all():
                live, over, counters = live[keep], over[keep], [c[keep] for c in counters]
                if not len(live):
                    break
    near = np.unpackbits((~_exceeding(counters, over, radius)).reshape(-1).view(np.uint8)).astype(bool)
    lanes = (live[:, None] * size + np.arange(size)).reshape(-1)[near]
    return lanes[lanes < n]


def _links(tables: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal (table, key), each from the first table that can see it."""
    n = len(fps)
    same = (tables[1:] == tables[:-1]) & (keys[1:] == keys[:-1])
    group = np.concatenate(([0], np.cumsum(~same)))
    sizes = np.bincount(group)
    order = np.arange(n)[sizes[group] > 1]
    out = np.array(PAIRS)
    for step in range(1, int(sizes.max(initial=1))):
        order = order[order + step < n]
        order = order[group[order] == group[np.minimum(order + step, n - 1)]]
        for i in range(0, len(order), LANES):
            a = order[i : i + LANES]
            a = a[within(fps[a], fps[a + step])]
            b = a + step
            x, (p, q) = fps[a] ^ fps[b], out[tables[a]].T
            in_p = (x >> (8 * p).astype(np.uint64)) & np.uint64(255) != 0
            in_q = (x >> (8 * q).astype(np.uint64)) & np.uint64(255) != 0
            first = np.where(in_p & in_q, True, np.where(in_p, q == (p == 0), p == (q == 0)))
            yield a[first], b[first]


def links(fps: DataFrame, column: str = "fp") -> DataFrame:
    """``left, right`` of all pairs of different fingerprints within two bits, each once."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m  # noqa: E731  as Spark's long
    masks = [signed((1 << 64) - 1 - (0xFF << 8 * p) - (0xFF << 8 * q)) for p, q in PAIRS]
    keyed = fps.select(
        F.col(column).alias("fp"),
        F.posexplode(F.array(*[F.col(column).bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in _links(cols[0], cols[1], cols[2].view(np.uint64)):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[2][a]), pa.array(cols[2][b])], names=["left", "right"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield from flush([c[:cut] for c in cols])
            held = [c[cut:].copy() for c in cols]
        if held is not None:
            yield from flush(held)

    dealt = keyed.select("table", "key", "fp").repartition("table", "key").sortWithinPartitions("table", "key", "fp")
    return dealt.mapInArrow(compare, "left long, right long")


# --- groups -------------------------------------------------------------------------


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` of every row.

    ``root`` is the group's least fingerprint, ``component_id`` its least document id.

    Null and empty texts share fingerprint 0 and are linked like any other.  Repeated
    rows and equal ids each give a row; null ids are never a component's id unless all
    of its ids are null.  Copies collapse to one fingerprint before any comparison.  An
    empty table gives no rows.  Other columns are not read.
    """
    return grouped(stage(fingerprints(documents, doc_id, text, shingle), "fingerprints"), links)


def grouped(prints: DataFrame, find_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows ``doc_id, text_hash, fp`` with ``root`` and ``component_id`` of what links between ``fp`` join."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "distinct-fingerprints")
    stars = components(find_links(distinct), "left", "right")
    roots = stars.select("node", "root").union(stars.select("root", "root").distinct()).toDF("fp", "root")
    linked = roots.join(distinct, "fp")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    named = linked.join(least, "root").select("fp", "root", "least")
    ids = distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "rep").alias("component_id")
    )
    # a fingerprint with more than one in HOT_SHARE of all rows keeps its rows where they are;
    # there are fewer than HOT_SHARE of those by arithmetic
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(distinct.filter(F.col("n") * HOT_SHARE > total).select("fp"))
    hot_ids = F.broadcast(ids.join(hot, "fp", "left_semi"))
    cold = prints.join(hot, "fp", "left_anti").join(ids, "fp")
    return prints.join(hot_ids, "fp").unionByName(cold).select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Of every group the row with the least id, all columns as they came.

    Rows that stay are not moved.  Rows that share id and text are one document:
    one of them stays.
    """
    return keep_least(documents, near_duplicates(documents, doc_id, text, shingle), doc_id, text)


def keep_least(documents: DataFrame, groups: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents without those that are not the least of their ``root`` in ``groups``."""
    found = stage(groups, "groups")
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n")
    winners = rows.groupBy("root").agg(F.min(order).alias("win"))
    lost = stage(rows.join(winners, "root").filter(
        ~(F.col("doc_id").eqNullSafe(F.col("win.doc_id")) & (F.col("text_hash") == F.col("win.text_hash")))
    ).select("doc_id", "text_hash").distinct(), "lost")
    repeated = stage(winners.filter("win.n > 1").select("win.doc_id", "win.text_hash"), "repeated")
    own = [F.col(doc_id), F.xxhash64(F.col(text).cast("string"))]
    sure, unsure = split_by_slot(documents, own, lost.union(repeated))
    kept = matching(unsure, own, lost, "left_anti")
    copies = matching(kept, own, repeated, "left_semi").dropDuplicates([doc_id, text])
    return sure.union(matching(kept, own, repeated, "left_anti")).union(copies)


def digest_rows(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(documents).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
