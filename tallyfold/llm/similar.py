"""Near-duplicate texts: SimHash on bit planes among texts that share a key, then the shingles themselves.

Two texts are linked if their sets of ``SHINGLE``-word shingles have a Jaccard similarity
of ``LEAST`` or more.

1. Every different text has a 64-bit SimHash of its shingles, their number, and ``BANDS``
   keys of ``ROWS`` minimum hashes.  Blocks of a 64-bit fingerprint cannot hold pairs about
   ten bits apart together without holding most others too; the keys can, and miss a pair
   at the threshold with a probability of (1 - LEAST ** ROWS) ** BANDS, one in 40,000.
2. Stars: in every bucket of a key the fingerprint of one text, not the same for all keys,
   is compared with all others.  So a group of many copies is joined with a few
   comparisons per copy, however large its buckets are.
   These pairs of hashes are joined with the texts' shingle sets, one side at a time.
3. What stars have not joined is compared in full: a bucket is cut into blocks of
   ``BLOCK`` texts, or fewer if they are long, and every two blocks meet in a task, with
   their sets.  A pair is looked at in the first bucket that it shares, and only until its
   groups are joined, so that texts of one template, which are many and not similar, cost
   comparisons and no rows.
4. Comparison is bit-sliced, by carry-save counters, and leaves pairs within ``RADIUS``
   bits whose sizes allow the threshold.  Their sets are checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import batches_of, mix, stage, together
from .components import components
from .keys import split_by_slot

SHINGLE = 5
LEAST = 0.8
ROWS, BANDS = 4, 20
RADIUS = 24  # the threshold gives ten bits, with a deviation of three
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
WIDE_ROWS = 500  # texts or shingle sets that a task holds at once
STEP = 1 << 12  # shingles that are hashed by all functions at once

_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


# --- sketches -------------------------------------------------------------------------


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the different shingles; a text without a word has one of its own."""
    found = np.unique(simhash.shingle_hashes((text or "").encode(), SHINGLE))
    return found if len(found) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, one per band."""
    least = np.full(len(_SEEDS), ~np.uint64(0))
    for i in range(0, len(hashes), STEP):
        least = np.minimum(least, mix(hashes[None, i : i + STEP] + _SEEDS).min(1))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + row)
    return keys


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """Of two sets as sorted arrays."""
    if len(left) > len(right):
        left, right = right, left
    both = int((right[np.minimum(np.searchsorted(right, left), len(right) - 1)] == left).sum())
    return both / (len(left) + len(right) - both)


def _sketches(documents: DataFrame, text: str) -> DataFrame:
    """Staged ``text_hash, fp, n, keys`` of every different text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, int] = {}
            for i, h in enumerate(batch.column(0).to_pylist()):
                seen.setdefault(h, i)  # copies within a batch are one text
            fps, sizes, keys = np.zeros(len(seen), np.uint64), np.zeros(len(seen), np.int64), np.zeros((len(seen), BANDS), np.uint64)
            for at, i in enumerate(seen.values()):
                own = shingles(batch.column(1)[i].as_py())
                fps[at], sizes[at], keys[at] = simhash.fingerprint(own), len(own), band_keys(own)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.int64()), pa.array(fps.view(np.int64)), pa.array(sizes), flat], names=["text_hash", "fp", "n", "keys"]
            )

    own = F.col(text).cast("string")
    found = documents.select(F.xxhash64(own).alias("text_hash"), own.alias("text")).mapInArrow(scan, "text_hash long, fp long, n long, keys array<long>")
    return stage(found.groupBy("text_hash").agg(*[F.first(c).alias(c) for c in ("fp", "n", "keys")]), "sketches")


def _members(sketches: DataFrame) -> DataFrame:
    """Staged ``band, key, text_hash, fp, n, keys`` of the buckets with two texts or more; of buckets with the same texts the first."""
    banded = sketches.select("text_hash", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(
        F.count("*").alias("size"), F.min("text_hash").alias("low"), F.max("text_hash").alias("high"),
        F.sum(F.xxhash64("text_hash").cast("decimal(38,0)")).alias("sum"),
    ).filter("size > 1")
    kept = buckets.groupBy("size", "low", "high", "sum").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key")
    return stage(banded.join(kept, ["band", "key"]).join(sketches, "text_hash"), "bucket-members")


# --- comparison of fingerprints ---------------------------------------------------------


def _sizes_allow(a: Column, b: Column) -> Column:
    return F.least(a, b) >= LEAST * F.greatest(a, b)


def _near(pairs: DataFrame) -> DataFrame:
    """``left, right`` of the rows ``left, right, left_fp, right_fp`` within ``RADIUS`` bits, each pair once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (2, 3))
            at = np.concatenate([simhash.within(a[i : i + simhash.LANES], b[i : i + simhash.LANES], RADIUS) + i for i in range(0, len(a), simhash.LANES)])
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in batch.columns[:2]], names=["left", "right"])

    found = pairs.select("left", "right", "left_fp", "right_fp").mapInArrow(compare, "left long, right long")
    return found.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with the ``root`` of the group that links so far put them in."""
    return members.join(roots.toDF("text_hash", "_root"), "text_hash", "left").withColumn("root", F.coalesce("_root", "text_hash")).drop("_root")


def _stars(members: DataFrame) -> DataFrame:
    """Near pairs of every bucket's star: one of its texts with all others."""
    own = F.struct(F.col("text_hash").alias("right"), F.col("fp").alias("right_fp"), F.col("n").alias("right_n"))
    centres = members.groupBy("band", "key").agg(F.min_by(own, F.xxhash64("text_hash", "band")).alias("c")).select("band", "key", "c.*")
    pairs = members.join(stage(centres, "centres"), ["band", "key"]).filter((F.col("text_hash") != F.col("right")) & _sizes_allow(F.col("n"), F.col("right_n")))
    return _near(pairs.select(F.col("text_hash").alias("left"), "right", F.col("fp").alias("left_fp"), "right_fp"))


def _rest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``left, right`` of similar texts of different groups that share a bucket, by blocks of texts."""
    mixed = members.groupBy("band", "key").agg(
        F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("root").alias("low"), F.max("root").alias("high")
    ).filter("low < high")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(mixed.select("band", "key", blocks.alias("blocks")), ["band", "key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("text_hash", "band"), F.col("blocks")).cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "text_hash", "fp", "n", "root", "keys",
    ).join(sets, "text_hash").select("band", "key", "i", "j", "block", "text_hash", "fp", "n", "root", "keys", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            whole = batch if held is None else pa.concat_batches([held, batch])
            group = np.any([c != c[-1] for c in (whole.column(i).to_numpy() for i in range(4))], axis=0)
            cut = int(np.flatnonzero(group)[-1]) + 1 if group.any() else 0  # the last group may go on
            if cut:
                yield from _links_of_blocks(whole.slice(0, cut))
            held = whole.slice(cut)
        if held is not None and len(held):
            yield from _links_of_blocks(held)

    dealt = spread.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return dealt.mapInArrow(compare, "left long, right long")


def _links_of_blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Links of whole groups of rows, enough of them to join what is similar."""
    band, key, i, j, block, names, fps, sizes, roots = (c.to_numpy() for c in batch.columns[:9])
    keys = batch.column(9).flatten().to_numpy().reshape(-1, BANDS)
    group = np.concatenate(([0], np.cumsum((band[1:] != band[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    shingle_sets, joined, found = batch.column(10), {}, []

    def top(root: int) -> int:
        while (above := joined.get(root, root)) != root:
            root = above
        return root

    for a, b in _near_pairs(group, i == j, band, block, fps.view(np.uint64), sizes, roots, keys):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            left, right = top(int(roots[x])), top(int(roots[y]))
            if left != right and jaccard(*(np.frombuffer(shingle_sets[at].as_buffer(), np.uint64) for at in (x, y))) >= LEAST:
                joined[left] = right
                found.append((int(names[x]), int(names[y])))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["left", "right"])


def _near_pairs(
    group: np.ndarray, alone: np.ndarray, band: np.ndarray, block: np.ndarray, fps: np.ndarray, sizes: np.ndarray, roots: np.ndarray, keys: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of different roots within groups: of a block with itself (``alone``), or between its two blocks.

    Pairs that share a key of an earlier band are left out.
    """
    members = np.bincount(group)
    order = np.flatnonzero(members[group] > 1)
    for step in range(1, int(members.max(initial=1))):
        order = order[order + step < len(group)]
        order = order[group[order] == group[order + step]]
        other = order + step
        fits = (roots[order] != roots[other]) & (alone[order] | (block[order] != block[other]))
        fits &= np.minimum(sizes[order], sizes[other]) >= LEAST * np.maximum(sizes[order], sizes[other])
        a, b = order[fits], other[fits]
        for at in range(0, len(a), simhash.LANES):
            left, right = a[at : at + simhash.LANES], b[at : at + simhash.LANES]
            near = simhash.within(fps[left], fps[right], RADIUS)
            left, right = left[near], right[near]
            earlier = ((keys[left] == keys[right]) & (np.arange(BANDS) < band[left][:, None])).any(axis=1)
            if not earlier.all():
                yield left[~earlier], right[~earlier]


# --- exact check ------------------------------------------------------------------------


def _shingle_sets(documents: DataFrame, text: str, members: DataFrame) -> DataFrame:
    """Staged ``text_hash, shingles`` of the texts that share a bucket with another."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = (
                pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([shingles(batch.column(1)[i].as_py()).tobytes()], pa.binary())], names=["text_hash", "shingles"])
                for i in range(len(batch))
            )
            yield from together(rows)

    own = F.xxhash64(F.col(text).cast("string"))
    wanted = members.select("text_hash").distinct()
    _, unsure = split_by_slot(documents.select(own.alias("text_hash"), F.col(text).cast("string").alias("text")), [F.col("text_hash")], wanted)
    texts = unsure.groupBy("text_hash").agg(F.first("text").alias("text")).join(wanted, "text_hash", "left_semi")
    return stage(texts.mapInArrow(whole, "text_hash long, shingles binary"), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``left, right`` whose sets are similar: a join for each side."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= LEAST for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["left", "right"])

    first = pairs.join(sets.toDF("left", "a"), "left")
    both = first.join(sets.toDF("right", "b"), "right").select("left", "right", "a", "b")
    return both.mapInArrow(check, "left long, right long")


def links(documents: DataFrame, text: str = "text") -> DataFrame:
    """``left, right`` hashes of similar texts: enough of the pairs to join every group."""
    with batches_of(documents.sparkSession, WIDE_ROWS):
        members = _members(_sketches(documents, text))
        sets = _shingle_sets(documents, text, members)
        found = stage(_verified(stage(_stars(members), "star-pairs"), sets), "star-links")
        grouped = stage(_rooted(members, components(found, "left", "right")), "grouped-members")
        return found.union(stage(_rest(grouped, sets), "other-links"))


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every group of similar texts the row with the least id, all columns as they came.

    Texts without a word are one group.  Rows that stay are not moved, and of rows that
    share id and text one stays.
    """
    prints = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    found = simhash.grouped(stage(prints.withColumn("fp", F.col("text_hash")), "text-hashes"), lambda _: links(documents, text))
    return simhash.keep_least(documents, found, doc_id, text)
