"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a smaller
document, or earlier in the same one) is removed.

1. *Cut.*  A window is a ``LENGTH``-byte string.  Its anchor is the ``GRAM``-byte string
   in it with the least hash, the leftmost of equals, so equal windows have equal anchors
   at equal places.  Consecutive windows with one anchor are a segment: every window of
   the corpus lies in exactly one segment, and a segment adds 41 bytes of text on average.
   Anchor hashes are counted; the repeated ones go to the tasks as a bitmap of fixed size
   (``SLOT_BITS``), and only segments with such an anchor are looked at again.  A full
   bitmap costs shuffle volume, never a result.
2. *Equal segments* of one task are found there: all but the first are removed and go no
   further, so a passage with any number of copies sends one segment per task.
3. *Shards.*  The others are dealt out by anchor.  A shard concatenates the different
   segments of its anchors, builds their suffix array by prefix doubling that refines
   unsorted groups only (Larsson and Sadakane), takes common prefixes by Kasai's walk, all
   segments in step, and so finds equal windows.  The shards of an anchor are merged by
   binary search in the sorted windows of those before.  Anchors with more than ``HOT``
   segments (a second bitmap) are not dealt out whole: their windows travel as digests
   that are anchors of their own.
4. The spans of every document are merged and cut out.

Documents are known by their id and a hash of their text, so every step can be run again
on other executors, and rows that share both are handled as copies at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, runs, sliding_min

LENGTH = 100
GRAM = 20
SLOT_BITS = 27
HOT = 20_000
SHARD_BYTES = 1 << 18
FLUSH = 200_000  # different segments that a task remembers

_PLACE = 24  # bits of an anchor's place in a packed value; blocks are cut below 2 ** 24 bytes
_CUT = 1 << 20


# --- 1. segments ----------------------------------------------------------------------


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and anchor hash of all segments of a block.

    A row longer than ``_CUT`` is cut into overlapping stretches; a segment that a cut
    divides is two segments with the same anchor, which step 3 compares.
    """
    out = []
    for lo in range(0, max(1, len(data) - LENGTH + 1), _CUT):
        part = data[lo : lo + _CUT + LENGTH - 1]
        if len(part) < LENGTH:
            break
        grams = gram_values(part)
        packed = grams >> np.uint64(_PLACE) << np.uint64(_PLACE)
        packed |= np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(packed, LENGTH - GRAM + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        at = np.arange(lo, lo + len(anchor))
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(np.clip(bounds, lo, lo + len(anchor))))
        whole = at + LENGTH <= bounds[row + 1]
        starts = np.flatnonzero(whole)
        if not len(starts):
            continue
        a, r = anchor[starts], row[starts]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        out.append((r[first], starts[first] + lo - bounds[r[first]], count, grams[a[first]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gram_values(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` = 20 bytes from every position."""
    words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), 0, (1,)).copy()
    n = len(data) - GRAM + 1
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out += words[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    out += words[12 : 12 + n] * np.uint64(0x165667B19E3779F9)
    return mix(out)


def _anchors(documents: DataFrame) -> DataFrame:
    """``anchor, n`` of every task's segments."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in blocks(batch.column(0)):
                found = np.sort(segments(data, bounds)[3].view(np.int64))
                heads = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else found
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[heads]), pa.array(np.diff(np.append(heads, len(found))))], names=["anchor", "n"])

    return documents.select("text").mapInArrow(scan, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _bitmaps(anchors: DataFrame, limits: list[int]) -> list[np.ndarray]:
    """Bits of the slots of anchors with more than each limit of segments, 2 ** SLOT_BITS of them whatever the input."""
    slot = F.col("anchor").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    at = (slot % 32768).cast("long")
    parts = anchors.filter(F.col("n") > min(limits)).groupBy(F.shiftright(slot, 15).cast("int").alias("part")).agg(
        *[F.call_function("bitmap_construct_agg", F.when(F.col("n") > limit, at)).alias(f"over_{limit}") for limit in limits]
    ).toPandas()
    out = [np.zeros((1 << SLOT_BITS) // 8, np.uint8) for _ in limits]
    for part, *own in parts.itertuples(index=False):
        for bits, bitmap in zip(out, own, strict=True):
            bits[part * 4096 : part * 4096 + len(bitmap)] = np.frombuffer(bytes(bitmap), np.uint8)
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = (hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


_PIECE = ["anchor", "body", "doc_id", "text_hash", "start", "n"]


def _pieces(documents: DataFrame, id_type: str) -> DataFrame:
    """Segments with a repeated anchor, the first of every task, and without a body what the task saw repeated."""
    sent = documents.sparkSession.sparkContext.broadcast(_bitmaps(_anchors(documents), [1, HOT]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = sent.value
        seen: dict[bytes, tuple] = {}  # body: (no id, id, hash of text, start, n, anchor)
        gone: list[tuple] = []  # (id, hash of text, start, n)

        def drop(doc: object, text_hash: int, start: int, n: int) -> None:
            if gone and gone[-1][:2] == (doc, text_hash) and gone[-1][2] + gone[-1][3] == start:
                n += gone[-1][3]
                start = gone.pop()[2]
            gone.append((doc, text_hash, start, n))

        def add(body: bytes, doc: object, text_hash: int, start: int, n: int, anchor: int) -> None:
            own = (doc is None, doc, text_hash, start, n, anchor)
            first = seen.setdefault(body, own)
            if first[1:4] == own[1:4]:
                return
            if own[:4] < first[:4]:
                seen[body], own = own, first
            drop(*own[1:5])

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(v[5], k, *v[1:5]) for k, v in seen.items()]
            rows += [((h ^ (s * 0x9E3779B97F4A7C15)) % (1 << 62), None, d, h, s, n) for d, h, s, n in gone]
            seen.clear()
            gone.clear()
            for i in range(0, len(rows), 5000):
                columns = zip(*rows[i : i + 5000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_PIECE)

        types = None
        for batch in batches:
            types = types or [pa.int64(), pa.binary(), batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64()]
            docs, text_hashes = batch.column(0), batch.column(1)
            for first, _, data, bounds in blocks(batch.column(2)):
                rows, lows, counts, hashes = segments(data, bounds)
                keep = np.flatnonzero(_has(repeated, hashes))
                rows, lows, counts, hashes = rows[keep], lows[keep], counts[keep], hashes[keep]
                begin, spread = bounds[rows] + lows, _has(hot, hashes)
                raw = data.tobytes()
                row = -1
                for r, at, start, n, anchor, wide in zip(*(x.tolist() for x in (rows, begin, lows, counts, hashes.view(np.int64), spread)), strict=True):
                    if r != row:
                        row, doc, text_hash = r, docs[first + r].as_py(), text_hashes[first + r].as_py()
                    if wide:
                        for j in range(n):
                            digest = xxhash.xxh3_128_digest(raw[at + j : at + j + LENGTH])
                            add(digest, doc, text_hash, start + j, 1, int.from_bytes(digest[:8], "little", signed=True))
                    else:
                        add(raw[at : at + n + LENGTH - 1], doc, text_hash, start, n, anchor)
                if len(seen) + len(gone) > FLUSH:
                    yield from flush()
        if seen or gone:
            yield from flush()

    return documents.select("doc_id", "text_hash", "text").mapInArrow(
        scan, f"anchor long, body binary, doc_id {id_type}, text_hash long, start long, n long"
    )


# --- 3. suffix arrays -----------------------------------------------------------------


def byte_keys(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Four bytes from every position as a number; the end of a segment is less than any byte."""
    n = len(data)
    at = np.arange(n)
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for j in range(4):  # nine bits each
        key = (key << 9) | np.where(at + j < ends, padded[j : j + n], 0)
    return key


def _sorted_places(major: np.ndarray, minor: np.ndarray | None, bits: int) -> np.ndarray:
    """Places in the order of (major, minor, place), numbers of at most ``bits`` bits each in one word if they fit."""
    n = len(major)
    wide = max(n - 1, 1).bit_length()
    if wide + bits * (1 if minor is None else 2) > 63:
        return np.lexsort((np.arange(n), major) if minor is None else (np.arange(n), minor, major))
    word = major << wide if minor is None else ((major << bits) | minor) << wide
    word |= np.arange(n)
    word.sort()
    return word & ((1 << wide) - 1)


def suffix_array(key: np.ndarray, depth: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the place of each; a suffix ends where its segment does.

    ``key`` orders them by their first ``depth`` symbols, ``ends`` is the end of the
    segment of every position.  Groups of equal suffixes, and only those, are ordered by
    the rank of what follows, which doubles the depth.  Suffixes equal to their ends keep
    their order.
    """
    n = len(key)
    at = np.arange(n)
    order = _sorted_places(key, None, int(key.max(initial=0)).bit_length())
    sorted_key = key[order]
    rank = np.empty(n, np.int64)

    def name(places: np.ndarray, head: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Rank of each suffix: the place of the head of its group."""
        heads = np.flatnonzero(head)
        group = np.cumsum(head) - 1
        rank[places] = base[heads][group]
        return np.diff(np.append(heads, len(places)))[group] > 1

    many = name(order, np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])), at)
    slots = at[many]  # places in the order that are not settled
    longest = int((ends - at).max(initial=0))
    while len(slots) and depth < longest:
        members = order[slots]
        beyond = members + depth >= ends[members]
        follow = np.where(beyond, 0, rank[np.minimum(members + depth, n - 1)] + 1)
        own = rank[members]
        moved = _sorted_places(own, follow, n.bit_length())
        members, own, follow = members[moved], own[moved], follow[moved]
        order[slots] = members
        many = name(members, np.concatenate(([True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1]))), slots)
        slots = slots[many]
        depth *= 2
    place = np.empty(n, np.int64)
    place[order] = at
    return order, place


def common_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, by position.

    Kasai's walk along the text (a suffix shares at least one byte less than the one
    before it in the text), taken through all segments at once.
    """
    n = len(data)
    stop = np.repeat(ends, ends - starts)
    out = np.zeros(n, np.int64)
    length = ends - starts
    have = np.zeros(len(starts), np.int64)
    by_length = np.argsort(-length, kind="stable")
    for t in range(int(length.max(initial=0))):
        alive = by_length[: int(np.searchsorted(-length[by_length], -t, "left"))]
        i = starts[alive] + t
        before = place[i] - 1
        j = order[np.maximum(before, 0)]
        h = np.maximum(have[alive] - 1, 0)
        limit = np.where(before >= 0, np.minimum(stop[i] - i, stop[j] - j), 0)
        h = np.minimum(h, limit)
        going = np.flatnonzero(h < limit)
        while len(going):
            same = data[i[going] + h[going]] == data[j[going] + h[going]]
            going = going[same]
            h[going] += 1
            going = going[h[going] < limit[going]]
        out[i] = h
        have[alive] = h
    return out


class Shards:
    """Pieces in order of anchor and then of document and start, shard by shard.

    Windows that an earlier piece of the same anchor also holds are reported; earlier
    shards of an anchor are searched in the sorted first windows that they leave.
    """

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.anchor: int | None = None  # of the windows left by the shards before
        self.left = np.zeros(0, f"S{length}")

    def repeats(self, anchors: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, offset and number of windows of all runs of repeated windows."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        stop = np.repeat(ends, sizes)
        order, place = suffix_array(byte_keys(data, stop), 4, stop)
        shared = common_prefixes(data, starts, ends, order, place)
        # equal windows are neighbours in the order: what stands between them begins alike
        group = np.cumsum(shared[order] < self.length)
        full = order + self.length <= stop[order]
        windows, group = order[full], group[full]
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        repeated = np.zeros(len(data), bool)
        repeated[windows] = True
        first = np.minimum.reduceat(windows, heads)
        repeated[first] = False
        texts = np.lib.stride_tricks.sliding_window_view(data, self.length)
        string = lambda at: np.ascontiguousarray(texts[at]).view(f"S{self.length}").reshape(-1)
        if len(self.left) and self.anchor == anchors[0]:
            at = first[first < ends[np.flatnonzero(anchors == self.anchor)[-1]]]
            own = string(at)
            found = np.searchsorted(self.left, own)
            seen = self.left[np.minimum(found, len(self.left) - 1)] == own
            repeated[at[seen]] = True
        if self.anchor != anchors[-1]:
            self.left = self.left[:0]
        self.anchor = anchors[-1]
        at = first[first >= starts[np.flatnonzero(anchors == self.anchor)[0]]]
        new = string(at[~repeated[at]])
        self.left = np.insert(self.left, np.searchsorted(self.left, new), new)
        begin, end = runs(repeated, starts)
        piece = np.searchsorted(ends, begin, "right")
        return piece, begin - starts[piece], end - begin


def _repeats(pieces: DataFrame, id_type: str) -> DataFrame:
    """``doc_id, text_hash, start, n``: runs of windows that also start earlier."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards()
        anchor: int | None = None
        firsts: dict[bytes, tuple] = {}  # different bodies of the anchor at hand, in document order
        shard: list[tuple[int, bytes, tuple]] = []
        out: list[tuple] = []
        size = 0

        def cut_shard() -> None:
            found = shards.repeats(np.array([s[0] for s in shard], np.int64), [s[1] for s in shard])
            for piece, offset, n in zip(*(x.tolist() for x in found), strict=True):
                doc, text_hash, start = shard[piece][2]
                out.append((doc, text_hash, start + offset, n))
            shard.clear()

        def close() -> None:
            nonlocal size
            if len(firsts) > 1:
                for body, place in firsts.items():
                    shard.append((anchor, body, place))
                    size += len(body)
                    if size > SHARD_BYTES:
                        cut_shard()
                        size = 0
            firsts.clear()

        def emit() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_hash", "start", "n"])

        types = None
        for batch in batches:
            types = types or [batch.schema.field(2).type, pa.int64(), pa.int64(), pa.int64()]
            for own, body, doc, text_hash, start, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if body is None:
                    out.append((doc, text_hash, start, n))
                    continue
                if own != anchor:
                    close()
                    anchor = own
                place = (doc, text_hash, start)
                if firsts.setdefault(body, place) != place:
                    out.append((*place, n))
            if len(out) > 5000:
                yield emit()
        close()
        if shard:
            cut_shard()
        if out:
            yield emit()

    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").isNull(), "doc_id", "text_hash", "start")
    return dealt.select(*_PIECE).mapInArrow(scan, f"doc_id {id_type}, text_hash long, start long, n long")


# --- 2 and 4. all together --------------------------------------------------------------


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, spans`` of the documents with repeats: sorted disjoint (start, end) in bytes.

    Rows that share id and text count as one document here.  Documents are ordered by id,
    then by the hash of the text; null ids come last.
    """
    docs = _keyed(documents, doc_id, text)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spans = _repeats(_pieces(docs, id_type), id_type)
    # a set: rows that share id and text report the same spans
    ordered = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n") + LENGTH - 1).alias("end"))))
    return spans.groupBy("doc_id", "text_hash").agg(ordered.alias("spans"))


def _keyed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def _merged(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans from sorted ones; those that touch become one."""
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    return np.stack((spans[new, 0], np.append(reach[:-1][new[1:]], reach[-1])), axis=1)


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` of every row; ``kept`` are the bytes that stay.

    A null text is empty.  Of rows that share id and text the first keeps what it keeps,
    and all others lose every byte a window of theirs covers, which is the whole text if
    it has ``LENGTH`` bytes.  Matches never cross documents.  Bytes may be cut inside a
    character, so ``kept`` is binary.  An empty table gives no rows.  Other columns are
    not read.
    """
    docs = _keyed(documents, doc_id, text)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    own = repeated_spans(documents, doc_id, text).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = docs.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, n_spans, n_bytes = [], [], [], []
            for value, spans in zip(batch.column(2), batch.column(3), strict=True):
                data = value.as_py().encode()
                flat = _merged(np.array([(s["start"], s["end"]) for s in spans.as_py() or []], np.int64).reshape(-1, 2))
                edges = [0, *flat.reshape(-1).tolist(), len(data)]
                parts = [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                kept.append(b"".join(parts))
                removed.append(len(data) - len(kept[-1]))
                n_spans.append(len(flat))
                n_bytes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans))],
                names=["doc_id", "text_hash", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return joined.select("doc_id", "text_hash", "text", "spans").mapInArrow(
        cut, f"doc_id {id_type}, text_hash long, kept binary, n_bytes long, n_removed long, n_spans long"
    )


def digest_rows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's columns; later rows that share id and text are copies of the first."""
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = without_repeats(documents, doc_id, text).select("text_hash", *columns[:-1], F.sha2("kept", 256).alias("kept_sha256"))
    rows = rows.groupBy("text_hash", *columns).agg(F.count("*").alias("rows"))
    whole = F.col("n_bytes") >= LENGTH
    copies = rows.filter("rows > 1").withColumn("copy", F.explode(F.sequence(F.lit(2).cast("long"), "rows"))).select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    return rows.select(*columns).unionByName(copies)
