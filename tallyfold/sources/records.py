"""Quoted text with newlines inside quotes, read by many tasks.

Whether a byte stands inside quotes depends on all quotes before it in its file.  So the
file is read twice.  First every piece counts its quotes, and the sums before a piece, one
number per piece, say whether it begins inside quotes.  Then every piece is cut into the
records that begin in it, from that true state; the last one is read on beyond the piece's
end.  Nothing is guessed, and no task reads more than its piece and one record.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import BATCH_BYTES, LOOK, PIECE_BYTES, file_pieces, locate, tasks_of


def _ends(block: bytes, inside: bool) -> tuple[np.ndarray, bool]:
    """Places of the newlines that end a record, and whether the block ends inside quotes."""
    data = np.frombuffer(block, np.uint8)
    newlines = np.flatnonzero(data == 10)
    quotes = np.flatnonzero(data == 34)
    before = np.searchsorted(quotes, newlines)
    return newlines[(before + inside) % 2 == 0], bool((len(quotes) + inside) % 2)


def records_of(file: pa.NativeFile, start: int, end: int, size: int, inside: bool) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of every record that begins in ``start`` to ``end``; ``inside`` is the state at ``start``."""
    block = file.read_at(end - start, start)
    ends, state = _ends(block, inside)
    begins = start == 0 or (not inside and file.read_at(1, start - 1) == b"\n")
    starts = ends + 1
    if begins:
        starts = np.concatenate(([0], starts))
    else:
        ends = ends[1:]
    starts = starts[starts < len(block)].tolist()
    for first, last in zip(starts, ends.tolist(), strict=False):
        yield start + first, block[first:last]
    if len(starts) > len(ends):  # the last record goes on behind the piece
        parts, at = [block[starts[-1] :]], end
        while at < size:
            more = file.read_at(min(LOOK, size - at), at)
            found, after = _ends(more, state)
            if len(found):
                parts.append(more[: found[0]])
                break
            parts.append(more)
            at, state = at + len(more), after
        yield start + starts[-1], b"".join(parts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "start", "record"]
    kinds = [pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    rows, held = [], 0
    for task in batches:
        pieces = sorted(task.to_pylist(), key=lambda p: (p["path"], p["start"]))
        for address, inside in groupby(pieces, key=lambda p: p["path"]):
            store, path, _ = locate(address)
            with store.open_input_file(path) as file:
                for piece in inside:
                    for at, record in records_of(file, piece["start"], piece["end"], piece["size"], piece["inside"]):
                        rows.append((address, at, record))
                        held += len(record) + 64
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
    if rows:
        yield batch(rows)


def read_quoted_records(spark: SparkSession, path: str | Sequence[str], piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``path, start, record``: every record of every file with its place, the newline at its end left out.

    A newline ends a record unless an odd number of double quotes stands before it in the
    file.  An unclosed quote makes the rest of the file one record.
    """
    pieces = file_pieces(spark, path, piece_bytes, "bytes", "quotes").where("size > 0")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
    states = pieces.select("path", "start", "end", "size", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # a few numbers per piece: as many tasks as read the pieces, where small rows would else be put into one
    dealt = states.repartition(max(1, len(tasks_of(spark, path, piece_bytes))), "path", "start")
    found = dealt.mapInArrow(_cut, "path string, start bigint, record binary")
    return found.select("path", "start", F.make_valid_utf8(F.col("record").cast("string")).alias("record"))
