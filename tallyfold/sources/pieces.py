"""Files of any size as numbered pieces, read by tasks that are planned as byte ranges.

A file is cut every ``piece_bytes``, and every cut is moved forward to the next place where
the text may be cut.  Both pieces at a cut find that place by the same rule from the same
bytes, so pieces neither overlap nor leave anything out, and no task needs another's work.
Small files share a task, and so do small pieces: what a task holds depends on all bytes to
read, so the number of tasks does not follow the size of a piece.  Only names and sizes pass
through the planning, as in any file listing, and no cell ever holds a whole large file.

Files are read through Arrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import pickle
import posixpath
import re
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatchcase
from functools import cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE_BYTES = 64 << 20
CUTS = ("bytes", "chars", "words", "lines", "never")
LOOK = 1 << 16  # bytes that are read at once, at most, to find the place of a cut
FIRST_LOOK = 1 << 8  # and at first: most places are near
TASK_BYTES = 16 << 20  # that small pieces are put together to, at most
LEAST_TASK = 1 << 20  # and at least, as a task has its own cost
BATCH_BYTES = 4 << 20  # of rows that are handed on at once
LARGEST_CELL = (1 << 31) - 1
OPEN_COST = 1 << 16  # what opening a file counts for when small ones are put together
_GLOB = re.compile(r"[*?\[]")


class Piece(NamedTuple):
    path: str
    piece: int
    start: int
    end: int
    size: int  # of the whole file


# --- files --------------------------------------------------------------------------


@cache
def _store(scheme: str, authority: str) -> pafs.FileSystem:
    if scheme in ("", "file"):
        return pafs.LocalFileSystem()
    return pafs.FileSystem.from_uri(f"{scheme}://{authority}/")[0]


def locate(address: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of an address, the path in it, and what stands before the path.

    Addresses are Hadoop's: nothing in the path is percent-encoded.
    """
    scheme, authority, path = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?)?(.*)", address, re.S).groups(default="")
    store = _store(scheme, authority)
    if scheme in ("", "file"):
        return store, path, f"{scheme}:" if scheme else ""
    return store, (authority + path if scheme in ("s3", "s3a", "gs") else path), f"{scheme}://" + ("" if scheme in ("s3", "s3a", "gs") else authority)


def _hidden(name: str) -> bool:
    return name.startswith(("_", ".")) and "=" not in name


def _matching(store: pafs.FileSystem, path: str) -> list[str]:
    """The paths that a pattern stands for, ``*``, ``?`` and ``[...]`` within one name."""
    if not _GLOB.search(path):
        return [path]
    head, name = posixpath.split(path.rstrip("/"))
    found = []
    for parent in _matching(store, head):
        if not _GLOB.search(name):
            found.append(posixpath.join(parent, name))
            continue
        inside = store.get_file_info(pafs.FileSelector(parent, allow_not_found=True))
        found += [i.path for i in inside if fnmatchcase(i.base_name, name) and not _hidden(i.base_name)]
    return found


def _files(store: pafs.FileSystem, path: str) -> Iterator[tuple[str, int]]:
    """Files under a path: itself, those in the folder, and those in its ``name=value`` folders."""
    info = store.get_file_info(path)
    if info.type == pafs.FileType.File:
        yield path, info.size
    elif info.type == pafs.FileType.Directory:
        for i in store.get_file_info(pafs.FileSelector(path)):
            if _hidden(i.base_name):
                continue
            if i.type == pafs.FileType.File:
                yield i.path, i.size
            elif "=" in i.base_name:
                yield from _files(store, i.path)


def listed(addresses: Sequence[str]) -> list[tuple[str, int]]:
    """Addresses and sizes of all files under some addresses, each once, in their order by name."""
    found: dict[str, int] = {}
    for address in addresses:
        store, path, before = locate(address)
        paths = _matching(store, path)
        files = [(before + p, size) for one in paths for p, size in _files(store, one)]
        if not files and not any(store.get_file_info(p).type == pafs.FileType.Directory for p in paths):
            raise FileNotFoundError(f"no such file or folder: {address}")
        found.update(files)
    return sorted(found.items())


def planned(files: list[tuple[str, int]], piece_bytes: int, whole: bool) -> list[list[Piece]]:
    """The pieces of every task: a piece of a large file, or the files of about ``piece_bytes`` together."""
    tasks: list[list[Piece]] = []
    together: list[Piece] = []
    held = 0
    for path, size in files:
        if size > piece_bytes and not whole:
            starts = range(0, size, piece_bytes)
            tasks += [[Piece(path, i, a, min(a + piece_bytes, size), size)] for i, a in enumerate(starts)]
            continue
        cost = max(size, OPEN_COST)
        if together and held + cost > piece_bytes:
            tasks.append(together)
            together, held = [], 0
        together.append(Piece(path, 0, 0, size, size))
        held += cost
    return tasks + ([together] if together else [])


def gathered(tasks: list[list[Piece]], task_bytes: int) -> list[list[Piece]]:
    """Neighbouring tasks put together to about ``task_bytes``; the pieces and their order stay."""
    found: list[list[Piece]] = []
    held = 0
    for task in tasks:
        cost = sum(max(p.end - p.start, OPEN_COST) for p in task)
        if not found or held + cost > task_bytes:
            found.append([])
            held = 0
        found[-1].extend(task)
        held += cost
    return found


def tasks_of(spark: SparkSession, path: str | Sequence[str], piece_bytes: int, whole: bool = False) -> list[list[Piece]]:
    """The pieces of every task: as many tasks as shuffle partitions if these then hold ``LEAST_TASK`` to ``TASK_BYTES``."""
    files = listed([path] if isinstance(path, str) else path)
    share = sum(size for _, size in files) // int(spark.conf.get("spark.sql.shuffle.partitions"))
    return gathered(planned(files, piece_bytes, whole), max(piece_bytes, min(TASK_BYTES, max(LEAST_TASK, share))))


# --- cuts ---------------------------------------------------------------------------


def _is_word(byte: int) -> bool:
    return 48 <= byte <= 57 or 65 <= byte <= 90 or 97 <= byte <= 122


def _between_chars(before: int, at: int) -> bool:
    return at & 0xC0 != 0x80


def _between_words(before: int, at: int) -> bool:
    """Not inside a word: digits belong to words, as they vanish when words are made."""
    return at & 0xC0 != 0x80 and not (_is_word(before) and _is_word(at))


def _after_line(before: int, at: int) -> bool:
    return before == 10


_RULES = {"chars": _between_chars, "words": _between_words, "lines": _after_line}


def cut_place(file: pa.NativeFile, at: int, size: int, rule: str) -> int:
    """The first place from ``at`` on where the rule lets a text be cut; the end of the file at the latest.

    Bytes that are no UTF-8 are cut as they come: a run of continuation bytes is left
    after three, as no character has more.
    """
    if at <= 0 or at >= size or rule == "bytes":
        return min(max(at, 0), size)
    allowed, place, run, look = _RULES[rule], at, 0, FIRST_LOOK
    before = file.read_at(1, at - 1)[0]
    while place < size:
        block = file.read_at(min(look, size - place), place)
        look = min(4 * look, LOOK)
        if rule == "lines" and before != 10:
            found = block.find(b"\n")
            if found < 0:
                place, before = place + len(block), block[-1]
                continue
            return place + found + 1
        for byte in block:
            run = run + 1 if byte & 0xC0 == 0x80 else 0
            if allowed(before, byte) or (rule == "chars" and run > 3) or (rule == "words" and run > 3):
                return place
            before, place = byte, place + 1
    return size


def _rows_of(task: list[Piece], cut: str, quotes: bool) -> Iterator[tuple]:
    """The rows of a task's pieces; a cut between two of them is looked for once, and a file is opened once."""
    rule = "bytes" if cut == "never" else cut
    for address, pieces in groupby(task, key=lambda p: p.path):
        store, path, _ = locate(address)
        with store.open_input_file(path) as file:
            asked = place = -1
            for piece in pieces:
                if piece.end - piece.start > LARGEST_CELL:
                    raise ValueError(f"{piece.path} has {piece.size} bytes, too many for one cell; read it in pieces")
                start = place if asked == piece.start else cut_place(file, piece.start, piece.size, rule)
                asked, place = piece.end, cut_place(file, piece.end, piece.size, rule)
                if start < place or piece.size == 0:
                    content = file.read_at(place - start, start)
                    value = content.count(b'"') if quotes else content
                    yield piece.path, piece.piece, start, place, piece.size, value


def _reader(plans: list[bytes], cut: str, quotes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["path", "piece", "start", "end", "size", "value"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64() if quotes else pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers in batches:
            for number in numbers.column(0).to_pylist():
                rows, held = [], 0
                for row in _rows_of([*map(Piece._make, pickle.loads(plans[number]))], cut, quotes):
                    cost = 64 if quotes else len(row[-1]) + 64
                    if rows and held + cost > BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                    rows.append(row)
                    held += cost
                if rows:
                    yield batch(rows)

    return read


def file_pieces(
    spark: SparkSession, path: str | Sequence[str], piece_bytes: int = PIECE_BYTES, cut: str = "chars", want: str = "content"
) -> DataFrame:
    """``path, piece, start, end, size`` and ``content`` (bytes) of every piece, or with ``want="quotes"`` the number of its double quotes.

    The files are listed now.  A plan that reads these rows more than once can share what
    it shuffles of them: the rows come out of one function, and equal plans compare equal.
    """
    if cut not in CUTS:
        raise ValueError(f"cut must be one of {CUTS}, not {cut!r}")
    if piece_bytes < 1:
        raise ValueError(f"a piece needs a byte at least, not {piece_bytes}")
    tasks = tasks_of(spark, path, piece_bytes, cut == "never")
    plans = [pickle.dumps([tuple(p) for p in task]) for task in tasks]  # a task unpacks its own only
    value = "quotes" if want == "quotes" else "content"
    found = spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(
        _reader(plans, cut, want == "quotes"),
        f"path string, piece int, start bigint, end bigint, size bigint, value {'bigint' if want == 'quotes' else 'binary'}",
    )
    return found.withColumnRenamed("value", value)


def read_file_pieces(
    spark: SparkSession, path: str | Sequence[str], piece_bytes: int = PIECE_BYTES, cut: str = "chars"
) -> DataFrame:
    """``path, file_name, piece, start, content`` of every piece of every file.

    ``cut`` says where a text may be cut: between characters (``chars``), between words
    (``words``: never between two ASCII letters or digits), after a newline (``lines``),
    or anywhere (``bytes``).  A word or line longer than a piece stays whole and makes its
    piece longer; the pieces that it covers have no row, so numbers rise and may leave
    gaps.  Joined in the order of ``start``, contents are the file's bytes, and bytes that
    are no UTF-8 become U+FFFD as in the whole file.  An empty file is one empty piece.
    """
    found = file_pieces(spark, path, piece_bytes, cut)
    return found.select(
        "path", F.regexp_extract("path", "[^/]*$", 0).alias("file_name"), "piece", "start",
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )
