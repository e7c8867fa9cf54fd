"""Leaving out rows by key without moving the rows that stay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SLOT_BITS = 27  # a bitmap of 16 MB, whatever the number of keys


def _marked(rows: DataFrame, own: list[Column], keys: DataFrame) -> DataFrame:
    """``_row`` and ``_may``: whether the row's key may be among ``keys``.

    ``own`` makes a row's key, in the order of the columns of ``keys``.  Keys set bits in
    a bitmap of fixed size, which is broadcast; a row whose bit is not set is sure.  With
    very many keys more rows are unsure, which costs moving them and nothing else.
    """
    def slot(columns: list[Column]) -> Column:
        return F.xxhash64(*columns).bitwiseAND(F.lit((1 << SLOT_BITS) - 1))

    bits = (
        keys.select(slot([F.col(c) for c in keys.columns]).alias("slot"))
        .groupBy(F.shiftright("slot", 15).alias("_part"))
        .agg(F.call_function("bitmap_construct_agg", F.col("slot") % 32768).alias("_bits"))
    )
    marked = rows.select(F.struct("*").alias("_row"), slot(own).alias("_slot"))
    joined = marked.join(F.broadcast(stage(bits, "slots")), F.shiftright("_slot", 15) == F.col("_part"), "left")
    at = (F.col("_slot") % 32768).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.col("_bits").isNotNull() & (F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1)
    return joined.select("_row", may.alias("_may"))


def split_by_slot(documents: DataFrame, own: list[Column], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key cannot be among ``keys``, and staged the few that may be."""
    marked = _marked(documents, own, keys)
    return marked.filter(~F.col("_may")).select("_row.*"), stage(marked.filter("_may").select("_row.*"), "unsure")


def possible(rows: DataFrame, own: list[Column], keys: DataFrame) -> DataFrame:
    """The rows whose key may be among ``keys``."""
    return _marked(rows, own, keys).filter("_may").select("_row.*")


def matching(rows: DataFrame, own: list[Column], keys: DataFrame, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join on all columns of ``keys``, nulls equal."""
    keys = keys.toDF(*[f"_key{i}" for i in range(len(own))])
    same = F.lit(True)
    for i, column in enumerate(own):
        same = same & column.eqNullSafe(F.col(f"_key{i}"))
    return rows.join(keys, same, how)


def bitmap(rows: DataFrame, slot: str) -> np.ndarray:
    """The bits of a column of slots (0 to 2 ** SLOT_BITS - 1): 16 MB at most come to the driver, whatever the rows."""
    parts = rows.groupBy(F.shiftright(slot, 15).cast("int").alias("part")).agg(
        F.call_function("bitmap_construct_agg", F.col(slot) % 32768).alias("bits")
    ).toPandas()
    out = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for part, bits in parts.itertuples(index=False):
        out[part * 4096 : part * 4096 + len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return out


def has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the bits of some slots are set."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
