"""Language identification by compression.

Every language has a raw-content zstandard dictionary, made of whole training texts.  The
words of a text, lower-cased and without digits and signs, are compressed with each
dictionary; the one that makes them smallest names the language.  How much smaller the
winner is than the next is the margin; below ``min_margin`` the text is rejected as
``und``.  Equal sizes, as for a few words that no dictionary holds, go to the language
with more training texts.

Dictionaries are fitted on a bounded sample: per language the ``SAMPLE`` training texts
with the least hash of their id, and of these, in that order, every one that still fits
into ``DICTIONARY_BYTES``.  If none does, the first is taken in stretches spread over it.
All texts are classified, whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc_mod

UNKNOWN = "und"
SAMPLE = 200
DICTIONARY_BYTES = 200_000
PIECES = 20
LEVEL = 6

_WORDS = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """The words of a text, lower-cased, one space between them."""
    return " ".join(_WORDS.findall(text.lower())).encode()


def _within(text: Column) -> Column:
    """The text, or if it is longer than a dictionary ``PIECES`` stretches spread over all of it."""
    size = DICTIONARY_BYTES // (4 * PIECES)  # a character has four bytes at most
    step = (F.length(text) - size) / (PIECES - 1)
    stretches = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, F.floor(i * step).cast("int") + 1, F.lit(size)))
    return F.when(F.octet_length(text) <= DICTIONARY_BYTES, text).otherwise(F.array_join(stretches, " "))


def learn(documents: DataFrame, lang: str = "lang", text: str = "text", order: str = "doc_id") -> dict[str, bytes]:
    """A dictionary of training bytes per language, from rows with text and language, commonest language first.

    Ranks are cut in every task before rows move, so a language with most of the rows
    sends no more than the others, and texts are only read once they are chosen.
    """
    own = documents.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(order).alias("place"),
    ).withColumn("same", F.xxhash64("text"))
    by_place = Window.partitionBy("lang").orderBy("place", "same")
    ranked = own.select("lang", "place", "same", F.octet_length("text").alias("size")).withColumn("rank", F.row_number().over(by_place))
    # whole texts in the order of the ranking, those that fit into what is left; SAMPLE numbers per language
    sample = ranked.filter(F.col("rank") <= SAMPLE).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "size", "place", "same"))).alias("texts"))
    zero = F.struct(F.lit(0).cast("long").alias("bytes"), F.array().cast("array<int>").alias("ranks"))

    def take(state: Column, t: Column) -> Column:
        fits = state["bytes"] + t["size"] <= DICTIONARY_BYTES
        return F.struct(
            F.when(fits, state["bytes"] + t["size"]).otherwise(state["bytes"]).alias("bytes"),
            F.when(fits, F.concat(state["ranks"], F.array(t["rank"]))).otherwise(state["ranks"]).alias("ranks"),
        )

    chosen = sample.withColumn("ranks", F.aggregate("texts", zero, take)["ranks"])
    chosen = chosen.withColumn("ranks", F.when(F.size("ranks") > 0, F.col("ranks")).otherwise(F.array(F.lit(1))))  # none fits: the first, in pieces
    kept = chosen.select("lang", F.explode(F.filter("texts", lambda t: F.array_contains("ranks", t["rank"]))).alias("t")).select("lang", "t.rank", "t.place", "t.same")
    rows = own.join(F.broadcast(kept), ["lang", "place", "same"])  # at most SAMPLE rows of numbers per language
    texts: dict[str, list[bytes]] = {}
    for row in rows.orderBy("lang", F.desc("rank")).select("lang", _within(F.col("text")).alias("text")).toLocalIterator():
        texts.setdefault(row.lang, []).append(plain(row.text))
    counts = {row.lang: row["count"] for row in own.groupBy("lang").count().collect()}  # one row per language
    return {name: b"\n".join(texts[name]) for name in sorted(texts, key=lambda name: (-counts[name], name))}


class Classifier:
    """Compressors of all languages, made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))

    def classify(self, text: str | None, min_margin: float = 0.0) -> tuple[str, float]:
        """Language and score; the score is how far the next language is behind, from 0 to 1."""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = plain(text)
        sizes = [len(c.compress(data)) for c in self.compressors]
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.names[0], 1.0
        others = min(sizes[:best] + sizes[best + 1 :])
        margin = 1 - sizes[best] / others
        return (self.names[best] if margin >= min_margin else UNKNOWN), margin


def identify(documents: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = 0.0) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``; columns of those names are replaced.

    A null text and one without a letter are ``und`` with score 0, and so is a text whose
    margin is below ``min_margin`` (its score stays).  Ties go to the first
    dictionary.  Without a dictionary everything is ``und``.  Rows are kept as they
    come, repeated or not; an empty table gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(dictionaries)
    own = [c for c in documents.columns if c not in ("lang_pred", "score")]
    place = own.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(sent.value)
        for batch in batches:
            found = [classifier.classify(t.as_py(), min_margin) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*own, "lang_pred", "score"],
            )

    rows = documents.select(*own)
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(judge, schema)


def digest_rows(documents: DataFrame) -> DataFrame:
    """The contract's columns, learned from the documents that are not held out.

    Every text with a letter gets a language; a narrow margin shows as a low score.
    """
    held_out = crc_mod("doc_id", 5) == 0
    dictionaries = learn(documents.filter(~held_out))
    rows = documents.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, dictionaries).drop("text")
