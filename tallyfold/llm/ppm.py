"""Language-model scores by prediction by partial matching (PPM, method C).

The model counts what follows byte contexts of up to ``ORDER`` symbols in all training
texts.  A symbol seen in the longest known context costs its share of that context's
count; otherwise an escape is paid (distinct symbols over count plus distinct symbols)
and the next shorter context is asked, without the symbols that the longer one has
already excluded, down to a uniform choice.  The code length of a text is the sum over
its bytes and an end symbol.

Training counts (ORDER + 1)-grams in tasks and sums them by shuffle; counts of shorter
contexts are sums of longer ones.  The trie of contexts is a table, a row per context with
its symbols, keyed by length and context: it is never in one place, and what grows with the
corpus stays distributed.

Texts are scored in two ways that give the same costs.  The ``HOT`` most frequent grams,
a table of fixed size, are looked up where the texts are read.  All others are counted per
text and priced once for each different gram: they are joined with the contexts by their
suffixes, from the longest down, and a gram leaves as soon as a context knows its symbol.
Almost all do so at the first one, as training has seen them.

Beside it stands the base score of whole words, whose counts are complete as well: the
most frequent ones are looked up in tasks, all others are joined by shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, stage

ORDER = 5
HOT_GRAMS = 1 << 20  # 16 bytes each
HOT = 100_000
HOT_BYTES = 64  # longest word that is looked up in tasks
FLUSH = 200_000
EDGE = 256  # before the start in contexts, after the end as a symbol
_BITS = 9

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


# --- counts -------------------------------------------------------------------------


def _symbols(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each with ``order`` edges before and one after; and where each ends."""
    sizes = np.diff(bounds)
    ends = np.cumsum(sizes + order + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, EDGE, np.int64)
    shift = np.repeat(ends - (sizes + 1) - bounds[:-1], sizes)
    out[np.arange(len(data)) + shift] = _LOWER[data]
    return out, ends


def grams(symbols: np.ndarray, ends: np.ndarray, order: int) -> np.ndarray:
    """The packed (order + 1)-gram that ends at every predicted symbol."""
    packed = symbols[: len(symbols) - order].copy()
    for j in range(1, order + 1):
        packed = (packed << _BITS) | symbols[j : len(symbols) - order + j]
    own = np.ones(len(symbols), bool)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    own[(starts[:, None] + np.arange(order)).reshape(-1)] = False
    return packed[own[order:]]


def _gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """Staged ``gram, n`` of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def combined() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in kept])
            by = np.argsort(keys, kind="stable")
            keys, weights = keys[by], np.concatenate([n for _, n in kept])[by]
            heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[heads], np.add.reduceat(weights, heads)

        for batch in batches:
            for _, _, data, bounds in blocks(batch.column(0)):
                found = np.sort(grams(*_symbols(data, bounds, order), order))
                heads = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else found
                kept.append((found[heads], np.diff(np.append(heads, len(found)))))
                if sum(len(k) for k, _ in kept) > 8 * FLUSH:
                    kept = [combined()]
                    if len(kept[0][0]) > 4 * FLUSH:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, kept.pop())), names=["gram", "n"])
        if kept:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, combined())), names=["gram", "n"])

    return stage(texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")


def _word_counts(texts: DataFrame) -> DataFrame:
    """Staged ``word, n`` of all training texts, without the end tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or "").encode().lower().split())
                if len(counts) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return stage(texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


# --- model --------------------------------------------------------------------------


def _least_of_most(counted: DataFrame, column: str, most: int) -> int:
    """The least count above which there are at most ``most`` rows.

    The driver gets one row per different count, of which there are few: their sum is
    bounded by the corpus.
    """
    rows = counted.groupBy(column).count().toPandas().sort_values(column, ascending=False)
    above = rows[rows["count"].cumsum() <= most]
    if len(above) == len(rows):
        return 0
    return int(above[column].min()) if len(above) else int(rows[column].max()) + 1


def _context_rows(grams: DataFrame, order: int) -> DataFrame:
    """``length, context, symbol, n`` of all contexts."""
    shift = F.shiftright("gram", _BITS)
    suffixes = F.array(*[
        F.struct(F.lit(k).alias("length"), shift.bitwiseAND(F.lit((1 << (_BITS * k)) - 1)).alias("context")) for k in range(order + 1)
    ])
    rows = grams.select(F.explode(suffixes).alias("c"), F.col("gram").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("symbol"), "n")
    return rows.groupBy("c.length", "c.context", "symbol").agg(F.sum("n").alias("n"))


ORDER_LIMIT = 6  # symbols of nine bits that a packed context can hold beside its length


def _key(length: int | Column, context: Column) -> Column:
    """A context with its length in one number."""
    return F.shiftleft((F.lit(length) if isinstance(length, int) else length).cast("long"), _BITS * ORDER_LIMIT).bitwiseOR(context)


@dataclass
class Model:
    """The trie as a staged table ``key, total, seen``; ``seen`` are the at most 257 symbols after the context, with counts.

    ``hot`` are ``HOT_GRAMS`` grams at most, sorted, and ``costs`` their log10 probabilities.
    """

    order: int
    table: DataFrame
    hot: np.ndarray
    costs: np.ndarray
    last: float  # log10 probability of a symbol that no context has

    @staticmethod
    def of(texts: DataFrame, order: int = ORDER) -> Model:
        """From all rows of ``texts`` (a column ``text``)."""
        grams = _gram_counts(texts, order)
        rows = _context_rows(grams, order)
        table = stage(rows.groupBy(_key(F.col("length"), F.col("context")).alias("key")).agg(
            F.sum("n").alias("total"), F.collect_list(F.struct(F.col("symbol").cast("short").alias("symbol"), "n")).alias("seen")
        ), "ppm-model")
        least = _least_of_most(grams, "n", HOT_GRAMS)
        frequent = grams.filter(F.col("n") >= least).withColumn("key", _key(order, F.shiftright("gram", _BITS)))
        priced = frequent.join(table.withColumn("distinct", F.size("seen")).drop("seen"), "key")
        # HOT_GRAMS rows of two numbers
        hot = priced.select("gram", (F.log10("n") - F.log10(F.col("total") + F.col("distinct"))).alias("cost")).toArrow()
        by = np.argsort(hot.column("gram").to_numpy())
        root = table.filter("key = 0").select(F.size("seen")).first()
        last = -math.log10(max(EDGE + 1 - (root[0] if root else 0), 1))
        return Model(order, table, hot.column("gram").to_numpy()[by], hot.column("cost").to_numpy()[by], last)

    def priced(self, grams: DataFrame) -> DataFrame:
        """``gram, cost`` of every row of a table of different grams."""
        context, symbol = F.shiftright("gram", _BITS), F.col("gram").bitwiseAND(F.lit((1 << _BITS) - 1)).cast("short")
        none = F.lit(None).cast("array<struct<symbol:smallint,n:bigint>>")
        left = grams.select("gram", symbol.alias("symbol"), context.alias("context"), F.lit(0.0).alias("paid"), none.alias("longer"))
        done: list[DataFrame] = []
        known, hit = F.col("seen").isNotNull(), F.col("count").isNotNull()
        escape = F.when(known & (F.col("more") > 0), F.log10("more") - F.log10("below")).otherwise(0.0)
        for k in range(self.order, -1, -1):
            lowest, highest = k << (_BITS * ORDER_LIMIT), (k + 1) << (_BITS * ORDER_LIMIT)
            own = self.table.filter((F.col("key") >= lowest) & (F.col("key") < highest))
            own = F.broadcast(own) if k <= 1 else own  # at most 258 rows of 257 symbols
            joined = left.withColumn("key", _key(k, F.col("context").bitwiseAND(F.lit((1 << (_BITS * k)) - 1)))).join(own, "key", "left")
            asked = stage(joined.select("*", *self._step()).drop("key", "total"), "asked")  # fewer with every level
            done.append(asked.filter(hit).select("gram", (F.col("paid") + F.log10("count") - F.log10("below")).alias("cost")))
            left = asked.filter(~hit).select(
                "gram", "symbol", "context", (F.col("paid") + escape).alias("paid"), F.coalesce("seen", "longer").alias("longer")
            )
        done.append(left.select("gram", (F.col("paid") + self.last).alias("cost")))
        return reduce(DataFrame.union, done)

    @staticmethod
    def _step() -> list[Column]:
        """Of a gram's row joined with a context: the symbol's count there, what counts below the line, and what is for an escape.

        Behind a longer context, its symbols are left out of both.
        """
        def counts(values: Column) -> Column:
            return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v["n"])

        count = F.get(F.filter("seen", lambda v: v["symbol"] == F.col("symbol")), 0)["n"]
        excluded = F.filter("seen", lambda v: F.exists(F.col("longer"), lambda x: x["symbol"] == v["symbol"]))
        behind = F.col("longer").isNotNull()
        more = F.size("seen") - F.when(behind, F.size("longer")).otherwise(0)
        rest = F.col("total") - F.when(behind, counts(excluded)).otherwise(0)
        return [count.alias("count"), more.alias("more"), (rest + more).alias("below")]


# --- scores -------------------------------------------------------------------------


def score(documents: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``training`` has a column ``text``.  A null or empty text has the end token alone.
    Repeated rows and equal or null ids each give a row.  Without training texts every
    symbol costs the same and no token is known.  An empty table gives no rows.  Other
    columns are not read.
    """
    spark = documents.sparkSession
    model = Model.of(training, order)
    words = _word_counts(training)
    n_texts = training.count()
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all = total + n_texts  # every training text has an end token
    below = n_all + 0.1 * (distinct + (n_texts > 0) + 1)
    short = words.filter(F.octet_length("word") <= HOT_BYTES)
    hot = short.filter(F.col("n") >= _least_of_most(short, "n", HOT)).toPandas()
    known_words = {bytes(w): math.log10((n + 0.1) / below) for w, n in zip(hot["word"], hot["n"], strict=True)}
    sent = spark.sparkContext.broadcast((model.hot, model.costs, known_words))
    end = math.log10((n_texts + 0.1) / below)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_grams, costs, known = sent.value
        for batch in batches:
            texts = batch.column(2)
            scores, rare = np.zeros(len(texts)), [[] for _ in range(len(texts))]
            for a, b, data, bounds in blocks(texts, 1 << 20):
                scores[a:b], row, gram, n = _hot_scores(data, bounds, order, hot_grams, costs)
                for r, g, m in zip((row + a).tolist(), gram.tolist(), n.tolist(), strict=True):
                    rare[r].append((g, m))
            n_tokens, n_known, base, rest = [], [], [], []
            for value in texts:
                counts = Counter((value.as_py() or "").encode().lower().split())
                have, sums, other = int(n_texts > 0), end, []
                for word, n in counts.items():
                    cost = known.get(word)
                    if cost is None:
                        other.append((word, n))
                    else:
                        have += n
                        sums += n * cost
                n_tokens.append(counts.total() + 1)
                n_known.append(have)
                base.append(sums)
                rest.append(other)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_tokens, n_known)), pa.array(base, pa.float64()), pa.array(scores),
                _pairs(rest, "word", pa.binary()), _pairs(rare, "gram", pa.int64()),
            ], names=["_row", "doc_id", "n_tokens", "n_known", "base", "score", "rest", "rare"])

    id_type = documents.schema[doc_id].dataType.simpleString()
    picked = documents.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = stage(picked.mapInArrow(
        scan, f"_row long, doc_id {id_type}, n_tokens long, n_known long, base double, score double, "
        "rest array<struct<word:binary,n:long>>, rare array<struct<gram:long,n:long>>"
    ), "scores")
    cost = F.log10((F.coalesce("total", F.lit(0)) + 0.1) / below)
    others = (
        scanned.select("_row", F.explode("rest").alias("r")).select("_row", "r.word", "r.n")
        .join(words.withColumnRenamed("n", "total"), "word", "left")
        .groupBy("_row").agg(F.sum(F.col("n") * cost).alias("more"), F.sum(F.when(F.col("total").isNotNull(), F.col("n"))).alias("found"))
    )
    rare = scanned.select("_row", F.explode("rare").alias("r")).select("_row", "r.gram", "r.n")
    prices = model.priced(rare.select("gram").distinct())
    grams = rare.join(prices, "gram").groupBy("_row").agg(F.sum(F.col("n") * F.col("cost")).alias("rest_score"))
    return scanned.drop("rest", "rare").join(others, "_row", "left").join(grams, "_row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"),
    )


def _pairs(rows: list[list[tuple]], name: str, kind: pa.DataType) -> pa.Array:
    """A list column of (name, n) pairs."""
    ends = np.cumsum([0] + [len(r) for r in rows])
    flat = [x for r in rows for x in r]
    values = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], kind), pa.array([x[1] for x in flat], pa.int64())], [name, "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _hot_scores(
    data: np.ndarray, bounds: np.ndarray, order: int, hot: np.ndarray, costs: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the costs of the hot grams of every text of a block; and row, gram and count of all others."""
    found = grams(*_symbols(data, bounds, order), order)
    ends = np.cumsum(np.diff(bounds) + 1)
    if len(hot):
        at, known = _search(hot, found)
        own = np.where(known, costs[at], 0.0)
    else:
        known, own = np.zeros(len(found), bool), np.zeros(len(found))
    sums = np.concatenate(([0.0], np.cumsum(own)))
    scores = sums[ends] - sums[np.concatenate(([0], ends[:-1]))] if len(ends) else np.zeros(0)
    others = np.flatnonzero(~known)
    row, gram = np.searchsorted(ends, others, "right"), found[others]
    by = np.lexsort((gram, row))
    row, gram = row[by], gram[by]
    heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])))) if len(row) else by
    return scores, row[heads], gram[heads], np.diff(np.append(heads, len(row)))


def _search(have: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among sorted ones, and which are there."""
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return at, have[at] == keys


def digest_rows(documents: DataFrame) -> DataFrame:
    """The contract's columns, learned from the documents that are not held out."""
    held_out = crc_mod("doc_id", 10) == 0
    scored = score(documents.select(F.struct("doc_id", held_out.alias("held_out")).alias("own"), "text"), documents.filter(~held_out), "own")
    return scored.select("doc_id.doc_id", "doc_id.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
