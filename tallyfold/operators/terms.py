"""Word counts, term frequency, and the top document of every word.

Documents come in two shapes.  When every document is one row (a table of
texts, or whole files), all that concerns one document is worked out inside its
row: term frequency then needs no shuffle at all, and only the last step, per
word, moves data, already reduced to one row per word and task.  When a document
is spread over many rows (lines of a file), its words are counted with a shuffle
on (document, word), which splits a huge document over all tasks.

``one_row_per_doc=True`` says that every document is one row.  It is for tables
whose document column is a declared key: with repeated documents the result would be
wrong.  The default is right for either shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_text, tokens

# Names that the steps below use themselves; a document column is renamed on entry.
_DOC = "_document"


# Totals of a document: how many distinct words, or how many words.
NORMS = {"distinct": "_terms", "total": "_tokens"}


def cut_rows(df: DataFrame, text: str, size: int = 1 << 20, tasks: int | None = None) -> DataFrame:
    """The rows with their texts cut between words into parts of at most ``size`` characters, a row each.

    For texts of any length: what comes after holds the words of one part at a time, and
    with ``tasks`` the parts of one row are dealt out over that many tasks.  Words are the
    same as before, so everything here that takes many rows per document can follow, but
    for rows without a word, which are not told apart any more.  Rows with a NULL text go.
    """
    others = [c for c in df.columns if c != text]
    parts = df.select(*others, F.posexplode(cut_text(text, size)).alias("_part", text))
    if tasks is not None:
        parts = parts.repartition(tasks, *[c for c in others if "map<" not in df.schema[c].dataType.simpleString()], "_part")
    return parts.select(*df.columns)


def _counts_within_rows(df: DataFrame, doc: str, text: str, total: str | None = None) -> DataFrame:
    """(doc, word, n) of one-row documents and the wanted total, without a shuffle.

    The words of a row are sorted, so equal words stand together: a word's count
    is the distance from its first position to the first position of the next.
    """
    words = df.select(F.col(doc), F.sort_array(tokens(text)).alias("_words"))
    # An empty token sorts first and stands alone, in a text without letters: such a
    # text has no starts.  (A filter on the words would be pushed below the sort and
    # tokenize every text twice.)
    starts = words.select(
        doc,
        "_words",
        F.filter(
            F.sequence(F.lit(0), F.size("_words") - 1),
            lambda i: F.get("_words", i) != F.when(i > 0, F.get("_words", i - 1)).otherwise(""),
        ).alias("_starts"),
    )
    # The total travels inside the entries: a column that is kept beside an explode is
    # copied for every exploded row, and these arrays are as long as the document.
    totals = {"_terms": F.size("_starts"), "_tokens": F.size("_words")}
    entries = F.transform(
        F.col("_starts"),
        lambda start, k: F.struct(
            F.get("_words", start).alias("word"),
            (F.coalesce(F.get("_starts", k + 1), F.size("_words")) - start).alias("n"),
            *([totals[total].alias(total)] if total else []),
        ),
    )
    exploded = starts.select(doc, F.explode(entries).alias("_entry"))
    numbers = ["n"] + ([total] if total else [])
    return exploded.select(doc, "_entry.word", *[F.col(f"_entry.{c}").cast("long").alias(c) for c in numbers])


def _counts_across_rows(df: DataFrame, doc: str, text: str) -> DataFrame:
    words = df.select(F.col(doc), F.explode(tokens(text)).alias("word")).where("word <> ''")
    return words.groupBy(doc, "word").agg(F.count(F.lit(1)).alias("n"))


def _own(df: DataFrame, doc: str, text: str, result: list[str]) -> DataFrame:
    """The document column under a name of ours, and the text."""
    if doc in result:
        raise ValueError(f"a document column named {doc!r} clashes with the result's; rename it")
    return df.select(F.col(doc).alias(_DOC), F.col(text).alias("_text"))


def _counts_with_total(
    df: DataFrame, doc: str, text: str, total: str, one_row_per_doc: bool, hot_share: int | None
) -> DataFrame:
    if one_row_per_doc:
        return _counts_within_rows(df, doc, text, total)
    counts = _counts_across_rows(df, doc, text)
    # Both totals read n, so this branch has the same shuffle as `counts` and reuses it.
    totals = counts.groupBy(F.col(doc).alias("_doc")).agg(
        F.count_if(F.col("n") > 0).alias("_terms"),
        F.sum("n").alias("_tokens"),
    )
    return _attach_totals(counts, totals, doc, hot_share)


def _attach_totals(counts: DataFrame, totals: DataFrame, doc: str, hot_share: int | None) -> DataFrame:
    """Join every (doc, word, n) row with its document's totals, skewed or not.

    A document with more than one in ``hot_share`` of all rows is hot.  There are
    fewer than ``hot_share`` of those by arithmetic, so their totals are broadcast;
    in the shuffle join with the other totals their rows are dealt out by word
    instead of all meeting at one document's task.  Without a number it is twice the
    shuffle partitions: no task then gets much more than half of the mean from one
    document.
    """
    if hot_share is None:
        hot_share = 2 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = totals.agg(F.sum("_terms").alias("_all"))
    hot = totals.crossJoin(F.broadcast(whole)).where(F.col("_terms") * hot_share > F.col("_all"))
    hot = hot.select(
        F.col("_doc").alias("_hot_doc"), F.col("_terms").alias("_hot_terms"), F.col("_tokens").alias("_hot_tokens")
    )

    def place(column: str) -> Column:
        return F.pmod(F.hash(column), F.lit(hot_share))

    flagged = counts.join(F.broadcast(hot), F.col(doc).eqNullSafe(F.col("_hot_doc")), "left")
    is_hot = F.col("_hot_terms").isNotNull()
    flagged = flagged.withColumn("_place", F.when(is_hot, place("word")).otherwise(place(doc)))
    placed = totals.withColumn("_doc_place", place("_doc"))
    # Null-safe on both: a plain equality would add an "is not null" filter below the
    # totals, and their shuffle would no longer be the one that `counts` has.
    same_doc = F.col(doc).eqNullSafe(F.col("_doc")) & F.col("_place").eqNullSafe(F.col("_doc_place"))
    return flagged.join(placed, same_doc, "left").select(
        doc,
        "word",
        "n",
        F.coalesce("_hot_terms", "_terms").alias("_terms"),
        F.coalesce("_hot_tokens", "_tokens").alias("_tokens"),
    )


def word_counts(df: DataFrame, text: str, keep_blank: bool = False) -> DataFrame:
    """Occurrences of every word of a corpus: (word, n).

    ``keep_blank`` counts every row without a word as one empty word.
    """
    words = df.select(F.explode(tokens(text)).alias("word"))
    if not keep_blank:
        words = words.where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def doc_word_counts(df: DataFrame, doc: str, text: str, one_row_per_doc: bool = False) -> DataFrame:
    """Occurrences of every word in every document: (doc, word, n)."""
    own = _own(df, doc, text, ["word", "n"])
    counted = _counts_within_rows(own, _DOC, "_text") if one_row_per_doc else _counts_across_rows(own, _DOC, "_text")
    return counted.select(F.col(_DOC).alias(doc), "word", "n")


def _scored(df: DataFrame, doc: str, text: str, norm: str, one_row_per_doc: bool, hot_share: int | None, result: list[str]) -> DataFrame:
    if norm not in NORMS:
        raise ValueError(f"norm must be one of {sorted(NORMS)}, not {norm!r}")
    counts = _counts_with_total(_own(df, doc, text, result), _DOC, "_text", NORMS[norm], one_row_per_doc, hot_share)
    tf = F.col("n").cast("double") / F.col(NORMS[norm]).cast("double")
    return counts.select(_DOC, "word", "n", tf.alias("tf"))


def term_frequency(
    df: DataFrame, doc: str, text: str, norm: str = "distinct", one_row_per_doc: bool = False, hot_share: int | None = None
) -> DataFrame:
    """(doc, word, n, tf): a word's count over the document's number of distinct
    words, or with ``norm='total'`` over its number of words."""
    scored = _scored(df, doc, text, norm, one_row_per_doc, hot_share, ["word", "n", "tf"])
    return scored.select(F.col(_DOC).alias(doc), "word", "n", "tf")


def max_tf(
    df: DataFrame, doc: str, text: str, norm: str = "distinct", one_row_per_doc: bool = False, hot_share: int | None = None
) -> DataFrame:
    """Per word, the number of documents with it and the document where its term
    frequency is highest, ties by document: (word, docs, doc, tf).

    Least (-tf, doc) is the highest frequency in the first document.  It is
    aggregated before the shuffle, so the commonest word sends one row per task
    and no word's documents are ever brought together.  A pair has no fixed width,
    so the plan sorts each task's rows by word; the sort spills like any other.
    """
    scored = _scored(df, doc, text, norm, one_row_per_doc, hot_share, ["word", "docs", "tf"])
    best = F.min(F.struct((-F.col("tf")).alias("neg_tf"), F.col(_DOC)))
    per_word = scored.groupBy("word").agg(F.count(F.lit(1)).alias("docs"), best.alias("_best"))
    return per_word.select(
        "word", "docs", F.col("_best").getField(_DOC).alias(doc), (-F.col("_best.neg_tf")).alias("tf")
    )
