"""Personal data: patterns, and information-theoretic sanitisation of what stands beside them.

DataFrame functions only: no Python in tasks.

*Base spans* are e-mail addresses, IP addresses, card and phone numbers, found by linear
patterns: the contract's expressions with look-arounds in place of nested repeats, so
that no text makes them backtrack or recurse.

*Terms* are words of three letters or more.  The value of a base span is a protected
entity e.  Over all distinct texts, p(e) is its share of texts, p(t) a term's, and p(e, t)
the share of texts that hold t within ``REACH`` characters of e.  A term discloses e by
their pointwise mutual information; where that reaches ``DISCLOSURE`` times the
information content of e itself (-log p(e)), reading t tells as good as all about e, and t
is generalised wherever it stands.  Pairs in fewer than ``SUPPORT`` texts are no evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, let, part, running_maxima, running_sums
from .common import stage
from .keys import possible, split_by_slot

REACH = 60
SUPPORT = 5
DISCLOSURE = 0.95

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}+@{_HOST}++\.(?={_HOST})(?:(?!\.(?!{_HOST}))[A-Za-z0-9.-])++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"(?<!\p{L})\p{L}{3,64}+(?!\p{L})"
WORDS = r"\p{L}++"

_FOUND = "array<struct<kind:string,start:int,end:int,value:string>>"
_SPANS = "array<struct<kind:string,start:int,end:int>>"
KINDS = ["email", "ip", "card", "phone", "term"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_part(part: Column) -> Column:
    part = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(part) <= 3) & (part.cast("int") <= 255)


def _valid_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), _small_part)


def _valid_card(value: Column) -> Column:
    return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))


def _valid_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


_BASE: list[tuple[str, str, str, Callable[[Column], Column]]] = [
    ("email", "@", EMAIL, lambda value: F.lit(True)),
    ("ip", ".", IP, _valid_ip),
    ("card", "", CARD, _valid_card),
    ("phone", "+", PHONE, _valid_phone),
]


def _occurrences(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Spans of all valid matches: the pieces between matches give the places."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(gaps, values, lambda gap, value: F.struct(
        F.length(gap).alias("gap"), F.coalesce(F.length(value), F.lit(0)).alias("size"), value.alias("value")))

    def placed(pieces: Column) -> Column:
        before = running_sums(F.transform(pieces, lambda p: p["gap"] + p["size"]))
        spans = F.zip_with(pieces, before, lambda p, at: F.struct(
            F.lit(kind).alias("kind"), (at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["value"].alias("value")))
        return F.filter(spans, lambda s: s["value"].isNotNull() & valid(s["value"]))

    return let(pieces, placed)


def base_spans(text: str) -> Column:
    """All base spans of a text column by kind, then start; nothing is searched for without its sign or a digit."""
    text = F.col(text)
    found = [
        F.when(text.contains(sign) & (text.rlike("[0-9]") if kind != "email" else F.lit(True)) & text.rlike(pattern),
               _occurrences(text, kind, pattern, valid)).otherwise(F.array().cast(_FOUND))
        for kind, sign, pattern, valid in _BASE
    ]
    return F.concat(*found)


def _entity(span: Column) -> Column:
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), plain)


def _beside(cut: Column, span: Column) -> Column:
    """Whole terms within reach of a span, of a text cut into chunks.

    What is left of a word that the reach or the span cuts through is no word and left out.
    """
    start, end = span["start"], span["end"]
    before = part(cut, start - REACH - 1, start)
    after = part(cut, end, end + REACH + 1)
    before = F.when(start > REACH, F.regexp_replace(before, r"^\p{L}+", "")).otherwise(before)
    before = F.when(span["value"].rlike(r"^\p{L}"), F.regexp_replace(before, r"(?<!\p{L})\p{L}++$", "")).otherwise(before)
    after = F.when(F.length(after) > REACH, F.regexp_replace(after, r"(?<!\p{L})\p{L}++$", "")).otherwise(after)
    after = F.when(span["value"].rlike(r"\p{L}$"), F.regexp_replace(after, r"^\p{L}+", "")).otherwise(after)
    return F.regexp_extract_all(F.lower(F.concat(before, F.lit("\n"), after)), F.lit(TERM), F.lit(0))


def _text_rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def _find_base(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Staged ``doc_id, text_hash, base, entities`` of every row."""
    rows = _text_rows(documents, doc_id, text).withColumn("found", base_spans("text"))
    return stage(rows.select(
        "doc_id", "text_hash",
        F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("base"),
        F.when(F.size("found") > 0, let(chunks(F.col("text")), lambda cut: F.transform(
            "found", lambda s: F.struct(_entity(s).alias("entity"), _beside(cut, s).alias("terms"))
        ))).otherwise(F.array().cast("array<struct<entity:string,terms:array<string>>>")).alias("entities"),
    ), "base-spans")


def _mutual(total: float, n_term: Column) -> Column:
    return F.log2(F.lit(total) * F.col("n_both") / (F.col("n_entity") * n_term))


def disclosing_terms(found: DataFrame, documents: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``term, entity, disclosure`` of pairs beyond the threshold, and ``text_hash, term`` of texts with candidates."""
    total = float(found.select("text_hash").distinct().count())
    content = F.log2(F.lit(total) / F.col("n_entity"))
    seen = found.select("text_hash", F.explode("entities").alias("e")).select("text_hash", "e.entity", "e.terms")
    texts = seen.groupBy("entity").agg(F.count_distinct("text_hash").alias("n_entity"))
    near = seen.select("text_hash", "entity", F.explode("terms").alias("term"))
    beside = near.groupBy("term").agg(F.count_distinct("text_hash").alias("n_beside"))
    both = near.groupBy("entity", "term").agg(F.count_distinct("text_hash").alias("n_both")).filter(F.col("n_both") >= SUPPORT)
    # whole terms stand in no fewer texts than those that have them beside some entity, so a
    # pair that would fail with so few fails; this leaves out the words that stand beside all
    able = _mutual(total, F.col("n_beside")) >= DISCLOSURE * content
    pairs = stage(both.join(texts, "entity").join(beside, "term").filter((content > 0) & able), "disclosure-pairs")
    candidates = stage(pairs.select("term").distinct(), "candidate-terms")
    words = documents.select(
        F.xxhash64(F.col(text).cast("string")).alias("text_hash"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(TERM), F.lit(0)))).alias("term"),
    )
    # only words that may be candidates are moved
    likely = possible(words, [F.col("term")], candidates)
    holders = stage(likely.join(candidates, "term").select("text_hash", "term").distinct(), "term-holders")
    n_term = holders.groupBy("term").agg(F.count("*").alias("n_term"))
    beyond = pairs.join(n_term, "term").select("term", "entity", (_mutual(total, F.col("n_term")) / content).alias("disclosure"))
    return beyond.filter(F.col("disclosure") >= DISCLOSURE), holders


def _term_sets(found: DataFrame, documents: DataFrame, text: str) -> DataFrame:
    """Staged ``text_hash, terms``: what is to be generalised in which text."""
    beyond, holders = disclosing_terms(found, documents, text)
    risky = stage(beyond.select("term").distinct(), "risky-terms")
    return stage(holders.join(risky, "term").groupBy("text_hash").agg(F.collect_set("term").alias("terms")), "term-sets")


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Spans of the words among ``terms`` that touch no base span."""
    def apart(chosen: Column) -> Column:
        # words at their ends and base spans at their starts in one order, words first: a word
        # is free if no base span that starts before its end reaches beyond its start
        marks = F.sort_array(F.concat(
            F.transform(chosen, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("base"), s["start"].alias("other"))),
            F.transform(base, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("base"), s["end"].alias("other"))),
        ))

        def free(marks: Column) -> Column:
            reach = running_maxima(F.transform(marks, lambda m: F.when(m["base"] == 1, m["other"]).otherwise(0)))
            marked = F.zip_with(marks, reach, lambda m, r: F.struct(m["at"].alias("end"), m["base"].alias("base"), m["other"].alias("start"), r.alias("reach")))
            words = F.filter(marked, lambda m: (m["base"] == 0) & (m["reach"] <= m["start"]))
            return F.transform(words, lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

        return let(marks, free)

    chosen = _occurrences(text, "term", WORDS, lambda word: F.array_contains(terms, F.lower(word)))
    return F.when(terms.isNotNull(), let(chosen, apart)).otherwise(F.array().cast(_SPANS))


def _keyed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, terms`` of every row: arrays of ``kind, start, end`` in code points, end exclusive.

    A null or empty text has no span.  Repeated rows and equal or null ids each give a
    row.  Equal texts are one piece of evidence, however many rows hold them.  Spans of
    different kinds may overlap; those of terms touch no base span.  Empty tables give no
    rows.  Other columns are not read.
    """
    found = _find_base(documents, doc_id, text)
    sets = _term_sets(found, documents, text)
    rows = possible(_text_rows(documents, doc_id, text).select("text_hash", "text"), [F.col("text_hash")], sets.select("text_hash"))
    risky = rows.groupBy("text_hash").agg(F.first("text").alias("text")).join(sets, "text_hash")  # a text once, however many copies
    spans = risky.select("text_hash", "text", F.col("terms").alias("words")).withColumn("base", base_spans("text")).select(
        "text_hash", _term_spans(F.col("text"), F.col("words"), F.col("base")).alias("terms")
    )
    return found.drop("entities").join(stage(spans, "term-spans"), "text_hash", "left").select(
        "doc_id", "base", F.coalesce("terms", F.array().cast(_SPANS)).alias("terms")
    )


def digest_rows(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:4]]
    return personal_data(documents).select(
        "doc_id", *counts, F.sha2(_keyed(F.col("base")), 256).alias("base_sha256"), _keyed(F.concat("base", "terms")).alias("spans")
    )


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by the name of its first span's kind."""
    def joined(ordered: Column) -> Column:
        reach = running_maxima(F.transform(ordered, lambda s: s["end"]))
        last = F.array_max(F.transform(ordered, lambda s: s["end"]))

        def of(cut: Column) -> Column:
            pieces = F.zip_with(ordered, reach, lambda s, at: F.when(
                s["start"] >= at, F.concat(part(cut, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
            return F.concat(F.array_join(pieces, ""), part(cut, last, F.length(text)))

        return let(chunks(text), of)

    return let(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"]))), joined)


def sanitise(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with personal data replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` and ``[TERM]``.

    Columns as they came; a text without a span is left as it is, null included.  Texts
    without terms to generalise are not moved; those that may have some are joined with
    them by the hash of the text, where Spark splits the copies of a frequent one.
    """
    sets = _term_sets(_find_base(documents, doc_id, text), documents, text)
    own = [F.xxhash64(F.col(text).cast("string"))]
    sure, unsure = split_by_slot(documents, own, sets.select("text_hash"))
    rows = unsure.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), own[0].alias("text_hash"))
    none = F.lit(None).cast("array<string>").alias("terms")
    alone = sure.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), none)
    joined = alone.union(rows.join(sets, "text_hash", "left").select("row", "text", "terms")).withColumn("found", base_spans("text"))
    base = F.transform("found", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    spans = joined.withColumn("spans", F.concat(base, _term_spans(F.col("text"), F.col("terms"), F.col("found"))))
    clean = F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return spans.select(*[(clean.alias(c) if c == text else F.col("row")[c].alias(c)) for c in documents.columns])
