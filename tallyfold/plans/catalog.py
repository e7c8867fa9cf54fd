"""The registered queries: every operator over the given tables.

Operators run straight on the tables.  The ``job_*`` queries write a whole table
as the text a job expects, into the session's shared folder, and run the job on
that folder, so the text sources and sinks do real work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import flatten_lines, layout, tokens, unpack
from ..session import TEXT_PARTITIONS_KEY, new_path, until_exit
from ..sinks import key_ranges, read_range, write_lines, write_pairs, write_ranges
from ..sources import (
    read_delimited,
    read_file_pieces,
    read_lines,
    read_pairs,
    read_setting_aside,
    read_whole_files,
)
from ..stages import Stages
from . import jobs

MONEY = 2  # places after the point of the money columns
PIECE_BYTES = 1 << 16  # of files that are read in pieces: small, so that small tables have several too
ORDERED_FILES = 16  # of folders in key order
LINES_PER_FILE = 200_000  # of files that are read whole: a few megabytes per cell, and no swarm of files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Texts where they are read, or dealt out over as many tasks as the session asks for.

    Dealing out is for tables in few unsplittable files and costs a shuffle of the texts,
    so it is the caller's choice (``TEXT_PARTITIONS_KEY``) and never guessed.
    """
    documents = table(spark, sf_dir, "documents").select(*columns)
    asked = spark.conf.get(TEXT_PARTITIONS_KEY, None)
    return documents.repartition(int(asked)) if asked else documents


# --- aggregates -------------------------------------------------------------------


def mean_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mean_by(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "avg_balance", scale=MONEY)


def count_sum_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return ops.count_sum_by(orders, "o_orderpriority", "o_totalprice", "orders", "total_price", scale=MONEY)


def max_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_by_key(table(spark, sf_dir, "events"), "event_type", "value", "max_value")


def max_by_key_floor0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_by_key(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal", "max_balance", floor=0)


def sums_by_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return ops.sums_by(
        table(spark, sf_dir, "lineitem"),
        ["l_suppkey", "l_linestatus"],
        {
            "gold": F.when(flag == "A", 1).otherwise(0),
            "silver": F.when(flag == "N", 1).otherwise(0),
            "bronze": F.when(flag == "R", 1).otherwise(0),
        },
    )


def global_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.argmax(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


def max_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_by_key(table(spark, sf_dir, "part"), "p_brand", "p_size", "max_size")


def signed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.signed_ratio_by(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", "score", scale=MONEY)


def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of doubles of both signs whose sizes differ by up to 2 ** 24: the order of a plain sum would show."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("double")
    size = F.element_at(F.array(*[F.lit(16.0**i) for i in range(7)]), F.col("l_linenumber").cast("int"))
    value = cents * size * F.when(F.col("l_orderkey") % 2 == 0, 1.0).otherwise(-1.0)
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", value.alias("value"))
    return ops.exact_sums_by(lines, "l_suppkey", "value", "total", count_name="n", mean_name="mean")


# --- normalization, filter, sets ---------------------------------------------------


def min_max_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.min_max_normalize(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


def normalize_one_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.min_max_normalize(
        table(spark, sf_dir, "part"), "p_name", "p_retailprice",
        one_per_key=True, order_by="p_partkey", order_is_unique=True,
    )


def compound_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return ops.keep_unless(orders, "o_orderstatus", "P", "o_orderpriority", "1-URGENT")


def compound_filter_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL in either column: it is neither the unwanted value nor the exempt one."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"),
        F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("priority"))
    return ops.keep_unless(orders, "status", "P", "priority", "1-URGENT")


def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    return ops.symmetric_difference(orders, lines, "orderkey")


def tagged_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tagged_difference(ops.split_tagged(_two_kinds_of_lines(spark, sf_dir)), "id", "side")


def stored_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sets are stored in buckets once; the comparison itself moves nothing."""
    names = []
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        path = new_path(spark, f"stored-{name}")
        names.append(f"stored_{path[-32:]}")
        ops.store_keys(table(spark, sf_dir, name).select(F.col(key).alias("orderkey")), "orderkey", names[-1], path, buckets=8)
        until_exit(spark, path)
    return ops.difference_of_stored(spark, *names, "orderkey")


# --- text -------------------------------------------------------------------------


def flatten_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", flatten_lines("text").alias("content"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.word_counts(_documents(spark, sf_dir, "text"), "text")


def doc_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` is the key of its table, here and below: one row per document."""
    return ops.doc_word_counts(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", one_row_per_doc=True)


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.term_frequency(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", one_row_per_doc=True)


def term_frequency_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.term_frequency(
        _documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", norm="total", one_row_per_doc=True)


def max_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_tf(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", one_row_per_doc=True)


def max_tf_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_tf(
        _documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", norm="total", one_row_per_doc=True)


def max_tf_many_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of one source are one document: many rows per document."""
    return ops.max_tf(_documents(spark, sf_dir, "source", "text"), "source", "text")


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_n(word_counts(spark, sf_dir), "n", 10, ties="word")


def word_counts_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into parts between words first, as for texts of any length."""
    return ops.word_counts(ops.cut_rows(_documents(spark, sf_dir, "text"), "text", 500), "text")


def max_tf_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.max_tf(ops.cut_rows(_documents(spark, sf_dir, "source", "text"), "text", 2000), "source", "text")


def top_words_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``top_words`` by a sketch of all words and exact counts of a few."""
    words = _documents(spark, sf_dir, "text").select(F.explode(tokens("text")).alias("word")).where("word <> ''")
    return ops.top_counts(words, "word", 10, "n").rows.select("word", "n")


def staged_max_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, frequencies and maxima as three written stages, each freed when the next is written."""
    with Stages(spark) as stages:
        counts = stages.write(ops.doc_word_counts(_documents(spark, sf_dir, "source", "text"), "source", "text"), "word-counts", readers=2)
        sizes = stages.derive("sizes", lambda c: c.groupBy("source").agg(F.count("*").alias("terms")), counts)
        tf = stages.derive(
            "frequencies",
            # a document is a source here, so the sizes are few; the general form is ops.max_tf
            lambda c, s: c.join(s.withColumnRenamed("source", "_doc"), F.col("source").eqNullSafe(F.col("_doc")))
            .select("word", "source", (F.col("n").cast("double") / F.col("terms").cast("double")).alias("tf")),
            counts, sizes,
        )
        best = F.min(F.struct((-F.col("tf")).alias("neg"), "source"))
        top = stages.derive("maxima", lambda t: t.groupBy("word").agg(F.count("*").alias("docs"), best.alias("best")), tf)
        return stages.result(top).select("word", "docs", "best.source", (-F.col("best.neg")).alias("tf"))


def top_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_distinct_counts(word_counts(spark, sf_dir), "n", "word", 500)


def unpack_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "#", ["prefix", "number"])


def composite_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed line layouts: fields, an empty field, and two values in one."""
    sums = sums_by_composite_key(spark, sf_dir)
    line = layout(",", "l_suppkey", "l_linestatus", F.lit(""), layout(" ", "gold", "silver"), "bronze")
    return sums.select(line.alias("line"))


# --- written and read back ----------------------------------------------------------


def _write_text(spark: SparkSession, lines: DataFrame, label: str, max_lines_per_file: int = 0) -> str:
    path = new_path(spark, label)
    write_lines(lines, path, max_lines_per_file)
    return until_exit(spark, path)


def _two_kinds_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        layout(" ", F.concat(F.lit("O"), F.col("o_orderkey")), "o_custkey").alias("value"))
    items = table(spark, sf_dir, "lineitem").select(
        layout(" ", "l_linenumber", F.concat(F.lit("O"), F.col("l_orderkey"))).alias("value"))
    return orders.unionByName(items)


def pairs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage written as tab-separated pairs in key order, and read by the next."""
    counts = ops.count_sum_by(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "orders", "total_price",
                              scale=MONEY)
    path = new_path(spark, "pairs")
    write_pairs(counts, path, keys="o_custkey", fmt="tsv")
    return read_pairs(spark, until_exit(spark, path), "o_custkey BIGINT, orders BIGINT, total_price DOUBLE")


def quoted_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted CSV with a header in every file: the quotes are stripped."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(", ", "p_name", "p_brand").alias("label"), "p_size")
    path = new_path(spark, "quoted")
    write_pairs(parts, path, fmt="csv", header=True)
    return read_delimited(spark, until_exit(spark, path), "p_partkey BIGINT, label STRING, p_size INT", quoted=True)


def bad_rows_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text where finished orders have an unparsable price and pending
    ones no price at all: only the rest is read."""
    price = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x"), F.col("o_totalprice").cast("string")))
             .when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_totalprice").cast("string")))
    lines = table(spark, sf_dir, "orders").select(layout(",", "o_orderkey", price).alias("value"))
    path = _write_text(spark, lines, "bad-rows")
    return read_delimited(spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE", header=False)


def line_scan_with_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "supplier").select(layout("\t", "s_suppkey", "s_name").alias("value"))
    scanned = read_lines(spark, _write_text(spark, lines, "lines"))
    return scanned.select("value", F.col("file_name").rlike(r"^part-.*\.txt$").alias("named_after_file"))


def whole_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in small files; every file is read whole and cut into lines again."""
    lines = table(spark, sf_dir, "customer").select(layout("\t", "c_custkey", "c_name").alias("value"))
    files = read_whole_files(spark, _write_text(spark, lines, "whole", LINES_PER_FILE))
    return files.select(F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")


def _hard_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with newlines, quotes, tabs and blanks around them, empty strings and NULLs."""
    key = F.col("doc_id") % 7
    text = (F.when(key == 0, F.concat(F.lit('  "'), "text", F.lit('"\t ')))
            .when(key == 1, F.lit("")).when(key == 2, F.lit(None)).otherwise(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang")


def texts_roundtrip_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "texts-tsv")
    write_pairs(_hard_texts(spark, sf_dir), path, keys="doc_id", fmt="tsv")
    return read_pairs(spark, until_exit(spark, path), "doc_id BIGINT, text STRING, lang STRING")


def texts_roundtrip_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the used columns decide about a row, so a NULL text does not drop it."""
    path = new_path(spark, "texts-csv")
    write_pairs(_hard_texts(spark, sf_dir).where("text IS NOT NULL"), path, fmt="csv", header=True)
    return read_delimited(
        spark, until_exit(spark, path), "doc_id BIGINT, text STRING, lang STRING", quoted=True, multiline=True)


def quoted_records_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with newlines, every file read by a task per piece."""
    path = new_path(spark, "records-csv")
    write_pairs(_hard_texts(spark, sf_dir).where("text IS NOT NULL"), path, fmt="csv", header=True)
    return read_delimited(
        spark, until_exit(spark, path), "doc_id BIGINT, text STRING, lang STRING", quoted=True, multiline=True, piece_bytes=PIECE_BYTES)


def pairs_records_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records-tsv")
    write_pairs(_hard_texts(spark, sf_dir), path, keys="doc_id", fmt="tsv")
    return read_pairs(spark, until_exit(spark, path), "doc_id BIGINT, text STRING, lang STRING", piece_bytes=PIECE_BYTES)


def file_pieces_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut anywhere between characters and joined again: their lines are whole."""
    lines = table(spark, sf_dir, "documents").select(layout("\t", "doc_id", "lang", F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    pieces = read_file_pieces(spark, _write_text(spark, lines, "pieces", 5000), PIECE_BYTES)
    whole = pieces.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "content"))).alias("parts"))  # a file of 5,000 lines
    content = F.array_join(F.transform("parts", lambda p: p["content"]), "")
    return whole.select(F.explode(F.split(content, "\n")).alias("line")).where("line <> ''")


def max_tf_file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are files of any size: cut between words where they are read."""
    path = new_path(spark, "languages")
    _documents(spark, sf_dir, "lang", "text").write.partitionBy("lang").text(path)
    pieces = read_file_pieces(spark, until_exit(spark, path), PIECE_BYTES, cut="words")
    return ops.max_tf(pieces.select(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang"), "content"), "lang", "content")


def rows_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by outcome, as they lie in the folders and as they were counted in the same pass."""
    price = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x"), F.col("o_totalprice").cast("string")))
             .when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_totalprice").cast("string")))
    lines = table(spark, sf_dir, "orders").select(layout(",", "o_orderkey", price).alias("value"))
    out = new_path(spark, "aside")
    found = read_setting_aside(spark, _write_text(spark, lines, "bad-rows"), "o_orderkey BIGINT, o_totalprice DOUBLE", out, header=False)
    until_exit(spark, out)
    stored = found.bad.groupBy("reason").agg(F.count("*").alias("n"), F.lit(None).cast("decimal(18,2)").alias("price")).union(
        found.good.agg(F.lit("good"), F.count("*"), F.sum(F.col("o_totalprice").cast("decimal(18,2)"))))
    counted = spark.createDataFrame(list(found.counts.items()), "reason STRING, counted BIGINT")  # a row per reason
    return stored.join(counted, "reason").select("reason", "n", "counted", F.col("price").cast("double").alias("price"))


def overwrite_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose second writing fails half-way still holds its first result."""
    path = new_path(spark, "kept")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"))
    write_lines(names, path)
    until_exit(spark, path)
    broken = names.select(F.when(F.xxhash64("value") % 100 == 0, F.raise_error(F.lit("broken on purpose"))).otherwise(F.col("value")).alias("value"))
    try:
        write_lines(broken, path)
    except Exception as error:  # the one that the rows raise
        if "broken on purpose" not in str(error):
            raise
    return read_lines(spark, path).select("value")


def key_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a quarter of the customers from a key-ordered folder, whose other files are not opened."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    top = orders.agg(F.max("o_custkey")).first()[0]
    path = new_path(spark, "ranges")
    write_ranges(orders, path, "o_custkey", files=ORDERED_FILES)
    found = read_range(spark, until_exit(spark, path), "o_custkey", top // 4, top // 2)
    return found.select("o_custkey", "o_orderkey", F.lit(len(found.inputFiles()) < key_ranges(spark, path).count()).alias("pruned"))


def strict_clean_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text under the strictest rules: any bad row would be an error."""
    lines = table(spark, sf_dir, "orders").select(layout(",", "o_orderkey", "o_custkey", "o_totalprice").alias("value"))
    return read_delimited(spark, _write_text(spark, lines, "strict"), "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE",
                          header=False, on_bad="fail", strict=True)


def key_order_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a key-ordered folder, and how many of its files begin before an earlier one ends."""
    path = new_path(spark, "ordered")
    write_pairs(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), path, keys="o_custkey", fmt="text", files=ORDERED_FILES)
    lines = read_lines(spark, until_exit(spark, path)).select(
        "file_name", F.split_part("value", F.lit("\t"), F.lit(1)).cast("bigint").alias("key"))
    files = lines.groupBy("file_name").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    by_name = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    checked = files.withColumn("before", F.max("high").over(by_name))
    return checked.agg(F.sum("n").alias("n"), F.count_if(F.col("before") > F.col("low")).alias("overlaps"),
                       (F.count("*") >= 4).alias("several_files"))


def written_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that is written again holds the second result only."""
    path = new_path(spark, "twice")
    for table_name, column in (("customer", "c_name"), ("supplier", "s_name")):
        write_lines(table(spark, sf_dir, table_name).select(F.col(column).alias("value")), path)
    return read_lines(spark, until_exit(spark, path)).select("value")


def named_folders_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files in folders with blanks and signs in their names, an empty file among them."""
    path = new_path(spark, "a b+c%41")
    named = table(spark, sf_dir, "customer").select(F.concat(F.lit("n o"), F.col("c_nationkey")).alias("part"), F.col("c_mktsegment").alias("value"))
    named.write.partitionBy("part").text(path)
    write_lines(named.select("value").limit(0), f"{path}/part=none at all")
    files = read_whole_files(spark, f"{until_exit(spark, path)}/*")
    lines = files.select(F.explode(F.split("content", "\n")).alias("line"), F.col("file_name").rlike(r"^part-[^%]*\.txt$").alias("named"))
    return lines.groupBy("line", "named").agg(F.count("*").alias("n")).where("line <> ''")


# --- the twelve jobs ----------------------------------------------------------------


def _houses(spark: SparkSession, sf_dir: str) -> str:
    houses = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("Address"), F.col("c_mktsegment").alias("City"), F.lit("-").alias("State"),
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("Zipcode"), F.col("c_acctbal").alias("Price"))
    path = new_path(spark, "houses")
    write_pairs(houses, path, fmt="csv", header=True)
    return until_exit(spark, path)


def job_avg_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.avg_price(spark, _houses(spark, sf_dir), scale=MONEY)


def job_bank_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(layout(
        " ", F.concat(F.lit("B"), F.col("o_custkey")), F.to_date("o_orderdate"),
        F.floor("o_totalprice").cast("int")).alias("value"))
    return jobs.bank_transfers(spark, _write_text(spark, lines, "transfers"))


def job_max_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(
        layout(", ", "user_id", F.floor("value").cast("int")).alias("value"))
    return jobs.max_temp(spark, _write_text(spark, lines, "temperatures"))


def job_medals(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit('"Supplier, '), F.col("l_suppkey"), F.lit('"'))
    blank = F.lit("")
    lines = table(spark, sf_dir, "lineitem").select(layout(
        ",", "l_orderkey", name, "l_returnflag", "l_linestatus", blank, blank, blank,
        F.concat(F.lit("S"), F.col("l_linenumber")),
        F.col("l_quantity").cast("int"), "l_linenumber", F.lit(1)).alias("value"))
    return jobs.medals(spark, _write_text(spark, lines, "medals"))


def _grades(spark: SparkSession, sf_dir: str) -> str:
    lines = table(spark, sf_dir, "part").select(
        layout(",", F.concat(F.lit("P"), F.col("p_partkey")), "p_size").alias("value"))
    return _write_text(spark, lines, "grades")


def job_norm_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.norm_grades(spark, _grades(spark, sf_dir))


def _trees(spark: SparkSession, sf_dir: str) -> str:
    lines = table(spark, sf_dir, "orders").select(layout(
        ",", F.concat(F.lit("D"), F.col("o_custkey")), F.floor("o_totalprice").cast("int")).alias("value"))
    return _write_text(spark, lines, "trees")


def job_oldest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.oldest_tree(spark, _trees(spark, sf_dir))


def job_oldest_tree_per_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.oldest_tree(spark, _trees(spark, sf_dir), per_district=True)


def job_patient_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counseling = F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No")
    lines = table(spark, sf_dir, "orders").select(
        layout(", ", "o_orderkey", F.floor(F.col("o_totalprice") / 10000).cast("int"), counseling).alias("value"))
    return jobs.patient_filter(spark, _write_text(spark, lines, "patients"))


def _scores(spark: SparkSession, sf_dir: str) -> str:
    lines = table(spark, sf_dir, "customer").select(
        layout(" ", F.concat(F.lit("N"), F.col("c_nationkey")), "c_acctbal").alias("value"))
    return _write_text(spark, lines, "scores")


def job_score_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.score_comp(spark, _scores(spark, sf_dir), scale=MONEY)


def job_sym_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sym_diff(spark, _write_text(spark, _two_kinds_of_lines(spark, sf_dir), "ids"))


def job_read_folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened files, cut at the joins: file names and sizes are the
    writer's, the lines are not."""
    lines = table(spark, sf_dir, "supplier").select(layout("\t", "s_suppkey", "s_name").alias("value"))
    flat = jobs.read_folder_files(spark, _write_text(spark, lines, "folder", LINES_PER_FILE))
    return flat.select(F.explode(F.split("content", " --- ")).alias("line")).where("line <> ''")


def job_max_tf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written into one folder per language; a language is a document."""
    path = new_path(spark, "languages")
    _documents(spark, sf_dir, "lang", "text").write.partitionBy("lang").text(path)
    return jobs.max_tf_words(spark, until_exit(spark, path), doc="lang")


def job_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without a word count as the empty word here."""
    lines = _documents(spark, sf_dir, "text").select(F.col("text").alias("value"))
    return jobs.top_words(spark, _write_text(spark, lines, "texts"), keep_blank=True)


def _job_lines(spark: SparkSession, job: Callable[..., DataFrame], folder: str, **options: object) -> DataFrame:
    """The text lines that a job writes."""
    out = new_path(spark, "out")
    job(spark, folder, out=out, **options)
    return read_lines(spark, until_exit(spark, out)).select(F.col("value").alias("line"))


def lines_bank_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select(layout(
        " ", F.concat(F.lit("B"), F.col("o_custkey")), F.to_date("o_orderdate"), F.floor("o_totalprice").cast("int")).alias("value"))
    return _job_lines(spark, jobs.bank_transfers, _write_text(spark, lines, "transfers"))


def lines_max_temp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(layout(", ", "user_id", F.floor("value").cast("int")).alias("value"))
    return _job_lines(spark, jobs.max_temp, _write_text(spark, lines, "temperatures"))


def lines_medals(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit('"Supplier, '), F.col("l_suppkey"), F.lit('"'))
    blank = F.lit("")
    lines = table(spark, sf_dir, "lineitem").select(layout(
        ",", "l_orderkey", name, "l_returnflag", "l_linestatus", blank, blank, blank, F.concat(F.lit("S"), F.col("l_linenumber")),
        F.col("l_quantity").cast("int"), "l_linenumber", F.lit(1)).alias("value"))
    return _job_lines(spark, jobs.medals, _write_text(spark, lines, "medals"))


def lines_oldest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job_lines(spark, jobs.oldest_tree, _trees(spark, sf_dir), per_district=True)


def lines_patient_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counseling = F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No")
    lines = table(spark, sf_dir, "orders").select(
        layout(", ", "o_orderkey", F.floor(F.col("o_totalprice") / 10000).cast("int"), counseling).alias("value"))
    return _job_lines(spark, jobs.patient_filter, _write_text(spark, lines, "patients"))


def lines_sym_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _job_lines(spark, jobs.sym_diff, _write_text(spark, _two_kinds_of_lines(spark, sf_dir), "ids"))


def lines_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with their places in the result's files: the order of use is ascending."""
    lines = _documents(spark, sf_dir, "text").select(F.col("text").alias("value"))
    out = new_path(spark, "out")
    jobs.top_words(spark, _write_text(spark, lines, "texts"), out=out, keep_blank=True)
    pieces = read_file_pieces(spark, until_exit(spark, out), cut="lines")
    placed = pieces.select("file_name", "start", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where("line <> ''")
    order = Window.orderBy("file_name", "start", "pos")  # ten lines
    return placed.select("line", F.row_number().over(order).alias("place"))


def lines_read_folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file's line, cut at the joins, and whether the lines come in the order of the file names."""
    lines = table(spark, sf_dir, "customer").select(layout("\t", "c_custkey", "c_name").alias("value")).repartition(4)
    out = new_path(spark, "out")
    jobs.read_folder_files(spark, _write_text(spark, lines, "folder", LINES_PER_FILE), out=out)
    pieces = read_file_pieces(spark, until_exit(spark, out), cut="lines")
    written = pieces.select("file_name", "start", F.posexplode(F.split("content", "\n")).alias("pos", "line")).where("line <> ''")
    named = written.select("*", F.substring_index("line", "\t", 1).alias("name"), F.regexp_replace("line", "^[^\t]*\t", "").alias("content"))
    before = Window.orderBy("file_name", "start", "pos")  # a row per file of the input
    checked = named.withColumn("in_order", F.coalesce(F.lag("name").over(before) < F.col("name"), F.lit(True)))
    return checked.select(F.explode(F.split("content", " --- ")).alias("line"), "in_order").where("line <> ''")


def _number_lines(spark: SparkSession, job: Callable[..., DataFrame], folder: str, key: str, value: str, **options: object) -> DataFrame:
    """The lines of a job that gives a number per key, cut at the tab; an empty number is NULL, as it was written."""
    lines = _job_lines(spark, job, folder, **options)
    number = F.nullif(F.split_part("line", F.lit("\t"), F.lit(2)), F.lit(""))
    return lines.select(F.split_part("line", F.lit("\t"), F.lit(1)).alias(key), number.cast("double").alias(value))


def lines_avg_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number_lines(spark, jobs.avg_price, _houses(spark, sf_dir), "zipcode", "avg_price", scale=MONEY)


def lines_norm_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number_lines(spark, jobs.norm_grades, _grades(spark, sf_dir), "name", "normalized")


def lines_score_comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number_lines(spark, jobs.score_comp, _scores(spark, sf_dir), "character", "score", scale=MONEY)


def lines_max_tf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "languages")
    _documents(spark, sf_dir, "lang", "text").write.partitionBy("lang").text(path)
    return _job_lines(spark, jobs.max_tf_words, until_exit(spark, path), doc="lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        mean_by_key,
        count_sum_by_key,
        max_by_key,
        max_by_key_floor0,
        sums_by_composite_key,
        global_argmax,
        max_per_group,
        signed_ratio,
        exact_sums,
        min_max_normalize,
        normalize_one_per_key,
        compound_filter,
        compound_filter_nulls,
        symmetric_difference,
        tagged_symmetric_difference,
        stored_difference,
        flatten_text,
        word_counts,
        doc_word_counts,
        term_frequency,
        term_frequency_total,
        max_tf,
        max_tf_total,
        max_tf_many_rows,
        top_words,
        top_words_sketched,
        word_counts_cut,
        max_tf_cut,
        staged_max_tf,
        top_distinct_counts,
        unpack_composite,
        composite_layout,
        pairs_roundtrip,
        quoted_csv_scan,
        bad_rows_skipped,
        line_scan_with_file_name,
        whole_file_scan,
        named_folders_whole,
        texts_roundtrip_tsv,
        texts_roundtrip_csv,
        quoted_records_split,
        pairs_records_split,
        file_pieces_joined,
        max_tf_file_pieces,
        rows_set_aside,
        overwrite_after_failure,
        key_range_read,
        strict_clean_scan,
        key_order_over_files,
        written_twice,
        job_avg_price,
        job_bank_transfers,
        job_max_temp,
        job_medals,
        job_norm_grades,
        job_oldest_tree,
        job_oldest_tree_per_district,
        job_patient_filter,
        job_score_comp,
        job_sym_diff,
        job_read_folder_files,
        job_max_tf_words,
        job_top_words,
        lines_avg_price,
        lines_bank_transfers,
        lines_max_temp,
        lines_max_tf_words,
        lines_medals,
        lines_norm_grades,
        lines_read_folder_files,
        lines_score_comp,
        lines_oldest_tree,
        lines_patient_filter,
        lines_sym_diff,
        lines_top_words,
    )
}
