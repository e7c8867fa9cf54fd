"""The same results as SQL for a second engine (DuckDB), by query name."""

from __future__ import annotations

_MONEY_SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

# One row per word occurrence: {doc} and the word, blanks included.
_TOKENS = """
  SELECT {doc} AS doc,
         unnest(string_split(trim(lower(regexp_replace(
           regexp_replace({text}, '[0-9]+', '', 'g'), '[^a-zA-Z]+', ' ', 'g'))), ' ')) AS word
  FROM {source}
"""

_COUNTS = """
WITH tokens AS (""" + _TOKENS + """),
counts AS (
  SELECT doc, word, count(*) AS n FROM tokens WHERE word <> '' GROUP BY doc, word
),
totals AS (
  SELECT doc, count(*) AS terms, CAST(sum(n) AS BIGINT) AS tokens FROM counts GROUP BY doc
),
tf AS (
  SELECT c.doc, c.word, c.n,
         CAST(c.n AS DOUBLE) / CAST(t.terms AS DOUBLE) AS tf,
         CAST(c.n AS DOUBLE) / CAST(t.tokens AS DOUBLE) AS tf_total
  FROM counts c JOIN totals t ON c.doc IS NOT DISTINCT FROM t.doc
)
"""


def _counts(doc: str = "doc_id") -> str:
    return _COUNTS.format(doc=doc, text="text", source="documents")


def _max_tf(doc: str, tf: str = "tf") -> str:
    return _counts(doc) + f""",
ranked AS (
  SELECT word, doc, {tf} AS tf,
         count(*) OVER (PARTITION BY word) AS docs,
         row_number() OVER (PARTITION BY word ORDER BY {tf} DESC, doc) AS place
  FROM tf
)
SELECT word, docs, doc AS {doc}, tf FROM ranked WHERE place = 1
"""


_WORDS = "WITH tokens AS (" + _TOKENS.format(doc="doc_id", text="text", source="documents") + """),
words AS (SELECT word, count(*) AS n FROM tokens WHERE word <> '' GROUP BY word)
"""

_SCORE = """
SELECT {key} AS {name},
       coalesce(max(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), 0.0)
         / nullif(-coalesce(CAST(sum(CASE WHEN c_acctbal < 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE),
                            0.0), 0.0) AS score
FROM customer GROUP BY 1
"""

_ONE_SIDED_ORDERS = """
SELECT {shown} FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)
UNION ALL
SELECT {shown} FROM (SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT o_orderkey FROM orders)
"""

_MEDAL_SUMS = """
SELECT l_suppkey, l_linestatus,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS gold,
       CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS silver,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS bronze
FROM lineitem GROUP BY l_suppkey, l_linestatus
"""

_TREES = "SELECT 'D' || o_custkey AS district_name, CAST(floor(o_totalprice) AS INTEGER) AS age_of_tree FROM orders"

_HARD_TEXTS = """
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '  "' || text || '"' || chr(9) || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE text END AS text, lang
FROM documents"""

ORACLE: dict[str, str] = {
    "mean_by_key": f"""
        SELECT c_mktsegment, {_MONEY_SUM.format('c_acctbal')} / CAST(count(c_acctbal) AS DOUBLE) AS avg_balance
        FROM customer GROUP BY c_mktsegment""",
    "count_sum_by_key": f"""
        SELECT o_orderpriority, count(*) AS orders, {_MONEY_SUM.format('o_totalprice')} AS total_price
        FROM orders GROUP BY o_orderpriority""",
    "max_by_key": "SELECT event_type, max(value) AS max_value FROM events GROUP BY event_type",
    "max_by_key_floor0": """
        SELECT c_custkey, greatest(max(c_acctbal), 0.0) AS max_balance FROM customer GROUP BY c_custkey""",
    "sums_by_composite_key": _MEDAL_SUMS,
    "global_argmax": """
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""",
    "max_per_group": "SELECT p_brand, max(p_size) AS max_size FROM part GROUP BY p_brand",
    "signed_ratio": _SCORE.format(key="c_mktsegment", name="c_mktsegment"),
    "exact_sums": """
        SELECT l_suppkey, CAST(CAST(sum(v) AS BIGINT) AS DOUBLE) AS total, count(*) AS n,
               CAST(CAST(sum(v) AS BIGINT) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean
        FROM (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) * (CAST(1 AS BIGINT) << CAST(4 * (l_linenumber - 1) AS BIGINT))
                       * CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS v FROM lineitem)
        GROUP BY l_suppkey""",
    "min_max_normalize": """
        WITH bounds AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
        SELECT c_custkey, (c_acctbal - lo) / (hi - lo) AS normalized FROM customer, bounds""",
    "normalize_one_per_key": """
        WITH bounds AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
        first_rows AS (
          SELECT p_name, p_retailprice, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS place FROM part
        )
        SELECT p_name, (p_retailprice - lo) / (hi - lo) AS normalized FROM first_rows, bounds WHERE place = 1""",
    "compound_filter": """
        SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
        WHERE o_orderstatus <> 'P' OR o_orderpriority = '1-URGENT'""",
    "compound_filter_nulls": """
        SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status, nullif(o_orderpriority, '2-HIGH') AS priority FROM orders
        WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM 'P' OR nullif(o_orderpriority, '2-HIGH') IS NOT DISTINCT FROM '1-URGENT'""",
    "symmetric_difference": _ONE_SIDED_ORDERS.format(shown="k AS orderkey"),
    "tagged_symmetric_difference": _ONE_SIDED_ORDERS.format(shown="'O' || k AS id"),
    "stored_difference": _ONE_SIDED_ORDERS.format(shown="k AS orderkey"),
    "flatten_text": "SELECT doc_id, replace(text, chr(10), ' --- ') AS content FROM documents",
    "word_counts": _WORDS + "SELECT word, n FROM words",
    "doc_word_counts": _counts() + "SELECT doc AS doc_id, word, n FROM counts",
    "term_frequency": _counts() + "SELECT doc AS doc_id, word, n, tf FROM tf",
    "term_frequency_total": _counts() + "SELECT doc AS doc_id, word, n, tf_total AS tf FROM tf",
    "max_tf": _max_tf("doc_id"),
    "max_tf_total": _max_tf("doc_id", "tf_total"),
    "max_tf_many_rows": _max_tf("source"),
    "top_words": _WORDS + "SELECT word, n FROM words ORDER BY n DESC, word LIMIT 10",
    "top_words_sketched": _WORDS + "SELECT word, n FROM words ORDER BY n DESC, word LIMIT 10",
    "word_counts_cut": _WORDS + "SELECT word, n FROM words",
    "max_tf_cut": _max_tf("source"),
    "staged_max_tf": _max_tf("source"),
    "max_tf_file_pieces": _max_tf("lang"),
    "top_distinct_counts": _WORDS + """
        SELECT n, max(word) AS word FROM words GROUP BY n ORDER BY n DESC LIMIT 500""",
    "unpack_composite": """
        SELECT c_custkey, split_part(c_name, '#', 1) AS prefix, split_part(c_name, '#', 2) AS number FROM customer""",
    "composite_layout": f"""
        SELECT l_suppkey || ',' || l_linestatus || ',,' || gold || ' ' || silver || ',' || bronze AS line
        FROM ({_MEDAL_SUMS})""",
    "pairs_roundtrip": f"""
        SELECT o_custkey, count(*) AS orders, {_MONEY_SUM.format('o_totalprice')} AS total_price
        FROM orders GROUP BY o_custkey""",
    "quoted_csv_scan": "SELECT p_partkey, p_name || ', ' || p_brand AS label, p_size FROM part",
    "bad_rows_skipped": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus NOT IN ('F', 'P')",
    "line_scan_with_file_name": """
        SELECT s_suppkey || chr(9) || s_name AS value, true AS named_after_file FROM supplier""",
    "whole_file_scan": "SELECT c_custkey || chr(9) || c_name AS line FROM customer",
    "named_folders_whole": "SELECT c_mktsegment AS line, true AS named, count(*) AS n FROM customer GROUP BY c_mktsegment",
    "quoted_records_split": _HARD_TEXTS + " WHERE doc_id % 7 <> 2",
    "pairs_records_split": _HARD_TEXTS,
    "file_pieces_joined": "SELECT doc_id || chr(9) || lang || chr(9) || replace(text, chr(10), ' ') AS line FROM documents",
    "rows_set_aside": """
        SELECT CASE o_orderstatus WHEN 'F' THEN 'bad o_totalprice' WHEN 'P' THEN 'missing o_totalprice' ELSE 'good' END AS reason,
               count(*) AS n, count(*) AS counted,
               CAST(sum(CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS price
        FROM orders GROUP BY 1""",
    "overwrite_after_failure": "SELECT c_name AS value FROM customer",
    "key_range_read": """
        SELECT o_custkey, o_orderkey, true AS pruned FROM orders
        WHERE o_custkey BETWEEN (SELECT max(o_custkey) // 4 FROM orders) AND (SELECT max(o_custkey) // 2 FROM orders)""",
    "texts_roundtrip_tsv": _HARD_TEXTS,
    "texts_roundtrip_csv": _HARD_TEXTS + " WHERE doc_id % 7 <> 2",
    "strict_clean_scan": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "key_order_over_files": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS overlaps, true AS several_files FROM orders",
    "written_twice": "SELECT s_name AS value FROM supplier",
    "lines_avg_price": f"""
        SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zipcode,
               {_MONEY_SUM.format('c_acctbal')} / CAST(count(*) AS DOUBLE) AS avg_price
        FROM customer GROUP BY 1""",
    "lines_norm_grades": """
        WITH bounds AS (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part)
        SELECT 'P' || p_partkey AS name, (p_size - lo) / (hi - lo) AS normalized FROM part, bounds""",
    "lines_score_comp": _SCORE.format(key="'N' || c_nationkey", name='"character"'),
    "lines_max_tf_words": "SELECT word || chr(9) || docs || ', ' || lang AS line FROM (" + _max_tf("lang") + ")",
    "lines_read_folder_files": "SELECT c_custkey || chr(9) || c_name AS line, true AS in_order FROM customer",
    "lines_bank_transfers": """
        SELECT 'B' || o_custkey || chr(9) || count(*) || ' ' || CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS line
        FROM orders GROUP BY o_custkey""",
    "lines_max_temp": """
        SELECT user_id || chr(9) || max(CAST(floor(value) AS INTEGER)) AS line FROM events GROUP BY user_id""",
    "lines_medals": """
        SELECT '"Supplier, ' || l_suppkey || '",' || l_linestatus || ',,' || l_returnflag || ',S' || l_linenumber || ','
               || CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) || ',' || CAST(sum(l_linenumber) AS BIGINT) || ',' || count(*) AS line
        FROM lineitem GROUP BY l_suppkey, l_linestatus, l_returnflag, l_linenumber""",
    "lines_oldest_tree": f"SELECT district_name || chr(9) || max(age_of_tree) AS line FROM ({_TREES}) GROUP BY district_name",
    "lines_patient_filter": """
        SELECT o_orderkey || chr(9) || CAST(floor(o_totalprice / 10000) AS INTEGER) || ' '
               || CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS line
        FROM orders WHERE CAST(floor(o_totalprice / 10000) AS INTEGER) <> 1 OR o_orderstatus = 'F'""",
    "lines_sym_diff": _ONE_SIDED_ORDERS.format(shown="'O' || k || chr(9) AS line"),
    "lines_top_words": "WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), tokens AS ("
    + _TOKENS.format(doc="1", text="line", source="lines")
    + """), top AS (SELECT count(*) AS n, word FROM tokens GROUP BY word ORDER BY n DESC, word LIMIT 10)
        SELECT n || chr(9) || word AS line, CAST(row_number() OVER (ORDER BY n, word DESC) AS INTEGER) AS place FROM top""",
    "job_avg_price": f"""
        SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zipcode,
               {_MONEY_SUM.format('c_acctbal')} / CAST(count(*) AS DOUBLE) AS avg_price
        FROM customer GROUP BY 1""",
    "job_bank_transfers": """
        SELECT 'B' || o_custkey AS bank, count(*) AS transfers,
               CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS amount
        FROM orders GROUP BY 1""",
    "job_max_temp": """
        SELECT CAST(user_id AS VARCHAR) AS city, max(CAST(floor(value) AS INTEGER)) AS max_temperature
        FROM events GROUP BY 1""",
    "job_medals": """
        SELECT '"Supplier, ' || l_suppkey || '"' AS name, l_linestatus AS sex, l_returnflag AS country,
               'S' || l_linenumber AS sport,
               CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS gold,
               CAST(sum(l_linenumber) AS BIGINT) AS silver, count(*) AS bronze
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "job_norm_grades": """
        WITH bounds AS (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part)
        SELECT 'P' || p_partkey AS name, (p_size - lo) / (hi - lo) AS normalized FROM part, bounds""",
    "job_oldest_tree": f"""
        SELECT district_name, age_of_tree FROM ({_TREES}) ORDER BY age_of_tree DESC, district_name LIMIT 1""",
    "job_oldest_tree_per_district": f"""
        SELECT district_name, max(age_of_tree) AS age_of_tree FROM ({_TREES}) GROUP BY district_name""",
    "job_patient_filter": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id,
               CAST(floor(o_totalprice / 10000) AS INTEGER) AS patient_cycle_num,
               CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS counseling
        FROM orders WHERE CAST(floor(o_totalprice / 10000) AS INTEGER) <> 1 OR o_orderstatus = 'F'""",
    "job_score_comp": _SCORE.format(key="'N' || c_nationkey", name='"character"'),
    "job_sym_diff": _ONE_SIDED_ORDERS.format(shown="'O' || k AS id"),
    "job_read_folder_files": "SELECT s_suppkey || chr(9) || s_name AS line FROM supplier",
    "job_max_tf_words": _max_tf("lang"),
    "job_top_words": "WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), tokens AS ("
    + _TOKENS.format(doc="1", text="line", source="lines")
    + ") SELECT count(*) AS n, word FROM tokens GROUP BY word ORDER BY n DESC, word LIMIT 10",
}
