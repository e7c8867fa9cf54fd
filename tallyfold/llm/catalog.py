"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    html_text,
    language_id,
    mixture,
    pii,
    ppm,
    preferences,
    quality,
    resample,
    sharding,
    simhash,
    suffix_dedup,
    whitening,
)
from .common import table


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest_rows(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_rows(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest_rows(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest_rows(table(spark, sf_dir, "documents"))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.digest_rows(table(spark, sf_dir, "documents"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.digest_rows(table(spark, sf_dir, "conversations"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest_rows(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest_rows(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest_rows(table(spark, sf_dir, "embeddings"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.digest_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixture": op1_mixture,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_pii": op4_pii,
    "op5_html_text": op5_html_text,
    "op6_language": op6_language,
    "op7_ppm": op7_ppm,
    "op8_preferences": op8_preferences,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_sharding": op11_sharding,
    "op12_whitening": op12_whitening,
    "op13_resample": op13_resample,
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op1_mixture": r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':'
                    || row_number() OVER (PARTITION BY source, doc_id, coalesce(text, ''))), 1, 9) AS place
  FROM documents
),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM sizes GROUP BY source
),
levels AS (
  SELECT *, 3 * CAST(source_size AS DOUBLE) AS ceiling,
         CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS DOUBLE)
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM ranked
  WINDOW before AS (ORDER BY 3 * CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
goals AS (
  SELECT source, source_size,
         CASE WHEN level * weight > ceiling THEN ceiling
              ELSE least(ceiling, weight * first_value(CASE WHEN level * weight <= ceiling THEN level END IGNORE NULLS)
                OVER (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS target
  FROM levels
),
rests AS (
  SELECT *, greatest(0.0, target - whole * source_size) AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM goals)
),
places AS (SELECT source, place, sum(size) AS inside FROM sizes GROUP BY source, place),
running AS (SELECT *, sum(inside) OVER (PARTITION BY source ORDER BY place) AS after FROM places),
bounds AS (
  SELECT r.source, min(p.place) AS bound, min(p.after) AS after, arg_min(p.inside, p.place) AS inside
  FROM rests r JOIN running p ON r.source IS NOT DISTINCT FROM p.source AND p.after > r.rest GROUP BY r.source
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       s.size * (r.whole + CASE WHEN s.place < b.bound THEN 1
                                WHEN s.place = b.bound AND b.after - r.rest < r.rest - (b.after - b.inside) THEN 1 ELSE 0 END) AS taken
FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
LEFT JOIN bounds b ON s.source IS NOT DISTINCT FROM b.source
""",
    "op8_preferences": r"""
WITH turns AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair, coalesce(conv_id % 2 <> 0, false) AS side, conv_id,
         coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations
),
said AS (
  SELECT *, '<|' || replace(role, '<|', '<||') || '|>' || chr(10) AS opening, replace(text, '<|', '<||') || '<|end|>' || chr(10) AS body FROM turns
),
pairs AS (
  SELECT pair, min(conv_id) FILTER (NOT side) AS chosen_id, min(conv_id) FILTER (side) AS rejected_id,
         least(count(*) FILTER (NOT side), count(*) FILTER (side)) AS shortest
  FROM turns GROUP BY pair
),
firsts AS (
  SELECT c.pair, min(c.i) - 1 AS n FROM turns c JOIN turns r ON c.pair IS NOT DISTINCT FROM r.pair AND c.i = r.i AND NOT c.side AND r.side
  WHERE c.role <> r.role OR c.text <> r.text GROUP BY c.pair
),
commons AS (SELECT p.*, CAST(coalesce(f.n, p.shortest) AS BIGINT) AS n_common FROM pairs p LEFT JOIN firsts f ON p.pair IS NOT DISTINCT FROM f.pair),
rest AS (
  SELECT s.*, n_common, coalesce(sum(length(opening || body)) OVER (PARTITION BY s.pair, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(opening) AS start
  FROM said s JOIN commons c ON s.pair IS NOT DISTINCT FROM c.pair WHERE i > n_common
),
prompts AS (
  SELECT s.pair, string_agg(opening || body, '' ORDER BY i) AS prompt
  FROM said s JOIN commons c ON s.pair IS NOT DISTINCT FROM c.pair WHERE i <= n_common AND NOT side GROUP BY s.pair
),
ends AS (
  SELECT pair, string_agg(opening || body, '' ORDER BY i) FILTER (NOT side) AS chosen, string_agg(opening || body, '' ORDER BY i) FILTER (side) AS rejected,
         string_agg(start || ':' || (start + length(body)), ',' ORDER BY i) FILTER (NOT side AND role = 'assistant') AS chosen_mask,
         string_agg(start || ':' || (start + length(body)), ',' ORDER BY i) FILTER (side AND role = 'assistant') AS rejected_mask
  FROM rest GROUP BY pair
)
SELECT c.pair, chosen_id, rejected_id, n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen, coalesce(rejected, '') AS rejected,
       coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_mask, '') AS rejected_mask
FROM commons c LEFT JOIN prompts p ON c.pair IS NOT DISTINCT FROM p.pair LEFT JOIN ends e ON c.pair IS NOT DISTINCT FROM e.pair
""",
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
words AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
