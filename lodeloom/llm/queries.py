"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, language, minhash, packing, quality, rules, suffixes, tokenstore, warc
from .store import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, _table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.host_rules(spark, _table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(spark, _table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(spark, _table(spark, sf_dir, "documents"), 2048)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark, _table(spark, sf_dir, "pages"), min_bytes=0)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_dedup(spark, _table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.store_tokens(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_language_id, op3_quality_rules, op4_decontamination, op5_suffix_dedup, op6_quality_classifier,
        op7_best_fit_packing, op8_warc, op9_minhash_dedup, op10_token_store,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP3 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
),
tri AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
),
covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r
),
lines AS (
    SELECT r, count(*) - count(DISTINCT line) AS n
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
counted AS (
    SELECT d.r, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)
),
base AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted),
hosts AS (
    SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM base WHERE source IS NOT NULL GROUP BY source
),
spread AS (
    SELECT sum(failed) / sum(n) AS m, coalesce(var_samp(failed / n), 0) AS v, coalesce(avg(1 / n), 1) AS noise FROM hosts
),
prior AS (
    SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * noise, 1e-9) - 1, 1.0), 1000.0) AS k FROM spread
),
verdict AS (
    SELECT source, (failed + m * k) / (n + m * k + (1 - m) * k) > 0.5 AS host_failed FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    (NOT base_failed AND NOT coalesce(host_failed, false)) AS kept
FROM base LEFT JOIN verdict USING (source)
"""

_OP4 = r"""
WITH clean AS (
    SELECT 'd' AS kind, doc_id AS id, lower(text) AS text FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT DISTINCT 'i', item_id, lower(text) FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
),
w AS (
    SELECT kind, id, row_number() OVER () AS r, list_filter(list_transform(regexp_extract_all(text, '[^\x20\x09-\x0D]+'),
        lambda x: regexp_replace(x, '[!-/:-@\[-`{-~]', '', 'g')), lambda x: x <> '') AS w FROM clean
),
runs AS (
    SELECT kind, id, r, len(w) AS n, unnest(range(0, greatest(len(w) - 4, 1))) AS p, w FROM w WHERE len(w) > 0
),
sh AS (SELECT kind, id, r, n, p, CASE WHEN n < 5 THEN n::VARCHAR || ' ' || array_to_string(w, ' ') ELSE array_to_string(w[p + 1 : p + 5], ' ') END AS g FROM runs),
item AS (SELECT id AS item_id, r AS ir, n, g, count(*) AS c FROM sh WHERE kind = 'i' GROUP BY 1, 2, 3, 4),
short AS (
    SELECT 'd' AS kind, id, r, n, unnest(range(0, n - k + 1)) AS p, k, w FROM (SELECT id, r, len(w) AS n, w FROM w WHERE kind = 'd'), (SELECT DISTINCT n AS k FROM item WHERE n < 5) WHERE n >= k
),
hits AS (
    SELECT d.id AS doc_id, d.r, d.n AS size, d.p, i.item_id, i.ir, i.n, i.g, i.c FROM sh d JOIN item i ON i.g = d.g WHERE d.kind = 'd' AND i.n >= 5 AND d.n >= 5
    UNION ALL SELECT d.id, d.r, d.n, d.p, i.item_id, i.ir, i.n, i.g, i.c FROM short d JOIN item i ON i.n = d.k AND i.g = d.k::VARCHAR || ' ' || array_to_string(d.w[d.p + 1 : d.p + d.k], ' ')
),
spots AS (
    SELECT DISTINCT doc_id, r, item_id, ir, n, size, least(n, size) AS span, s
    FROM (SELECT *, unnest(range(greatest(p - greatest(least(n, size) - 5, 0), 0), least(p, size - least(n, size)) + 1)) AS s FROM hits WHERE 100 * size >= 75 * n)
),
shared AS (
    SELECT s.doc_id, s.r, s.item_id, s.ir, s.n, s.span, s.s, h.g, least(count(*), max(h.c)) AS m FROM spots s
    JOIN hits h ON h.r = s.r AND h.ir = s.ir AND h.p BETWEEN s.s AND s.s + greatest(s.span - 5, 0) GROUP BY ALL
),
scored AS (
    SELECT doc_id, r, item_id, s, span, m / (greatest(n - 4, 1) + greatest(span - 4, 1) - m) AS similarity
    FROM (SELECT doc_id, r, item_id, ir, n, span, s, sum(m)::BIGINT AS m FROM shared GROUP BY ALL)
)
SELECT doc_id, item_id, similarity, s::BIGINT AS start, span::BIGINT AS n_words FROM scored WHERE similarity >= 0.8 - 1e-11
QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, s, span) = 1
"""

_OP5 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
),
runs AS (
    SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
),
often AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS later, count(*) OVER (PARTITION BY h) AS c FROM runs
),
marked AS (
    SELECT doc_id, i, later, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new
    FROM often WHERE c > 1
),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked)
SELECT doc_id, min(i)::BIGINT AS start, (max(i) + 50 - min(i))::BIGINT AS n_words, NOT bool_or(later) AS first
FROM grouped GROUP BY doc_id, g
"""

_OP8 = r"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
),
q AS (
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS best,
        array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((('0x' || substr(hex, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest
    FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM q
"""

_OP9 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT DISTINCT doc_id, md5(s) AS s FROM (
        SELECT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)
        UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3
    )
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) t
    JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) JOIN least_ ON a = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _OP3,
    "op4_decontamination": _OP4,
    "op5_suffix_dedup": _OP5,
    "op8_warc": _OP8,
    "op9_minhash_dedup": _OP9,
}
