"""The queries of this package by name, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import leak_report
from .importance import importance_report
from .language import language_report, page_languages
from .line_dedup import line_report
from .media_chunks import media_report
from .mixing import mix_report
from .near_duplicates import jaccard_report
from .pii import find_pii
from .secret_scan import scan
from .substrings import substring_report
from .token_counts import token_counts
from .vector_codes import code_report
from .warc_archive import archive_report

Query = Callable[[SparkSession, str], DataFrame]


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_report(table(spark, sf_dir, "documents"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark passage."""
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("leaked")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_report(table(spark, sf_dir, "documents"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def page_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_media_chunks,
        op2_secret_forest,
        op3_source_mixing,
        op4_language_fusion,
        op5_substring_dedup,
        op6_pii_spans,
        op7_token_counts,
        op8_benchmark_leaks,
        op9_jaccard_join,
        op10_warc_archive,
        op11_importance_resampling,
        op12_vector_codes,
        op13_line_dedup,
        page_language_fusion,
    )
}

def _codes_sql() -> str:
    """Lloyd's rounds by comparing every part with every entry, one step a table."""
    near = lambda i: f"""
a{i} AS MATERIALIZED (SELECT vec_id, p, x, min({{'d': list_sum(list_transform(range(1, w + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::BIGINT, 'k': k}}) AS best
  FROM parts JOIN b{i} USING (p) GROUP BY vec_id, p, x),"""  # noqa: E731
    mean = lambda i: f"""
m{i} AS (SELECT p, k, list(v ORDER BY j) AS c FROM (SELECT p, best.k AS k, j, floor(sum(x[j])::DOUBLE / count(*))::BIGINT AS v
  FROM a{i - 1}, (SELECT unnest(range(1, w + 1)) AS j, w FROM shape) GROUP BY p, best.k, j) GROUP BY p, k),
b{i} AS MATERIALIZED (SELECT p, k, coalesce(m{i}.c, b{i - 1}.c) AS c FROM b{i - 1} LEFT JOIN m{i} USING (p, k)),"""  # noqa: E731
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
shape AS (SELECT max(len(v)) // 16 AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, p, w, list_slice(v, p * w + 1, p * w + w) AS x FROM kept, shape, range(16) r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < 64),
b0 AS MATERIALIZED (SELECT p, k, x AS c FROM parts JOIN first USING (vec_id)),{near(0)}{mean(1)}{near(1)}{mean(2)}{near(2)}
e AS (SELECT vec_id, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN kept USING (vec_id), s"""


ORACLES: dict[str, str] = {
    "op10_warc_archive": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
r AS (SELECT d, min(page_id) AS f FROM p GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM p JOIN r USING (d)""",
    # CRC-32 byte by byte from the table of a register's low byte; distinct features only
    "op11_importance_resampling": r"""
WITH RECURSIVE steps AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS MATERIALIZED (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
grams AS MATERIALIZED (SELECT kind, id, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g
  FROM (SELECT kind, id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, range(1, 4) r(n))),
bytes AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)),
hashed AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
counted AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM grams JOIN hashed USING (g) GROUP BY bucket),
total AS (SELECT sum(s) AS sa, sum(t) AS ta FROM counted),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sa + 10000)::DOUBLE / ((s + 1)::DOUBLE * (ta + 10000)::DOUBLE)))::BIGINT AS gain FROM counted, total),
weights AS (SELECT id, count(*) AS n, sum(gain) AS weight FROM grams JOIN hashed USING (g) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id),
scored AS (SELECT w.id, len(ws) AS words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) +
  floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN weights USING (id) WHERE kind = 0),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r, count(*) OVER () AS able FROM scored WHERE words >= 20)
SELECT id AS doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= 5 * able // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (id)""",
    "op12_vector_codes": _codes_sql(),
    "op13_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, line, pos, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
