"""Search, chunk and quality queries on documents, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import quality as q
from sparkloom.operators import retrieval as r
from sparkloom.sources.proxy import chunks, table

_QUERY, _TERMS = "token with the thing", ("thing", "token", "with", "the")
_IDENT = "'[A-Za-z_][A-Za-z0-9_]{2,}|[0-9]+'"


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return r.lexical_search(chunks(spark, d), _QUERY)


def lexical_search_two_per_path(spark: SparkSession, d: str) -> DataFrame:
    return r.lexical_search(chunks(spark, d), _QUERY, 30, per_path=2)


def lexical_search_in_paths(spark: SparkSession, d: str) -> DataFrame:
    """Search held to a list of paths."""
    return r.lexical_search(chunks(spark, d).where(F.col("path").isin("src1", "src2", "src3")), _QUERY)


def grep_text(spark: SparkSession, d: str) -> DataFrame:
    return r.grep(chunks(spark, d), "token =")


def grep_terms(spark: SparkSession, d: str) -> DataFrame:
    return r.grep_terms(chunks(spark, d), "the with that and")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    query = e.orderBy("vec_id").first()["embedding"]
    return r.cosine_topk(e.select(F.col("vec_id").alias("id"), "embedding"), query)


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return r.round_robin(chunks(spark, d), 250)


def chunk_offsets(spark: SparkSession, d: str) -> DataFrame:
    return r.doc_slices(chunks(spark, d))


def term_index(spark: SparkSession, d: str) -> DataFrame:
    return r.term_index(chunks(spark, d))


def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    return r.recent_turns(table(spark, d, "conversations"), 3)


def retrieval_query(spark: SparkSession, d: str) -> DataFrame:
    return r.query_text(table(spark, d, "conversations"))


def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    return r.within_budget(chunks(spark, d), 18_000)


#: The driver's texts write credentials as `token = "..."`, which the fixed names do not have.
_NAMES = ("token", *q.SECRET_NAMES)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, those of English documents behind a marker, since the driver's texts hold none."""
    text = F.when(F.col("lang") == "en", F.concat(F.lit("x\n# TODO: "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), text.alias("text"))


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return q.duplicate_groups(chunks(spark, d), 1)


def credential_scan(spark: SparkSession, d: str) -> DataFrame:
    return q.secrets(chunks(spark, d), None, _NAMES)


def todo_counts(spark: SparkSession, d: str) -> DataFrame:
    return q.todos(_marked(spark, d))


def todo_samples(spark: SparkSession, d: str) -> DataFrame:
    return q.todo_samples(_marked(spark, d))


def untested(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label names: symbols without tests."""
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source", "n_chars")


def longest_untested(spark: SparkSession, d: str) -> DataFrame:
    return untested(spark, d).orderBy(F.desc("n_chars"), "source", "doc_id").limit(10)


def language_share(spark: SparkSession, d: str) -> DataFrame:
    """Files, lines and share of lines of each language, largest first."""
    lines = F.size(F.split("text", "\n"))
    g = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("loc"))
    total = g.agg(F.sum("loc").alias("total"))
    return g.join(F.broadcast(total)).select("lang", "files", "loc", F.round(100.0 * F.col("loc") / F.col("total"), 1).alias("share"))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("id", F.sha1(F.col("text").cast("binary")).alias("hash"))


def health_score(spark: SparkSession, d: str) -> DataFrame:
    """Health from findings: secrets high, duplicates low, markers info."""
    c = chunks(spark, d)
    found = [q.secrets(c, None, _NAMES).select(F.lit("high").alias("severity")), q.duplicate_groups(c, 1).select(F.lit("low").alias("severity")), q.todos(_marked(spark, d)).select(F.lit("info").alias("severity"))]
    return q.health(found[0].unionByName(found[1]).unionByName(found[2]), c.count())


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    from sparkloom.functions.text import stable_id

    return chunks(spark, d).select("id", stable_id(F.lit("run"), F.col("path"), F.col("id")).alias("stable_id"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_search, lexical_search_two_per_path, lexical_search_in_paths, grep_text, grep_terms, cosine_topk, round_robin, chunk_offsets, term_index, recent_turns, retrieval_query, prompt_budget,
        duplicate_groups, credential_scan, todo_counts, todo_samples, untested, longest_untested, language_share, content_hashes, health_score, stable_ids,
    )
}

_CHUNKS = "WITH chunks AS (SELECT doc_id AS id, source AS path, text FROM documents)"
_SCORED = f"""{_CHUNKS}, t AS (SELECT id, path, lower(path || ' ' || text) AS low, list_distinct(regexp_extract_all(lower(path || ' ' || text), {_IDENT})) AS terms FROM chunks),
scored AS (SELECT id, path, round(CASE WHEN {" OR ".join(f"list_contains(terms, '{x}')" for x in _TERMS)} THEN least(1.5,
  ({" + ".join(f"CAST(list_contains(terms, '{x}') AS INT)" for x in _TERMS)}) / {len(_TERMS)}.0
  {"".join(f" + CASE WHEN list_contains(terms, '{x}') THEN least(0.25, 0.05 * ((length(low) - length(replace(low, '{x}', ''))) / {len(x)})) ELSE 0 END" for x in _TERMS if len(x) > 4)}) ELSE 0 END, 4) AS score FROM t)"""
_CUT = "CASE WHEN length(trim({c})) > {n} THEN rtrim(left(trim({c}), {m})) || '…' ELSE trim({c}) END"
_SECRET = r"""'(?i)\b(token|api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|private[_-]?key|client[_-]?secret|db_password)\b\s*[:=]\s*[''"]([^''"]{12,})[''"]'"""
_SECRETS = f"""hits AS (SELECT id, text, unnest(regexp_extract_all(text, {_SECRET}, 0)) AS whole, unnest(regexp_extract_all(text, {_SECRET}, 1)) AS name, unnest(regexp_extract_all(text, {_SECRET}, 2)) AS value FROM chunks),
secrets AS (SELECT id, lower(name) AS name, length(value) AS value_chars,
  length(left(text, instr(text, whole) - 1)) - length(replace(left(text, instr(text, whole) - 1), chr(10), '')) + 1 AS line
  FROM hits WHERE NOT regexp_matches(lower(whole), 'changeme|your-key-here|xxx|todo|placeholder|example|test|secret'))"""
_TODO = r"""'(?i)\b(?:TODO|FIXME|HACK|XXX)\b[:\s](?:.{0,90})'"""
_DUPES = r"""dupes AS (SELECT sha1(array_to_string(list_slice(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]'), lambda x: x NOT IN ('self', 'this', 'def', 'function', 'const', 'let', 'var')), 1, 240), ' ')) AS shingle,
  count(*) AS members, min(id) AS first, count(DISTINCT path) AS paths FROM chunks GROUP BY 1 HAVING count(*) > 1)"""
_MARKED = "marked AS (SELECT doc_id AS id, source AS path, CASE WHEN lang = 'en' THEN 'x' || chr(10) || '# TODO: ' || text ELSE text END AS text FROM documents)"

ORACLES = {
    "lexical_search": f"{_SCORED} SELECT id, path, score FROM scored WHERE score > 0.01 ORDER BY score DESC, id LIMIT 12",
    "lexical_search_two_per_path": f"""{_SCORED} SELECT id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS r FROM scored WHERE score > 0.01)
WHERE r <= 2 ORDER BY score DESC, id LIMIT 30""",
    "lexical_search_in_paths": f"{_SCORED} SELECT id, path, score FROM scored WHERE score > 0.01 AND path IN ('src1', 'src2', 'src3') ORDER BY score DESC, id LIMIT 12",
    "grep_text": f"{_CHUNKS} SELECT id, path, {_CUT.format(c='text', n=260, m=259)} AS snippet FROM chunks WHERE contains(lower(text), 'token =') ORDER BY id LIMIT 60",
    "grep_terms": f"{_CHUNKS} SELECT id, path FROM chunks WHERE list_has_all(regexp_extract_all(lower(text), {_IDENT}), ['the', 'with', 'that', 'and']) ORDER BY id LIMIT 60",
    "cosine_topk": """WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 4) AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 6""",
    "round_robin": f"""{_CHUNKS}, ok AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY id) AS INT) AS depth, min(id) OVER (PARTITION BY path) AS first
  FROM chunks WHERE length(text) >= 40 AND NOT contains(path, '..'))
SELECT id, path, depth, CAST(least(length(text), 3500) AS INT) AS chars FROM ok ORDER BY depth, first LIMIT 250""",
    "chunk_offsets": f"""{_CHUNKS}, s AS (SELECT id, CAST(unnest(range(0, length(text), 4000)) AS INT) AS start, text FROM chunks WHERE length(text) > 0),
p AS (SELECT id, start, substr(text, start + 1, 4000) AS slice FROM s),
l AS (SELECT *, CAST(1 + coalesce(sum(length(slice) - length(replace(slice, chr(10), ''))) OVER (PARTITION BY id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line FROM p)
SELECT id, start, line, CAST(length(slice) AS INT) AS chars FROM l WHERE length(trim(slice)) >= 40""",
    "term_index": f"""{_CHUNKS}, e AS (SELECT id, unnest(regexp_extract_all(lower(text), {_IDENT})) AS term, generate_subscripts(regexp_extract_all(lower(text), {_IDENT}), 1) AS place FROM chunks),
f AS (SELECT id, term, min(place) AS place FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS r FROM f),
g AS (SELECT id, count(*) AS n, string_agg(term, ' ' ORDER BY r) AS s FROM k WHERE r <= 800 GROUP BY id)
SELECT c.id, CAST(coalesce(n, 0) AS INT) AS n_terms, sha1(coalesce(s, '')) AS digest FROM chunks c LEFT JOIN g USING (id)""",
    "recent_turns": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, turn, role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chars FROM k WHERE back <= 3""",
    "retrieval_query": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role = 'user')
SELECT conv_id, right(string_agg(text, chr(10) ORDER BY turn), 2400) AS query FROM k WHERE back <= 3 GROUP BY conv_id""",
    "prompt_budget": f"""{_CHUNKS}, l AS (SELECT *, 18000 - coalesce(sum(length(text)) OVER (PARTITION BY path ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM chunks)
SELECT id, path, CAST(least(length(text), room) AS BIGINT) AS chars FROM l WHERE room > 0""",
    "duplicate_groups": f"{_CHUNKS}, {_DUPES} SELECT * FROM dupes",
    "credential_scan": f"{_CHUNKS}, {_SECRETS} SELECT id, name, CAST(value_chars AS INT) AS value_chars, CAST(line AS INT) AS line FROM secrets",
    "todo_counts": f"WITH {_MARKED} SELECT id, CAST(len(regexp_extract_all(text, {_TODO})) AS BIGINT) AS markers FROM marked WHERE len(regexp_extract_all(text, {_TODO})) > 0",
    "todo_samples": f"""WITH {_MARKED}, e AS (SELECT id, CAST(generate_subscripts(regexp_extract_all(text, {_TODO}), 1) - 1 AS INT) AS place, unnest(regexp_extract_all(text, {_TODO})) AS s FROM marked)
SELECT id, place AS "at", {_CUT.format(c='s', n=80, m=79)} AS sample FROM e ORDER BY id, place LIMIT 6""",
    "untested": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "longest_untested": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, source, doc_id LIMIT 10",
    "language_share": """WITH g AS (SELECT lang, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS loc FROM documents GROUP BY lang)
SELECT lang, files, loc, round(100.0 * loc / (SELECT sum(loc) FROM g), 1) AS share FROM g""",
    "content_hashes": f"{_CHUNKS} SELECT id, sha1(text) AS hash FROM chunks",
    "health_score": f"""{_CHUNKS}, {_MARKED}, {_SECRETS}, {_DUPES}, n AS (SELECT (SELECT count(*) FROM secrets) AS a, (SELECT count(*) FROM dupes) AS b,
  (SELECT count(*) FROM marked WHERE len(regexp_extract_all(text, {_TODO})) > 0) AS c, (SELECT count(*) FROM chunks) AS k),
p AS (SELECT a + b + c AS issues, round(a * 1.0 + b * 0.3 + c * 0.1, 4) AS penalty, k FROM n),
s AS (SELECT *, CAST(greatest(0, least(100, round_even(100 - penalty / greatest(1.0, k / 40.0) * 10, 0))) AS BIGINT) AS score FROM p)
SELECT issues, CAST(penalty AS DOUBLE) AS penalty, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'fair' ELSE 'needs attention' END AS label FROM s""",
    "stable_ids": f"{_CHUNKS} SELECT id, left(sha1('run::' || path || '::' || id), 20) AS stable_id FROM chunks",
}
