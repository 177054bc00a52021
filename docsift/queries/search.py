"""Free-text queries: every benchmark text searched over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docsift.operators.embed import embed, hashed_embedding, hashed_terms
from docsift.operators.neighbours import nearest_terms
from docsift.operators.paging import page_of
from docsift.operators.term_index import best_in_term_index, build_term_index
from docsift.plans.index import added_documents, process_files
from docsift.plans.search import SearchOptions, debug_hits_of_many, hit_totals, text_hits, text_search, with_documents
from docsift.queries.common import SQL_MANIFEST, TEXT_EXTENSIONS, documents, manifest, now, rounded, sql_manifest, table
from docsift.queries.files import SQL_PROCESSED
from docsift.queries.texts import sql_occurrences, sql_snippets
from docsift.session import shared_path, written
from docsift.sources.store import api_projection, append_documents, hits_as_json, open_documents

TERM_BUCKETS = 4096


def _queries(spark, folder) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_CORPUS = """
    row_id string, doc_id string, path string, filename string, type string, match_source string, embedding_type string,
    content string, is_empty boolean, text_chars bigint, embedding array<float>
"""


def _corpus(spark, folder) -> DataFrame:
    """Index the documents, store them with their vectors, and open the store."""
    path = shared_path(spark, "corpus")
    append_documents(added_documents(process_files(manifest(spark, folder, TEXT_EXTENSIONS), now()), hashed_embedding), path, _CORPUS)
    return open_documents(spark, path, _CORPUS)


def hashed_embeddings(spark, folder):
    vectors = embed(documents(spark, folder), "text")
    entries = vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "weight")).filter("weight <> 0")
    return entries.select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), rounded(F.col("weight").cast("double")).alias("weight"))


def hashed_search(spark, folder):
    """Cosine of sparse term vectors, ten best documents per query."""
    docs = documents(spark, folder).select("doc_id", hashed_terms(F.col("text"), TERM_BUCKETS).alias("terms"))
    asked = _queries(spark, folder).select("query_id", hashed_terms(F.col("query"), TERM_BUCKETS).alias("terms"))
    return nearest_terms(docs, asked, 10).withColumn("score", rounded("score"))


def hashed_search_indexed(spark, folder):
    """The same from a stored inverted index, without the postings that cannot matter."""
    docs = documents(spark, folder).select("doc_id", hashed_terms(F.col("text"), TERM_BUCKETS).alias("terms"))
    asked = _queries(spark, folder).select("query_id", hashed_terms(F.col("query"), TERM_BUCKETS).alias("terms"))
    index = build_term_index(docs, shared_path(spark, "term-index"))
    return best_in_term_index(index, asked, 10).withColumn("score", rounded("score"))


def knn_debug(spark, folder):
    """Raw neighbours of every benchmark text with preview and length."""
    docs = embed(documents(spark, folder), "text")
    asked = embed(_queries(spark, folder), "query")
    return debug_hits_of_many(docs, asked, 10, "text").withColumn("score", rounded("score"))


def hits_per_query(spark, folder):
    totals = hit_totals(_corpus(spark, folder), _queries(spark, folder))
    return totals.select("query_id", "hits", rounded("nearest").alias("nearest"), rounded("farthest").alias("farthest"))


def full_text_search(spark, folder):
    found = text_search(_corpus(spark, folder), _queries(spark, folder))
    first = F.get("snippets", F.lit(0))
    return found.select(
        "query_id", "rank", "path", "type", rounded("score").alias("score"),
        F.size("snippets").cast("bigint").alias("snippet_count"), first["snippet"].alias("first_snippet"),
        rounded(first["score"]).alias("first_score"), F.array_join(first["matched_terms"], " ").alias("first_terms"),
        first["match_type"].alias("first_type"),
    )


def full_text_second_page(spark, folder):
    corpus, options = _corpus(spark, folder), SearchOptions(page=2)
    hits = page_of(text_hits(corpus, _queries(spark, folder), options), options.page, options.page_size)
    return with_documents(written(hits, "page-ids"), corpus).select("query_id", "rank", "path", rounded("score").alias("score"))


def api_hits(spark, folder):
    found = text_search(_corpus(spark, folder), _queries(spark, folder))
    shown = found.select("query_id", "rank", *api_projection())
    return shown.withColumn("snippets", F.array_join(F.transform("snippets", lambda s: s["snippet"]), "|"))


def api_hits_json(spark, folder):
    return hits_as_json(text_search(_corpus(spark, folder), _queries(spark, folder)))


QUERIES = {
    "hashed_embedding": hashed_embeddings,
    "api_projection": api_hits,
    "api_json": api_hits_json,
    **{f.__name__: f for f in (hashed_search, hashed_search_indexed, knn_debug, hits_per_query, full_text_search, full_text_second_page)},
}


def _bucket_sql(name: str, relation: str, key: str, text: str, dim: int = 256, kind: str = "FLOAT") -> str:
    """CTE ``name(key, bucket, weight)`` of unit word-hash vectors."""
    return f"""
{name}_c AS (SELECT key, (('0x' || substr(md5(t), 1, 8))::UBIGINT % {dim})::BIGINT AS bucket, count(*) AS n
  FROM (SELECT {key} AS key, unnest(regexp_extract_all(lower({text}), '[a-z0-9_]+')) AS t FROM {relation}) GROUP BY ALL),
{name} AS (SELECT key, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY key)))::{kind}::DOUBLE AS weight FROM {name}_c)"""


def _distance_sql(docs: str, asks: str, doc_rows: str, ask_rows: str) -> str:
    """CTE ``dist(query_id, key, score)``: squared distance of every query and document."""
    return f"""
dots AS (SELECT a.key AS query_id, d.key, sum(a.weight * d.weight) AS dot FROM {asks} a JOIN {docs} d ON a.bucket = d.bucket GROUP BY ALL),
dp AS (SELECT key, sum(weight * weight) AS power FROM {docs} GROUP BY key),
ap AS (SELECT key, sum(weight * weight) AS power FROM {asks} GROUP BY key),
dist AS (SELECT q.key AS query_id, r.key, round(coalesce(ap.power, 0) + coalesce(dp.power, 0) - 2 * coalesce(dots.dot, 0), 10) + 0.0 AS score
  FROM ({ask_rows}) q CROSS JOIN ({doc_rows}) r LEFT JOIN dots ON dots.query_id = q.key AND dots.key = r.key
  LEFT JOIN dp ON dp.key = r.key LEFT JOIN ap ON ap.key = q.key)"""


# All hits of every benchmark text among the processed documents, with their result number.
def _hits_sql() -> str:
    return f"""{SQL_PROCESSED.replace(SQL_MANIFEST, sql_manifest(TEXT_EXTENSIONS))},
docs AS (SELECT *, md5(path) AS id FROM c WHERE status = 'added'),
{_bucket_sql("dv", "docs", "id", "body")},
{_bucket_sql("qv", "benchmark", "item_id", "text")},
{_distance_sql("dv", "qv", "SELECT id AS key FROM docs", "SELECT item_id AS key FROM benchmark WHERE regexp_matches(text, '[^ ]')")},
hits AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score, key) AS rank
  FROM dist WHERE score >= 0.1)"""


_PAGE = f"""WITH {_hits_sql()},
page AS (SELECT h.*, b.text AS query, d.path, d.type, d.body, d.match_source, d.embedding_type FROM hits h JOIN docs d ON h.key = d.id
  JOIN benchmark b ON b.item_id = h.query_id WHERE rank <= 10),
{sql_occurrences('''SELECT query_id || '/' || key AS key, query,
  CASE WHEN match_source = 'file_content' THEN body ELSE string_split(path, '/')[-1] || ' ' || path END AS text FROM page''')},
{sql_snippets()},
shown AS (SELECT page.*, (SELECT count(*) FROM top t WHERE t.key = page.query_id || '/' || page.key) AS snippet_count FROM page)"""

_TERM_SEARCH = f"""WITH {_bucket_sql("dv", "documents", "doc_id", "text", TERM_BUCKETS, "DOUBLE")},
{_bucket_sql("qv", "benchmark", "item_id", "text", TERM_BUCKETS, "DOUBLE")},
s AS (SELECT qv.key AS query_id, dv.key AS doc_id, round(sum(qv.weight * dv.weight), 10) AS score FROM qv JOIN dv ON qv.bucket = dv.bucket GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""

ORACLES = {
    "hashed_embedding": f"WITH {_bucket_sql('v', 'documents', 'doc_id', 'text')} SELECT key AS doc_id, bucket, round(weight, 6) AS weight FROM v",
    "hashed_search": _TERM_SEARCH,
    "hashed_search_indexed": _TERM_SEARCH,
    "knn_debug": f"""WITH {_bucket_sql("dv", "documents", "doc_id", "text")},
{_bucket_sql("qv", "benchmark", "item_id", "text")},
{_distance_sql("dv", "qv", "SELECT doc_id AS key FROM documents", "SELECT item_id AS key FROM benchmark")},
r AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score, key) AS rank FROM dist)
SELECT query_id, r.key AS doc_id, round(score, 6) AS score, rank, substring(text, 1, 150) AS content_preview, length(text) AS content_length
FROM r JOIN documents d ON d.doc_id = r.key WHERE rank <= 10""",
    "hits_per_query": f"""WITH {_hits_sql()}
SELECT query_id, count(*) AS hits, round(min(score), 6) AS nearest, round(max(score), 6) AS farthest FROM hits GROUP BY query_id""",
    "full_text_search": f"""{_PAGE}
SELECT shown.query_id, rank, path, type, round(shown.score, 6) AS score, snippet_count, t.snippet AS first_snippet,
  round(t.score, 6) AS first_score, t.terms AS first_terms, t.match_type AS first_type
FROM shown LEFT JOIN top t ON t.key = shown.query_id || '/' || shown.key AND t.snippet_rank = 1""",
    "full_text_second_page": f"""WITH {_hits_sql()}
SELECT query_id, rank, path, round(score, 6) AS score FROM hits JOIN docs ON id = key WHERE rank BETWEEN 11 AND 20""",
    "api_projection": f"""{_PAGE},
joined AS (SELECT key, string_agg(snippet, '|' ORDER BY snippet_rank) AS snippets FROM top GROUP BY key)
SELECT query_id, rank, string_split(path, '/')[-1] AS filename, path AS filepath, substring(body, 1, 300) AS content_preview,
  CASE match_source WHEN 'file_content' THEN '✓ Match from file content' ELSE 'ℹ Match from metadata only' END AS match_type,
  embedding_type, coalesce(j.snippets, '') AS snippets
FROM shown LEFT JOIN joined j ON j.key = shown.query_id || '/' || shown.key""",
}
