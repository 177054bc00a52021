"""Queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.functions.vectors import sanity_columns
from docsift.operators.neighbours import nearest, nearest_to_one, vector_of
from docsift.operators.pairs import mean_similarity_by, outermost_pairs, similarity_summary
from docsift.operators.vector_index import approximate_in_index, build_index, nearest_in_index
from docsift.plans.search import SearchOptions, vector_hits, vector_page, vector_page_info
from docsift.queries.common import rounded, sql_cosine, sql_dot, sql_l2, table
from docsift.session import shared_path

_COLUMNS = {"id_col": "vec_id", "vector_col": "embedding"}


def _corpus(spark, folder):
    corpus = table(spark, folder, "embeddings")
    return corpus, vector_of(corpus, 0, **_COLUMNS)


def _shown(hits):
    return hits.select(F.col("doc_id").alias("vec_id"), rounded("score").alias("score"), "rank")


def knn_single(spark, folder):
    corpus, vector = _corpus(spark, folder)
    return _shown(nearest_to_one(corpus, vector, 10, **_COLUMNS))


def knn_cosine(spark, folder):
    corpus, vector = _corpus(spark, folder)
    return _shown(nearest_to_one(corpus, vector, 10, metric="cosine", **_COLUMNS))


def knn_batch(spark, folder):
    corpus, _ = _corpus(spark, folder)
    found = nearest(corpus, corpus, 5, query_id="vec_id", query_vector="embedding", **_COLUMNS)
    return found.select("query_id", F.col("doc_id").alias("vec_id"), rounded("score").alias("score"), "rank")


def knn_batch_blocks(spark, folder):
    """The same through the path for more queries than a task can carry."""
    corpus, _ = _corpus(spark, folder)
    found = nearest(corpus, corpus, 5, query_id="vec_id", query_vector="embedding", blocks=(4, 2), **_COLUMNS)
    return found.select("query_id", F.col("doc_id").alias("vec_id"), rounded("score").alias("score"), "rank")


def knn_threshold_reference(spark, folder):
    corpus, vector = _corpus(spark, folder)
    return _shown(vector_hits(corpus, vector, SearchOptions(), **_COLUMNS))


def knn_threshold_max_distance(spark, folder):
    corpus, vector = _corpus(spark, folder)
    options = SearchOptions(threshold_mode="max_distance", score_threshold=1.6)
    return _shown(vector_hits(corpus, vector, options, **_COLUMNS))


def search_page(spark, folder):
    corpus, vector = _corpus(spark, folder)
    return _shown(vector_page(corpus, vector, SearchOptions(), **_COLUMNS))


def search_second_page(spark, folder):
    corpus, vector = _corpus(spark, folder)
    return _shown(vector_page(corpus, vector, SearchOptions(page=2), **_COLUMNS))


def search_page_info(spark, folder):
    corpus, vector = _corpus(spark, folder)
    return vector_page_info(corpus, vector, SearchOptions(page=2), **_COLUMNS)


def _indexed(spark, folder):
    """The index of all rows, and every hundredth row as a query."""
    corpus = table(spark, folder, "embeddings")
    index = build_index(corpus, shared_path(spark, "vectors"), **_COLUMNS)
    return index, corpus.where("vec_id % 100 = 0")


def _index_hits(found):
    return found.select("query_id", F.col("doc_id").alias("vec_id"), rounded("score").alias("score"), "rank")


def knn_lsh(spark, folder):
    """Approximate neighbours of every hundredth row among all rows, through the codes of the index."""
    index, asked = _indexed(spark, folder)
    return _index_hits(approximate_in_index(index, asked, 10, query_id="vec_id"))


def knn_indexed(spark, folder):
    """Exact neighbours of every hundredth row, without the lists that are too far."""
    index, asked = _indexed(spark, folder)
    return _index_hits(nearest_in_index(index, asked, 10, query_id="vec_id"))


def pairwise_top_bottom(spark, folder):
    corpus, _ = _corpus(spark, folder)
    return outermost_pairs(corpus, "vec_id", "embedding").withColumn("sim", rounded("sim"))


_MOMENTS = ("mean_similarity", "std_similarity", "min_similarity", "max_similarity")


def pairwise_summary(spark, folder):
    corpus, _ = _corpus(spark, folder)
    return similarity_summary(corpus, "vec_id", "embedding").withColumns({name: rounded(name) for name in _MOMENTS})


def pairwise_by_label(spark, folder):
    corpus, _ = _corpus(spark, folder)
    return similarity_summary(corpus, "vec_id", "embedding", F.col("label")).withColumns(
        {name: rounded(name) for name in _MOMENTS}
    )


def label_mean_similarity(spark, folder):
    corpus, _ = _corpus(spark, folder)
    return mean_similarity_by(corpus, "label", "embedding").withColumn("mean_similarity", rounded("mean_similarity"))


def embedding_sanity(spark, folder):
    corpus, _ = _corpus(spark, folder)
    facts = sanity_columns(F.col("embedding"))
    return corpus.select("vec_id", *[column.alias(name) for name, column in facts.items()]).withColumn(
        "mean_square", rounded("mean_square")
    )


QUERIES = {
    f.__name__: f
    for f in (
        knn_single, knn_cosine, knn_batch, knn_batch_blocks, knn_threshold_reference, knn_threshold_max_distance,
        search_page, search_second_page, search_page_info, knn_lsh, knn_indexed,
        pairwise_top_bottom, pairwise_summary, pairwise_by_label, label_mean_similarity, embedding_sanity,
    )
}


def _ranked_sql(distance: str, order: str) -> str:
    return f"""
d AS (SELECT e.vec_id, round({distance}, 10) AS score FROM embeddings e,
        (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0) q),
raw AS (SELECT vec_id, score, row_number() OVER (ORDER BY {order}, vec_id) AS raw_rank FROM d)"""


_L2 = _ranked_sql(sql_l2("e.embedding", "q.qv"), "score")
_COSINE = _ranked_sql(sql_cosine("e.embedding", "q.qv"), "score DESC")


def _hits_sql(keep: str, page: str = "rank <= 10") -> str:
    return f"""WITH {_L2},
k AS (SELECT vec_id, score, row_number() OVER (ORDER BY score, vec_id) AS rank
      FROM raw WHERE score {keep})
SELECT vec_id, round(score, 6) AS score, rank FROM k WHERE {page}"""


_BATCH = f"""
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, round({sql_l2("e.embedding", "q.embedding")}, 10) AS score
           FROM embeddings e, embeddings q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""

_HUNDREDTH = _BATCH.replace("embeddings q)", "embeddings q WHERE q.vec_id % 100 = 0)").replace("rank <= 5", "rank <= 10")

_PAIRS = f"""
p AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label, b.label AS other_label,
             round({sql_cosine("a.embedding", "b.embedding")}, 10) AS sim
      FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id)"""

_MOMENTS_SQL = """count(*) AS pairs, round(avg(sim), 6) AS mean_similarity, round(stddev_pop(sim), 6) AS std_similarity,
  round(min(sim), 6) AS min_similarity, round(max(sim), 6) AS max_similarity"""

ORACLES = {
    "knn_single": f"WITH {_L2} SELECT vec_id, round(score, 6) AS score, raw_rank AS rank FROM raw WHERE raw_rank <= 10",
    "knn_cosine": f"WITH {_COSINE} SELECT vec_id, round(score, 6) AS score, raw_rank AS rank FROM raw WHERE raw_rank <= 10",
    "knn_batch": _BATCH,
    "knn_batch_blocks": _BATCH,
    "knn_indexed": _HUNDREDTH,
    # the codes miss none of these neighbours among a thousand rows and fewer
    "knn_lsh": _HUNDREDTH,
    "knn_threshold_reference": _hits_sql(">= 0.1"),
    "knn_threshold_max_distance": _hits_sql("<= 1.6"),
    "search_page": _hits_sql(">= 0.1", "rank BETWEEN 1 AND 10"),
    "search_second_page": _hits_sql(">= 0.1", "rank BETWEEN 11 AND 20"),
    "search_page_info": f"""WITH {_L2},
t AS (SELECT count(*) AS n, count(*) AS shown FROM raw WHERE score >= 0.1)
SELECT 2::BIGINT AS current_page, 10::BIGINT AS page_size, n AS total_results,
  (CASE WHEN n > 0 THEN ceil(n / 10) ELSE 1 END)::BIGINT AS total_pages,
  2 < (CASE WHEN n > 0 THEN ceil(n / 10) ELSE 1 END) AS has_next, TRUE AS has_prev,
  (CASE WHEN shown > 10 THEN 11 ELSE 0 END)::BIGINT AS start_index,
  (CASE WHEN shown > 10 THEN least(20, n) ELSE 0 END)::BIGINT AS end_index FROM t""",
    "pairwise_top_bottom": f"""WITH {_PAIRS},
r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, i, j) AS most, row_number() OVER (ORDER BY sim, i, j) AS least FROM p)
SELECT 'most' AS side, most AS position, i, j, round(sim, 6) AS sim FROM r WHERE most <= 3
UNION ALL SELECT 'least', least, i, j, round(sim, 6) FROM r WHERE least <= 3""",
    "pairwise_summary": f"WITH {_PAIRS} SELECT {_MOMENTS_SQL} FROM p",
    "pairwise_by_label": f"WITH {_PAIRS} SELECT label::VARCHAR AS label, {_MOMENTS_SQL} FROM p WHERE label = other_label GROUP BY label",
    "label_mean_similarity": f"""WITH {_PAIRS},
s AS (SELECT label, avg(sim) AS mean_similarity FROM p WHERE label = other_label GROUP BY label)
SELECT e.label, count(*) AS vectors, max(len(e.embedding))::BIGINT AS dimension, round(any_value(s.mean_similarity), 6) AS mean_similarity
FROM embeddings e LEFT JOIN s ON e.label = s.label GROUP BY e.label""",
    "embedding_sanity": f"""
SELECT vec_id, len(embedding)::BIGINT AS dimension,
  len(list_filter(embedding, lambda x: x <> 0)) = 0 AS all_zero,
  round({sql_dot("embedding", "embedding")} / greatest(1, len(embedding)), 6) AS mean_square,
  {sql_dot("embedding", "embedding")} / greatest(1, len(embedding)) < 1e-4 AS low_power
FROM embeddings""",
}
