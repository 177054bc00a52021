import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsift.functions.vectors import cosine, dot, l2_squared, literal_vector, sanity_columns
from docsift.operators import neighbours
from docsift.operators.embed import embed, hashed_embedding, hashed_terms
from docsift.operators.neighbours import nearest, nearest_terms, nearest_to_one
from docsift.operators.pairs import compared_share, mean_similarity_by, outermost_pairs, similarity_summary
from docsift.operators.paging import page_info, page_of
from docsift.sources.store import append_documents, open_documents
from docsift.plans.search import SearchOptions, debug_hits, text_hits, text_search, valid_queries, vector_hits, vector_page

RNG = np.random.default_rng(7)
VECTORS = RNG.normal(size=(300, 16)).round(3).astype(np.float32)
VECTORS[100:140] = VECTORS[0]  # many equal vectors
VECTORS[7] = 0


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(n, [float(x) for x in v], n % 3) for n, v in enumerate(VECTORS)]
    return spark.createDataFrame(rows, "doc_id bigint, embedding array<float>, label int").repartition(5).cache()


def brute(query, k, metric):
    rows, q = VECTORS.astype(np.float64), np.asarray(query, dtype=np.float64)
    if metric == "l2":
        cost = ((rows - q) ** 2).sum(axis=1)
    else:
        cost = -(rows @ q)
        if metric == "cosine":
            size = np.linalg.norm(rows, axis=1) * np.linalg.norm(q)
            cost = np.divide(cost, size, out=np.zeros_like(cost), where=size > 0)
    cost = np.round(cost, 10)
    order = np.lexsort((np.arange(len(rows)), cost))[:k]
    return [(int(n), pytest.approx(cost[n] if metric == "l2" else -cost[n], abs=1e-9)) for n in order]


@pytest.mark.parametrize("metric", neighbours.METRICS)
@pytest.mark.parametrize("k", [1, 10, 60, 1000])
def test_one_query_matches_brute_force(corpus, metric, k):
    for n in (0, 5):
        rows = nearest_to_one(corpus, VECTORS[n].tolist(), k, metric=metric).orderBy("rank").collect()
        assert [(row.doc_id, row.score) for row in rows] == brute(VECTORS[n], k, metric)
        assert [row.rank for row in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("blocks", [None, (1, 1), (4, 3)])
@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_many_queries_match_brute_force(corpus, metric, blocks):
    asked = corpus.filter("doc_id < 30").select(F.col("doc_id").alias("query_id"), "embedding")
    found = {}
    for row in nearest(corpus, asked, 7, metric=metric, blocks=blocks).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.doc_id, row.score))
    assert found == {n: brute(VECTORS[n], 7, metric) for n in range(30)}


def test_more_queries_than_can_travel(corpus, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 4096)
    asked = corpus.select(F.col("doc_id").alias("query_id"), "embedding")
    rows = nearest(corpus, asked, 3, max_shipped_bytes=1000).collect()
    assert len(rows) == 900
    assert all(row.score == 0 for row in rows if row.rank == 1)


def test_ranking_in_groups_of_tasks(corpus, monkeypatch):
    monkeypatch.setattr(neighbours, "RANK_GROUPS", 2)
    asked = corpus.filter("doc_id < 3").select(F.col("doc_id").alias("query_id"), "embedding")
    rows = nearest(corpus, asked, 50).orderBy("query_id", "rank").collect()
    assert [(row.doc_id, row.score) for row in rows if row.query_id == 2] == brute(VECTORS[2], 50, "l2")


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_only_the_first_copies_can_be_hits(spark, metric):
    rows = [(n, [1.0, 2.0] if n % 4 else [float(n), 1.0]) for n in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (1, [500.0, 1.0])], "query_id int, embedding array<float>")
    vectors = np.array([vector for _, vector in rows])
    for blocks in (None, (3, 1)):
        got = {}
        for row in nearest(df, asked, 9, metric=metric, blocks=blocks).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append(row.doc_id)
        for query_id, q in ((0, np.array([1.0, 2.0])), (1, np.array([500.0, 1.0]))):
            if metric == "l2":
                cost = ((vectors - q) ** 2).sum(axis=1)
            else:
                size = np.linalg.norm(vectors, axis=1) * np.linalg.norm(q) if metric == "cosine" else 1.0
                cost = -(vectors @ q) / size
            assert got[query_id] == np.lexsort((np.arange(3000), np.round(cost, 10)))[:9].tolist()


def test_small_chunks(corpus, monkeypatch):
    monkeypatch.setattr(neighbours, "_CHUNK_VALUES", 1)
    rows = nearest_to_one(corpus, VECTORS[3].tolist(), 5).orderBy("rank").collect()
    assert [(row.doc_id, row.score) for row in rows] == brute(VECTORS[3], 5, "l2")


def test_unusable_vectors_are_no_hits(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", []), ("e", [0.0, 0.0])], "doc_id string, embedding array<float>")
    assert [row.doc_id for row in nearest_to_one(df, [1.0, 0.0], 10).orderBy("rank").collect()] == ["a", "e"]
    asked = df.select(F.col("doc_id").alias("query_id"), "embedding").filter("query_id in ('a', 'b')")
    assert [(r.query_id, r.doc_id) for r in nearest(df, asked, 1).collect()] == [("a", "a")]
    assert nearest(df, asked.limit(0), 1).count() == 0


def test_stored_vector_finds_itself_and_distances_ascend(corpus):
    rows = nearest_to_one(corpus, VECTORS[42].tolist(), 50).orderBy("rank").collect()
    assert (rows[0].doc_id, rows[0].score) == (42, 0)
    assert [row.score for row in rows] == sorted(row.score for row in rows)


def test_helpers_run_once(spark):
    docs = embed(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id int, content string"))
    plan = nearest_to_one(docs.filter("size(embedding) > 1"), [0.0] * 256, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sparse_search_is_cosine(spark):
    texts = ["the sea is deep", "the ocean is blue and deep", "cats are fluffy", "", "sea sea sea"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    terms = docs.select("doc_id", hashed_terms(F.col("text"), 1 << 20).alias("terms")).repartition(3)
    asked = terms.select(F.col("doc_id").alias("query_id"), "terms")
    dense = docs.select("doc_id", hashed_embedding(F.col("text"), 4096).alias("embedding"))
    want = nearest(dense, dense.select(F.col("doc_id").alias("query_id"), "embedding"), 5, metric="cosine").filter("score > 1e-6")
    expected = {(r.query_id, r.doc_id): pytest.approx(r.score, abs=1e-6) for r in want.collect()}
    for blocks in (None, (2, 2)):
        got = {(r.query_id, r.doc_id): r.score for r in nearest_terms(terms, asked, 5, blocks=blocks).collect()}
        assert got == expected


def test_vector_columns(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    first, second = df.select(l2_squared(a, b).alias("l"), dot(a, b).alias("d"), cosine(a, b).alias("c")).collect()
    assert (first.l, first.d, first.c) == (13.0, 1.0, pytest.approx(1 / 50**0.5))
    assert (second.l, second.d, second.c) == (2.0, 0.0, 0.0)
    facts = df.select(*[c.alias(n) for n, c in sanity_columns(F.col("a")).items()]).collect()
    assert [tuple(row) for row in facts] == [(2, False, 2.5, False), (2, True, 0.0, True)]
    assert df.select(dot(F.col("a"), literal_vector([2, 1]))).first()[0] == 4.0


SENTENCES = [
    "The ocean is vast and full of mysterious creatures",
    "Bart  works    for    ENTER, a company in Eindhoven",
    "The sea contains many undiscovered species",
    "Machine learning models can generate text embeddings",
    "Vector similarity measures how close two sentences are in meaning",
    "Python is great for data science, Bart and machine learning",
    "The deep sea holds secrets we haven't explored yet",
]


def test_sentence_pairs(spark):
    df = embed(spark.createDataFrame(list(enumerate(SENTENCES)), "id int, content string"))
    summary = similarity_summary(df, "id", "embedding").first()
    assert summary.pairs == 21
    sides = outermost_pairs(df, "id", "embedding").orderBy("side", "position").collect()
    assert [(row.side, row.position) for row in sides] == [(s, n) for s in ("least", "most") for n in (1, 2, 3)]
    assert sides[3].sim == pytest.approx(summary.max_similarity)


@pytest.mark.parametrize("block_rows", [10_000, 37])
def test_pairs_match_brute_force(corpus, block_rows):
    rows = VECTORS.astype(np.float64)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = rows / np.where(size == 0, 1, size)
    sims = np.round(unit @ unit.T, 10)
    i, j = np.triu_indices(len(rows), 1)
    values = sims[i, j]
    row = similarity_summary(corpus, "doc_id", "embedding", block_rows=block_rows).first()
    assert row.pairs == len(values)
    got = (row.mean_similarity, row.std_similarity, row.min_similarity, row.max_similarity)
    assert got == pytest.approx((values.mean(), values.std(), values.min(), values.max()), abs=1e-9)
    ends = outermost_pairs(corpus, "doc_id", "embedding", keep=4, block_rows=block_rows).collect()
    for side, sign in (("most", -1), ("least", 1)):
        order = np.lexsort((j, i, sign * values))[:4]
        want = [(n + 1, i[at], j[at], pytest.approx(values[at], abs=1e-9)) for n, at in enumerate(order)]
        assert sorted((r.position, r.i, r.j, r.sim) for r in ends if r.side == side) == want
    for label_row in similarity_summary(corpus, "doc_id", "embedding", F.col("label"), block_rows).collect():
        inside = (i % 3 == int(label_row.label)) & (j % 3 == int(label_row.label))
        assert (label_row.pairs, label_row.mean_similarity) == (inside.sum(), pytest.approx(values[inside].mean()))
    for label_row in mean_similarity_by(corpus, "label", "embedding").collect():
        inside = (i % 3 == label_row.label) & (j % 3 == label_row.label)
        assert (label_row.dimension, label_row.mean_similarity) == (16, pytest.approx(values[inside].mean(), abs=1e-6))


def test_threshold_modes(corpus):
    vector = VECTORS[0].tolist()
    # Forty-one stored vectors equal the query; "reference" drops exactly those.
    kept = vector_hits(corpus, vector, SearchOptions(page_size=300))
    assert kept.count() == 300 - 41 and kept.filter("score < 0.1").count() == 0
    close = vector_hits(corpus, vector, SearchOptions(threshold_mode="max_distance", page_size=300))
    assert close.count() == 41
    with pytest.raises(ValueError):
        SearchOptions(threshold_mode="other").keeps(F.lit(1.0))


def test_pages_make_up_the_whole_list(corpus):
    vector, size = VECTORS[9].tolist(), 13
    whole = [r.doc_id for r in vector_hits(corpus, vector, SearchOptions(page_size=300)).orderBy("rank").collect()]
    pages = []
    for page in range(1, 25):
        options = SearchOptions(page=page, page_size=size)
        pages += [r.doc_id for r in vector_page(corpus, vector, options).orderBy("rank").collect()]
    assert pages == whole


def test_page_numbers(spark):
    def info(total, page):
        row = page_info(spark.range(total), page, 10).first()
        return row.total_pages, row.start_index, row.end_index, row.has_next, row.has_prev

    assert info(0, 1) == (1, 0, 0, False, False)
    assert info(21, 3) == (3, 21, 21, False, True)
    assert info(21, 1) == (3, 1, 10, True, False)
    assert info(21, 4) == (3, 0, 0, False, True)
    assert page_of(spark.range(1, 22).withColumnRenamed("id", "rank"), 3, 10).count() == 1


def _library(spark):
    rows = [
        ("1", "deep sea creatures live in the deep sea and nowhere else", "file_content"),
        ("2", "python programming for machine learning beginners", "file_content"),
        ("3", "tiny", "file_content"),
        ("4", "Femap 3D model file: python.modfem", "metadata_only"),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, content string, match_source string")
    docs = docs.withColumns({"filename": F.concat("doc_id", F.lit(".txt")), "path": F.concat(F.lit("/python/"), "doc_id", F.lit(".txt"))})
    return embed(docs)


def test_text_search(spark):
    queries = spark.createDataFrame([(1, "python programming"), (2, "   "), (3, "deep sea")], "query_id int, query string")
    assert [r.query_id for r in valid_queries(queries).orderBy("query_id").collect()] == [1, 3]
    rows = text_search(_library(spark), queries).orderBy("query_id", "rank").collect()
    assert {(r.query_id, r.doc_id) for r in rows} == {(q, d) for q in (1, 3) for d in "124"}
    first = rows[0]
    assert (first.query_id, first.doc_id, first.snippets[0].match_type) == (1, "2", "exact_phrase")
    # A document without text is matched on its name and path.
    model = next(r for r in rows if r.query_id == 1 and r.doc_id == "4")
    assert model.snippets[0].snippet == "4.txt /python/4.txt"
    unfiltered = text_hits(_library(spark), queries, SearchOptions(filter_empty=False))
    assert unfiltered.filter("query_id = 1").count() == 4


def test_debug_hits(spark):
    library = _library(spark)
    vector = list(library.filter("doc_id = '2'").first().embedding)
    rows = debug_hits(library, vector, 2, "content").orderBy("rank").collect()
    assert (rows[0].doc_id, rows[0].score, rows[0].content_length) == ("2", 0.0, 49)


def test_copies_are_hits_of_their_own(spark, tmp_path):
    docs = _library(spark).withColumn("type", F.lit("text")).drop("is_empty")
    docs = docs.withColumns({"is_empty": F.lit(False), "text_chars": F.length("content").cast("bigint")})
    for _ in range(2):
        append_documents(docs, str(tmp_path / "store"))
    stored = open_documents(spark, str(tmp_path / "store"))
    queries = spark.createDataFrame([(1, "python programming")], "query_id int, query string")
    rows = text_search(stored, queries).orderBy("rank").collect()
    assert [row.doc_id for row in rows].count("2") == 2 and len({row.row_id for row in rows}) == len(rows) == 6
    # "tiny" is shorter than ten characters by its stored length.
    assert "3" not in {row.doc_id for row in rows}
    assert rows[0].snippets[0].match_type == "exact_phrase"


def test_many_hits_are_joined_without_a_lookup(spark, monkeypatch):
    monkeypatch.setattr("docsift.plans.search.MAX_PUSHED_IDS", 1)
    monkeypatch.setattr("docsift.plans.search.MAX_BROADCAST_HITS", 1)
    queries = spark.createDataFrame([(1, "python programming"), (3, "deep sea")], "query_id int, query string")
    assert text_search(_library(spark), queries).count() == 6


def test_pairs_with_very_many_equal_vectors(spark):
    rows = [(n, [1.0, 0.0] if n % 3 else [0.0, 1.0 + n]) for n in range(400)]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    for block_rows in (1000, 50):
        ends = {(r.side, r.position): (r.i, r.j, r.sim) for r in outermost_pairs(df, "id", "v", block_rows=block_rows).collect()}
        assert ends == {
            ("most", 1): (0, 3, 1.0), ("most", 2): (0, 6, 1.0), ("most", 3): (0, 9, 1.0),
            ("least", 1): (0, 1, 0.0), ("least", 2): (0, 2, 0.0), ("least", 3): (0, 4, 0.0),
        }


@pytest.mark.parametrize("grouped", [False, True])
def test_far_blocks_are_not_compared(spark, grouped):
    """Clusters, a vector of zeros and repeated vectors: the same extremes, from a small share of the pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 24)) * 0.02
    rows[7], rows[1500:1504] = 0, rows[3]
    df = spark.createDataFrame([(n, n % 2, row.tolist()) for n, row in enumerate(rows)] + [(9999, 0, None), (9998, 0, []), (9997, None, [1.0] * 24)],
                               "id bigint, label int, v array<double>")
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = rows / np.where(size == 0, 1, size)
    sims = np.round(unit @ unit.T, 10)
    i, j = np.triu_indices(len(rows), 1)
    if grouped:
        for row in similarity_summary(df, "id", "v", F.col("label"), block_rows=60).collect():
            values = sims[i, j][(i % 2 == int(row.label)) & (j % 2 == int(row.label))]
            got = (row.mean_similarity, row.std_similarity, row.min_similarity, row.max_similarity)
            assert got == pytest.approx((values.mean(), values.std(), values.min(), values.max()), abs=1e-9)
        return
    df = df.where("label is not null")
    ends = outermost_pairs(df, "id", "v", keep=5, block_rows=60).collect()
    for side, sign in (("most", -1), ("least", 1)):
        order = np.lexsort((j, i, sign * sims[i, j]))[:5]
        got = sorted((r.position, r.i, r.j, r.sim) for r in ends if r.side == side)
        assert got == [(n + 1, i[at], j[at], pytest.approx(sims[i[at], j[at]], abs=1e-9)) for n, at in enumerate(order)]
    share = compared_share(df, "id", "v", keep=5, block_rows=60).first()
    assert share.pairs == len(i) and 0 < share.compared < 0.3 * share.pairs


def test_pairs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, v array<double>")
    assert similarity_summary(df, "id", "v").collect() == outermost_pairs(df, "id", "v").collect() == []
    assert compared_share(df, "id", "v").first().asDict() == {"pairs": 0, "compared": 0}


def test_every_vector_length_is_searched(spark):
    rows = [(n, [float(n + m) for m in range(2 + n % 3)]) for n in range(30)] + [(30, None), (31, []), (32, [1.0])]
    df = spark.createDataFrame(rows, "doc_id bigint, embedding array<float>").repartition(4)
    asked = df.where("doc_id < 30").select(F.col("doc_id").alias("query_id"), "embedding")
    want = []
    for q, query in rows[:30]:
        found = sorted((sum((a - b) ** 2 for a, b in zip(query, v)), n) for n, v in rows if v and len(v) == len(query))
        want += [(q, n, cost) for cost, n in found[:3]]
    for blocks in (None, (3, 2)):
        got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in nearest(df, asked, 3, blocks=blocks).collect())
        assert [(q, n, cost) for q, _, n, cost in got] == want
    totals = neighbours.score_summary(df, asked, (0.0, 1e9)).collect()
    assert {r.query_id: r.hits for r in totals} == dict.fromkeys(range(30), 10)
    lone = neighbours.not_compared(df, asked.unionByName(spark.createDataFrame([(99, [0.0] * 7)], "query_id bigint, embedding array<float>")))
    assert sorted(map(tuple, lone.collect()), key=repr) == sorted([
        ("document", "30", None, "no vector"), ("document", "31", 0, "no vector"), ("document", "32", 1, "no such query"),
        ("query", "99", 7, "no such document"),
    ], key=repr)


def test_many_queries_are_cut_into_enough_blocks():
    # one pair of blocks for all vectors before, so one task
    docs, asks = neighbours._block_counts(102_564, 102_564, 512, 12)
    assert docs * asks >= 24
    assert neighbours._block_counts(300, 300, 512, 12) == (1, 1)
    # given numbers of blocks are the least; no block passes its bytes
    docs, asks = neighbours._block_counts(4_000_000, 1_000_000, 512, 12, (4, 2))
    assert docs * neighbours.BLOCK_BYTES >= 4_000_000 * 512 and asks * neighbours.BLOCK_BYTES >= 1_000_000 * 512


def test_many_queries_in_one_partition_are_spread(corpus, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_SHIPPED_QUERIES", 50)
    monkeypatch.setattr(neighbours, "BLOCK_PAIRS", 5_000)
    cut = []
    inner = neighbours._block_candidates
    monkeypatch.setattr(neighbours, "_block_candidates", lambda *args: cut.append(args[5]) or inner(*args))
    one = corpus.coalesce(1)
    got = nearest(one, one, 5, query_id="doc_id").orderBy("query_id", "rank").collect()
    assert cut and cut[0][0] * cut[0][1] >= min(2 * one.sparkSession.sparkContext.defaultParallelism, 18)
    want = [(q, at, score) for q in range(300) for at, score in brute(VECTORS[q], 5, "l2")]
    assert [(r.query_id, r.doc_id, r.score) for r in got] == want


def test_many_sparse_queries_are_no_matrix(monkeypatch):
    # all queries were one dense matrix in every task before
    entry = pa.struct([("bucket", pa.int32()), ("weight", pa.float64())])
    vectors = pa.array([[{"bucket": n, "weight": 0.6}, {"bucket": n + 1, "weight": 0.8}] for n in range(400)], pa.list_(entry))
    ids, sizes = pa.array(range(400), pa.int64()), []
    monkeypatch.setattr(neighbours, "_HELD_VALUES", 1_000)
    monkeypatch.setattr(neighbours, "_CHUNK_VALUES", 20_000)
    best = neighbours._Best(ids, vectors, neighbours._sparse_scorer, 1, "dot", neighbours.EVERY_SCORE, pa.int64())
    inner = best.to_rows
    best.to_rows = lambda part: sizes.append(len(part)) or inner(part)
    best.add(ids, vectors)
    assert best.held is None and max(sizes) * best.width <= 20_000
    assert best.ids[:, 0].tolist() == list(range(400))


def test_python_gets_batches_bounded_in_bytes(spark):
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = rows.mapInArrow(lambda batches: (pa.record_batch({"n": [b.num_rows]}) for b in batches), "n bigint").collect()
    assert len(sizes) >= 8 and max(row.n for row in sizes) < 1000
