"""Nothing is dropped: long texts, deep pages, complete totals, fresh documents, files that can't be read."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators.embed import hashed_embedding
from docsift.operators.neighbours import nearest, score_summary
from docsift.operators.snippets import with_snippets
from docsift.plans.index import added_documents, process_files
from docsift.plans.search import SearchOptions, hit_totals, text_search, vector_hits, vector_page, vector_page_info
from docsift.sources.files import scan_files
from docsift.sources.store import append_documents, open_documents, upsert_documents

VECTORS = np.random.default_rng(5).random((2500, 4)).astype(np.float32)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(n, vector.tolist()) for n, vector in enumerate(VECTORS)]
    return spark.createDataFrame(rows, "doc_id bigint, embedding array<float>").repartition(5)


def brute(query, least):
    costs = np.round(((VECTORS.astype(float) - query) ** 2).sum(axis=1), 10)
    return [int(n) for n in np.lexsort((np.arange(len(costs)), costs)) if costs[n] >= least]


def test_pages_past_a_thousand_hits_and_totals(corpus):
    vector = VECTORS[3].astype(float)
    want = brute(vector, 0.1)
    assert len(want) > 1500
    page = vector_page(corpus, vector.tolist(), SearchOptions(page=120, page_size=10)).orderBy("rank").collect()
    assert [r.doc_id for r in page] == want[1190:1200] and page[0].rank == 1191
    info = vector_page_info(corpus, vector.tolist(), SearchOptions(page=120)).first()
    assert (info.total_results, info.start_index, info.end_index) == (len(want), 1191, 1200)


@pytest.mark.parametrize("blocks", [None, (3, 2)])
def test_limits_hold_before_ranking(spark, corpus, blocks):
    asked = spark.createDataFrame([(n, VECTORS[n].tolist()) for n in (1, 2)], "query_id int, embedding array<float>")
    found = nearest(corpus, asked, 20, limits=(0.1, 0.3), blocks=blocks).orderBy("query_id", "rank").collect()
    for n in (1, 2):
        costs = np.round(((VECTORS.astype(float) - VECTORS[n].astype(float)) ** 2).sum(axis=1), 10)
        want = [int(d) for d in np.lexsort((np.arange(2500), costs)) if 0.1 <= costs[d] <= 0.3][:20]
        assert [r.doc_id for r in found if r.query_id == n] == want
    totals = {r.query_id: r for r in score_summary(corpus, asked, (0.1, 0.3)).collect()}
    costs = np.round(((VECTORS.astype(float) - VECTORS[1].astype(float)) ** 2).sum(axis=1), 10)
    inside = costs[(costs >= 0.1) & (costs <= 0.3)]
    assert (totals[1].hits, totals[1].nearest, totals[1].farthest) == (len(inside), inside.min(), inside.max())


def test_limits_that_few_rows_meet(corpus):
    vector = VECTORS[0].tolist()
    close = vector_hits(corpus, vector, SearchOptions(threshold_mode="max_distance", score_threshold=0.0, page_size=50))
    assert [r.doc_id for r in close.collect()] == [0]


def test_words_behind_the_first_hundred_thousand_characters_count(spark):
    df = spark.createDataFrame([("filler " * 20_000 + "needle",), ("filler " * 20_000,)], "text string")
    one, other = [r[0] for r in df.select(hashed_embedding(F.col("text"))).collect()]
    assert one != other


def _processed(spark, texts):
    rows = [(f"/docs/{name}.txt", text, len(text)) for name, text in texts.items()]
    files = spark.createDataFrame(rows, "path string, content string, size_bytes bigint")
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return added_documents(process_files(files.withColumns({"created_time": at, "modified_time": at}), at), hashed_embedding)


def test_fresh_documents_replace_stored_ones_and_are_found(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    append_documents(_processed(spark, {"sea": "the deep sea and its creatures", "sun": "the sun and all its planets"}), first)
    fresh = _processed(spark, {"sea": "a dry desert with camels and sand", "new": "completely new words about gardens"})
    upsert_documents(open_documents(spark, first), fresh.unionAll(fresh), second)
    now = open_documents(spark, second)
    assert sorted(r.filename for r in now.collect()) == ["new.txt", "sea.txt", "sun.txt"]
    assert now.filter("row_id IS NULL").count() == 0
    queries = spark.createDataFrame([(1, "desert camels"), (2, "deep sea creatures")], "query_id int, query string")
    options = SearchOptions(threshold_mode="max_distance", score_threshold=1.9)
    found = {(r.query_id, r.filename) for r in text_search(now, queries, options).filter("rank = 1").collect()}
    assert (1, "sea.txt") in found
    totals = {r.query_id: r.hits for r in hit_totals(now, queries, options).collect()}
    assert totals[1] >= 1


def test_long_files_fail_alone_and_left_out_files_stay_unread(spark, tmp_path):
    for place, size in (("ok.txt", 40), ("long.txt", 4000), ("node_modules/long.txt", 4000), ("lib.so", 4000), (".git/a b.txt", 40)):
        path = tmp_path / place
        path.parent.mkdir(exist_ok=True)
        path.write_text("words " * (size // 6))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        processed = process_files(scan_files(spark, str(tmp_path), exclude_dirs=[]))
        got = {r.filename: (r.status, r.size_bytes) for r in processed.select("filename", "status", "size_bytes").collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got["ok.txt"][0] == "added" and got["long.txt"][0] == "failed" and set(got) == {"ok.txt", "long.txt"}


def test_snippets_take_time_in_proportion_to_the_text(spark):
    def seconds(matches):
        hits = spark.createDataFrame([(1, "needle in some hay " * matches, "needle")], "query_id int, text string, query string")
        start = time.perf_counter()
        shown = with_snippets(hits, ["query_id"], F.col("text"), F.col("query")).collect()[0].snippets
        assert shown and shown[0].match_type == "exact_phrase"
        return time.perf_counter() - start

    seconds(10)
    assert seconds(40_000) < 20
