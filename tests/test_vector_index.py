import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import vector_index
from docsift.operators.neighbours import nearest
from docsift.operators.vector_index import RESCORED, approximate_in_index, build_index, nearest_in_index, open_index
from docsift.queries.vectors import QUERIES
from docsift.session import shared_path

RNG = np.random.default_rng(11)
# twelve far clusters, one of them of equal vectors
CLUSTERS = RNG.normal(size=(12, 10)) * 40
VECTORS = np.concatenate([c + RNG.normal(size=(40, 10)) * (n > 0) for n, c in enumerate(CLUSTERS)]).astype(np.float32)


def key(found):
    return sorted((str(r.query_id), r["rank"], str(r.doc_id), r.score) for r in found.collect())


@pytest.fixture(scope="module")
def rows(spark):
    own = [(n, [float(x) for x in v]) for n, v in enumerate(VECTORS)]
    own += [(n, own[n][1]) for n in range(60, 70)] + [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [0.5, 2.0, 3.0]), (None, own[3][1])]
    return spark.createDataFrame(own, "doc_id bigint, embedding array<float>").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, rows):
    return build_index(rows, shared_path(spark, "index"))


@pytest.fixture(scope="module")
def asked(rows):
    return rows.where("doc_id % 5 = 2 OR doc_id = 900").select(F.col("doc_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])


@pytest.mark.parametrize("k", [1, 7, 60, 1000])
def test_exact_search_skips_nothing_that_counts(rows, index, asked, k):
    want = key(nearest(rows, asked, k))
    assert key(nearest_in_index(index, asked, k)) == want


def test_all_rows_with_a_vector_are_in_the_lists(index, rows):
    assert index.rows.count() == rows.where(F.size("embedding") > 0).count() == sum(index.sizes.values())


def test_large_lists_and_many_queries_are_cut(rows, index, asked, monkeypatch):
    want = key(nearest(rows, asked, 12))
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 900)
    assert key(nearest_in_index(index, asked, 12)) == want
    monkeypatch.setattr(vector_index, "GROUP_ROWS", 30)
    monkeypatch.setattr(vector_index, "GROUP_QUERIES", 10)
    assert key(approximate_in_index(index, asked, 12, rescored=1000)) == want


def test_approximate_search_with_all_rows_rescored_is_exact(rows, index, asked):
    assert key(approximate_in_index(index, asked, 9, rescored=1000)) == key(nearest(rows, asked, 9))


def test_a_few_lists_are_enough_where_there_are_clusters(rows, index, asked):
    exact, found = key(nearest(rows, asked, 5)), key(approximate_in_index(index, asked, 5, probes=3, rescored=60))
    assert len({x[::2] for x in exact} & {x[::2] for x in found}) >= 0.95 * len(exact)


def test_far_lists_are_not_opened(spark, rows):
    path = shared_path(spark, "index")
    index = build_index(rows, path)
    near = rows.where("doc_id = 50").select(F.col("doc_id").alias("query_id"), "embedding")
    far = rows.where("doc_id = 450").select(F.col("doc_id").alias("query_id"), "embedding")
    own = {r.cell for r in index.rows.where("dim = 10").select("cell", "id").where("id BETWEEN 440 AND 479").distinct().collect()}
    for cell in own:
        for file in glob.glob(f"{path}/lists/dim=10/cell={cell}/*.parquet"):
            with open(file, "wb") as out:
                out.write(b"no parquet")
            crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
            if os.path.exists(crc):
                os.remove(crc)
    assert key(nearest_in_index(index, near, 10)) == key(nearest(rows, near, 10))
    assert len(key(approximate_in_index(index, near, 10, probes=2))) == 10
    with pytest.raises(Exception, match="(?i)parquet"):
        nearest_in_index(index, far, 10).collect()


def test_an_index_is_opened_again(spark, rows, asked):
    path = shared_path(spark, "index")
    build_index(rows, path)
    assert key(nearest_in_index(open_index(spark, path), asked, 4)) == key(nearest(rows, asked, 4))


def test_empty_tables_and_string_ids(spark, index, rows):
    empty = spark.createDataFrame([], "doc_id bigint, embedding array<float>")
    assert nearest_in_index(index, empty.withColumnRenamed("doc_id", "query_id"), 3).count() == 0
    none = build_index(empty, shared_path(spark, "index"))
    one = rows.limit(1).select(F.col("doc_id").alias("query_id"), "embedding")
    assert nearest_in_index(none, one, 3).count() == 0 and approximate_in_index(none, one, 3).count() == 0
    names = rows.where("doc_id < 200").withColumn("doc_id", F.concat(F.lit("v"), "doc_id"))
    named = build_index(names, shared_path(spark, "index"))
    asks = names.where("doc_id = 'v7'").select(F.col("doc_id").alias("query_id"), "embedding")
    assert key(nearest_in_index(named, asks, 5)) == key(nearest(names, asks, 5))
    assert key(approximate_in_index(named, asks, 5, rescored=200)) == key(nearest(names, asks, 5))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_recall_and_share_of_the_registered_search(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    asks = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.doc_id) for r in nearest(table, asks, 10, id_col="vec_id").collect()}
    found = QUERIES["knn_lsh"](spark, folder).collect()
    recall = len(exact & {(r.query_id, r.vec_id) for r in found}) / len(exact)
    share = RESCORED / table.count()
    print(f"recall {recall:.4f}, scored {share:.4f}")
    assert recall >= 0.9 and share <= 0.2 and len(exact) == 10 * asks.count()
