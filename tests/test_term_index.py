import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import term_index
from docsift.operators.neighbours import nearest_terms
from docsift.operators.term_index import best_in_term_index, build_term_index, open_term_index, read_share
from docsift.session import shared_path

RNG = np.random.default_rng(5)
KIND = "array<struct<bucket:int,weight:double>>"


def unit(buckets, counts):
    length = float(np.sqrt(np.square(counts).sum()))
    return [(int(b), float(c) / length) for b, c in zip(buckets, counts, strict=True)]


def drawn(size):
    """Common low buckets and rare high ones; bucket 0 is in every row."""
    buckets = np.unique(np.concatenate([[0], (RNG.pareto(0.7, size) * 3).astype(int) % 4000]))
    return unit(buckets, RNG.integers(1, 6, len(buckets)))


VECTORS = [drawn(RNG.integers(1, 40)) for _ in range(600)]


def key(found):
    return sorted((str(r.query_id), r["rank"], str(r.doc_id), r.score) for r in found.collect())


@pytest.fixture(scope="module")
def rows(spark):
    own = list(enumerate(VECTORS)) + [(n, VECTORS[3]) for n in range(700, 900)]
    own += [(900, None), (901, []), (None, VECTORS[7]), (5, VECTORS[9]), (902, [(0, 0.0), (17, 1.0)])]
    return spark.createDataFrame(own, f"doc_id bigint, terms {KIND}").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(spark):
    own = [(n, VECTORS[n]) for n in (3, 7, 50, 51, 52)] + [(60, [(3999, 0.6), (0, 0.8)]), (61, [(1_000_000, 1.0)]), (62, None), (63, [])]
    return spark.createDataFrame([*own, (None, VECTORS[80])], f"query_id int, terms {KIND}")


@pytest.fixture(scope="module")
def index(spark, rows):
    return build_term_index(rows, shared_path(spark, "terms"))


@pytest.mark.parametrize("k", [1, 5, 150, 2000])
def test_finds_what_the_scan_finds(rows, index, asked, k, monkeypatch):
    want = key(nearest_terms(rows, asked, k))
    assert want and key(best_in_term_index(index, asked, k)) == want
    monkeypatch.setattr(term_index, "FIRST_POSTINGS", 20)
    assert key(best_in_term_index(index, asked, k)) == want


@pytest.mark.parametrize("chosen", ["true", "false"])
def test_both_ways_to_score_agree(rows, index, asked, chosen, monkeypatch):
    monkeypatch.setattr(term_index, "FIRST_POSTINGS", 20)
    monkeypatch.setattr(term_index, "MAX_SENT_LEVELS", 0 if chosen == "true" else 1000)
    monkeypatch.setattr(term_index, "_read_on", lambda index, plan, able: plan.select("ask").distinct().filter(chosen))
    assert key(best_in_term_index(index, asked, 5)) == key(nearest_terms(rows, asked, 5))


def test_levels_are_cut_into_blocks_of_segments(spark, rows, asked, monkeypatch):
    monkeypatch.setattr(term_index, "SEGMENT_ROWS", 16)
    path = shared_path(spark, "terms")
    build_term_index(rows, path)
    index = open_term_index(spark, path)
    largest, total = index.blocks.agg(F.max(F.size("postings")), F.sum(F.size("postings"))).first()
    assert largest < 60
    assert total == index.levels.agg(F.sum("postings")).first()[0] == rows.select(F.inline("terms")).filter("weight > 0").count()
    assert key(best_in_term_index(index, asked, 5)) == key(nearest_terms(rows, asked, 5))


def test_light_postings_of_common_buckets_are_not_read(spark, index, rows, monkeypatch):
    monkeypatch.setattr(term_index, "FIRST_POSTINGS", 50)
    rare = [(n, [(0, 0.1), (VECTORS[n][-1][0], 0.995)]) for n in (10, 11, 12) if len(VECTORS[n]) > 1]
    asked = spark.createDataFrame(rare, f"query_id int, terms {KIND}")
    shares = read_share(index, asked, 1).collect()
    assert len(shares) == len(rare) > 0
    assert all(r.levels_read < r.levels and r.postings_read < 0.5 * r.postings for r in shares)
    assert key(best_in_term_index(index, asked, 1)) == key(nearest_terms(rows, asked, 1))


def test_empty_tables_and_weights_below_zero(spark, index, asked):
    none = spark.createDataFrame([], f"doc_id bigint, terms {KIND}")
    assert best_in_term_index(build_term_index(none, shared_path(spark, "terms")), asked, 3).count() == 0
    assert best_in_term_index(index, asked.filter("false"), 3).count() == 0
    negative = spark.createDataFrame([(1, [(1, -0.5), (2, 0.5)])], f"doc_id bigint, terms {KIND}")
    with pytest.raises(Exception, match="below zero"):
        build_term_index(negative, shared_path(spark, "terms"))
