import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docsift.llm import ranked_search as module
from docsift.llm.ranked_search import Block, ranked_search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    own = [(doc, Counter(terms(text))) for doc, text in docs]
    own = [(doc, tf, sum(tf.values())) for doc, tf in own if tf]
    total, occurrences = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, tf, _ in own for t in tf)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, tf, n in own:
            m = 100 - 25 + 25 * n * total // occurrences
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                for t in terms(text) if tf[t]
            )
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["É", "é", "日本", "Ab", "aB", "x_y", "a\x7fb", "\x80"]
    docs = [(n if n % 11 else None, " ".join(rng.choices(vocabulary, k=rng.randint(0, 50)))) for n in range(300)]
    docs += [(7, "w1 w2"), (7, "w1 w2"), (8, None), (9, ""), (10, ".,;"), (11, "w1 " * 20_000), (12, "rare W1")]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for n in range(15)]
    items += [(20, None), (None, "w1 rare"), (21, "w1 w1 w2"), (21, "w1 w1 w2"), (21, "w3"), (22, "nowhere")]
    return docs, items


@pytest.mark.parametrize("k,block,query_bytes", [(20, 1 << 14, 10**6), (3, 16, 10**6), (5, 40, 60)])
def test_search_matches_brute_force(spark, monkeypatch, k, block, query_bytes):
    monkeypatch.setattr(module, "BLOCK_DOCS", block)
    docs, items = corpus(k)
    table = spark.createDataFrame([(d, t, 1) for d, t in docs], "score long, text string, docs int").repartition(5)
    asks = spark.createDataFrame([(i, t, 1) for i, t in items], "item long, text string, query int")
    found = ranked_search(table, "score", "text", asks, "item", "text", k, query_bytes)
    assert found.columns == ["item", "rank", "doc", "score"]
    rows = sorted((tuple(r) for r in found.collect()), key=str)
    wanted = brute(docs, items, k)
    # two queries of one id are ranked apart
    assert rows == wanted


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc string, text string")
    asks = spark.createDataFrame([("q", "x")], "item string, text string")
    assert [r.doc for r in ranked_search(docs, "doc", "text", asks, "item", "text").orderBy("rank").collect()] == [None, "a", "b"]


def test_empty_tables(spark):
    docs, asks = spark.createDataFrame([], "doc long, text string"), spark.createDataFrame([], "item long, text string")
    some = spark.createDataFrame([(1, "x")], "doc long, text string")
    for own, queries in ((docs, asks), (some, asks), (docs, some.withColumnRenamed("doc", "item"))):
        assert ranked_search(own, "doc", "text", queries, "item", "text").count() == 0


def test_accumulators_stay_few_and_scores_exact():
    rng = np.random.default_rng(3)
    docs, parts = 20_000, []
    for n, size in enumerate((30, 50, 9_000, 15_000, 19_000)):
        places = np.sort(rng.choice(docs, size, replace=False))
        parts.append((n, size, places, rng.integers(1, 4, size)))
    block = Block(
        rng.integers(50, 60, docs), np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.concatenate([p[2] for p in parts]),
        np.concatenate([p[3] for p in parts]), docs, docs * 55,
    )
    weights = np.array([9000, 8000, 700, 200, 40])
    best, scores = block.search(np.arange(5), weights, 20, 1)
    assert block.made < 200 and block.updated < 500
    all_scores = np.zeros(docs, np.int64)
    for n in range(5):
        own = slice(block.starts[n], block.starts[n + 1])
        np.add.at(all_scores, block.places[own], weights[n] * block.impacts[own])
    wanted = np.lexsort((np.arange(docs), -all_scores))[:20]
    assert best.tolist() == wanted.tolist() and scores.tolist() == all_scores[wanted].tolist()


def test_terms():
    assert terms_of("Ab_cÉ-9\x7fx".encode()) == [b"ab", "cÉ".encode(), b"9", b"x"] and terms_of(None) == []
