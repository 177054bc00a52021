import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docsift.llm.exact_dedup import exact_duplicates, frequent_digests, without_duplicates


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[hashlib.sha256(lowered(text).encode()).hexdigest()].append(doc)
    out = []
    for digest, docs in groups.items():
        ordered = sorted(docs, key=lambda d: (d is not None, d or 0))
        out += [(doc, ordered[-1], len(docs), n == len(docs) - 1, digest) for n, doc in enumerate(ordered)]
    return Counter(out)


def rows_of(seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "Abc", "aBC", "ÀB", "àb", "Àb", "K", "K", "İ", "x" * 300_000, "X" * 300_000]
    rows = [(n if n % 3 else None, rng.choice(texts)) for n in range(400)]
    rows += [(5, "Twice"), (5, "tWICE"), (5, "other"), (7, "Twice")] + [(1000 + n, f"own {n}") for n in range(500)]
    rows += [(3000 + n, "Hot") for n in range(400)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_duplicates_match_brute_force(spark, counters):
    rows = rows_of(counters)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "row int, text string, digest int").repartition(7)
    found = exact_duplicates(docs, "row", "text", counters, block_rows=64)
    assert Counter(tuple(r) for r in found.collect()) == brute(rows)
    assert found.columns == ["doc", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("counters", [2, 4096])
def test_whole_rows_that_stay(spark, counters):
    rows = rows_of(9)
    docs = spark.createDataFrame([(d, t, n) for n, (d, t) in enumerate(rows)], "doc int, text string, digest int").repartition(5)
    left = without_duplicates(docs, "doc", "text", counters, block_rows=64)
    assert left.columns == docs.columns
    kept = Counter((d, hashlib.sha256(lowered(t).encode()).hexdigest()) for d, t, _ in left.collect())
    assert kept == Counter((d, digest) for (d, _, _, stays, digest), n in brute(rows).items() if stays for _ in range(n))
    assert {tuple(r) for r in left.collect()} <= {tuple(r) for r in docs.collect()}


@pytest.mark.parametrize("counters,block_rows,fan_in", [(1, 10, 2), (5, 50, 3), (20, 7, 16), (50, 10_000, 16)])
def test_summary_has_every_frequent_digest_and_few_others(spark, counters, block_rows, fan_in):
    rng = random.Random(counters)
    values = [b"%d" % int(rng.paretovariate(0.6)) for _ in range(3000)]
    rows = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "digest binary, row long").repartition(6)
    found = {bytes(r.digest) for r in frequent_digests(rows, len(values), counters, block_rows, fan_in).collect()}
    assert {v for v, n in Counter(values).items() if n > len(values) / (counters + 1)} <= found
    assert len(found) <= counters


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc long, text string")
    assert exact_duplicates(empty, "doc", "text").count() == 0
    assert without_duplicates(empty, "doc", "text").count() == 0


def test_no_python_on_the_path(spark):
    docs = spark.range(100).select("id", F.lit("x").alias("text"))
    plan = exact_duplicates(docs, "id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
