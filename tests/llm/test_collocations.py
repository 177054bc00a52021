import random
import re
from collections import Counter

import numpy as np
import pytest

from docsift.llm import collocations as module
from docsift.llm.collocations import collocations, frequent_phrases
from docsift.llm.quotient_filter import counted, decoded, encoded, merged, permuted, shards, unpermuted


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, most, first):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, most + 1) for i in range(len(words) - n + 1))
    frequent = {k: f for k, f in counts.items() if f >= least}
    found = {}
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        longer = (w for (other, w), f in frequent.items() if other == lang and len(w) > len(words) and f >= a)
        if any(words == w[i : i + len(words)] for w in longer for i in range(len(w) - len(words) + 1)):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = frequent[lang, words[:k]], frequent[lang, words[k:]]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, own in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(own)[:first], 1)
    )


def got(found):
    return sorted(tuple(r) for r in found.collect())


def texts(seed, docs):
    rng = random.Random(seed)
    words = "the The of an\x0b é ñu 日本 x-y a\x1cb ... , ; q1 Q1 z   z z".split(" ")
    rows = [(rng.choice(["en", None, "und", "", "x y"]), " \t".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(docs)]
    rows += [("en", "deep sea creature lives here! ") ] * 7 + [("de", None), (None, ""), (None, None), ("fr", " .,;\n")]
    return rows + [("long", "only one piece of words " * 3000)]


@pytest.mark.parametrize("limits", [(4, 5, 50), (1, 2, 1000)])
def test_collocations_match_brute_force(spark, limits):
    least, most, first = limits
    rows = texts(least, 120)
    docs = spark.createDataFrame([(lang, text, n) for n, (lang, text) in enumerate(rows)], "lang string, text string, phrase int").repartition(5)
    found = collocations(docs, "text", "lang", least, most, first, block_words=200, shard_bytes=3000)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(found) == brute(rows, least, most, first)


def test_blocks_and_shards_do_not_change_the_counts(spark):
    docs = spark.createDataFrame(texts(9, 60), "lang string, text string").repartition(3)
    counts = [
        sorted(tuple(r) for r in frequent_phrases(docs, "text", "lang", 5, 4, block, shard)[0].collect())
        for block, shard in ((10, 300), (1_000_000, 10_000_000))
    ]
    assert counts[0] == counts[1] and max(row[1] for row in counts[0]) == 4


def test_no_documents_no_collocations(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty, "text", "lang").count() == 0
    assert collocations(spark.createDataFrame([(None, None)], "lang string, text string"), "text", "lang").count() == 0


def test_scores_pass_64_bits(spark):
    from docsift.llm.collocations import _scored

    big = 3_000_000_000_000
    rows = [("en", 1, "a", big, 9 * big), ("en", 1, "b", big + 1, 9 * big), ("en", 2, "a b", big - 1, 9 * big)]
    row = _scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f long, n long")).head()
    assert row.score == 1000 * (big - 1) * 9 * big // (big * (big + 1))


def test_filters_lose_nothing():
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.integers(0, 1 << 63, 3000), rng.integers(0, 50, 20_000), [0, (1 << 63) - 1]])
    assert (unpermuted(permuted(keys)).astype(np.int64) == keys).all()
    halves = [counted(keys[:9000]), counted(keys[9000:])]
    for bits in (0, 1, 5):
        whole = []
        for shard in range(1 << bits):
            parts = []
            for found, counts in halves:
                begin, end = shards(found, bits)[shard : shard + 2]
                data = encoded(found[begin:end], counts[begin:end], bits)
                parts.append(decoded(data, shard, bits))
                assert (parts[-1][0] == found[begin:end]).all() and (parts[-1][1] == counts[begin:end]).all()
            whole.append(merged(parts))
        found, counts = (np.concatenate(column) for column in zip(*whole, strict=True))
        assert dict(zip(unpermuted(found).tolist(), counts.tolist(), strict=True)) == Counter(keys.tolist())


def test_filters_are_compact():
    found, counts = counted(np.random.default_rng(2).integers(0, 1 << 63, 100_000))
    assert len(encoded(found, counts, 0)) < 8 * len(found)


def test_lookups_of_phrases_read_stored_rows(spark, monkeypatch):
    # the rows of the second lookup were a plan of the first one, four times over
    plans, inner = [], module.looked_up

    def seen(rows, keys, table):
        if keys in (["first"], ["last"]):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return inner(rows, keys, table)

    monkeypatch.setattr(module, "looked_up", seen)
    docs = spark.createDataFrame([("en", "a b c a b c " * 5)], "lang string, text string")
    assert module.frequent_phrases(docs, "text", "lang", min_count=2, most_words=3)[0].count() > 0
    assert len(plans) == 4 and not any("Join" in plan or "Generate" in plan for plan in plans)
